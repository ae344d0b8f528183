"""An inverted-file index of vectors: coarse centroids, a list of vectors for each, a few lists probed per query, exact re-ranking within them; written once and reused."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centroids are fitted on, at the most; centroids, at the most; rounds of the fit.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 10
#: Queries that one pass answers; more of them take more passes, each over the lists that it probes.
QUERIES = 5_000
#: Queries by which the number of probes is set.
TUNED_ON = 200
#: Parts in which a list is written, so that one list of very many vectors is no single task's.
PARTS = 4
#: Rows that a task scores at a time.
ROWS = 2048


def normal(vectors: pd.Series) -> np.ndarray:
    data = np.array(vectors.tolist(), dtype=np.float64)
    return data / np.sqrt((data * data).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Vectors that have a direction: not null, not zero, all components finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means; a centroid without vectors stays where it is."""
    centres = sample[np.random.default_rng(3).permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def _foremost(who: np.ndarray, row: np.ndarray, cos: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, ties by row."""
    order = np.lexsort((row, -cos, who))
    who = who[order]
    start = np.r_[0, np.flatnonzero(np.diff(who)) + 1]
    nth = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
    order = order[nth < k]
    return who[nth < k], row[order], cos[order], place[order]


@dataclass
class VectorIndex:
    """The index below `path`: lists of (key, vector), centroids, and how many lists a query probes unless told."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    key: str
    vector: str
    probes: int

    @staticmethod
    def build(vectors: DataFrame, path: str, key: str, vector: str, lists: int | None = None, recall: float = 0.9, k: int = 10) -> VectorIndex:
        """Indexes every usable row; others are in no list, as they are similar to nothing. lists: the root of the number of rows by default. probes are the fewest that find `recall` of the true k nearest of sampled rows; extra columns are not kept. Vectors must be of one length."""
        spark = vectors.sparkSession
        rows = vectors.select(key, vector).filter(usable(F.col(vector)))
        n = rows.count()
        share = F.xxhash64(key, vector).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
        sample = normal(rows.filter(share < SAMPLE / max(n, 1)).limit(2 * SAMPLE).select(vector).toPandas()[vector]) if n else np.zeros((0, 1))
        centroids = fit(sample, max(1, min(lists or round(n**0.5), MOST_LISTS, len(sample)))) if len(sample) else sample
        shared = spark.sparkContext.broadcast(centroids)

        @F.pandas_udf("int")
        def nearest(vs: pd.Series) -> pd.Series:
            return pd.Series((normal(vs) @ shared.value.T).argmax(axis=1))

        placed = rows.withColumn("list", nearest(vector)).repartition("list", F.pmod(F.xxhash64(key, vector), F.lit(PARTS)))
        placed.write.partitionBy("list").parquet(f"{path}/lists")
        index = VectorIndex(spark, path, centroids, key, vector, max(1, len(centroids)))
        if len(sample):
            index.probes = index.probes_for(rows.filter(share < TUNED_ON / n).limit(TUNED_ON), recall, k)
        facts = json.dumps({"centroids": centroids.tolist(), "key": key, "vector": vector, "probes": index.probes})
        spark.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{path}/facts")
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        facts = json.loads(spark.read.text(f"{path}/facts", wholetext=True).first()[0])
        return VectorIndex(spark, path, np.array(facts["centroids"]), facts["key"], facts["vector"], facts["probes"])

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def probes_for(self, queries: DataFrame, recall: float, k: int) -> int:
        """The fewest probes that find `recall` of the true k nearest: in one search of all lists, the places at which the lists of the true ones stand in each query's order."""
        found = self._search(queries, k, len(self.centroids)).toPandas()
        places = np.sort(found["place"].to_numpy())
        return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else len(self.centroids)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query, key, similarity, position) of each query's k most similar rows of the lists probed, ties by key; similarity is the cosine, rounded to six places. queries: the key and vector columns of the index; those without a direction find nothing, keys should differ. A row finds itself if it is indexed."""
        found = self._search(queries, k, min(probes or self.probes, max(1, len(self.centroids))))
        return found.select("query", self.key, "similarity", "position")

    def _search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        asked = queries.select(F.col(self.key).alias("query"), F.col(self.vector).alias("v")).filter(usable(F.col("v")))
        n = asked.count()
        blocks = max(1, -(-n // QUERIES))
        block = F.pmod(F.xxhash64("query", "v"), F.lit(blocks))
        parts = [self._pass((asked.filter(block == b) if blocks > 1 else asked).toPandas(), k, probes, asked) for b in range(blocks)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), self.key)
        return out.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)

    def _pass(self, asked: pd.DataFrame, k: int, probes: int, like: DataFrame) -> DataFrame:
        """Scored rows of one block of queries; each task hands on its k best for each query."""
        kind = like.schema["query"].dataType.simpleString()
        if not len(asked) or not len(self.centroids):
            return self.rows().limit(0).select(F.lit(None).cast(kind).alias("query"), self.key, F.lit(0.0).alias("similarity"), F.lit(0).alias("place")) if len(self.centroids) else self.spark.createDataFrame([], f"query {kind}, {self.key} {kind}, similarity double, place int")
        q = normal(asked["v"])
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]
        places = np.full((len(self.centroids), len(q)), -1, np.int16)  # by list: the place in each query's order, -1 if it isn't probed
        places[order, np.arange(len(q))[:, None]] = np.arange(order.shape[1])
        shared = self.spark.sparkContext.broadcast((q, places))
        key, n = self.key, len(q)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The k best of each query among a task's rows, ties by key: what is held grows with the queries of a pass, not with rows or lists."""
            mine, probed = shared.value
            held: pa.Table | None = None
            for batch in batches:
                for low in range(0, len(batch), ROWS):
                    some = batch.slice(low, ROWS)
                    some = some.take(pc.sort_indices(some[0]))
                    data, at = normal(some[1].to_pandas()), some[2].to_numpy(zero_copy_only=False)
                    fresh: list[tuple[np.ndarray, ...]] = []
                    for one in np.unique(at):
                        rows = np.flatnonzero(at == one)
                        who = np.flatnonzero(probed[one] >= 0)
                        for s in range(0, len(who), 512):
                            cos = np.round(mine[who[s : s + 512]] @ data[rows].T, 6)
                            first = np.argsort(-cos, axis=1, kind="stable")[:, :k]  # rows ascend by key
                            w = np.repeat(who[s : s + 512], first.shape[1])
                            fresh.append((w, rows[first.ravel()], np.take_along_axis(cos, first, 1).ravel(), probed[one][w]))
                            if sum(len(x[0]) for x in fresh) > 20 * k * n:
                                fresh = [_foremost(*map(np.concatenate, zip(*fresh, strict=True)), k)]
                    if fresh:
                        w, r, cos, place = _foremost(*map(np.concatenate, zip(*fresh, strict=True)), k)
                        new = pa.table({"nth": pa.array(w, pa.int32()), key: some[0].take(pa.array(r)), "similarity": pa.array(cos, pa.float64()), "place": pa.array(place, pa.int32())})
                        every = new if held is None else pa.concat_tables([held, new])
                        every = every.take(pc.sort_indices(every, sort_keys=[(key, "ascending")]))
                        w, r, _, _ = _foremost(every["nth"].to_numpy(), np.arange(len(every)), every["similarity"].to_numpy(), every["place"].to_numpy(), k)
                        held = every.take(pa.array(r)).combine_chunks()
            if held is not None:
                yield from held.to_batches(10_000)

        probed = self.rows().filter(F.col("list").isin([int(x) for x in np.unique(order)]))
        name = self.rows().schema[self.key].dataType.simpleString()
        hits = probed.select(self.key, self.vector, "list").mapInArrow(best, f"nth int, `{self.key}` {name}, similarity double, place int")
        names = self.spark.createDataFrame([(i, x) for i, x in enumerate(asked["query"].tolist())], f"nth int, query {kind}")
        return hits.join(F.broadcast(names), "nth").select("query", self.key, "similarity", "place")
