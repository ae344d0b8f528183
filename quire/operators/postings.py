"""A stored inverted index of whole texts with the places of their words, phrases looked up by places, and retrieval by a question's type over it."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Folders that terms are spread over by their hash; a lookup reads those of its terms only.
BUCKETS = 64
#: Words after which a segment ends, with the text that is being read; distinct phrases that one pass looks up, about.
SEGMENT, PHRASES = 1 << 19, 100_000
COLUMNS = ["term", "segment", "places", "start", "kind", "id"]

#: For each type of question, the kinds of context it reads, how many rows an entity gives, how many there are in all, how many entities count (0: all), and the confidence of the whole.
ROUTES = (
    ("LOCATION", "place", 3, 5, 0, 0.8),
    ("LOCATION", "note", 2, 5, 0, 0.8),
    ("PERSON", "lexicon", 3, 8, 0, 0.85),
    ("PERSON", "note", 2, 5, 0, 0.85),
    ("CONCEPTUAL", "note", 2, 5, 0, 0.75),
    ("CONCEPTUAL", "lexicon", 2, 8, 0, 0.75),
    ("HISTORICAL", "note", 2, 5, 0, 0.82),
    ("HISTORICAL", "place", 2, 5, 0, 0.82),
    ("TEXTUAL", "lexicon", 4, 8, 0, 0.8),
    ("GENERAL", "note", 1, 2, 3, 0.65),
)
#: The least similarity of a passage by type, that of the other types, and passages at the most.
LEAST_SIMILAR, OTHERWISE, PASSAGES = {"CONCEPTUAL": 0.6, "GENERAL": 0.6}, 0.7, 10


def terms(text: Column) -> Column:
    """Words of letters and digits in lower case, in order, repeats included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def packed(places: np.ndarray) -> bytes:
    """Ascending numbers as their differences, in as many bytes each as the largest needs."""
    steps = np.diff(places, prepend=0)
    most = steps.max()
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + steps.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).cumsum(dtype=np.int64)


def segments(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Texts (kind, id, said: words between single spaces) of a task as segments of whole texts, of SEGMENT words and the last text's: a row for each term with its places in the segment, and one for each text (term null) with its first place. A place is left free after each text."""
    part, nth = TaskContext.get().partitionId(), 0
    known: dict[str, int] = {}
    codes, at, starts, sizes, kinds, ids = array("i"), 0, [], [], [], []

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal nth, at
        number = (part << 32) + nth
        all_codes, lengths = np.frombuffer(codes, np.int32), np.array(sizes)
        places = np.arange(len(all_codes)) + np.repeat(np.arange(len(sizes)), lengths)
        order = np.argsort(all_codes, kind="stable")
        ends = np.cumsum(np.bincount(all_codes, minlength=len(known)))
        places, names = places[order], list(known)
        for low in range(0, len(names), 50_000):
            some = range(low, min(low + 50_000, len(names)))
            lists = [packed(places[ends[i - 1] if i else 0 : ends[i]]) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(names[low : low + 50_000], pa.string()), pa.array([number] * len(some), pa.int64()), pa.array(lists, pa.binary()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.string()), pa.nulls(len(some), id_type)], names=COLUMNS)
        n = len(starts)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.array([number] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(starts, pa.int32()), pa.array(kinds, pa.string()), pa.array(ids, id_type)], names=COLUMNS)
        nth, at = nth + 1, 0

    for batch in batches:
        for kind, own, said in zip(batch["kind"], batch["id"], batch["said"], strict=True):
            words = said.as_py().split(" ")
            codes.extend([known.setdefault(w, len(known)) for w in words])
            starts.append(at)
            sizes.append(len(words))
            kinds.append(kind.as_py())
            ids.append(own.as_py())
            at += len(words) + 1
            if len(codes) >= SEGMENT:
                yield from closed()
                known, codes, starts, sizes, kinds, ids = {}, array("i"), [], [], [], []
    if starts:
        yield from closed()


@dataclass
class Trie:
    """Phrases as ways through numbered terms: node 0 is the root, an edge is node * len(terms) + term, edges ascend."""

    phrases: list[str]
    terms: dict[str, int]
    edges: np.ndarray
    targets: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(phrases: Sequence[str]) -> Trie:
        terms: dict[str, int] = {}
        numbers = [[terms.setdefault(w, len(terms)) for w in p.split(" ")] for p in phrases]
        made: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, way in enumerate(numbers):
            node = 0
            for x in way:
                node = made.setdefault(node * len(terms) + x, len(made) + 1)
            ends[node] = i
        edges = np.array(sorted(made), np.int64)
        last = np.full(len(made) + 1, -1, np.int64)
        last[list(ends)] = list(ends.values())
        return Trie(list(phrases), terms, edges, np.array([made[e] for e in edges.tolist()], np.int64), last)

    def step(self, nodes: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The nodes that terms lead to; -1 where there is none."""
        wanted = nodes * len(self.terms) + terms
        found = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
        return np.where(self.edges[found] == wanted, self.targets[found], -1)

    def found(self, places: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, where it begins) for terms at ascending places: all beginnings go on together, word by word, so the time is that of the places whatever the number of phrases."""
        at, nodes, length = np.arange(len(places)), self.step(np.zeros(len(places), np.int64), terms), 1
        out = []
        while True:
            kept = nodes >= 0
            at, nodes = at[kept], nodes[kept]
            whole = self.ends[nodes] >= 0
            out.append((self.ends[nodes[whole]], places[at[whole]]))
            more = at + length < len(places)
            at, nodes = at[more], nodes[more]
            more = places[at + length] == places[at] + length
            at, nodes = at[more], nodes[more]
            if not len(at):
                return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
            nodes = self.step(nodes, terms[at + length])
            length += 1


@dataclass
class TextIndex:
    """The index below `path`: for each segment of texts a row a term (bucket, term, segment, places) and a row a text (bucket -1, segment, start, kind, id)."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(texts: DataFrame, path: str) -> TextIndex:
        """Indexes all words of texts (kind, id, text); rows without kind, id or text are in no list, other columns aren't kept.

        A task numbers the words of its texts through and packs a term's places, so what is shuffled and stored is a few bytes a word. A folder is written in as many parts as the session's shuffle partitions leave for each, segments being told to parts by their hash, so a term that stands in every text is no single task's.
        """
        said = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
        rows = texts.filter("kind IS NOT NULL AND id IS NOT NULL AND text IS NOT NULL").select("kind", "id", said.alias("said")).filter("said <> ''")
        spark, kind = texts.sparkSession, texts.schema["id"].dataType
        id_type = to_arrow_type(kind)
        made = rows.mapInArrow(lambda batches: segments(batches, id_type), f"term string, segment long, places binary, start int, kind string, id {kind.simpleString()}")
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        placed = made.withColumn("bucket", F.coalesce(F.when(F.col("term").isNotNull(), _bucket(F.col("term"))), F.lit(-1))).repartition("bucket", F.pmod(F.xxhash64("segment"), F.lit(parts)))
        placed.sortWithinPartitions("bucket", "term", "segment").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        return TextIndex(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path).withColumn("bucket", F.col("bucket").cast("int"))

    def holding(self, phrases: DataFrame) -> DataFrame:
        """(phrase, kind, id), once each: the texts that hold a phrase's words next to each other in their order. Phrases that are null or have no word are held by nothing.

        PHRASES at a time are looked up in one pass over the lists of their terms; a segment's lists meet in one place, where its terms, ascending by place, run through a trie of the phrases.
        """
        asked = phrases.select("phrase").distinct().withColumn("_key", F.array_join(terms(F.col("phrase")), " ")).filter("_key <> ''")
        keys = asked.select("_key").distinct()
        blocks = max(1, -(-keys.count() // PHRASES))
        found = [self._pass(keys.filter(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b)) for b in range(blocks)]
        return reduce(DataFrame.unionByName, found).join(asked, "_key").select("phrase", "kind", "id").distinct()

    def _pass(self, keys: DataFrame) -> DataFrame:
        trie = Trie.of(sorted(r["_key"] for r in keys.collect()))
        stored = self.rows()
        schema = f"_key string, kind string, id {stored.schema['id'].dataType.simpleString()}"
        if not trie.phrases:
            return self.spark.createDataFrame([], schema)
        shared = self.spark.sparkContext.broadcast(trie)

        def met(rows: pa.Table) -> pa.Table:
            known, texts = shared.value, rows.filter(pc.is_null(rows["term"])).sort_by("start")
            lists = rows.filter(pc.is_valid(rows["term"]))
            names = [known.terms[x] for x in lists["term"].to_pylist()]
            places = [unpacked(x) for x in lists["places"].to_pylist()]
            at = np.concatenate([np.zeros(0, np.int64), *places])
            order = np.argsort(at)
            phrase, start = known.found(at[order], np.repeat(np.array(names, np.int64), [len(x) for x in places])[order]) if len(at) else (at, at)
            text = np.searchsorted(texts["start"].to_numpy(), start, side="right") - 1
            pairs = np.unique(phrase * max(1, len(texts)) + text)
            phrase, text = pairs // max(1, len(texts)), pairs % max(1, len(texts))
            held = texts.take(pa.array(text))
            return pa.table({"_key": pa.array(np.array(known.phrases, object)[phrase], pa.string()), "kind": held["kind"], "id": held["id"]})

        wanted = keys.select(F.explode(F.split("_key", " ")).alias("term")).distinct().withColumn("bucket", _bucket(F.col("term")))
        lists = stored.join(F.broadcast(wanted), ["bucket", "term"], "left_semi")
        both = lists.unionByName(stored.filter("bucket = -1")).select("segment", "term", "places", "start", "kind", "id")
        return both.groupBy("segment").applyInArrow(met, schema)


def _first(df: DataFrame, group: list[str], order: list[Column], most: Column | int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("position") <= most)


def typed_retrieval(index: TextIndex, questions: DataFrame, entities: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """(question, kind, id, position, confidence): context of questions (question, type) by their entities (question, nth from 0, phrase), as ROUTES says.

    Of each kind an entity gives its first texts by id, each text once, at the entity that comes first; then entities in order, up to the kind's limit. passages (question, id, similarity) come as kind "passage", the most similar first, if they reach their type's least similarity. Null or unknown questions and types find nothing; each question has one type.
    """
    spark = questions.sparkSession
    routes = F.broadcast(spark.createDataFrame(list(ROUTES), "type string, kind string, each int, most int, counted int, confidence double"))
    most_each = max(route[2] for route in ROUTES)
    texts = _first(index.holding(entities), ["phrase", "kind"], [F.col("id")], most_each).withColumnRenamed("position", "rank")  # no more than that goes on, however many texts hold a phrase
    asked = questions.select("question", "type").join(entities.select("question", "nth", "phrase"), "question").join(routes, "type").filter("counted = 0 OR nth < counted")
    found = asked.join(texts, ["phrase", "kind"]).filter("rank <= each").groupBy("question", "kind", "id", "most", "confidence").agg(F.min("nth").alias("nth"))
    out = _first(found, ["question", "kind"], [F.col("nth"), F.col("id")], F.col("most")).select("question", "kind", "id", "position", "confidence")
    if passages is None:
        return out
    sure = spark.createDataFrame([(r[0], r[5], LEAST_SIMILAR.get(r[0], OTHERWISE)) for r in ROUTES], "type string, confidence double, least double").distinct()
    near = questions.select("question", "type").join(F.broadcast(sure), "type").join(passages.select("question", "id", "similarity"), "question").filter("similarity >= least")
    best = _first(near, ["question"], [F.col("similarity").desc(), F.col("id")], PASSAGES)
    return out.unionByName(best.select("question", F.lit("passage").alias("kind"), "id", "position", "confidence"))
