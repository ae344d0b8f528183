"""Near-duplicate vectors through an inverted multi-index.

Each half of a unit vector has a codebook of its own; a pair of codes is a cell of the product grid. A vector lives in its nearest cell and visits the nearest ones in the order of the multi-sequence traversal, as many as the target recall takes; whom it meets there is verified by cosine in double precision. Cells of one first code and label are compared in one task, in blocks; links are counted there, and only enough of them to connect what is linked leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, joined_by_hot_key
from quire.llm.components import connected_components, spanning_links

#: Vectors that the codebooks are fitted on, at the most; codes a half, at the least; vectors of a cell, about; sampled vectors of a code, at the least.
SAMPLE, LEAST_CODES, IN_CELL, IN_CODE = 20_000, 4, 50, 8
#: Share of pairs at the threshold that visits must meet on the sample; cells that are visited at the least, as a small sample tells little; cells that are tried first.
RECALL, LEAST_CELLS, FIRST_CELLS = 0.995, 16, 64
#: Members of a block.
BLOCK = 4096


def fit_codes(data: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means; an empty code stays where it is."""
    rng = np.random.default_rng(seed)
    centres = data[rng.permutation(len(data))[:k]].copy()
    for _ in range(rounds):
        near = distances(data, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        sizes = np.bincount(near, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def distances(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((data * data).sum(axis=1)[:, None] - 2 * data @ centres.T + (centres * centres).sum(axis=1)[None], 0)


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1):
        self.first, self.second, self.visits = first, second, visits

    def cells(self, data: np.ndarray, visits: int | None = None) -> np.ndarray:
        """Nearest cells of each vector, a bounded number of vectors at a time."""
        most = min(visits or self.visits, len(self.first) * len(self.second))
        step = max(1, (1 << 22) // (most * (1 + most.bit_length())))
        return np.concatenate([self.traverse(data[s : s + step], most) for s in range(0, len(data), step)]) if len(data) else np.zeros((0, most), int)

    def traverse(self, data: np.ndarray, most: int) -> np.ndarray:
        """The nearest cells of each vector in the order in which a multi-sequence traversal pops them: by the sum of the two halves' distances. Of pairs of ranks (i, j) only those with (i + 1)(j + 1) <= visits can be among the first, as all smaller pairs come before."""
        half = self.first.shape[1]
        a, b = distances(data[:, :half], self.first), distances(data[:, half:], self.second)
        ra, rb = np.argsort(a, axis=1, kind="stable")[:, :most], np.argsort(b, axis=1, kind="stable")[:, :most]
        da, db = np.take_along_axis(a, ra, 1), np.take_along_axis(b, rb, 1)
        pairs = np.array([(i, j) for i in range(ra.shape[1]) for j in range(min(rb.shape[1], most // (i + 1)))])
        sums = da[:, pairs[:, 0]] + db[:, pairs[:, 1]]
        first = np.argsort(sums, axis=1, kind="stable")[:, :most]
        i, j = pairs[first, 0], pairs[first, 1]
        return np.take_along_axis(ra, i, 1) * len(self.second) + np.take_along_axis(rb, j, 1)


def fit(sample: np.ndarray, n: int, threshold: float) -> Grid:
    """Codebooks for n vectors, and the fewest visits that meet the target recall for partners set at exactly the threshold from sampled vectors, in random directions: the hardest links there are. Visits grow until the recall holds, to all cells if need be, which compares all with all. Codes grow with the root of n as far as the sample can tell them apart."""
    k = int(np.clip(round((n / IN_CELL) ** 0.5), LEAST_CODES, max(LEAST_CODES, len(sample) // IN_CODE)))
    half = (sample.shape[1] + 1) // 2
    grid = Grid(fit_codes(sample[:, :half], min(k, len(sample))), fit_codes(sample[:, half:], min(k, len(sample)), seed=6))
    rng = np.random.default_rng(7)
    x = sample[rng.permutation(len(sample))[:2000]]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    y = threshold * x + (1 - threshold * threshold) ** 0.5 * away
    every, tried = len(grid.first) * len(grid.second), FIRST_CELLS
    while True:
        most = min(tried, every)
        cx, cy = grid.cells(x, most), grid.cells(y, most)
        found = lambda cells, home: np.where((cells == home[:, None]).any(axis=1), (cells == home[:, None]).argmax(axis=1), every)  # noqa: B023, E731
        rank = np.sort(np.minimum(found(cx, cy[:, 0]), found(cy, cx[:, 0])))[min(len(x) - 1, int(np.ceil(RECALL * len(x))))]
        if rank < every or most == every:
            grid.visits = int(min(max(rank + 1, LEAST_CELLS), every))
            return grid
        tried *= 4


def unit(column: pd.Series) -> np.ndarray:
    data = np.array(column.tolist(), dtype=np.float64)
    return data / np.sqrt((data * data).sum(axis=1, keepdims=True))


def shaped(data: np.ndarray, size: int) -> np.ndarray:
    """As many components as the codebooks have: only to find cells for vectors of another length."""
    return data[:, :size] if data.shape[1] >= size else np.pad(data, ((0, 0), (0, size - data.shape[1])))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id, n_links (other rows linked directly), component_id (smallest id reachable) and kept.

    Only rows of equal, non-null labels and equal lengths link. Null, empty and zero vectors, and those with null or non-finite components, link with nothing. Equal vectors of a label are compared once and counted as often as they stand; every row is a vector of its own, whatever its id: rows that share an id and differ in their vectors have links of their own, and rows without id link like others, but name no component unless all of it have none. Other columns are ignored; an empty table gives an empty result. All rows are indexed; visits are set for a recall of RECALL.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    good = rows.filter(fine)
    # a kind, the rows of one label and vector, has a number of its own: ids may be repeated or null
    kinds = checkpoint(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("kind", F.monotonically_increasing_id()))
    n = kinds.count()
    alone = lambda some: some.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone(rows)
    u = F.xxhash64("label", "v").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    sampled = kinds.filter(u < min(1.0, SAMPLE / n)).select("v", F.size("v").alias("size")).toPandas()
    if not len(sampled):
        sampled = kinds.select("v", F.size("v").alias("size")).limit(1).toPandas()
    size = int(sampled["size"].mode().iloc[0])
    grid = fit(unit(sampled[sampled["size"] == size]["v"]), n, threshold)
    shared = spark.sparkContext.broadcast(grid)
    width = len(grid.second)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            for _, part in batch.groupby(batch["v"].map(len)):
                cells = own.cells(shaped(unit(part["v"]), size)).astype(np.int32)
                yield part.assign(cells=list(cells))

    label = vectors.schema[label_col].dataType.simpleString()
    vector = vectors.schema[vector_col].dataType.simpleString()
    placed = checkpoint(kinds.drop("rep").mapInPandas(visit, f"label {label}, v {vector}, copies long, kind long, cells array<int>"))
    group = placed.withColumn("size", F.size("v")).withColumn("home", F.element_at("cells", 1))
    code = lambda c: F.floor(c / width).cast("int")
    codes = F.array_distinct(F.transform("cells", code))
    guests = group.withColumn("code", F.explode(codes)).withColumn("lives", code(F.col("home")) == F.col("code"))
    sizes = guests.groupBy("label", "size", "code").agg(F.ceil(F.count_if("lives") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    # members in blocks, visitors in parts, every block against every part in a task of its own
    block, part_of = (F.pmod(F.xxhash64("kind", F.lit(name)), F.col(name)).cast("int") for name in ("blocks", "parts"))
    role = lambda b, p, member: F.struct(b.alias("block"), p.alias("part"), F.lit(member).alias("member"))
    visits = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: role(b, part_of, False))
    lives = F.when(F.col("lives"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: role(block, p, True))).otherwise(F.array().cast("array<struct<block: int, part: int, member: boolean>>"))
    guests = guests.join(sizes.filter("blocks > 0"), ["label", "size", "code"]).withColumn("role", F.explode(F.concat(visits, lives)))
    guests = guests.select("label", "size", "code", "role.*", "v", "kind", "copies", "cells", "home")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        data, ids = unit(part["v"]), part["kind"].to_numpy()
        cells = np.array(part["cells"].tolist(), dtype=np.int32)
        home, copies = part["home"].to_numpy(), part["copies"].to_numpy(np.int64)
        links = np.zeros(len(part), dtype=np.int64)
        tied: list[tuple[np.ndarray, np.ndarray]] = []
        is_member = part["member"].to_numpy(bool)
        members, visitors = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        for cell in np.unique(home[members]):
            own = members[home[members] == cell]
            comers = visitors[(cells[visitors] == cell).any(axis=1)]
            for s in range(0, len(comers), 1024):
                some = comers[s : s + 1024]
                hit = data[some] @ data[own].T >= threshold
                hit &= ids[some][:, None] != ids[own][None, :]
                hot = hit.any(axis=1)
                if not hot.any():
                    continue
                some, hit = some[hot], hit[hot]
                # a member that visits the comer's cell counts the link for itself there
                returns = np.zeros_like(hit)
                for h in np.unique(home[some]):
                    returns[home[some] == h] = (cells[own] == h).any(axis=1)
                links[some] += (hit * copies[own]).sum(axis=1)
                links[own] += ((hit & ~returns) * copies[some][:, None]).sum(axis=0)
                cols = np.flatnonzero(hit.any(axis=0))
                a, b = spanning_links(some, own[cols], lambda x, y: data[x] @ data[y].T >= threshold)
                tied.append((ids[a], ids[b]))
        counted = np.flatnonzero(links)
        a = np.concatenate([ids[counted], *(t[0] for t in tied)])
        b = np.concatenate([ids[counted], *(t[1] for t in tied)])
        return pd.DataFrame({"a": a, "b": b, "n": np.r_[links[counted], np.zeros(len(a) - len(counted), np.int64)]})

    found = checkpoint(guests.groupBy("label", "size", "code", "block", "part").applyInPandas(compare, "a long, b long, n long"))
    counts = found.filter("a = b").groupBy(F.col("a").alias("kind")).agg(F.sum("n").alias("n"))
    moved = connected_components(found.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "kind")
    joined = checkpoint(kinds.join(counts, "kind", "left").join(moved, "kind", "left").withColumn("component", F.coalesce("component", "kind")))
    names = checkpoint(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("_n")))
    known = joined_by_hot_key(joined, names, "component", "_n")
    known = checkpoint(known.select(F.struct("label", "v").alias("_kind"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"))
    linked = joined_by_hot_key(good.withColumn("_kind", F.struct("label", "v")), known, "_kind", "copies")
    return linked.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone(rows.filter(~fine)))
