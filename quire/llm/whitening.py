"""Whitening of embeddings by their polarised covariance.

Components become whole numbers, so all sums are exact whatever the order of rows. The rows give sums of squares only, of every centred dimension and of the sum of every two: (a + b)^2 - a^2 - b^2 = 2ab, so differences of those variances are the cross-covariances. The table of sums has d (d + 1) / 2 rows, whatever the number of vectors; it alone reaches the driver, which assembles the matrix and decomposes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are squared at once; bits of a limb in which sums leave their task, and how many limbs there are.
BLOCK, BITS, LIMBS = 2048, 40, 5
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32


def whole_numbers(vectors: pd.Series) -> np.ndarray:
    """floor(64 c) + 1000000 of every component, as long; beyond that type's range a component counts as its end, less the shift."""
    scaled = np.floor(np.array(vectors.tolist(), dtype=np.float64) * SCALE)
    top = np.iinfo(np.int64).max
    inside = np.abs(scaled) < 2.0**62
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), np.where(scaled > 0, top - SHIFT, -top)) + SHIFT


def centred(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """x less the whole part of the mean: in 64 bits where squares of pairs summed over a block fit, else in Python's integers."""
    low, high = x.min(axis=0), x.max(axis=0)
    reach = max((abs(int(v) - int(m)) for side in (low, high) for v, m in zip(side, middle, strict=True)), default=0)
    if 4 * reach * reach * BLOCK < 1 << 62:
        return x - middle
    return x.astype(object) - middle.astype(object)


def pair_squares(y: np.ndarray) -> list[int]:
    """Sums over the rows of y_i^2, then of (y_i + y_j)^2, j > i, for each i in turn."""
    found: list[int] = []
    for i in range(y.shape[1]):
        both = y[:, i:] + y[:, i : i + 1]
        both[:, 0] = y[:, i]
        found.extend(int(v) for v in (both * both).sum(axis=0))
    return found


def limbs(value: int) -> list[int]:
    """value = sum of limb k times 2^(BITS k); all but the last are not negative."""
    low = [(value >> (BITS * k)) & ((1 << BITS) - 1) for k in range(LIMBS - 1)]
    return [*low, value >> (BITS * (LIMBS - 1))]


def exact_sums(rows: DataFrame, size: int, of) -> list[int]:
    """Sums over all rows of what `of` gives for a block of whole-number vectors (always equally many integers): one row per sum and task, added up by Spark limb by limb."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list[int] | None = None
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                found = of(whole_numbers(batch["v"].iloc[at : at + BLOCK]))
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            yield pd.DataFrame([(k, *limbs(v)) for k, v in enumerate(total)], columns=["k", *names])

    names = [f"l{i}" for i in range(LIMBS)]
    parts = rows.select("v").mapInPandas(part, "k int, " + ", ".join(f"{n} long" for n in names))
    summed = [0] * size
    for row in parts.groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).collect():
        summed[row["k"]] = sum(row[n] << (BITS * i) for i, n in enumerate(names))
    return summed


@dataclass
class Whitening:
    """n vectors with sums; components: unit eigenvectors as columns, by falling eigenvalue, those with variance only."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def deviation(self, x: np.ndarray) -> list[int]:
        """Of each row, the sum over dimensions of (n x - S)^2."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * reach * reach >= 1 << 62:  # means are far off zero: centred values are smaller
            mean = np.array([s // self.n for s in self.sums], dtype=object)
            rest = np.array([s % self.n for s in self.sums], dtype=object)
            y = centred(x, mean.astype(np.int64))
            reach = self.n * (int(np.abs(y).max(initial=0)) + 1)
            kind = object if len(self.sums) * reach * reach >= 1 << 62 else np.int64
            z = y.astype(kind) * self.n - rest.astype(kind)
        else:
            z = x * self.n - np.array(self.sums, dtype=np.int64)
        return [int(v) for v in (z * z).sum(axis=1)]

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows x components: the centred vectors, projected and divided by the root of the eigenvalue."""
        mean = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - mean) - rest) @ self.components / np.sqrt(self.values)


def decompose(n: int, sums: list[int], squares: list[int], most: int = COMPONENTS) -> Whitening:
    """From exact sums of squares about the whole part of the mean to the components. With y = x - S div n, r = S mod n: sum of (n y - r)^2 = n (n sum of y^2 - r^2), whose differences are exact too."""
    d = len(sums)
    rest = [s % n for s in sums]
    exact = [[0] * d for _ in range(d)]
    at = iter(squares)
    pairs = {(i, j): next(at) for i in range(d) for j in range(i, d)}
    for i in range(d):
        exact[i][i] = n * pairs[i, i] - rest[i] ** 2
    for i in range(d):
        for j in range(i + 1, d):
            both = n * pairs[i, j] - (rest[i] + rest[j]) ** 2
            exact[i][j] = exact[j][i] = (both - exact[i][i] - exact[j][j]) // 2
    covariance = np.array([[v / (n * n) for v in row] for row in exact])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    fine = values > max(d * np.finfo(float).eps * values[0], 0)
    return Whitening(n, sums, vectors[:, fine][:, :most], values[fine][:most], sum(exact[i][i] for i in range(d)) / (n * n))


def whiten(vectors: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Null and empty vectors and those with null or non-finite components are left out, as are vectors of another length than most have (of equally frequent lengths the longest stays). Components without variance cannot be whitened and give no rows: n equal vectors give none at all. Repeated rows and ids count as often as they stand; null ids stay. Other columns are ignored; an empty table gives no rows. A deviation beyond a long fails, rather than be wrong.
    """
    spark = vectors.sparkSession
    key = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {key}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fine = F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(fine & (F.size("v") > 0))
    sizes = {r["size"]: r["n"] for r in rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()}
    if not sizes:
        return spark.createDataFrame([], schema)
    ((d, n),) = sizes.items()
    rows = rows.filter(F.size("v") == d)
    sums = exact_sums(rows, d, lambda x: [int(v) for v in (x.sum(axis=0) if np.abs(x).max() < 1 << 50 else x.astype(object).sum(axis=0))])
    middle = np.array([s // n for s in sums], dtype=np.int64)
    squares = exact_sums(rows, d * (d + 1) // 2, lambda x: pair_squares(centred(x, middle)))
    shared = spark.sparkContext.broadcast(decompose(n, sums, squares, most))
    found = shared.value
    k = len(found.values)
    if not k:
        return spark.createDataFrame([], schema)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = shared.value.apply(whole_numbers(batch["v"]))
            total += np.c_[w.T @ w, w.sum(axis=0)]
        yield pd.DataFrame({"k": np.arange(total.size), "s": total.ravel()})

    measured = np.zeros(k * (k + 1))
    for row in rows.select("v").mapInPandas(moments, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        measured[row["k"]] = row["s"]
    measured = measured.reshape(k, k + 1) / n
    off = measured[:, :k] - np.outer(measured[:, k], measured[:, k]) - np.eye(k)

    @F.pandas_udf("deviation long, w array<double>")
    def project(vs: pd.Series) -> pd.DataFrame:
        own, deviation, w = shared.value, [], []
        for at in range(0, len(vs), BLOCK):
            x = whole_numbers(vs.iloc[at : at + BLOCK])
            deviation.extend(own.deviation(x))
            w.extend(own.apply(x))
        return pd.DataFrame({"deviation": deviation, "w": w})

    explained = F.array(*[F.lit(float(v / found.trace)) for v in found.values])
    out = rows.select("id", project("v").alias("p")).select("id", "p.deviation", F.posexplode("p.w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(float(np.abs(off).max())).alias("identity_error")
    )
