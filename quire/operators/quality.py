"""Rules of data quality; each returns findings or the rows that it is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_ranges(df: DataFrame, keys: list[str], position: str, last: DataFrame | None = None) -> DataFrame:
    """(keys, first, last) of missing positions from 1 up to the largest, or to `last` (keys, last) where given, without listing the positions."""
    seen = df.filter(F.col(position).isNotNull()).select(*keys, F.col(position).cast("long").alias("_p")).distinct()
    ends = seen.groupBy(*keys).agg(F.max("_p").alias("_p")) if last is None else last.select(*keys, F.col("last").cast("long").alias("_p"))
    marks = seen.unionByName(ends.select(*keys, (F.col("_p") + 1).alias("_p")))
    before = F.coalesce(F.lag("_p").over(Window.partitionBy(*keys).orderBy("_p")), F.lit(0))
    return marks.withColumn("_before", before).filter(F.col("_p") > F.col("_before") + 1).select(*keys, (F.col("_before") + 1).alias("first"), (F.col("_p") - 1).alias("last"))


def overlaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Distinct ranges that begin at or before the furthest end of those before them."""
    ranges = df.select(*keys, start, end).distinct()
    order = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_furthest", F.max(end).over(order)).filter(F.col(start) <= F.col("_furthest")).drop("_furthest")


def occurrences(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with occurrence, from 1 within its keys, and repeated, whether there are others."""
    window = Window.partitionBy(*keys)
    return df.withColumn("occurrence", F.row_number().over(window.orderBy(*order)).cast("long")).withColumn("repeated", F.count("*").over(window) > 1)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of those that stand more than once; nulls are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def repeated_texts(df: DataFrame, position: str, text: str) -> DataFrame:
    """(checksum, positions, first) of texts that stand at several positions."""
    return df.groupBy(F.sha2(text, 256).alias("checksum")).agg(F.countDistinct(position).alias("positions"), F.min(position).alias("first")).filter("positions > 1")


def missing(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys), keys, "left_anti")


def first_fault(rules: list[tuple[str, Column]]) -> Column:
    """The code of the first rule that holds, null if none does."""
    code = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        code = F.when(rule, F.lit(name)).otherwise(code)
    return code


def regressed(now: Column, before: Column) -> Column:
    """Over five in a hundred fewer than before, in whole numbers."""
    return now * 20 < before * 19


def exact_coverage(values: Column, declared: Column) -> Column:
    """Whether a list holds distinct positive numbers in order, as many as declared."""
    return (F.array_sort(F.array_distinct(values)).eqNullSafe(values)) & F.forall(values, lambda v: v > 0) & (F.size(values) == declared)


def findings(parts: list[DataFrame], ranks: dict[str, int]) -> DataFrame:
    """All findings (code, severity, at, detail) once, with rank by which reports are ordered: codes in the order given, unknown ones last."""
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("code")), F.lit(len(ranks)))
    return joined.distinct().withColumn("rank", rank.cast("long"))


def only_in(one: DataFrame, other: DataFrame, side: str) -> DataFrame:
    """Rows of one that the other lacks, as often as they are more there, with side."""
    return one.exceptAll(other).withColumn("side", F.lit(side))
