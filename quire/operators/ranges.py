"""Joins of positions with ranges, by equality: a range is cut into dyadic bins, a position stands in one bin of each size, so every pair meets once and no key holds more positions than the largest bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins have 2^0 ... 2^TOP positions; a longer range is as many of the largest as it needs.
TOP = 10


def merged(ranges: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """The union of each key's ranges as ranges that neither overlap nor touch; empty ranges (high < low) and null ends are left out."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    rows = ranges.select(*keys, low, high).filter(F.col(low) <= F.col(high))
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(reach.isNull() | (F.col(low) > reach + 1), 1).otherwise(0))
    run = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_run")


def bins(low: Column, high: Column) -> Column:
    """The bins (size, nth) that make up [low, high], each position in one: at each size the two ends that no larger bin takes, at the top all that is left."""
    end = high + 1

    def at(size: int) -> Column:
        a, b = F.ceil(low / (1 << size)).cast("long"), F.floor(end / (1 << size)).cast("long")
        one = lambda nth: F.struct(F.lit(size).alias("size"), nth.alias("nth"))
        none = F.array().cast("array<struct<size: int, nth: bigint>>")
        if size == TOP:
            return F.when(a < b, F.transform(F.sequence(a, b - 1), one)).otherwise(none)
        left = F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), F.array(one(a))).otherwise(none)
        right = F.when((a < b) & (F.pmod(b, F.lit(2)) == 1) & ~((F.pmod(a, F.lit(2)) == 1) & (a == b - 1)), F.array(one(b - 1))).otherwise(none)
        return F.concat(left, right)

    return F.concat(*[at(s) for s in range(TOP + 1)])


def range_join(ranges: DataFrame, rows: DataFrame, keys: Sequence[str], on: Sequence[str], low: str, high: str, position: str) -> DataFrame:
    """rows with the keys of every range they stand in, each pair once: a key's ranges are OR-ed, so they may overlap. on: columns that must be equal in both, such as the book. Null positions stand nowhere; rows' columns must differ from keys. Both sides are shuffled by bin, whose positions are bounded."""
    apart = merged(ranges, [*keys, *on], low, high)
    cut = apart.select(*keys, *on, F.explode(bins(F.col(low), F.col(high))).alias("_b")).select(*keys, *on, F.col("_b.size").alias("_size"), F.col("_b.nth").alias("_nth"))
    every = F.transform(F.sequence(F.lit(0), F.lit(TOP)), lambda s: F.struct(s.alias("size"), F.call_function("shiftright", F.col(position).cast("long"), s).alias("nth")))
    placed = rows.filter(F.col(position).isNotNull()).withColumn("_b", F.explode(every)).withColumn("_size", F.col("_b.size")).withColumn("_nth", F.col("_b.nth")).drop("_b")
    return placed.join(cut, [*on, "_size", "_nth"]).select(*[F.col(c) for c in keys], *[F.col(c) for c in rows.columns])


def complete_editions(pairs: DataFrame, ranges: DataFrame, keys: Sequence[str], on: Sequence[str], low: str, high: str, position: str, edition: str, row: str, trust: Sequence[str]) -> DataFrame:
    """keys, edition, rows: of each key the first edition by trust that has every position of all its ranges, with the smallest row of each position, in order. Editions that trust doesn't name, and keys that none covers wholly, are left out."""
    rank = F.array_position(F.array(*map(F.lit, trust)), F.col(edition))
    wanted = merged(ranges, [*keys, *on], low, high).groupBy(*keys).agg(F.sum(F.col(high) - F.col(low) + 1).alias("_wanted"))
    first = pairs.withColumn("_rank", rank).filter("_rank > 0").groupBy(*keys, *on, position, edition, "_rank").agg(F.min(row).alias(row))
    held = first.groupBy(*keys, edition, "_rank").agg(F.count("*").alias("_held"), F.array_sort(F.collect_list(F.struct(*on, position, row))).alias("_rows"))
    full = held.join(wanted, list(keys)).filter("_held = _wanted")
    best = full.groupBy(*keys).agg(F.min_by(F.struct(edition, "_rows"), "_rank").alias("_b"))
    return best.select(*keys, F.col(f"_b.{edition}").alias(edition), F.transform("_b._rows", lambda x: x[row]).alias("rows"))
