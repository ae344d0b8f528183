"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised: 1 keeps the shares, 0 makes all sources equal. The exponent is bisected until the weights reach a target entropy without any source being repeated beyond a limit. A source's documents are then drawn in blocks, each a permutation of all of them, until its budget of tokens is spent; the last block is cut where it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, whole

#: Passes over the sources; each tries 32 exponents at once, so it halves the interval five times.
PASSES, TRIED = 5, 32
#: Documents of a slice of a permutation, about; slices of a source at the most.
SLICE, SLICES = 500, 1 << 16
#: Sources whose plan is broadcast, at the most.
BROADCAST = 100_000


@dataclass(frozen=True)
class Mix:
    """entropy: target, as a share of that of equal weights; repeats: how often a source may be drawn whole; cover: the budget is the least that draws every document at least once, else it is the tokens there are, or `budget`."""

    entropy: float = 0.9
    repeats: float = 4.0
    cover: bool = False
    budget: float | None = None
    seed: int = 17


def words(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def totals(sources: DataFrame, exponents: list[float], mix: Mix) -> list[tuple[float, bool]]:
    """For each exponent: entropy as a share of the greatest, and whether some source would be repeated too often. One aggregation over the table of sources."""
    log_share = F.log(F.col("tokens") / F.col("total"))
    sums = []
    for i, a in enumerate(exponents):
        term = F.exp(a * log_share)
        sums += [F.sum(term).alias(f"z{i}"), F.sum(term * a * log_share).alias(f"e{i}"), F.max(F.exp((a - 1) * log_share)).alias(f"m{i}"), F.min(F.exp((a - 1) * log_share)).alias(f"l{i}")]
    row = sources.agg(F.count("*").alias("n"), F.first("total").alias("total"), *sums).first()
    out = []
    for i in range(len(exponents)):
        z = row[f"z{i}"]
        entropy = (math.log(z) - row[f"e{i}"] / z) / math.log(row["n"]) if row["n"] > 1 else 1.0
        budget = 1 / row[f"l{i}"] if mix.cover else (mix.budget or row["total"]) / row["total"] / z
        out.append((entropy, budget * row[f"m{i}"] > mix.repeats * (1 + 1e-9)))
    return out


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The least exponent, of 0 to 1, whose weights are as uneven as the target entropy allows and repeat no source too often; 1 if none does. Both hold from some exponent on, so it can be bisected."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * i / TRIED for i in range(TRIED + 1)]
        first = next((i for i, (entropy, over) in enumerate(totals(sources, tried, mix)) if entropy <= mix.entropy + 1e-12 and not over), None)
        if first is None:
            return high
        if not first:
            return low
        low, high = tried[first - 1], tried[first]
    return high


def draws(docs: DataFrame, mix: Mix = Mix(), count: Callable[[Column], Column] = words, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row for each time a document is drawn: id, source, n_tokens (by `count`, a column function of the text), block (from 0), weight of its source and draw_at (0 to 1), by which all draws are ordered so that sources mix at their weights throughout; with keep, the columns of docs and draw_at.

    In a block a source's documents are ordered by a hash of seed, block and id; in the last one by slices, hashes of seed and id, first, and those are drawn before which the budget isn't yet spent. Null sources are one source; null texts have no tokens. A source without tokens has weight 0 and is drawn once. Repeated rows are documents of their own, drawn together. An empty table gives no rows. Tokens are counted once, but for the slices in which budgets end.
    """
    own = docs.columns if keep else []
    group = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), whole(text_col).alias("_text"), group.alias("_group"))
    place = lambda *of: F.xxhash64(F.lit(mix.seed), *of, F.col("_id").cast("string")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    sizes = checkpoint(rows.groupBy("_group").agg(F.least(F.lit(SLICES), F.ceil(F.count("*") / SLICE)).cast("int").alias("slices")))
    held = F.broadcast if sizes.count() <= BROADCAST else lambda df: df  # one row a source: broadcast if that is few, else joined by shuffle
    rows = rows.join(held(sizes), "_group").withColumn("_slice", F.floor(place() * F.col("slices")).cast("int"))
    counted = rows.withColumn("_tokens", count("_text"))
    if not keep:
        rows = counted = checkpoint(counted.drop("_text"))
    by_slice = checkpoint(counted.groupBy("_group", "_slice").agg(F.sum("_tokens").alias("n")))
    by_source = by_slice.groupBy("_group").agg(F.sum("n").alias("tokens"))
    total = by_slice.agg(F.sum("n")).first()[0] or 0
    filled = checkpoint(by_source.filter("tokens > 0").withColumn("total", F.lit(float(total))))
    a = exponent(filled, mix) if total else 1.0
    term = F.exp(a * F.log(F.col("tokens") / F.col("total")))
    z, least = filled.agg(F.sum(term), F.max(F.col("tokens") / term)).first() if total else (1.0, 0.0)
    budget = least * z if mix.cover else float(mix.budget or total)
    some = F.col("tokens") > 0
    plan = by_source.withColumn("total", F.lit(float(total or 1))).select("_group", "tokens", F.when(some, term / z).otherwise(0.0).alias("weight"))
    plan = plan.withColumn("ratio", F.when(some, F.round(F.col("weight") * budget / F.greatest(F.col("tokens"), F.lit(1)), 9)).otherwise(1.0)).withColumn("blocks", F.floor("ratio").cast("int"))
    plan = plan.withColumn("left", (F.col("ratio") - F.col("blocks")) * F.col("tokens"))
    before = by_slice.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = before.join(plan.select("_group", "left"), "_group").filter(F.col("before") < F.col("left")).groupBy("_group").agg(F.max("_slice").alias("end"), F.max_by("before", "_slice").alias("before"))
    planned = rows.join(held(checkpoint(plan.join(ends, "_group", "left"))), "_group")
    # slices before the one in which the budget ends are drawn whole; only that one's rows are ordered
    last = F.col("blocks") - 1 + F.when(F.col("_slice") < F.col("end"), 1).otherwise(0)
    kept = [*(f"_c{i}" for i in range(len(own))), "_id", "_source", "_slice", "slices", *([] if keep else ["_tokens"]), "block", "blocks", "weight", "ratio"]
    drawn = planned.filter(last >= 0).withColumn("block", F.explode(F.sequence(F.lit(0), last))).select(*kept)
    within = F.coalesce(F.sum("_tokens").over(Window.partitionBy("_group").orderBy("_u", "_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = planned.filter(F.col("_slice") == F.col("end")).withColumn("block", F.col("blocks")).withColumn("_u", place(F.col("block")))
    edge = edge.withColumn("_tokens", count("_text")) if keep else edge
    edge = edge.withColumn("_within", within).filter(F.col("before") + F.col("_within") < F.col("left")).select(*kept)
    names = [F.col(f"_c{i}").alias(c) for i, c in enumerate(own)] if keep else [F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_tokens").alias("n_tokens"), "block", "weight"]
    at = F.when(F.col("block") < F.col("blocks"), place(F.col("block"))).otherwise((F.col("_slice") + place(F.col("block"))) / F.col("slices"))
    return drawn.unionByName(edge).select(*names, F.least(F.lit(1.0), (F.col("block") + at) / F.greatest(F.col("ratio"), F.lit(1e-9))).alias("draw_at"))
