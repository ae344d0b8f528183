"""Lexical, vector and fused retrieval: eligibility first, then a total order, then the limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import casefolded

#: Rows that each depth of a question returns.
DEPTHS = {"quick": 6, "study": 12, "deep": 24, "scholar": 32}


def lexical_score(book: Column, text: Column, tokens: list[str]) -> Column:
    """For each token: 100 if it is the book, else 50 if the book holds it, else 1 if the text does."""
    one = lambda t: F.when(F.lower(book) == t, 100).when(F.contains(F.lower(book), F.lit(t)), 50).when(F.contains(F.lower(text), F.lit(t)), 1).otherwise(0)
    return reduce(lambda a, b: a + b, map(one, tokens)).cast("long") if tokens else F.lit(0).cast("long")


def lexical_top(passages: DataFrame, eligible: DataFrame, on: list[str], tokens: list[str], book: str, text: str, order: list[str], depth: str = "deep") -> DataFrame:
    """The best passages among those in scope (rows that match eligible on its keys)."""
    scoped = passages.join(eligible.select(*on).distinct(), on, "left_semi").withColumn("score", lexical_score(F.col(book), F.col(text), tokens))
    return scoped.filter("score > 0").orderBy(F.col("score").desc(), *order).limit(DEPTHS[depth])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_top(vectors: DataFrame, query: list[float], vector: str, key: str, limit: int, threshold: float | None = None) -> DataFrame:
    """(key, similarity) of the most similar rows; ties by key. The query vector is a literal, so the scan is one pass and the sort keeps `limit` rows a task."""
    scored = vectors.select(key, F.round(cosine(F.col(vector), literal_vector(query)), 6).alias("similarity")).filter(F.col("similarity").isNotNull())
    if threshold is not None:
        scored = scored.filter(F.col("similarity") >= threshold)
    return scored.orderBy(F.col("similarity").desc(), key).limit(limit)


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("position") <= n)


def first_distinct(df: DataFrame, group: str, order: str, text: str, n: int, longest: int) -> DataFrame:
    """(group, k, order): of each group the first n texts that differ when trimmed and case folded; empty and longer texts are left out. Equal texts are reduced to their first before they are ordered."""
    plain = F.trim(text)
    first = df.filter(F.length(plain).between(1, longest)).groupBy(group, casefolded(plain).alias("k")).agg(F.min(order).alias(order))
    return top_per_group(first, group, [F.col(order)], n)


def reciprocal_ranks(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, fused) from rankings (key, position): the sum of 1 / (k + position)."""
    parts = reduce(DataFrame.unionByName, [r.select(key, (1.0 / (k + F.col("position"))).alias("part")) for r in rankings])
    return parts.groupBy(key).agg(F.round(F.sum("part"), 9).alias("fused"))


def cap_groups(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """Of each group at most a quarter of the limit, one to ten rows; then the limit over all, groups in order."""
    each = max(1, min(10, limit // 4))
    return top_per_group(df, group, order, each).orderBy(group, "position").limit(limit)


def budget_prefix(df: DataFrame, keys: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Rows while their texts fit into the budget of characters; the one that crosses it is cut."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text)).over(window), F.lit(0))
    kept = df.withColumn("_before", before).filter(F.col("_before") < budget)
    return kept.withColumn("truncated", F.col("_before") + F.length(text) > budget).withColumn(text, F.substring(F.col(text), F.lit(1), (budget - F.col("_before")).cast("int"))).drop("_before")


def argmax_class(scores: list[tuple[str, Column]], default: str) -> Column:
    """The first name with the highest positive score."""
    best = F.greatest(*[s for _, s in scores])
    out = F.lit(default)
    for name, score in reversed(scores):
        out = F.when((score == best) & (best > 0), F.lit(name)).otherwise(out)
    return out


def chunk_words(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk, words, body): runs of `size` words that share `overlap` with the one before; a tail that the one before holds makes no chunk."""
    w = F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")
    rows = df.select(key, w.alias("_w")).filter(F.size("_w") > 0)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - size) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    parts = rows.select(key, "_w", F.posexplode(starts).alias("chunk", "_at")).withColumn("_part", F.slice(F.col("_w"), F.col("_at") + 1, F.lit(size)))
    return parts.select(key, F.col("chunk").cast("long").alias("chunk"), F.size("_part").cast("long").alias("words"), F.array_join("_part", " ").alias("body"))
