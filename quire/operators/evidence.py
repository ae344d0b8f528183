"""Evidence for questions: a scope of what is eligible, then one path to it, chosen while the plan is built."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import retrieval as R
from quire.operators import scope as S

#: Scores of an exact reference and of a chapter; passages of events at the most; candidates at the most.
EXACT, CHAPTER, EVENTS, CANDIDATES = 1000, 500, 32, 256
REFERENCE = re.compile(r"\b((?:[1-3]\s*)?[A-Za-z]\w*)\s+(\d{1,3}):(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?")
NUMBER = re.compile(r"(?<=\s)\d{1,3}(?!\s*:|\d)")


def scope(parts: dict[str, DataFrame], enabled: Sequence[str]) -> DataFrame | None:
    """(book, translation) of what the enabled parts hold together; None, which admits nothing, if none is enabled."""
    chosen = [parts[name].select("book", "translation") for name in enabled if name in parts]
    return reduce(DataFrame.unionByName, chosen).distinct() if chosen else None


def in_scope(passages: DataFrame, eligible: DataFrame | None) -> DataFrame:
    """Passages whose book and translation are eligible; this comes before any limit."""
    if eligible is None:
        return passages.filter(F.lit(False))
    return passages.join(eligible, ["book", "translation"], "left_semi")


def target(aliases: DataFrame, labels: Sequence[str]) -> str | None:
    """The work of the first label that an alias names; the labels, a handful, are looked up at once."""
    keys = [" ".join(x.split()).lower() for x in labels]
    found = {r["_key"]: r["work"] for r in aliases.withColumn("_key", S.alias_key(F.col("alias"))).filter(F.col("_key").isin(keys)).groupBy("_key").agg(F.min("work").alias("work")).collect()}
    return next((found[k] for k in keys if k in found), None)


def exact(question: str, aliases: DataFrame) -> tuple[str | None, int, int, int] | None:
    """(work, chapter, first, last) of a reference with a verse; None if there is none. The work is None if no alias names it."""
    m = REFERENCE.search(question)
    if not m:
        return None
    first = int(m[3])
    last = int(m[4] or m[3])
    if first < 1 or last < first or last - first > 100:
        return None
    return target(aliases, [m[1]]), int(m[2]), first, last


def chapter(question: str, aliases: DataFrame) -> tuple[str, int] | None:
    """(work, chapter) of the first number that a book's name stands before, the longest name first."""
    for m in NUMBER.finditer(question):
        words = re.findall(r"[\w#-]+", question[: m.start()])[-4:]
        work = target(aliases, [" ".join(words[i:]) for i in range(len(words))]) if words else None
        if work is not None and int(m[0]) >= 1:
            return work, int(m[0])
    return None


def of_work(passages: DataFrame, aliases: DataFrame, work: str | None) -> DataFrame:
    names = aliases.filter(F.col("work") == F.lit(work)).select(S.alias_key(F.col("alias")).alias("_alias"))
    return passages.withColumn("_alias", S.alias_key(F.col("book"))).join(names, "_alias", "left_semi").drop("_alias")


def ranked(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows with their positions."""
    return S.cut(rows, order, limit).drop("truncated")


def evidence(passages: DataFrame, eligible: DataFrame | None, aliases: DataFrame, question: str, depth: str) -> DataFrame:
    """Passages (id, book, chapter, verse, text, translation) that answer a question, with score and position: an exact reference, else a chapter, else its words. A reference that is found but answers nothing ends the search."""
    limit = R.DEPTHS[depth]
    edition = F.upper(F.coalesce("translation", F.lit("")))
    if (asked := exact(question, aliases)) is not None:
        work, number, first, last = asked
        rows = of_work(passages, aliases, work).filter((F.col("chapter") == number) & F.col("verse").between(first, last))
        return ranked(rows.withColumn("score", F.lit(EXACT).cast("long")), [F.col("chapter"), F.col("verse"), edition, F.col("id")], limit)
    scoped = in_scope(passages, eligible)
    if (part := chapter(question, aliases)) is not None:
        rows = of_work(scoped, aliases, part[0]).filter(F.col("chapter") == part[1]).withColumn("score", F.lit(CHAPTER).cast("long"))
        return ranked(rows, [F.col("verse"), edition, F.col("id")], limit)
    words = passages.sparkSession.range(1).select(T.tokens(F.lit(question))).first()[0]
    scored = scoped.withColumn("score", R.lexical_score(F.col("book"), F.col("text"), words)).filter("score > 0")
    order = [F.col("score").desc(), F.col("book"), F.col("chapter"), F.col("verse"), edition, F.col("id")]
    return ranked(scored.orderBy(*order).limit(min(8 * limit, CANDIDATES)), order, limit)


def named_evidence(events: DataFrame, event: str, ids: str, kind: str, passages: DataFrame) -> DataFrame:
    """(event, id, score) of the passages that typed ids name, each once, in their order: the first of EVENTS scores EVENTS, the last 1; other kinds and what isn't there are left out."""
    each = events.select(event, F.posexplode(ids).alias("_p", "_x")).withColumn("id", T.typed_id(F.col("_x"), kind)).filter("id IS NOT NULL")
    once = each.groupBy(event, "id").agg(F.min("_p").alias("_p"))
    first = R.top_per_group(once, event, [F.col("_p")], EVENTS)
    return first.join(passages.select("id"), "id", "left_semi").select(event, "id", (EVENTS + 1 - F.col("position")).alias("score"))


def thematic(vectors: DataFrame, queries: dict[str, list[float]], vector: str, key: str, each: int, most: int) -> DataFrame:
    """(theme, key, similarity): queries named theme/n keep `each` rows, a theme its `most` best, each row once with its best score. One pass scores all queries; a task keeps what it must before rows are shuffled."""
    scores = F.array(*[F.struct(F.lit(name).alias("query"), F.round(R.cosine(F.col(vector), R.literal_vector(v)), 6).alias("similarity")) for name, v in queries.items()])
    rows = vectors.select(key, F.explode(scores).alias("s")).select(key, "s.*").filter("similarity IS NOT NULL")
    near = R.top_per_group(rows, "query", [F.col("similarity").desc(), F.col(key)], each)
    best = near.groupBy(F.element_at(F.split("query", "/"), 1).alias("theme"), key).agg(F.max("similarity").alias("similarity"))
    return R.top_per_group(best, "theme", [F.col("similarity").desc(), F.col(key)], most).drop("position")


def by_type(entities: DataFrame, sources: DataFrame, limits: DataFrame, on: str) -> DataFrame:
    """(type, id, confidence): of each type's rows that an entity names, `each` an entity and `most` in all. limits, a row a type, is broadcast."""
    held = sources.join(entities, on).join(F.broadcast(limits), "type")
    nth = F.row_number().over(Window.partitionBy("type", on).orderBy("id"))
    some = held.withColumn("_n", nth).filter("_n <= each").select("type", "id", "most", "confidence").distinct()
    place = F.row_number().over(Window.partitionBy("type").orderBy("id"))
    return some.withColumn("_p", place).filter("_p <= most").select("type", "id", "confidence")


def demo_vector(text: Column, size: int = 16) -> Column:
    """Numbers from the sum of a text's code points: for tests without a model."""
    total = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((total + i) % 997) / 997.0)
