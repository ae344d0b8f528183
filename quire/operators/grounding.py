"""Grounding: do citations exist, and do the cited sources say what is claimed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import folded

#: Characters of distinct statements that one automaton holds, at the most (some 50 bytes each in every Python worker); more statements meet the texts by rolling hashes.
AUTOMATON = 2_000_000
#: Bits of the filter that hashes of texts pass before they are shuffled, as a power of two: its size does not grow with the statements. Parts of one hash's join.
FILTER_BITS, PARTS = 26, 16
#: The rolling hash's base, odd and so with an inverse modulo 2^64, and the longest window, a power of two.
BASE, LONGEST = 0x9E3779B97F4A7C15, 1024


def supported(statements: DataFrame, sources: DataFrame, statement: str, text: str, key: str, source: str, automaton: int = AUTOMATON) -> DataFrame:
    """(key, source), each pair once, of statements that stand, as normalised (compatible forms, case folded, single spaces between letters and digits), in a source. Empty and null statements stand nowhere; null texts hold none.

    Every text is read once, in time linear in its length, whatever the number of statements. As long as the distinct statements have at most `automaton` characters, one Aho-Corasick automaton of them all runs over the texts, and no text is shuffled. More statements are looked for by the hash of one window each; what a hash finds is verified.
    """
    asked = statements.select(key, folded(F.col(statement)).alias("_s")).filter("_s <> ''")
    said = sources.select(source, folded(F.col(text)).alias("_t"))  # empty ones are left in: a filter would fold every text twice
    distinct = asked.select("_s").distinct()
    if (distinct.agg(F.sum(F.length("_s"))).first()[0] or 0) > automaton:
        return by_hashes(asked, said, key, source)
    return by_automaton(asked, said, [r["_s"] for r in distinct.collect()], source).join(asked, "_s").select(key, source).distinct()


@lru_cache(2)
def automaton_of(statements: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for n, s in enumerate(statements):
        made.add_word(s, n)
    made.make_automaton()
    return made


def by_automaton(asked: DataFrame, said: DataFrame, distinct: list[str], source: str) -> DataFrame:
    """(source, _s) of the distinct statements that each text holds."""
    ordered = sorted(distinct)
    shared = said.sparkSession.sparkContext.broadcast(tuple(ordered))

    @F.arrow_udf("array<int>")
    def held(texts: pa.Array) -> pa.Array:
        find = automaton_of(shared.value).iter if shared.value else lambda _: ()
        return pa.array([sorted({n for _, n in find(t.as_py() or "")}) for t in texts], pa.list_(pa.int32()))  # one text at a time is Python's own, hits are numbers

    numbers = asked.sparkSession.createDataFrame(list(enumerate(ordered)), "_n int, _s string")
    return said.select(source, F.explode(held("_t")).alias("_n")).join(F.broadcast(numbers), "_n").select(source, "_s")


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0 ... BASE^(n - 1) and their inverses, modulo 2^64; n a power of two, so few tables are made."""
    up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, np.uint64(b))]) for b in (BASE, pow(BASE, -1, 1 << 64)))
    return up, down


def window_hashes(text: str, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each width the hashes of all windows of that width: differences of one running sum, so a text costs its length for each width."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    up, down = powers(1 << max(10, len(codes).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)]
    for w in widths:
        if w <= len(codes):
            h = (sums[w:] - sums[:-w]) * down[: len(codes) - w + 1]
            h ^= h >> np.uint64(29)  # the low bits of such sums are weak
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            yield w, h.view(np.int64)


def width_of(text: str) -> int:
    """The longest power of two that is no longer than the text: a window of at least half of it."""
    return min(LONGEST, 1 << (len(text).bit_length() - 1))


def by_hashes(asked: DataFrame, said: DataFrame, key: str, source: str) -> DataFrame:
    """The same for any number of statements. A statement is sought by the hash of its first window; a filter of fixed size, built from all hashes, keeps what no statement has from the shuffle. Pairs found by equal hashes meet their text again and are verified."""

    @F.pandas_udf("w int, h long")
    def first_window(texts: pd.Series) -> pd.DataFrame:
        found = [(w, int(next(window_hashes(t[:w], [w]))[1][0])) for t in texts for w in [width_of(t)]]
        return pd.DataFrame(found, columns=["w", "h"])

    asked = asked.withColumn("_a", first_window("_s")).select(key, "_s", F.col("_a.w").alias("_w"), F.col("_a.h").alias("_h"))
    bit = lambda h: F.pmod(h, F.lit(1 << FILTER_BITS))
    words = asked.select("_w", bit(F.col("_h")).alias("b")).groupBy("_w", F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias("bits"))
    filters: dict[int, np.ndarray] = {}
    for r in words.collect():  # at most 2^(FILTER_BITS - 6) numbers for each of eleven widths
        filters.setdefault(r["_w"], np.zeros(1 << (FILTER_BITS - 6), np.int64))[r["at"]] = r["bits"]
    shared = said.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("w array<int>, h array<long>")
    def hits_of(texts: pd.Series) -> pd.DataFrame:
        own, rows = shared.value, []
        for t in texts.fillna(""):
            found = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
            for w, h in window_hashes(t, sorted(own)):
                b = h & np.int64((1 << FILTER_BITS) - 1)
                h = np.unique(h[(own[w][b >> 6] >> (b & 63)) & 1 == 1])
                found.append((np.full(len(h), w, np.int32), h))
            rows.append([np.concatenate(x) for x in zip(*found, strict=True)])
        return pd.DataFrame(rows, columns=["w", "h"])

    named = said.withColumn("_k", F.xxhash64("_t"))
    hits = named.select(source, "_k", hits_of("_t").alias("_f")).select(source, "_k", F.explode(F.arrays_zip("_f.w", "_f.h")).alias("_f"))
    hits = hits.select(source, "_k", F.col("_f.w").alias("_w"), F.col("_f.h").alias("_h")).distinct()
    # an anchor may stand in very many texts: its hits are dealt to PARTS, as are copies of the statements
    hits = hits.withColumn("_part", F.pmod("_k", F.lit(PARTS)))
    pairs = hits.join(asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>"))), ["_w", "_h", "_part"]).select(source, "_k", key, "_s")
    met = pairs.withColumnRenamed(source, "_d").join(named, (F.col("_d").eqNullSafe(F.col(source))) & (pairs["_k"] == named["_k"]) & F.contains("_t", "_s"))
    return met.select(key, source).distinct()


def valid_citations(cited: Column, known: Column) -> Column:
    """Struct: kept, the cited ids that are known, and valid, whether all are and there is one."""
    kept = F.array_intersect(cited, known)
    return F.struct(kept.alias("kept"), ((F.size(kept) == F.size(F.array_distinct(cited))) & (F.size(cited) > 0)).alias("valid"))


def settled(claims: DataFrame, support: DataFrame, key: str, classification: str) -> DataFrame:
    """(key, sources, status): a claim with a source is supported, one marked as synthesis may do without, any other is dropped."""
    counted = support.groupBy(key).agg(F.count("*").alias("sources"))
    status = F.when(F.col("sources") > 0, "supported").when(F.col(classification) == "synthesis", "synthesis").otherwise("dropped")
    return claims.select(key, classification).join(counted, key, "left").withColumn("sources", F.coalesce("sources", F.lit(0))).select(key, "sources", status.alias("status"))


def settled_claims(claims: DataFrame, known: DataFrame) -> DataFrame:
    """claims (id, cited, synthesis, confidence) with kept, the cited ids that are known, and confidence, low where some or all are missing; a claim without any known source goes unless it is synthesis.

    Citations are unfolded and meet the known ids by equality; a claim that cites nothing stays to be judged.
    """
    each = claims.select("id", F.explode(F.array_distinct("cited")).alias("source")).join(known.select("source").distinct(), "source", "left_semi")
    kept = each.groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("kept"))
    joined = claims.join(kept, "id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<long>")))
    lost = (F.size("kept") < F.size(F.array_distinct("cited"))) | (F.size("kept") == 0)
    return joined.filter((F.size("kept") > 0) | F.col("synthesis")).select("id", "kept", F.when(lost, "low").otherwise(F.col("confidence")).alias("confidence"))


def all_known(ids: Column, known: Column) -> Column:
    """Whether there are ids and all are known."""
    return (F.size(ids) > 0) & F.forall(ids, lambda x: F.array_contains(known, x))
