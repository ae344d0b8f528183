"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's symbols are its runs of at most twelve non-space characters; a longer run, as in scripts without spaces or in code, is cut by its own content: every character beyond ASCII is a symbol, and ASCII ends one after certain characters. So no symbol depends on where its run begins. A window of K symbols is an anchor if its smallest pair of neighbouring symbols, by hash, stands at either edge of the window: a rule that looks at nothing outside the window, so an anchor stays wherever its symbols do. A text starts with K - 1 blank symbols, so that any symbol at all gives an anchor.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import partitions, whole

#: Symbols in a window and in the substrings whose minimum counts.
K, S = 7, 2
#: Runs up to this length are symbols; in longer ones these characters, a seventh of all or so, and punctuation end a symbol.
SYMBOL, ENDS = 12, "aoAO037"
PATTERN = rf"((?<!\S)\S{{1,{SYMBOL}}}+(?!\S)|[^\x00-\x7f]|[\x00-\x7f&&\S&&[^{ENDS}\p{{Punct}}]]*+[{ENDS}\p{{Punct}}]|[\x00-\x7f&&\S&&[^{ENDS}\p{{Punct}}]]++)"
#: Rows in a range of ids, about; ranges at the most.
RANGE_ROWS, RANGES = 100, 1 << 16
LOWEST = -(1 << 63)


def symbol_hashes(text: Column) -> Column:
    """Blank symbols, then a hash of each symbol of the text."""
    symbols = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1))
    return F.concat(F.array_repeat(F.lit(0).cast("long"), K - 1), F.transform(symbols, lambda w: F.xxhash64(w)))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out, an array of structs (h, a 32-bit hash of the anchor's symbols, and at, its first symbol's number), in order."""
    df = df.withColumn("_sym", symbol_hashes(F.col(text)))
    pairs = F.zip_with(F.slice("_sym", 1, F.size("_sym") - 1), F.slice("_sym", 2, F.size("_sym") - 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_pairs", pairs)
    width = K - S + 1

    def closed(i: Column) -> Column:
        low = F.array_min(F.slice("_pairs", i + 1, width))
        return (low == F.get("_pairs", i)) | (low == F.get("_pairs", i + (width - 1)))

    numbers = F.when(F.size("_sym") >= K, F.sequence(F.lit(0), F.size("_sym") - K)).otherwise(F.array().cast("array<int>"))
    anchors = F.transform(F.filter(numbers, closed), lambda i: F.struct(F.xxhash64(F.slice("_sym", i + 1, K)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"), i.alias("at")))
    return df.withColumn(out, anchors).drop("_sym", "_pairs")


def digits(anchors: str) -> Column:
    """The anchors' hashes as eight hex digits each, in order."""
    return F.concat_ws("", F.transform(anchors, lambda a: F.lower(F.lpad(F.hex(a["h"]), 8, "0"))))


def likeness(a: str, b: str) -> Column:
    """Share of anchors in both among those in either: found anywhere, or at the same place (for texts that repeat themselves), whichever is more. 1 if neither has any."""

    def share(of) -> Column:
        x, y = F.transform(a, of), F.transform(b, of)
        both = F.size(F.array_intersect(x, y))
        either = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - both
        return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))

    return F.greatest(share(lambda s: s["h"]), share(lambda s: s["h"] + F.shiftleft(s["at"].cast("long"), 32)))


def range_column(df: DataFrame, key: str, rows: int = RANGE_ROWS) -> tuple[list[int], dict[int, int], Column]:
    """First keys of ranges of about so many rows, at most RANGES; for the nth range that begins with a key of more rows than that, in how many parts to cut that key's rows; and a column that finds a key's range through a coarse and a fine list: struct (range, begins, whether the key is its first)."""
    n = df.count()
    ranges = max(1, min(RANGES, n // rows))
    cuts = df.agg(F.min(key).alias("low"), F.percentile_approx(key, F.lit([i / ranges for i in range(1, ranges)] or [0.5]), 20 * ranges + 1000).alias("cuts")).first()
    starts = sorted({cuts["low"], *cuts["cuts"]}) if n else [LOWEST]
    met = Counter(cuts["cuts"] if n and ranges > 1 else ())
    hot = {i: met[k] for i, k in enumerate(starts) if met[k] > 1}
    step = max(1, int(len(starts) ** 0.5))
    blocks = [starts[i : i + step] for i in range(0, len(starts), step)]
    text = lambda xs: "array(" + ",".join("cast('%d' as bigint)" % x for x in xs) + ")"
    coarse, fine = F.expr(text([b[0] for b in blocks])), F.expr("array(" + ",".join(map(text, blocks)) + ")")
    block = F.greatest(F.size(F.filter(coarse, lambda x: x <= F.col(key))), F.lit(1))
    inner = F.get(fine, block - 1)
    nth = F.greatest(F.size(F.filter(inner, lambda x: x <= F.col(key))) - 1, F.lit(0))
    return starts, hot, F.struct(((block - 1) * step + nth).alias("range"), (F.get(inner, nth) == F.col(key)).alias("begins"))


def in_ranges(rows: DataFrame) -> DataFrame:
    """rows (_id, _k, _text) in ranges of keys, each with a copy, as a guest, of what begins the next one (the first range's, in the last): _id, _k, _text, _range, _guest. A key of very many rows makes ranges of its own, by a hash of the text."""
    starts, hot, own = range_column(rows.select("_k"), "_k")
    last = len(starts) - 1
    if not hot:
        range_, begins = F.col("_own.range"), F.col("_own.begins")
        before = F.when(range_ > 0, range_ - 1).otherwise(last)
        placed = rows.withColumn("_own", own)
    else:
        spark, wide = rows.sparkSession, 2 * RANGES
        parts = spark.createDataFrame([(i, starts[i], m) for i, m in hot.items()], "_r int, _start long, _m int")  # fewer than RANGES
        cut = rows.withColumn("_r", own["range"]).withColumn("_h", F.xxhash64("_text")).join(F.broadcast(parts), "_r", "left")
        share = F.least(F.floor((F.col("_h") / 2.0**64 + 0.5) * F.col("_m")).cast("int"), F.col("_m") - 1)
        part = F.when(F.col("_m").isNull(), 0).when(F.col("_k") == F.col("_start"), share).otherwise(F.col("_m") - 1)
        cut = cut.withColumn("_range", F.col("_r").cast("long") * wide + part)
        firsts = sorted((r["_range"], *r["f"]) for r in cut.groupBy("_range").agg(F.min(F.struct("_k", "_h")).alias("f")).collect())  # at most 2 RANGES
        table = spark.createDataFrame([(at, k, h, firsts[i - 1][0]) for i, (at, k, h) in enumerate(firsts)], "_range long, _fk long, _fh long, _before long")
        placed = cut.join(F.broadcast(table), "_range")
        range_, begins, before = F.col("_range"), (F.col("_k") == F.col("_fk")) & (F.col("_h") == F.col("_fh")), F.col("_before")
    stay, visit = F.struct(range_.alias("range"), F.lit(False).alias("guest")), F.struct(before.alias("range"), F.lit(True).alias("guest"))
    placed = placed.withColumn("_p", F.explode(F.when(begins, F.array(stay, visit)).otherwise(F.array(stay))))
    return placed.select("_id", "_k", "_text", F.col("_p.range").alias("_range"), F.col("_p.guest").alias("_guest"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document by id, the first after the last. Null texts count as empty; texts without symbols have empty fingerprints, which are alike. Null ids come first; rows of equal ids follow each other by a hash of the text. Other columns are ignored; an empty table gives an empty result.

    Only neighbours meet: ids are cut into ranges of about a hundred rows (rows of one id or of none, if there are very many, by a hash of their text), each range gets a copy of the next one's first row, and a window within the range finds what follows. Only rows equal in id and text stay together however many there are.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_k"), whole(text_col).alias("_text"))
    placed = in_ranges(rows).repartition(partitions(docs.sparkSession), "_range")
    placed = with_anchors(placed, "_text", "_anchors")
    order = Window.partitionBy("_range").orderBy("_guest", "_k", F.xxhash64("_text"))
    paired = placed.withColumn("_next", F.lead("_text").over(order)).withColumn("_next_anchors", F.lead("_anchors").over(order)).filter(~F.col("_guest"))
    n = F.length("_text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("_text", n - cut), F.left("_next", cut))
    both = with_anchors(paired.withColumn("_edited", edited), "_edited", "_edited_anchors")
    return both.select(
        F.col("_id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), digits("_anchors").alias("fingerprint"), digits("_edited_anchors").alias("edited_fingerprint"),
        likeness("_anchors", "_edited_anchors").alias("near_edited"), likeness("_anchors", "_next_anchors").alias("near_next"),
    )
