"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits through deletion variants.

A 64-bit fingerprint is cut into three segments. Two fingerprints at four or fewer differing bits differ by one bit at most in some segment, so they agree in that segment once one bit of it is left out. Each fingerprint is indexed under all 64 such variants, the variants are joined by equality and every pair is verified. A run of equal variants gives links enough to connect it, never all its pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quire.llm.common import checkpoint, joined_by_hot_key, partitions, whole
from quire.llm.components import connected_components, spanning_links

#: (first bit, bits) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: A longer run of equal variants is compared in blocks, each pair of blocks by a task of its own.
LONG_RUN = 2048
BLOCK = 1024


def fingerprint_of(text: str, words_in_shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash. bytes.lower() and bytes.split() know ASCII only: A-Z, the space and U+0009 to U+000D."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_in_shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - words_in_shingle + 1
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[words_in_shingle - 1 :].tolist()))
    hashes = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=seed), pieces), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint_of(x) for x in batch], dtype=np.uint64).view(np.int64))


def hex_digits(fingerprint: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def variant_key(bit: int) -> Column:
    """The bit left out, then what its segment holds without it; under 28 bits."""
    first, size = next(s for s in SEGMENTS if s[0] <= bit < s[0] + s[1])
    inside = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(((1 << size) - 1) & ~(1 << (bit - first))).cast("long"))
    return inside + F.lit(bit << 22)


def linked_in_run(fps: np.ndarray, bit: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among fingerprints of one variant."""
    return spanning_links(fps, fps, lambda a, b: np.bitwise_count(a[:, None] ^ b[None, :]) <= most)


def runs(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From rows (key, fp) in key order, arrays (key or -1 for a verified link, a, b); rows of a long run are handed on as (key, fp, fp)."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    passing = None  # key of a long run that is being handed on
    for batch in _with_end(batches):
        if batch is not None:
            keys = np.concatenate([keys, batch["key"].to_numpy(np.int64)])
            fps = np.concatenate([fps, batch["fp"].to_numpy(np.int64).view(np.uint64)])
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        if passing is not None and keys[0] == passing:
            yield keys[: ends[0]], fps[: ends[0]], fps[: ends[0]]
            starts, ends = starts[1:], ends[1:]
        if batch is not None and len(starts):  # the last run may go on
            if ends[-1] - starts[-1] > LONG_RUN:
                passing = keys[-1]
                yield keys[starts[-1] :], fps[starts[-1] :], fps[starts[-1] :]
                rest = len(keys)
            else:
                rest = starts[-1]
            starts, ends = starts[:-1], ends[:-1]
        else:
            rest = len(keys)
        sizes = ends - starts
        for s, e in zip(starts[sizes > LONG_RUN], ends[sizes > LONG_RUN], strict=True):
            yield keys[s:e], fps[s:e], fps[s:e]
        for s, e in zip(starts[(sizes > 16) & (sizes <= LONG_RUN)], ends[(sizes > 16) & (sizes <= LONG_RUN)], strict=True):
            a, b = linked_in_run(fps[s:e], 0, most)
            yield np.full(len(a), -1), a, b
        short = np.repeat(sizes, sizes) <= 16 if len(sizes) else np.zeros(0, bool)
        if short.any():
            base = starts[0]
            k, f = keys[base : ends[-1]][short], fps[base : ends[-1]][short]
            for lag in range(1, int(sizes[sizes <= 16].max())):
                near = (k[lag:] == k[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= most)
                if near.any():
                    yield np.full(int(near.sum()), -1), f[lag:][near], f[:-lag][near]
        keys, fps = keys[rest:], fps[rest:]


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def frame(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "a": a.view(np.int64), "b": b.view(np.int64)})


def fingerprint_links(fingerprints: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` (signed long) reachable at `most` or fewer differing bits a step."""
    if most > 2 * len(SEGMENTS) - 1:
        raise ValueError("three segments with one wildcard find at most five differing bits")
    spark = fingerprints.sparkSession
    found_schema = "key long, a long, b long"
    spread = fingerprints.select("fp").repartition(partitions(spark), "fp")  # each row becomes 64
    variants = spread.select("fp", F.explode(F.array(*[variant_key(b) for b in range(64)])).alias("key"))
    ordered = variants.repartition(partitions(spark), "key").sortWithinPartitions("key", "fp")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in runs(batches, most):
            yield frame(*found)

    found = checkpoint(ordered.mapInPandas(scan, found_schema).dropDuplicates(["key", "a", "b"]))
    long = found.filter("key >= 0").select("key", F.col("a").alias("fp"))
    blocks = long.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = long.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.select("key", "fp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fps, own = group["fp"].to_numpy(np.int64).view(np.uint64), group["own"].to_numpy()
        left, right = fps[own == group["lo"].iloc[0]], fps[own == group["hi"].iloc[0]]
        a, b = spanning_links(left, right, lambda x, y: np.bitwise_count(x[:, None] ^ y[None, :]) <= most)
        return frame(np.full(len(a), -1), a, b)

    across = pairs.groupBy("key", "lo", "hi").applyInPandas(compare, found_schema)
    return found.filter("key < 0").unionByName(across).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links at `most` or fewer differing bits, itself included.

    Null texts count as empty; a text without words has fingerprint zero and links like any other. Equal rows share a fingerprint and stay as rows; rows that share an id and differ in their texts are fingerprinted and linked each by its own. A null id is never smallest unless all ids of its component are null. Other columns are ignored; an empty table gives an empty result.
    """
    prints = checkpoint(docs.select(F.col(id_col).alias("_id"), simhash(whole(text_col)).alias("fp")))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("_id").alias("rep"), F.count("*").alias("_n")))
    links = fingerprint_links(nodes.select("fp"), most)
    # fingerprints are what is linked: rows that share an id may have unlike ones
    moved = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "fp")
    placed = checkpoint(nodes.join(moved, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    names = checkpoint(placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("_members")))
    named = checkpoint(joined_by_hot_key(placed, names, "component", "_members").select("fp", "component_id", "_n"))
    return joined_by_hot_key(prints, named, "fp", "_n").select(F.col("_id").alias(id_col), hex_digits("fp").alias("fingerprint"), "component_id")
