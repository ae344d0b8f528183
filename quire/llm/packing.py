"""Best-fit packing of documents into sequences, with dominance reduction first.

All that packing needs to know of a piece is its length, and there are at most `capacity` lengths. So Spark counts the pieces of each length, the driver packs those counts (a table bounded by the capacity, whatever the data), and Spark hands every piece its place: the r-th piece of a length takes the r-th slot for that length.
"""

from __future__ import annotations

import bisect
import functools
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.bpe import Reader
from quire.llm.common import checkpoint, whole


@dataclass
class Bins:
    """Groups of equal bins: [(length, copies), ...] and how many bins have it."""

    groups: list[tuple[list[tuple[int, int]], int]] = field(default_factory=list)

    def add(self, content: list[tuple[int, int]], bins: int) -> None:
        if bins:
            self.groups.append((content, bins))


def reduce_by_dominance(counts: Counter, capacity: int, bins: Bins) -> None:
    """Fix bins that some best packing holds; counts keeps what is left.

    A set of an item and at most two others dominates if whatever else may stand beside the item, in any packing, could be put where the chosen ones stand instead:
    - nothing, if not even the shortest item fits beside it;
    - the longest item that fits, if it fills the bin, if no two items fit, or if no three do and it is as long as any pair that fits;
    - the longest pair that fits, if no three items do, the longest item is one of the pair, and no two items that are both longer than the other one would fit instead.
    Equal items are fixed together: while some of each are left, nothing that was decided on changes. It repeats until nothing more can be fixed.
    """
    order, changed = sorted(counts), True
    while changed:
        changed = False
        for length in order[::-1]:
            while counts[length]:
                found = dominating(length, counts, order, capacity - length)
                if not found:
                    break
                content = Counter(found)
                n = min(counts[x] // copies for x, copies in content.items())
                bins.add(sorted(content.items(), reverse=True), n)
                for x, copies in content.items():
                    counts[x] -= copies * n
                    if not counts[x]:
                        del order[bisect.bisect_left(order, x)], counts[x]
                changed = True


def dominating(length: int, counts: Counter, order: list[int], room: int) -> tuple[int, ...] | None:
    """The dominating set that an item of this length begins, if there is one; order: the lengths that are left, ascending."""
    left = lambda x: counts[x] - (x == length)
    low = [x for x in order[:4] if x <= room for _ in range(min(3, left(x)))][:3]
    if not low:
        return (length,)
    end = bisect.bisect_right(order, room)
    best = order[end - 1] if left(order[end - 1]) else order[end - 2]
    if best == room or len(low) < 2 or low[0] + low[1] > room:
        return length, best
    if len(low) > 2 and sum(low) <= room:
        return None
    fits = {x: left(x) for x in order[:end] if left(x)}
    a, b = longest_pair(list(fits), fits, room)
    if best >= a + b:
        return length, best
    between = [x for x in fits if b < x < a for _ in range(min(2, fits[x]))][:2]
    if a == best and (len(between) < 2 or sum(between) > room):
        return length, a, b
    return None


def longest_pair(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, int]:
    """The two items, the longer first, of the largest sum that is at most room; lengths ascend and some pair fits."""
    most, i, j = (0, 0), 0, len(lengths) - 1
    while i <= j:
        both = lengths[i] + lengths[j]
        if both > room or (i == j and counts[lengths[i]] < 2):
            j -= 1
        else:
            most = max(most, (lengths[j], lengths[i]), key=sum)
            i += 1
    return most


def best_fit(counts: Counter, capacity: int, bins: Bins) -> None:
    """Best-fit decreasing over counts: equal items go into equal bins together, as one by one they would."""
    open_bins: dict[int, list[list]] = defaultdict(list)
    rests: list[int] = []

    def put(content: list[tuple[int, int]], n: int, rest: int) -> None:
        if not n:
            return
        if not open_bins[rest]:
            bisect.insort(rests, rest)
        open_bins[rest].append([content, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rests, length)
            if at < len(rests):
                rest = rests[at]
                content, n = open_bins[rest].pop()
                if not open_bins[rest]:
                    del rests[at]
            else:
                rest, content, n = capacity, [], -(-left // (capacity // length))
            each = rest // length
            full = min(n, left // each)
            put([*content, (length, each)], full, rest - each * length)
            left -= full * each
            if full < n:
                some = min(left, each)
                if some:
                    put([*content, (length, some)], 1, rest - some * length)
                    left -= some
                    full += 1
                if full < n:
                    put(content, n - full, rest)
    for groups in open_bins.values():
        for content, n in groups:
            bins.add(content, n)


def pack_counts(counts: dict[int, int], capacity: int) -> Bins:
    bins, left = Bins(), Counter({k: v for k, v in counts.items() if v})
    reduce_by_dominance(left, capacity, bins)
    best_fit(left, capacity, bins)
    return bins


def slots(bins: Bins) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first sequence, offset), by length and rank: where the pieces of a length go."""
    rows, ranks, sequence = [], Counter(), 0
    for content, n in bins.groups:
        offset = 0
        for length, copies in content:
            rows.append((length, ranks[length], copies, sequence, offset))
            ranks[length] += copies * n
            offset += copies * length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


class Encoder:
    """Little-endian 32-bit ids of texts by the tokenizers library's model; as in counting, a bounded table holds what words have given."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        tokenize = Tokenizer.from_str(vocabulary).model.tokenize
        self.reader = Reader(vocabulary, lambda word: pack(*[x.id for x in tokenize(word)]), pack)

    def ids(self, text: str) -> bytes:
        return b"".join(self.reader.read(text))

    def length(self, text: str) -> int:
        return sum(map(len, self.reader.read(text))) // 4


def pack(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def id_counter(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A column function that counts the ids of a text, as packing will cut them."""
    with open(path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(shared.value)
        for batch in texts:
            yield pd.Series([own.length(x) for x in batch], dtype="int64")

    return counted


def document_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32) with part, the task that made it, and nth, its place among the pieces of that length there."""
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    last = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(shared.value).ids
        part, met = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for key, text in zip(batch["_id"], batch["_text"], strict=True):
                ids = encode(text) + last
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    data = ids[4 * start : 4 * (start + capacity)]
                    length = len(data) // 4
                    rows.append((key, piece, start, length, zlib.crc32(data), part, met[length]))
                    met[length] += 1
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    return source.mapInPandas(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset; sequences of at most `capacity` tokens, as few as found.

    A document is its tokens and then end_id; only one longer than capacity is cut, every capacity tokens. Null and empty texts are the end id alone. Repeated rows are packed as often as they stand; ties between equal lengths are broken by task and order. Other columns are ignored whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = checkpoint(document_pieces(docs, path, capacity, end_id, id_col, text_col))
    met = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    counts = {r["length"]: r["n"] for r in met.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(pack_counts(counts, capacity))
    shared = spark.sparkContext.broadcast((table, table[:, 0] * (1 << 45) + table[:, 1]))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows, keys = shared.value
        lengths, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        slot = rows[np.searchsorted(keys, lengths * (1 << 45) + ranks, side="right") - 1]
        nth = ranks - slot[:, 1]
        return pd.DataFrame({"sequence_id": slot[:, 3] + nth // slot[:, 2], "offset": slot[:, 4] + nth % slot[:, 2] * lengths})

    before = met.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = pieces.join(before.select("length", "part", "before"), ["length", "part"])
    placed = ranked.withColumn("_at", place("length", F.col("before") + F.col("nth")))
    return placed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
