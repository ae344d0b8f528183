"""Chunks of anchored text: runs of whole anchors (verses, notes) near a target of words, with a little overlap, and the key by which equal chunks are one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a chunk aims at, has at the most, and shares with the one before at the most.
TARGET, MOST, OVERLAP = 350, 500, 40


class Cutter:
    """Cuts a sequence of anchors, one at a time; all it holds are the anchors of the open chunk."""

    def __init__(self, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP):
        if not 0 <= overlap < target <= most:
            raise ValueError("overlap must be less than target, target at most the limit")
        self.target, self.most, self.overlap = target, most, overlap
        self.open: list[tuple[int, int]] = []  # place, words
        self.fresh = False  # whether the open chunk has an anchor that no chunk before has

    def add(self, place: int, words: int) -> list[int] | None:
        """Takes an anchor; gives the places of the chunk that it closes, if it does."""
        size = sum(w for _, w in self.open)
        done = None
        if self.open and self.fresh and (size >= self.target or size + words > self.most):
            done = [p for p, _ in self.open]
            kept, size = [], 0
            for p, w in reversed(self.open[1:]):
                if size + w > self.overlap or size + w + words > self.most:
                    break
                kept.append((p, w))
                size += w
            self.open = kept[::-1]
        self.open.append((place, words))
        self.fresh = True
        return done

    def end(self) -> list[int] | None:
        done, self.open, self.fresh = [p for p, _ in self.open] if self.fresh else None, [], False
        return done


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def anchored_chunks(anchors: DataFrame, group: Sequence[str], order: str, text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """group, chunk (from 0), anchors, words, first and last (order of its ends), body (anchors joined by newlines).

    A chunk is anchors of one group in their order, closed once it has `target` words or the next anchor would take it over `most`; it begins with as many whole anchors of the one before as have at most `overlap` words together. No anchor is split: one of more than `most` words is a chunk alone. Anchors without words and with null order are left out; equal orders stand by a hash of their text, and equal rows are one anchor. Only places and counts of words go through the scan, in order, one at a time; texts meet their chunks by equality.
    """
    names = [f"_g{i}" for i in range(len(group))]
    rows = anchors.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col(order).alias("_o"), F.col(text).alias("_t"), word_count(F.col(text)).alias("_w"))
    rows = rows.filter("_w > 0 AND _o IS NOT NULL").withColumn("_h", F.xxhash64("_t"))
    rows = rows.withColumn("_g", F.to_json(F.struct(*names)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last, chunk = Cutter(target, most, overlap), None, 0
        held: dict[int, tuple] = {}
        place = 0

        def emit(places: list[int] | None, out: list[tuple]) -> None:
            nonlocal chunk
            if places is not None:
                out.extend((*held[p], chunk) for p in places)
                chunk += 1

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], kind), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["_g", "_o", "_h", "chunk"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("_o").type
            out: list[tuple] = []
            for g, o, h, w in zip(*[batch.column(c).to_pylist() for c in ("_g", "_o", "_h", "_w")], strict=True):
                if g != last:
                    emit(cutter.end(), out)
                    last, chunk, held = g, 0, {}
                place += 1
                held[place] = (g, o, h)
                done = cutter.add(place, w)
                emit(done, out)
                if done:
                    held = {p: held[p] for p, _ in cutter.open}
            yield batch_of(out)
        if kind is not None:
            out = []
            emit(cutter.end(), out)
            yield batch_of(out)

    kind = rows.schema["_o"].dataType.simpleString()
    placed = rows.select("_g", "_o", "_h", "_w").distinct().repartition("_g").sortWithinPartitions("_g", "_o", "_h").mapInArrow(scan, f"_g string, _o {kind}, _h long, chunk long")
    met = rows.dropDuplicates(["_g", "_o", "_h"]).join(placed, ["_g", "_o", "_h"])
    parts = F.array_sort(F.collect_list(F.struct("_o", "_h", "_t", "_w")))
    made = met.groupBy(*names, "chunk").agg(parts.alias("_p"))
    return made.select(
        *[F.col(n).alias(g) for g, n in zip(group, names, strict=True)], "chunk", F.size("_p").cast("long").alias("anchors"), F.aggregate("_p", F.lit(0).cast("long"), lambda s, x: s + x["_w"]).alias("words"),
        F.element_at("_p", 1)["_o"].alias("first"), F.element_at("_p", -1)["_o"].alias("last"), F.array_join(F.transform("_p", lambda x: x["_t"]), "\n").alias("body"),
    )


def keyed(chunks: DataFrame, scope: Sequence[str], boundary: str, order: Sequence[str], body: str = "body") -> DataFrame:
    """One row per key (the scope's columns, the boundary's type, the digest of the whole body): boundary, digest, copies and, by order, the first chunk that has it."""
    named = chunks.withColumn("boundary", F.lit(boundary)).withColumn("digest", F.sha2(F.coalesce(F.col(body), F.lit("")), 256))
    return named.groupBy(*scope, "boundary", "digest").agg(F.count("*").alias("copies"), F.min(F.struct(*order)).alias("_f")).select(*scope, "boundary", "digest", "copies", *[F.col(f"_f.{o}").alias(o) for o in order])
