"""An ordered digest of a table of any size: a Merkle tree whose blocks are cut by content.

Rows are sorted by key over the whole table; a row whose hash begins with two zero digits opens a block, about one in 256. So blocks hang on the rows alone, not on how they were partitioned; a row that is changed, put in or taken out changes its own block only, and two tables are compared block by block. Blocks are cut the same way again until few are left; their digests in order give the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graph import settled

#: Digests that are joined to the root on the driver, at the most.
ROOT = 1024
#: Hash prefix that opens a block.
OPENS = "00"


def encoded(columns: Sequence[str]) -> Column:
    """A row as a text that no other row gives: each value with its length, null told from empty."""
    one = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.concat_ws(";", *map(one, columns))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows, with a column _leaf (a hash), and with block and at: the number of the block each stands in, by order over the whole table, and its place. Each partition numbers its own in one pass; the partitions' totals, one row each, give the rest."""
    names = [f.name for f in rows.schema.fields]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, opened, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            blocks, places = [], []
            for leaf in batch.column("_leaf").to_pylist():
                opened += leaf.startswith(OPENS)
                at += 1
                blocks.append(opened)
                places.append(at)
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(blocks, pa.int64()), pa.array(places, pa.int64())], names=[*names, "_part", "_opened", "at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _part int, _opened long, at long"
    placed = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema))
    totals = placed.groupBy("_part").agg(F.max("_opened").alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("block", F.col("_before") + F.col("_opened")).withColumn("at", F.struct("_part", "at")).drop("_part", "_opened", "_before")


def blocks(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """block (from 0 or 1 on, ascending by keys), first and last (structs of keys), rows and digest. Equal rows are one leaf that tells how many they are; rows of equal keys stand by their hash. Null keys come first. An empty table has no block."""
    names = [f"k{i}" for i in range(len(keys))]
    leaves = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.sha2(encoded(columns), 256).alias("_h"))
    leaves = leaves.groupBy(*names, "_h").agg(F.count("*").alias("n")).withColumn("_leaf", F.sha2(F.concat("_h", F.lit(":"), F.col("n").cast("string")), 256)).drop("_h")
    placed = numbered(leaves, [*names, "_leaf"])
    key = F.struct(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)])
    return placed.groupBy("block").agg(F.min_by(key, "at").alias("first"), F.max_by(key, "at").alias("last"), F.sum("n").alias("rows"), digest_of().alias("digest"))


def digest_of() -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_leaf"))), lambda x: x["_leaf"]), ""), 256)


def root(found: DataFrame) -> str:
    """The digest of all blocks in their order; of no block, that of an empty text."""
    level = found.select(F.col("block").alias("b"), F.col("digest").alias("_leaf"))
    while level.count() > ROOT:
        level = numbered(level, ["b"]).groupBy("block").agg(digest_of().alias("_leaf")).withColumnRenamed("block", "b")
    return hashlib.sha256("".join(r["_leaf"] for r in level.orderBy("b").collect()).encode()).hexdigest()


def changed(one: DataFrame, other: DataFrame) -> DataFrame:
    """Ranges of keys (side, first, last, rows) whose rows differ: blocks that only one of the two tables' block tables has."""
    on = ["first", "last", "digest"]
    only = lambda a, b, side: a.join(b.select(*on), on, "left_anti").select(F.lit(side).alias("side"), "first", "last", "rows")
    return only(one, other, "one").unionByName(only(other, one, "other"))
