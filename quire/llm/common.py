"""Small helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, an empty string for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that spark.checkpoint.dir names; where none is set one of our own, but not on a cluster, where a folder of this machine would be lost or not seen."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quire-checkpoints"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed and cut off from its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: like a checkpoint, but compressed, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Groups whose shares are broadcast, at the most.
BROADCAST = 100_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_rows(df: DataFrame, group: str, most: int, key: str) -> DataFrame:
    """About `most` rows of every group at the most, picked by a hash of the key alone: the same rows for any partitioning. The groups' shares go to the rows, so no row is shuffled unless there are very many groups."""
    share = checkpoint(df.groupBy(group).agg((F.lit(most) / F.count("*")).alias("_share")))
    u = (F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    few = share.count() <= BROADCAST
    return df.join(F.broadcast(share) if few else share, group).filter(u < F.col("_share")).drop("_share")


#: A key is hot if it holds more than one of so many rows; so there are fewer hot keys than this, however large the table.
HOT = 1000


def joined_by_hot_key(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows with the columns of table, null where it has no such key (or the key is null). table: one row per key, with how many rows have it in the column weight.

    Fewer than HOT keys can hold more than one of HOT rows each: those are broadcast, so no task gets all rows of one; what is left is shuffled by key, at most one of HOT rows a key. table is read three times: give a table that is computed already.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.filter(F.col(weight) * HOT > total))
    wide = [c for c in table.columns if c not in (key, weight)]
    # rows of hot keys, and those without a key, have nothing to look for: a number of their own spreads them over all tasks
    light = table.filter(F.col(weight) * HOT <= total).select(key, (F.col(weight) - F.col(weight)).cast("long").alias("_apart"), *[F.col(c).alias(f"_{c}") for c in wide])
    met = rows.join(hot, key, "left").withColumn("_apart", F.when(F.col(weight).isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1))
    found = met.join(light, [key, "_apart"], "left")
    return found.select(*rows.columns, *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in wide])


_MADE: dict[str, object] = {}


def once(key: str, make):
    """What make() gives, made once in a Python worker for each key; a worker keeps two at the most."""
    if key not in _MADE:
        if len(_MADE) >= 2:
            _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def digest(value: object) -> str:
    """A key for once()."""
    return hashlib.sha256(pickle.dumps(value)).hexdigest()
