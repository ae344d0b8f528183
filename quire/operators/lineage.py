"""Versions: lineage, publication by pointer, rollback, and what differs between two states."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))).filter("_n = 1").drop("_n")


def predecessors(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with version (from 1) and previous, the value of the version before."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("version", F.row_number().over(window).cast("long")).withColumn("previous", F.lag(value).over(window))


def sync(target: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action): insert, update or delete what makes target equal source; equal rows are left out, nulls are equal."""
    t, s = target.select(F.col(key), F.col(value).alias("_old"), F.lit(True).alias("_t")), source.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_s"))
    joined = t.join(s, key, "full")
    action = F.when(F.col("_t").isNull(), "insert").when(F.col("_s").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    return joined.select(key, action.alias("action")).filter("action IS NOT NULL")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after) of counts that differ; a side without the key differs from every count."""
    a, b = (df.groupBy(*keys).agg(F.count("*").alias(name)) for df, name in ((before, "before"), (after, "after")))
    return a.join(b, keys, "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def table_digest(df: DataFrame, group: list[str], row: str) -> DataFrame:
    """(group, rows, digest), the same for any order of rows: the exact sum and the bitwise sum of each row's first sixty bits of SHA-256. Two partial aggregates in place of one long list."""
    bits = F.conv(F.substring(F.sha2(F.col(row), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*group).agg(F.count("*").alias("rows"), F.sum(bits).cast("string").alias("digest"))


def replace_file(spark: SparkSession, path: str, content: str) -> None:
    """Puts a small file in place in one step: readers see the old one or the new one, whatever happens between."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    target, fresh = hadoop.Path(path), hadoop.Path(f"{path}-{uuid.uuid4()}.new")
    files = target.getFileSystem(sc._jsc.hadoopConfiguration())
    out = files.create(fresh, True)
    out.write(bytearray(content.encode()))
    out.close()
    kind = getattr(hadoop, "Options$Rename")
    options = sc._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), sc._jsc.hadoopConfiguration()).rename(files.makeQualified(fresh), files.makeQualified(target), options)


class Publications:
    """Snapshots of an edition in folders of their own, never written twice; one small pointer file, put in place last and in one step, names the active one. A crash before that step leaves what was active. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointer.json")
        self.files = self.pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def history(self) -> list[dict]:
        """Publications from the first to the active one: version, folder, fingerprint, of (the version that a rollback restored)."""
        if not self.files.exists(self.pointer):
            return []
        return json.loads(self.spark.read.text(f"{self.root}/pointer.json", wholetext=True).first()[0])

    def _point(self, history: list[dict]) -> None:
        replace_file(self.spark, f"{self.root}/pointer.json", json.dumps(history))

    def publish(self, rows: DataFrame, key: str, faults: DataFrame | None = None) -> int:
        """The active version afterwards. Nothing changes if the rows are those already active. Refused: no rows, repeated keys, or any fault of severity error."""
        if faults is not None and faults.filter("severity = 'error'").limit(1).count():
            raise ValueError("rows with errors are not published")
        if rows.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ValueError("keys are not unique")
        mark = rows.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")).cast("string")).first()
        if not mark[0]:
            raise ValueError("no rows")
        history, fingerprint = self.history(), f"{mark[0]}:{mark[1]}"
        if history and history[-1]["fingerprint"] == fingerprint:
            return history[-1]["version"]
        version = len(history) + 1
        folder = f"{self.root}/version={version}-{uuid.uuid4()}"
        rows.write.mode("error").parquet(folder)
        self._point([*history, {"version": version, "folder": folder, "fingerprint": fingerprint, "of": version}])
        return version

    def rollback(self) -> int:
        """Publishes the content before the active one again, as a new version; a further rollback goes on from there, never back and forth."""
        history = self.history()
        active = history[-1] if history else None
        earlier = [h for h in history if active and h["of"] == h["version"] and h["version"] < active["of"]]
        if not earlier:
            raise ValueError("there is no earlier version")
        version = len(history) + 1
        self._point([*history, earlier[-1] | {"version": version, "of": earlier[-1]["version"]}])
        return version

    def active(self) -> DataFrame:
        return self.spark.read.parquet(self.history()[-1]["folder"])
