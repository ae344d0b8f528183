"""Publication of several tables as one: rows, the coverage rebuilt from them, metadata and findings in folders of one release, made active together by one pointer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("rows", "coverage", "metadata", "findings")


class Blocked(ValueError):
    """What may not be published, with the codes of all gates that it fails."""

    def __init__(self, codes: Sequence[str]):
        super().__init__("not published: " + ", ".join(codes))
        self.codes = list(codes)


class Conflict(ValueError):
    """Another writer has published since."""


def coverage(rows: DataFrame, work: str, chapter: str) -> DataFrame:
    """What there is of each work: chapters, entries."""
    return rows.groupBy(F.col(work).alias("work")).agg(F.countDistinct(chapter).alias("chapters"), F.count("*").alias("entries"))


def gates(head: dict, manifest: dict, rows: DataFrame, findings: DataFrame, key: Sequence[str], work: str, known: DataFrame, checksum: Column, sealed: str) -> list[str]:
    """Codes of the gates that a run fails, in order: its status, the errors it recorded, its findings, rows at all, places stood in once, known works, checksums as computed, the manifest's edition, the manifest's counts by work (where it declares any). key may be a range of places. Nulls in a key are a place, in a checksum a mismatch."""
    failed = []
    if head.get("status") != "verified":
        failed.append("status")
    if head.get("errors", 0):
        failed.append("recorded_errors")
    if findings.filter("severity = 'error'").limit(1).count():
        failed.append("error_findings")
    facts = rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(checksum == F.col(sealed), F.lit(False))).alias("torn")).first()
    if not facts["n"]:
        failed.append("no_rows")
    if rows.groupBy(*key).count().filter("count > 1").limit(1).count():
        failed.append("repeated_places")
    if rows.select(F.col(work).alias("work")).distinct().join(known.select("work"), "work", "left_anti").limit(1).count():
        failed.append("unknown_work")
    if facts["torn"]:
        failed.append("checksum")
    if manifest.get("edition") != head.get("edition") or not manifest.get("edition"):
        failed.append("manifest_edition")
    declared = manifest.get("counts")
    if declared is not None:
        wanted = rows.sparkSession.createDataFrame(list(declared.items()) or [], "work string, wanted long")
        held = rows.groupBy(F.col(work).cast("string").alias("work")).agg(F.count("*").alias("held"))
        if held.join(wanted, "work", "full").filter("NOT held <=> wanted").limit(1).count():
            failed.append("counts")
    return failed


class Releases:
    """Releases below root. Each state of the store is a pointer file of its own, pointer-<n>.json, created once and never replaced: whoever creates the next number has published, a second writer that started from the same state gets a Conflict (as sure as the file system's rename without overwriting). A crash before that leaves what was active, and a folder that nothing names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.hadoop.Path(self.root).getFileSystem(self.conf)

    def state(self) -> int:
        """The number of the newest pointer, 0 if nothing was published."""
        found = self.files.globStatus(self.hadoop.Path(f"{self.root}/pointer-*.json"))
        return max((int(f.getPath().getName()[8:-5]) for f in found or ()), default=0)

    def history(self, state: int | None = None) -> list[dict]:
        at = self.state() if state is None else state
        return json.loads(self.spark.read.text(f"{self.root}/pointer-{at:09d}.json", wholetext=True).first()[0]) if at else []

    def _point(self, base: int, history: list[dict]) -> None:
        fresh, target = (self.hadoop.Path(f"{self.root}/{n}") for n in (f"new-{uuid.uuid4()}", f"pointer-{base + 1:09d}.json"))
        out = self.files.create(fresh, False)
        out.write(bytearray(json.dumps(history).encode()))
        out.close()
        if self.state() != base:
            raise Conflict(f"state {base} is no longer the newest")
        options = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            self.hadoop.FileContext.getFileContext(self.files.getUri(), self.conf).rename(self.files.makeQualified(fresh), self.files.makeQualified(target), options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"state {base} is no longer the newest") from error
            raise

    def publish(self, head: dict, manifest: dict, rows: DataFrame, findings: DataFrame, key: Sequence[str], work: str, chapter: str, known: DataFrame, checksum: Column, sealed: str, base: int | None = None) -> int:
        """Publishes a run's rows with the coverage rebuilt from them, the manifest as metadata and its findings, if it passes all gates; otherwise Blocked, and nothing is written. base: the state that the caller has seen, the newest by default. Returns the new state; the same one if the content is what is active."""
        base = self.state() if base is None else base
        failed = gates(head, manifest, rows, findings, key, work, known, checksum, sealed)
        if failed:
            raise Blocked(failed)
        mark = rows.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")).cast("string")).first()
        history = self.history(base)
        fingerprint = f"{mark[0]}:{mark[1]}:{json.dumps(manifest, sort_keys=True)}"
        if history and history[-1]["fingerprint"] == fingerprint:
            return base
        folder = f"{self.root}/release-{uuid.uuid4()}"
        rows.write.parquet(f"{folder}/rows")
        stored = self.spark.read.parquet(f"{folder}/rows")  # what is counted is what is published
        coverage(stored, work, chapter).write.parquet(f"{folder}/coverage")
        self.spark.createDataFrame([(str(k), json.dumps(v, sort_keys=True)) for k, v in sorted(manifest.items())], "name string, value string").write.parquet(f"{folder}/metadata")
        findings.write.parquet(f"{folder}/findings")
        self._point(base, [*history, {"folder": folder, "fingerprint": fingerprint, "of": len(history) + 1}])
        return base + 1

    def rollback(self, base: int | None = None) -> int:
        """Makes the release before the active one active again, all its tables together, as a new state."""
        base = self.state() if base is None else base
        history = self.history(base)
        earlier = [h for i, h in enumerate(history, 1) if h["of"] == i and i < history[-1]["of"]]
        if not earlier:
            raise ValueError("there is no earlier release")
        self._point(base, [*history, earlier[-1]])
        return base + 1

    def table(self, name: str, state: int | None = None) -> DataFrame:
        """One of TABLES of the active release, or of the one that a state made active; read several with the state of one call, so that they belong together."""
        return self.spark.read.parquet(f"{self.history(state)[-1]['folder']}/{name}")
