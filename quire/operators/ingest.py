"""The life of an ingest: staging, findings, gates, and what is copied or registered once."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.text import name_id
from quire.operators.graph import settled
from quire.operators.lineage import Publications, replace_file


def normalised(rows: DataFrame, edition: str, work: str, chapter: str, verse: str, text: str) -> DataFrame:
    """Rows with text in normal form and single spaces, and checksum, SHA-256 of the typed sequence [edition, work, chapter, verse, text]."""
    clean = T.squeeze(T.nfc(F.col(text)))
    out = rows.withColumn(text, clean)
    return out.withColumn("checksum", T.sequence_checksum(T.json_text(F.col(edition)), T.json_text(F.col(work)), F.coalesce(F.col(chapter).cast("string"), F.lit("null")), F.coalesce(F.col(verse).cast("string"), F.lit("null")), T.json_text(F.col(text))))


def unexpected(observed: DataFrame, expected: DataFrame, keys: list[str], chapter: str, verse: str) -> DataFrame:
    """(keys, chapter, verse, code) of what lies beyond the declared coverage: expected has keys, chapters, and verses, a map from a chapter to its last verse, gaps included. A chapter without a number is not bounded."""
    joined = observed.select(*keys, chapter, verse).distinct().join(expected, keys, "left")
    last = F.try_element_at("verses", F.col(chapter))
    code = F.when(F.col("chapters").isNull(), "unexpected_work").when(F.col(chapter) > F.col("chapters"), "unexpected_chapter").when(F.col(verse) > last, "unexpected_verse")
    return joined.select(*keys, chapter, verse, code.alias("code")).filter("code IS NOT NULL")


def repeated_anchors(notes: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, kind, n, code, severity): several notes on one anchor are a warning, several introductions of one an error."""
    counts = notes.groupBy(*keys, kind).agg(F.count("*").alias("n")).filter("n > 1")
    note = F.col(kind).isin("verse", "verse_range")
    return counts.withColumn("code", F.when(note, "multiple_notes_at_anchor").otherwise("duplicate_identity")).withColumn("severity", F.when(note, "warning").otherwise("error"))


def missing_introductions(notes: DataFrame, work: str, chapter: str, kind: str) -> DataFrame:
    """(work, chapter, code) of books and chapters without an introduction; chapter is null for a book."""
    books, chapters = notes.select(work).distinct(), notes.filter(F.col(chapter).isNotNull()).select(work, chapter).distinct()
    no_book = books.join(notes.filter(F.col(kind) == "book_intro"), work, "left_anti").select(work, F.lit(None).cast(notes.schema[chapter].dataType).alias(chapter), F.lit("missing_book_intro").alias("code"))
    no_chapter = chapters.join(notes.filter(F.col(kind) == "chapter_intro"), [work, chapter], "left_anti").withColumn("code", F.lit("missing_chapter_intro"))
    return no_book.unionByName(no_chapter)


def canon_faults(entries: DataFrame, sizes: dict[str, int], part: str, order: str, code: str, works: str) -> DataFrame:
    """(code, detail) of what a counted canon must not be: another number of entries in a part, an order with gaps, codes used twice, entries without works, works with two owners."""
    parts = entries.groupBy(part).agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"), F.countDistinct(order).alias("orders"))
    wanted = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    one = lambda df, name, detail: df.select(F.lit(name).alias("code"), detail.cast("string").alias("detail"))
    found = one(parts.filter(F.coalesce(F.try_element_at(wanted, F.col(part)), F.lit(0)) != F.col("n")), "entry_count", F.col(part))
    found = found.unionByName(one(parts.filter("low <> 1 OR high <> n OR orders <> n"), "order_not_consecutive", F.col(part)))
    found = found.unionByName(one(entries.groupBy(code).agg(F.count("*").alias("n")).filter("n > 1"), "code_repeated", F.col(code)))
    found = found.unionByName(one(entries.filter(F.coalesce(F.size(works), F.lit(0)) < 1), "no_works", F.col(code)))
    owners = entries.select(code, F.explode(works).alias("work")).groupBy("work").agg(F.countDistinct(code).alias("n")).filter("n > 1")
    return found.unionByName(one(owners, "several_owners", F.col("work")))


def severity_counts(findings: DataFrame, group: str, severity: str) -> DataFrame:
    return findings.groupBy(group).agg(F.count_if(F.col(severity) == "error").alias("errors"), F.count_if(F.col(severity) == "warning").alias("warnings"))


@dataclass(frozen=True)
class Gate:
    """A condition on a run, and what to say where it fails."""

    code: str
    passes: Column


def blocked(runs: DataFrame, key: str, gates: list[Gate]) -> DataFrame:
    """(key, blocked): why each run may not be published, in the order of the gates; empty if it may. What is unknown doesn't pass."""
    return runs.select(key, F.array_compact(F.array(*[F.when(~F.coalesce(g.passes, F.lit(False)), g.code) for g in gates])).alias("blocked"))


def register(known: DataFrame, offered: DataFrame, key: str, value: str) -> DataFrame:
    """(key, outcome) of what is offered for registration: created if it is new, existing if the same is known, conflict if other content is. Nothing known is changed."""
    old = known.select(key, F.col(value).alias("_old"), F.lit(True).alias("_known"))
    new = offered.groupBy(key).agg(F.min(value).alias("_new"), F.countDistinct(value).alias("_n"), F.max(F.col(value).isNull()).alias("_gap"))
    joined = new.join(old, key, "left")
    outcome = F.when((F.col("_n") + F.col("_gap").cast("int")) > 1, "conflict").when(F.col("_known").isNull(), "created").when(F.col("_old").eqNullSafe(F.col("_new")), "existing").otherwise("conflict")
    return joined.select(key, outcome.alias("outcome"))


def find_or_create(known: DataFrame, wanted: DataFrame, key: str, number: str) -> DataFrame:
    """(key, number, created): known keys keep their numbers, new ones follow the greatest, in order of the key. Keys are ordered in ranges, each numbered from its own start, so none is ordered whole in one task; the ranges are settled before they are counted, so both uses see the same ones. Null keys get no number."""
    asked = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    fresh = asked.join(known, key, "left_anti")
    placed = settled(fresh.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    top = known.agg(F.max(number)).first()[0] or 0
    made = placed.join(F.broadcast(before), "_part").select(key, (F.col("_nth") + F.col("_before") + top + 1).alias(number), F.lit(True).alias("created"))
    return made.unionByName(known.join(asked, key, "left_semi").select(key, number, F.lit(False).alias("created")))


def guarded_copy(source: DataFrame, path: str, group: list[str]) -> int:
    """Copies source to the folder path, which must not exist or hold no rows, and returns how many rows there are. The copy is written beside it, its counts by group and a sum over its rows are compared with the source's, and one rename puts it in place: a crash before leaves the target as it was, and a copy that differs is taken away."""
    spark = source.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target, staged = hadoop.Path(path), f"{path}-{uuid.uuid4()}.staged"
    files = target.getFileSystem(conf)
    if files.exists(target):
        found = [f.getPath().getName() for f in files.listStatus(target)]
        if any(n.endswith(".parquet") for n in found) and spark.read.parquet(path).limit(1).count():
            raise ValueError("the target isn't empty")
    source.write.parquet(staged)
    copy = spark.read.schema(source.schema).parquet(staged)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)"))).first()
    if verified(source, copy, group).limit(1).count() or mark(source) != mark(copy):
        files.delete(hadoop.Path(staged), True)
        raise ValueError("the copy differs from its source")
    if files.exists(target):
        files.delete(target, True)  # holds no rows
    if not files.rename(hadoop.Path(staged), target):
        raise ValueError("the copy could not be put in place")
    return copy.sparkSession.read.parquet(path).count()


@dataclass(frozen=True)
class Kind:
    """A kind of record: its key, the fields that must agree, and for each link (field to kind) the kind whose key the field must name."""

    name: str
    key: str
    fields: tuple[str, ...]
    links: tuple[tuple[str, str], ...] = ()


def register_linked(kinds: list[Kind], known: dict[str, DataFrame], offered: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Outcomes (kind, id, key, outcome, fields) of records offered in several linked tables, and the rows to add to each: none at all if any record conflicts.

    An id hangs on kind and key alone. A record is created, existing (every field equal, null to null) or in conflict, and then `fields` names what differs: a field, one that is offered with several values, or a link to a key that is neither known nor offered. Null keys are left out. Kinds are given in order, what is linked to first.
    """
    keys: dict[str, DataFrame] = {}
    outcomes, fresh = [], {}
    for kind in kinds:
        old, new = known[kind.name], offered[kind.name].filter(F.col(kind.key).isNotNull())
        one = [F.first(f, ignorenulls=False).alias(f) for f in kind.fields]
        several = [F.when(F.min(F.struct(f)) != F.max(F.struct(f)), F.lit(f)) for f in kind.fields]
        merged = new.groupBy(kind.key).agg(*one, F.array_compact(F.array(*several)).alias("_several"))
        before = old.select(F.col(kind.key), F.lit(True).alias("_known"), *[F.col(f).alias(f"_old_{f}") for f in kind.fields])
        joined = merged.join(before, kind.key, "left")
        differs = F.array_compact(F.array(*[F.when(F.col("_known") & ~F.col(f).eqNullSafe(F.col(f"_old_{f}")), F.lit(f)) for f in kind.fields]))
        lost = []
        for field, other in kind.links:
            there = keys[other].select(F.col("_key").alias(field), F.lit(True).alias(f"_there_{field}"))
            joined = joined.join(there, field, "left")
            lost.append(F.when(F.col(field).isNotNull() & F.col(f"_there_{field}").isNull(), F.lit(f"link {field}")))
        bad = F.array_distinct(F.concat("_several", differs, F.array_compact(F.array(*lost)) if lost else F.array().cast("array<string>")))
        judged = joined.withColumn("_bad", bad)
        outcome = F.when(F.size("_bad") > 0, "conflict").when(F.col("_known"), "existing").otherwise("created")
        outcomes.append(judged.select(F.lit(kind.name).alias("kind"), name_id(kind.name, F.col(kind.key).cast("string")).alias("id"), F.col(kind.key).cast("string").alias("key"), outcome.alias("outcome"), F.array_join("_bad", ",").alias("fields")))
        fresh[kind.name] = judged.filter(F.col("_known").isNull()).select(kind.key, *kind.fields)
        keys[kind.name] = old.select(F.col(kind.key).alias("_key")).unionByName(new.select(F.col(kind.key).alias("_key"))).distinct()
    found = settled(reduce(DataFrame.unionByName, outcomes))
    if found.filter("outcome = 'conflict'").limit(1).count():
        fresh = {name: df.limit(0) for name, df in fresh.items()}
    return found, fresh


def verified(source: DataFrame, copy: DataFrame, group: list[str]) -> DataFrame:
    """(group, source, copy) of counts that differ between a table and its copy."""
    a, b = (df.groupBy(*group).agg(F.count("*").alias(name)) for df, name in ((source, "source"), (copy, "copy")))
    return a.join(b, group, "full").filter(~F.col("source").eqNullSafe(F.col("copy")))


class Runs:
    """Runs of an ingest: staged rows in partitions of a table, findings in another, and a small header for each, replaced in one step as its status moves."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def header(self, run: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/headers/{run}.json", wholetext=True).first()[0])

    def _head(self, run: str, **facts: object) -> dict:
        head = {"run": run, **facts}
        replace_file(self.spark, f"{self.root}/headers/{run}.json", json.dumps(head, sort_keys=True))
        return head

    def stage(self, run: str, rows: DataFrame) -> dict:
        """Writes a run's rows; staged again, they take the place of what was there."""
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/{run}")
        return self._head(run, status="staged", rows=self.rows(run).count(), errors=0, warnings=0)

    def rows(self, run: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows/{run}")

    def validate(self, run: str, findings: DataFrame) -> dict:
        """Replaces a run's findings (code, severity, ...); without an error among them, and with rows, it is verified."""
        findings.write.mode("overwrite").parquet(f"{self.root}/findings/{run}")
        found = self.spark.read.parquet(f"{self.root}/findings/{run}").groupBy("severity").agg(F.count("*").alias("n")).collect()
        counts = {r["severity"]: r["n"] for r in found}
        head = self.header(run)
        errors = counts.get("error", 0) + (head["rows"] == 0)
        return self._head(run, status="validated" if errors else "verified", rows=head["rows"], errors=errors, warnings=counts.get("warning", 0))

    def publish(self, run: str, key: str, store: Publications) -> int:
        """Publishes a verified run; others are refused."""
        if self.header(run)["status"] != "verified":
            raise ValueError("only verified runs are published")
        return store.publish(self.rows(run), key)
