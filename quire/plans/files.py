"""Files made of the tables and read back: archives, lines, JSON, XML, commentary, sinks and publications. What is written goes to the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ingest as I
from quire.operators.lineage import Publications
from quire.operators.scope import resolve
from quire.plans.registry import Tables, query
from quire.sources import files as S


def scratch(spark: SparkSession) -> str:
    """A new folder where spark.checkpoint.dir points; a temporary one only if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "quire-files")
    return f"{root}/files-{uuid.uuid4()}"


def written(df: DataFrame, kind: str, **options: str) -> str:
    path = scratch(df.sparkSession)
    df.write.format(kind).options(**options).save(path)
    return path


def _chapters(t: Tables) -> DataFrame:
    """Documents as books of a hundred: (book, c, v)."""
    id_ = F.col("doc_id")
    verse = F.struct((id_ % 10).cast("int").alias("n"), F.col("text").alias("t"))
    rows = t.documents.groupBy(F.floor(id_ / 100).alias("b"), (F.floor(id_ / 10) % 10).cast("int").alias("c")).agg(F.array_sort(F.collect_list(verse)).alias("v"))
    return rows.groupBy(F.concat(F.lit("b"), "b").alias("book")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("c", "v")))).alias("body"))


@query("SELECT 'b' || doc_id // 100 AS book, CAST(doc_id // 10 % 10 AS INT) AS chapter, CAST(doc_id % 10 AS INT) AS verse, md5(text) AS digest FROM documents")
def bundles(t: Tables) -> DataFrame:
    """Books zipped with fixed times, then read through the gate, with the digest that was declared for each."""
    members = _chapters(t).select("book", F.concat(F.lit("data/"), "book", F.lit(".json")).alias("member"), "body")
    archives = S.zipped(members, "book", "member", "body")
    rows = S.array_bundle(S.unzipped(archives, declared=archives.select("path", F.sha2("content", 256).alias("sha256"))))
    return rows.select("book", "chapter", "verse", F.md5("text").alias("digest"))


@query("SELECT 'b' || b AS path, CASE b % 4 WHEN 0 THEN 'another digest' WHEN 1 THEN 'unsafe name' WHEN 2 THEN 'BadZipFile' END AS fault FROM (SELECT DISTINCT doc_id // 100 AS b FROM documents)")
def bundle_faults(t: Tables) -> DataFrame:
    """Archives whose digest differs, whose member climbs, that are none, and sound ones."""
    number = F.substring("book", 2, 9).cast("int")
    name = F.concat(F.when(number % 4 == 1, "../x/").otherwise("data/"), "book", F.lit(".json"))
    archives = S.zipped(_chapters(t).select("book", name.alias("member"), "body"), "book", "member", "body")
    number = F.substring("path", 2, 9).cast("int")
    spoilt = archives.withColumn("content", F.when(number % 4 == 2, F.lit("none").cast("binary")).otherwise(F.col("content")))
    declared = spoilt.select("path", F.when(number % 4 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return S.unzipped(spoilt, declared=declared).select("path", "fault")


@query("SELECT lang AS edition, 'b' || doc_id // 100 AS book, CAST(doc_id // 10 % 10 AS INT) AS chapter, CAST(doc_id % 10 AS INT) AS verse, length(text) AS size FROM documents")
def edition_bundles(t: Tables) -> DataFrame:
    """Books that map editions to chapters."""
    id_ = F.col("doc_id")
    verses = t.documents.groupBy(F.floor(id_ / 100).alias("b"), "lang", (F.floor(id_ / 10) % 10).cast("int").alias("number")).agg(F.collect_list(F.struct((id_ % 10).cast("int").alias("number"), "text")).alias("verses"))
    editions = verses.groupBy("b", "lang").agg(F.struct(F.collect_list(F.struct("number", "verses")).alias("chapters")).alias("e"))
    books = editions.groupBy(F.concat(F.lit("b"), "b").alias("book")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "e"))).alias("editions"))
    members = books.select("book", F.concat("book", F.lit(".json")).alias("member"), F.to_json(F.struct("book", "editions")).alias("body"))
    return S.object_bundle(S.unzipped(S.zipped(members, "book", "member", "body"))).select("edition", "book", "chapter", "verse", F.length("text").alias("size"))


@query("SELECT source AS book, CAST(doc_id // 100 AS INT) AS chapter, CAST(doc_id % 100 AS INT) AS verse, CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang || ' ' || n_chars END AS text, doc_id % 9 = 0 AS blank FROM documents WHERE doc_id % 11 > 0")
def verse_lines(t: Tables) -> DataFrame:
    """Lines of verses, blank ones among them, and lines that are none."""
    place = F.concat("source", F.lit(" "), F.floor(F.col("doc_id") / 100), F.lit(":"), F.col("doc_id") % 100)
    line = F.when(F.col("doc_id") % 11 == 0, "no verse").when(F.col("doc_id") % 9 == 0, place).otherwise(F.concat(place, F.lit("  "), "lang", F.lit(" "), "n_chars"))
    return S.verse_lines(t.spark, written(t.documents.select(line.alias("value")), "text"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 > 0")
def json_lines(t: Tables) -> DataFrame:
    """JSON lines of which a tenth is cut off."""
    whole = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 10 == 0, F.substring(whole, 1, 9)).otherwise(whole)
    return S.json_lines(t.spark, written(t.events.select(line.alias("value")), "text"), "event_id long, event_type string")


@query("SELECT 'H' || p_partkey AS number, p_name AS word, p_brand AS meaning, d AS dialect FROM part, (SELECT unnest(['attributes', 'nested', 'strings']) AS d) WHERE p_partkey % 3 = CASE d WHEN 'attributes' THEN 0 WHEN 'nested' THEN 1 ELSE 2 END AND p_size > 2")
def lexicons(t: Tables) -> DataFrame:
    """Three dialects of XML; entries without a number are left out."""
    raw = F.when(F.col("p_size") > 2, F.concat(F.lit("x"), "p_partkey")).otherwise("none")
    some = lambda n: t.part.filter(F.col("p_partkey") % 3 == n)
    made = {
        "attributes": some(0).select(raw.alias("_id"), F.col("p_name").alias("w"), F.col("p_brand").alias("meaning")),
        "nested": some(1).select(F.struct(raw.alias("number"), F.col("p_name").alias("form")).alias("head"), F.col("p_brand").alias("gloss")),
        "strings": some(2).select(raw.alias("_strongs"), F.col("p_name").alias("_lemma"), F.col("p_brand").alias("_VALUE")),
    }
    read = [S.lexicon(t.spark, written(df, "xml", rowTag=S.DIALECTS[d][0], rootTag="all"), d, "H").withColumn("dialect", F.lit(d)) for d, df in made.items()]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("SELECT source AS work, CAST(NULL AS INT) AS chapter, CAST(NULL AS INT) AS first, CAST(NULL AS INT) AS last, 'book_intro' AS kind, 'About ' || source AS body FROM documents WHERE source <> 'src0' GROUP BY source UNION ALL SELECT source, CAST(doc_id // 100 AS INT), CAST(doc_id % 100 AS INT), CAST(doc_id % 100 + doc_id % 3 AS INT), 'note', lang || chr(10) || n_chars FROM documents")
def commentary_bundles(t: Tables) -> DataFrame:
    """Nested commentary: introductions of books, notes on verses and ranges."""
    first = F.col("doc_id") % 100
    number = F.when(F.col("doc_id") % 3 == 0, first.cast("string")).otherwise(F.concat_ws("-", first, first + F.col("doc_id") % 3))
    note = F.struct(F.lit("verse").alias("type"), number.alias("number"), F.array("lang", F.col("n_chars").cast("string")).alias("content"))
    chapters = t.documents.groupBy("source", F.floor(F.col("doc_id") / 100).cast("int").alias("number")).agg(F.collect_list(note).alias("content"))
    books = chapters.groupBy("source").agg(F.collect_list(F.struct("number", F.lit("").alias("introduction"), "content")).alias("chapters"))
    intro = F.when(F.col("source") != "src0", F.concat(F.lit("About "), "source")).otherwise("")
    return S.commentary(t.spark, written(books.select(F.array(F.struct(F.col("source").alias("id"), intro.alias("introduction"), "chapters")).alias("books")), "json", maxRecordsPerFile="1"))


@query("SELECT c_nationkey AS id, CASE n WHEN 1 THEN 'chapters_differ' WHEN 2 THEN 'empty_chapter' ELSE 'order_repeated' END AS code FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT unnest([1, 2, 3]) AS n) WHERE (n = 1 AND c_nationkey % 5 = 1) OR (n = 2 AND c_nationkey % 5 = 2) OR (n = 3 AND c_nationkey >= 22)")
def catalogue_faults(t: Tables) -> DataFrame:
    """Books whose chapters and counts disagree, with an empty chapter, or in one place of the order."""
    key = F.col("c_nationkey")
    books = t.customer.select("c_nationkey").distinct().select(
        key.alias("id"), F.lit("n").alias("name"), F.least(key, F.lit(22)).alias("order"), F.when(key % 5 == 1, 3).otherwise(2).alias("chapters"), F.array(F.lit(4), F.when(key % 5 == 2, 0).otherwise(7)).alias("verses"),
    )
    return S.catalogue_faults(books)


@query("WITH c AS (SELECT conv_id AS work, turn // 4 AS chapter, turn % 4 AS p, role AS anchor, length(text) AS size FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY work, chapter ORDER BY p) - 1 AS spot FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY work, chapter, anchor ORDER BY p) AS n, count(*) OVER (PARTITION BY work, chapter, anchor) AS m FROM k WHERE spot <> 1) SELECT work, chapter, work || ':' || chapter || ':' || anchor || CASE WHEN m > 1 THEN '#' || n ELSE '' END AS locator, size FROM s")
def chapter_notes(t: Tables) -> DataFrame:
    """Entries of a chapter's list but the excluded ones, numbered where several stand at one anchor."""
    content = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("anchor"), F.col("text").alias("body")))), lambda x: F.struct(x["anchor"].alias("anchor"), x["body"].alias("body")))
    chapters = t.conversations.groupBy(F.col("conv_id").alias("work"), F.floor(F.col("turn") / 4).alias("chapter")).agg(content.alias("content"))
    return S.chapter_notes(chapters, [1]).select("work", "chapter", "locator", F.length("body").alias("size"))


@query("SELECT c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN -c_custkey ELSE c_custkey END AS c_custkey FROM customer")
def partition_sink(t: Tables) -> DataFrame:
    """One partition replaced, the others as they were."""
    path = scratch(t.spark)
    S.replace_partitions(t.customer.select("c_mktsegment", "c_custkey"), path, "c_mktsegment")
    S.replace_partitions(t.customer.filter("c_mktsegment = 'BUILDING'").select("c_mktsegment", (-F.col("c_custkey")).alias("c_custkey")), path, "c_mktsegment")
    return t.spark.read.schema("c_mktsegment string, c_custkey long").parquet(path)


@query("SELECT n, count(*) AS rows, sum(l_quantity)::DOUBLE AS quantity FROM lineitem, (SELECT unnest([1, 2]) AS n) GROUP BY n")
def snapshot_sink(t: Tables) -> DataFrame:
    """Two publications appended; neither changes the other."""
    path = scratch(t.spark)
    for n in (1, 2):
        S.append_snapshot(t.lineitem.select(F.lit(n).alias("n"), "l_quantity"), path, "n")
    return t.spark.read.schema("n int, l_quantity double").parquet(path).groupBy("n").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))


@query("SELECT s_suppkey, s_name FROM supplier")
def publication_cycle(t: Tables) -> DataFrame:
    """Published, changed, rolled back: the first state is active again."""
    store = Publications(t.spark, scratch(t.spark))
    rows = t.supplier.select("s_suppkey", "s_name")
    store.publish(rows, "s_suppkey")
    store.publish(rows.withColumn("s_name", F.upper("s_name")).filter("s_suppkey > 1"), "s_suppkey")
    store.rollback()
    return store.active()


@query("SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def canonical_rows(t: Tables) -> DataFrame:
    return S.canonical_json(t.nation.select("n_regionkey", "n_nationkey", "n_name"))


def _roman(number: Column) -> Column:
    tens, ones = "  X XX XXX XL L".split(" ")[1:], "  I II III IV V VI VII VIII IX".split(" ")[1:]
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    return F.concat(at(tens, F.floor(number / 10)), at(ones, number % 10))


@query("SELECT p_partkey, p_size AS number FROM part")
def roman_numerals(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.roman(F.lower(_roman(F.col("p_size")))).alias("number"))


_HEX, _LETTERS = "0123456789ABCDEF", "abcdefghijklmnop"


def _lettered(text: Column) -> Column:
    """A name of letters alone, another one for each text; an empty text and none have theirs too."""
    return F.coalesce(F.concat(F.lit("src"), F.translate(F.hex(text), _HEX, _LETTERS)), F.lit("none"))


def _unlettered(name: Column) -> Column:
    return F.when(name.startswith("src"), F.unhex(F.translate(F.substr(name, F.lit(4)), _LETTERS, _HEX)).cast("string"))


@query("SELECT doc_id, source AS book, CAST(doc_id // 100 + 1 AS INT) AS chapter, CAST(doc_id % 100 AS INT) AS first, CAST(doc_id % 100 + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS INT) AS last FROM documents")
def reference_parts(t: Tables) -> DataFrame:
    """References written and taken apart again, with and without a range, to books named by letters for whatever a source is called."""
    first = F.col("doc_id") % 100
    said = F.concat(_lettered(F.col("source")), F.lit(" "), F.floor(F.col("doc_id") / 100) + 1, F.lit(":"), first, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("-"), first + 3)).otherwise(""))
    read = t.documents.select("doc_id", T.parsed_reference(said).alias("r"))
    return read.select("doc_id", _unlettered(F.col("r.book")).alias("book"), "r.chapter", "r.first", "r.last")


@query("SELECT event_id, 'user-' || user_id || ',' || event_type AS mentions, 'event:' || event_id AS cited, length(event_type) + 5 AS escaped, event_id % 4 = 1 AS control FROM events WHERE user_id >= 0")
def marks_in_text(t: Tables) -> DataFrame:
    """Mentions, citations, path segments and control characters in text that is made of events."""
    said = F.concat(F.lit("to @user-"), "user_id", F.lit(" and @"), "event_type", F.lit(" a@bcd ["), F.lit("event:"), "event_id", F.lit("] [x] [event:"), "event_id", F.lit("]"), F.when(F.col("event_id") % 4 == 1, F.lit("\x07")).otherwise(""))
    path = T.path_segment(F.concat("event_type", F.lit(" /")).substr(F.lit(1), F.length("event_type") + 2))
    return t.events.filter("user_id >= 0").select("event_id", F.array_join(T.mentions(said), ",").alias("mentions"), F.array_join(T.citations(said), ",").alias("cited"), (F.length(path) - 1).alias("escaped"), T.has_control(said).alias("control"))


_sha = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('nation:' || n_name))"


@query(f"SELECT n_name, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || CASE WHEN s[17] IN ('0', '4', '8', 'c') THEN '8' WHEN s[17] IN ('1', '5', '9', 'd') THEN '9' WHEN s[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || s[18:20] || '-' || s[21:32] AS id FROM (SELECT n_name, {_sha} AS s FROM nation)")
def named_ids(t: Tables) -> DataFrame:
    """Ids that follow from names."""
    return t.nation.select("n_name", T.name_id("nation", F.col("n_name")).alias("id"))


@query("SELECT run, 'verified' AS status, n AS rows, 0::BIGINT AS errors, n // 5 AS warnings FROM (SELECT 'a' AS run, count(*) AS n FROM supplier) UNION ALL SELECT 'b', 'validated', count(*), count(*) FILTER (s_acctbal < 0), 0 FROM supplier UNION ALL SELECT 'c', 'validated', 0, 1, 0")
def ingest_runs(t: Tables) -> DataFrame:
    """Three runs staged and validated: one sound but for warnings, one with errors, one without rows."""
    runs = I.Runs(t.spark, scratch(t.spark))
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    finding = lambda df, severity: df.select(F.lit("code").alias("code"), F.lit(severity).alias("severity"))
    heads = []
    for run, staged, found in (("a", rows, finding(rows.filter("s_suppkey % 5 = 0"), "warning")), ("b", rows, finding(rows.filter("s_acctbal < 0"), "error")), ("c", rows.limit(0), finding(rows.limit(0), "error"))):
        runs.stage(run, staged)
        heads.append(runs.validate(run, found))
    return t.spark.createDataFrame([(h["run"], h["status"], h["rows"], h["errors"], h["warnings"]) for h in heads], "run string, status string, rows long, errors long, warnings long")


@query("SELECT doc_id, source AS book, CASE WHEN doc_id % 3 = 0 THEN 'first_' WHEN doc_id % 3 = 1 THEN 'second_' ELSE '' END || source || '.' || doc_id // 100 || '.' || doc_id % 100 AS key FROM documents")
def canonical_keys(t: Tables) -> DataFrame:
    label = F.concat(F.when(F.col("doc_id") % 3 == 0, "1 ").when(F.col("doc_id") % 3 == 1, "2").otherwise(" "), F.upper("source"))
    return t.documents.select("doc_id", F.col("source").alias("book"), T.canonical_key(label, F.floor(F.col("doc_id") / 100), F.col("doc_id") % 100).alias("key"))


@query("SELECT doc_id, source AS work, CAST(doc_id // 100 + 1 AS INT) AS chapter, CAST(doc_id % 100 AS INT) AS first FROM documents")
def abbreviated_references(t: Tables) -> DataFrame:
    """References by names of letters in another case, with a full stop or a colon before the verse, resolved by a dictionary."""
    short = F.initcap(_lettered(F.col("source")))
    names = t.documents.select(short.alias("alias"), F.col("source").alias("work")).distinct()
    said = F.concat(short, F.when(F.col("doc_id") % 2 == 0, ". ").otherwise(" "), F.floor(F.col("doc_id") / 100) + 1, F.when(F.col("doc_id") % 3 == 0, ".").otherwise(":"), F.col("doc_id") % 100)
    read = t.documents.select("doc_id", T.parsed_reference(said).alias("r")).select("doc_id", "r.*")
    return resolve(read, "book", names).select("doc_id", "work", "chapter", "first")


@query("SELECT page_id, 1 AS chapter, n AS verse, CASE n WHEN 1 THEN 'begins ' || page_id || ' goes on' ELSE 'second of ' || page_id || ' E more' END AS text FROM pages, (SELECT unnest([1, 2]) AS n) UNION ALL SELECT page_id, 2, 1, 'next ' || page_id FROM pages")
def recension_prose(t: Tables) -> DataFrame:
    """Prose of two chapters and three recensions, of which one is kept, one verse number in its midst."""
    id_ = F.col("page_id").cast("string")
    text = F.concat(F.lit("Preface 1. none.\n\nI. 1. begins "), id_, F.lit("\n\nG^g\n\n  1. other words\n\nE\n\n  goes on 2. second of "), id_, F.lit(" E more\n\nII. next "), id_)
    return S.recension_verses(t.pages.select("page_id", text.alias("text")), "page_id", "text")
