"""Ingest: normal rows, findings, gates and lifecycle, canon and coverage audits, registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import prose as P
from quire.functions import text as T
from quire.operators import ingest as I
from quire.operators import quality as Q
from quire.operators import releases as R
from quire.plans.files import scratch
from quire.plans.readers import _notes, notes
from quire.plans.registry import Tables, query


@query("SELECT doc_id, sha256(text) AS digest, sha256('[\"' || lang || '\",\"' || source || '\",' || doc_id // 100 || ',' || doc_id % 100 || ',\"' || replace(replace(text, '\\', '\\\\'), '\"', '\\\"') || '\"]') AS checksum FROM (SELECT doc_id, lang, source, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS text FROM documents)")
def normalised_rows(t: Tables) -> DataFrame:
    """Staged rows: text in normal form with single spaces, and a checksum of the typed row."""
    rows = t.documents.select("doc_id", "lang", "source", F.floor(F.col("doc_id") / 100).alias("chapter"), (F.col("doc_id") % 100).alias("verse"), "text")
    return I.normalised(rows, "lang", "source", "chapter", "verse", "text").select("doc_id", F.sha2("text", 256).alias("digest"), "checksum")


@query("SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS size FROM documents")
def paragraph_form(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(P.paragraphs(F.col("text"))).cast("long").alias("size"))


@query("SELECT p_partkey, p_partkey % 8 IN (1, 2, 4, 5, 7) AS markup FROM part")
def prose_markup(t: Tables) -> DataFrame:
    """Markup told from comparisons: an element, a declaration, prose, an attribute, a hyphenated name, an unfinished unknown tag, an unfinished element."""
    name = F.col("p_name")
    forms = [name, F.concat(F.lit("<b>"), name), F.concat(F.lit("<!-- "), name), F.concat(name, F.lit(" a < b and 1<2")), F.concat(F.lit("<x y='1'>"), name), F.concat(F.lit("<my-tag>"), name), F.concat(F.lit("<unknown "), name), F.concat(name, F.lit(" <div "))]
    said = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", P.has_prose_markup(said).alias("markup"))


@query("SELECT p_partkey, p_partkey % 8 <> 0 AND p_partkey % 8 <> 7 AS placeholder FROM part")
def placeholder_rows(t: Tables) -> DataFrame:
    forms = [F.col("p_name"), F.lit("TBD..."), F.lit("Text unavailable for this book"), F.lit("[text not-yet-added]"), F.lit("Awaiting  source upload"), F.lit("Lorem ipsum dolor"), F.lit(" - "), F.concat(F.lit("[a "), "p_name", F.lit("]"))]
    said = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", T.is_placeholder(said).alias("placeholder"))


@query("SELECT page_id, page_id % 7 IN (1, 2, 3, 5) AS secret FROM pages")
def secret_urls(t: Tables) -> DataFrame:
    """Parameters that tell of secrets, in the query or the fragment."""
    ends = ["?page=2", "?api_key=1", "?a=1&accessToken=x", "#id_token=3", "#part", "?X-Signing-Key=z", "?monkey=1"]
    url = F.concat(F.regexp_replace("url", r"\?.*$", ""), F.element_at(F.array(*map(F.lit, ends)), (F.col("page_id") % 7 + 1).cast("int")))
    return t.pages.select("page_id", T.secret_url(url).alias("secret"))


@query(f"WITH n AS ({_notes}), e AS (SELECT work, 3 AS chapters FROM n WHERE work NOT IN ('src7', 'src8') GROUP BY 1) SELECT DISTINCT n.work, chapter, first, CASE WHEN e.work IS NULL THEN 'unexpected_work' WHEN chapter > 3 THEN 'unexpected_chapter' ELSE 'unexpected_verse' END AS code FROM n LEFT JOIN e ON n.work = e.work WHERE e.work IS NULL OR chapter > 3 OR chapter = 1 AND first > 30")
def unexpected_coverage(t: Tables) -> DataFrame:
    """Works, chapters and verses beyond what is declared: three chapters of each work, thirty verses of the first."""
    declared = t.documents.filter("source NOT IN ('src7', 'src8')").select(F.col("source").alias("work")).distinct()
    declared = declared.select("work", F.lit(3).alias("chapters"), F.create_map(F.lit(1).cast("long"), F.lit(30).cast("long")).alias("verses"))
    return I.unexpected(notes(t), declared, ["work"], "chapter", "first")


_kinds = f"SELECT id, work, chapter, first, last, CASE WHEN chapter IS NULL THEN 'book_intro' WHEN first IS NULL THEN 'chapter_intro' WHEN first = last THEN 'verse' ELSE 'verse_range' END AS kind FROM ({_notes})"


def kinds(t: Tables) -> DataFrame:
    kind = F.when(F.col("chapter").isNull(), "book_intro").when(F.col("first").isNull(), "chapter_intro").when(F.col("first") == F.col("last"), "verse").otherwise("verse_range")
    return notes(t).select("id", "work", "chapter", "first", "last", kind.alias("kind"))


@query(f"SELECT work, chapter, first, last, kind, count(*) AS n, CASE WHEN kind IN ('verse', 'verse_range') THEN 'multiple_notes_at_anchor' ELSE 'duplicate_identity' END AS code, CASE WHEN kind IN ('verse', 'verse_range') THEN 'warning' ELSE 'error' END AS severity FROM ({_kinds}) GROUP BY ALL HAVING count(*) > 1")
def repeated_anchors(t: Tables) -> DataFrame:
    return I.repeated_anchors(kinds(t), ["work", "chapter", "first", "last"], "kind")


@query(f"WITH k AS (SELECT * REPLACE (work || '/' || id % 41 AS work) FROM ({_kinds})) SELECT DISTINCT work, NULL::BIGINT AS chapter, 'missing_book_intro' AS code FROM k WHERE work NOT IN (SELECT work FROM k WHERE kind = 'book_intro') UNION ALL SELECT DISTINCT work, chapter, 'missing_chapter_intro' FROM k a WHERE chapter IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k b WHERE b.kind = 'chapter_intro' AND b.work = a.work AND b.chapter = a.chapter)")
def missing_introductions(t: Tables) -> DataFrame:
    """Notes by work and edition: what lacks its introduction."""
    return I.missing_introductions(kinds(t).withColumn("work", F.concat("work", F.lit("/"), F.col("id") % 41)), "work", "chapter", "kind")


@query(f"SELECT 'row' AS code, min(id) AS first, count(*) AS n FROM (SELECT min(id) AS id, work, chapter, first, last, sha256(text) AS body FROM ({_notes}) GROUP BY id, work, chapter, first, last, text) GROUP BY work, chapter, first, last, body HAVING count(*) > 1 UNION ALL SELECT 'locator', min(id), count(*) FROM ({_notes}) GROUP BY work || '#' || coalesce(CAST(chapter AS VARCHAR), '') || ':' || coalesce(CAST(first AS VARCHAR), '') HAVING count(*) > 1")
def duplicate_rows_and_locators(t: Tables) -> DataFrame:
    """Equal rows, and rows that give the same place as their source: two keys, two findings."""
    rows = notes(t).withColumn("body", F.sha2("text", 256)).drop("text")
    locator = F.concat("work", F.lit("#"), F.coalesce(F.col("chapter").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("first").cast("string"), F.lit("")))
    found = lambda df, keys, code: df.groupBy(*keys).agg(F.min("id").alias("_id"), F.count("*").alias("n")).filter("n > 1").select(F.lit(code).alias("code"), F.col("_id").alias("first"), "n")
    return found(rows, ["work", "chapter", "first", "last", "body"], "row").unionByName(found(rows.withColumn("locator", locator), ["locator"], "locator"))


@query(f"SELECT work, array_to_string(list_sort(list(DISTINCT chapter)), ',') AS chapters, count(*) AS entries, (SELECT count(DISTINCT work) FROM documents d2 JOIN (SELECT DISTINCT work FROM ({_notes})) ON source = work) AS books, (SELECT count(*) FROM (SELECT DISTINCT work, chapter FROM ({_notes}) WHERE chapter IS NOT NULL)) AS all_chapters FROM ({_notes}) GROUP BY work")
def commentary_coverage(t: Tables) -> DataFrame:
    """Chapters and entries of each book, beside the totals of all, which are made of the books' own."""
    each = notes(t).groupBy("work").agg(F.array_sort(F.collect_set("chapter")).alias("chapters"), F.count("*").alias("entries"))
    books, chapters = each.agg(F.count("*"), F.coalesce(F.sum(F.size("chapters")), F.lit(0))).first()
    return each.select("work", F.array_join("chapters", ",").alias("chapters"), "entries", F.lit(books).alias("books"), F.lit(chapters).alias("all_chapters"))


@query("SELECT source, string_agg(lang || '=' || last, ',' ORDER BY lang) AS texts FROM (SELECT source, lang, arg_max(n_chars, doc_id) AS last FROM documents GROUP BY ALL) GROUP BY source")
def texts_by_edition(t: Tables) -> DataFrame:
    """A map from edition to the value of its last passage."""
    last = t.documents.groupBy("source", "lang").agg(F.max_by("n_chars", "doc_id").alias("n"))
    entries = last.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("m"))
    return entries.select("source", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("texts"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS errors, count(*) FILTER (o_orderstatus = 'O') AS warnings FROM orders GROUP BY 1")
def severity_counts(t: Tables) -> DataFrame:
    named = t.orders.withColumn("severity", F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning"))
    return I.severity_counts(named, "o_custkey", "severity")


@query("SELECT l_suppkey, sum(greatest(0, last - n))::BIGINT AS gaps FROM (SELECT l_suppkey, l_returnflag, max(l_linenumber) AS last, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY ALL) GROUP BY 1")
def declared_gap_count(t: Tables) -> DataFrame:
    """Gaps declared as a map from chapter to its missing verses, counted."""
    each = t.lineitem.filter("l_quantity > 30").groupBy("l_suppkey", "l_returnflag").agg(F.collect_set("l_linenumber").alias("there"))
    gaps = F.array_except(F.sequence(F.lit(1), F.array_max("there")), "there")
    maps = each.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", gaps.alias("gaps")))).alias("m"))
    return maps.select("l_suppkey", F.aggregate(F.map_values("m"), F.lit(0), lambda s, x: s + F.size(x)).cast("long").alias("gaps"))


@query("SELECT o_custkey, count(*) AS runs, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def manifest_digest(t: Tables) -> DataFrame:
    """One digest over the members of each manifest, the orders of a customer, in their order. A manifest is a list that fits a row; tables of any size have `ordered_digest`."""
    member = F.struct("o_orderkey", F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("m"))
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("runs"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"]), ","), 256).alias("digest"))


@query("SELECT sum(o)::BIGINT AS orders, sum(l)::BIGINT AS lines, sum(c)::BIGINT AS customers FROM (SELECT count(*) AS o, 0 AS l, 0 AS c FROM orders UNION ALL SELECT 0, count(*), 0 FROM lineitem UNION ALL SELECT 0, 0, count(*) FROM customer WHERE c_acctbal > 0)")
def registration_totals(t: Tables) -> DataFrame:
    """Totals over unlike results, each with columns of its own."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = one(t.orders, "orders").unionByName(one(t.lineitem, "lines"), allowMissingColumns=True).unionByName(one(t.customer.filter("c_acctbal > 0"), "customers"), allowMissingColumns=True)
    return parts.agg(*[F.sum(c).alias(c) for c in ("orders", "lines", "customers")])


@query("SELECT l_orderkey, count(DISTINCT n) = max(n) AND min(n) = 1 AS complete FROM (SELECT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_linenumber <> 2 OR l_returnflag <> 'N' UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'F') WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 2 OR l_returnflag <> 'N') GROUP BY 1")
def contiguous_verses(t: Tables) -> DataFrame:
    """Whether verses, with the gaps that are declared, run from 1 to the last."""
    from quire.sources.files import contiguous

    seen = t.lineitem.filter("l_linenumber <> 2 OR l_returnflag <> 'N'").select("l_orderkey", F.col("l_linenumber").alias("verse"))
    declared = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(2).alias("verse"))
    return contiguous(seen, ["l_orderkey"], declared.join(seen, "l_orderkey", "left_semi"))


@query("SELECT 'code_repeated' AS code, CAST(n_nationkey // 2 AS VARCHAR) AS detail FROM nation GROUP BY n_nationkey // 2 HAVING count(*) > 1 UNION ALL SELECT 'entry_count', CAST(n_regionkey AS VARCHAR) FROM nation GROUP BY n_regionkey HAVING count(*) <> CASE n_regionkey WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 0 END UNION ALL SELECT 'order_not_consecutive', CAST(n_regionkey AS VARCHAR) FROM nation GROUP BY n_regionkey HAVING min(n_nationkey // 5 + 1) <> 1 OR max(n_nationkey // 5 + 1) <> count(*) OR count(DISTINCT n_nationkey // 5 + 1) <> count(*) UNION ALL SELECT 'no_works', CAST(n_nationkey // 2 AS VARCHAR) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'several_owners', CAST(s AS VARCHAR) FROM (SELECT DISTINCT s_suppkey % 40 AS s, s_nationkey // 2 AS o FROM supplier) GROUP BY s HAVING count(DISTINCT o) > 1")
def canon_faults(t: Tables) -> DataFrame:
    """What a counted canon must not be, with nations as entries and suppliers as their works."""
    works = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_set(F.col("s_suppkey") % 40).alias("works"))
    entries = t.nation.join(works, "n_nationkey", "left").select(F.col("n_regionkey").cast("string").alias("part"), (F.floor(F.col("n_nationkey") / 5) + 1).alias("place"), F.floor(F.col("n_nationkey") / 2).alias("entry"), "works")
    return I.canon_faults(entries, {"0": 5, "1": 4}, "part", "place", "entry", "works")


@query("WITH r AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS errors, count(DISTINCT o_orderdate) AS places, max(o_orderstatus) AS status FROM orders GROUP BY 1) SELECT c_custkey, array_to_string(list_filter([CASE WHEN status IS DISTINCT FROM 'O' THEN 'not_verified' END, CASE WHEN errors IS NULL OR errors > 5 THEN 'errors' END, CASE WHEN n IS NULL THEN 'no_rows' END, CASE WHEN places IS NULL OR places <> n THEN 'positions_not_unique' END, CASE WHEN c_acctbal < 0 THEN 'checksum_differs' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'manifest_invalid' END], lambda x: x IS NOT NULL), ',') AS blocked FROM customer LEFT JOIN r ON o_custkey = c_custkey")
def publish_gates(t: Tables) -> DataFrame:
    """Every gate of publication, at each run: why it is blocked."""
    facts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("errors"), F.countDistinct("o_orderdate").alias("places"), F.max("o_orderstatus").alias("status"))
    gates = [I.Gate("not_verified", F.col("status") == "O"), I.Gate("errors", F.col("errors") <= 5), I.Gate("no_rows", F.col("n") > 0), I.Gate("positions_not_unique", F.col("places") == F.col("n")), I.Gate("checksum_differs", F.col("c_acctbal") >= 0), I.Gate("manifest_invalid", F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"))]
    return I.blocked(t.customer.join(facts, "c_custkey", "left"), "c_custkey", gates).select("c_custkey", F.array_join("blocked", ",").alias("blocked"))


@query("SELECT p_partkey, CASE WHEN k IS NULL THEN 'created' WHEN v = p_brand THEN 'existing' ELSE 'conflict' END AS outcome FROM part LEFT JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN 'other' ELSE p_brand END AS v FROM part WHERE p_partkey % 3 > 0) ON k = p_partkey")
def legacy_registration(t: Tables) -> DataFrame:
    known = t.part.filter("p_partkey % 3 > 0").select("p_partkey", F.when(F.col("p_size") > 40, "other").otherwise(F.col("p_brand")).alias("p_brand"))
    return I.register(known, t.part, "p_partkey", "p_brand")


@query("WITH k AS (SELECT DISTINCT source AS name, CAST(substring(source, 4) AS BIGINT) AS number FROM documents WHERE CAST(substring(source, 4) AS INT) < 10), w AS (SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT lang || '-' || source FROM documents WHERE n_chars > 9000) SELECT name, number, FALSE AS created FROM k WHERE name IN (SELECT name FROM w) UNION ALL SELECT name, (SELECT max(number) FROM k) + row_number() OVER (ORDER BY name), TRUE FROM w WHERE name NOT IN (SELECT name FROM k)")
def find_or_create(t: Tables) -> DataFrame:
    number = F.substring("source", 4, 9).try_cast("long")
    known = t.documents.filter(number < 10).select(F.col("source").alias("name"), number.alias("number")).distinct()
    wanted = t.documents.select(F.col("source").alias("name")).union(t.documents.filter("n_chars > 9000").select(F.concat_ws("-", "lang", "source")))
    return I.find_or_create(known, wanted, "name", "number")


@query("SELECT c.conv_id, c.turn, coalesce(CAST(u.c_custkey AS VARCHAR), 'unmapped') AS author FROM conversations c LEFT JOIN customer u ON u.c_custkey = c.conv_id + 1400 WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id * 7 + c.turn)")
def forum_migration(t: Tables) -> DataFrame:
    """Legacy posts that aren't here yet, each with its author or reported as unmapped; a second run adds nothing."""
    posts = t.conversations.select("conv_id", "turn", (F.col("conv_id") * 7 + F.col("turn")).alias("doc_id"), (F.col("conv_id") + 1400).alias("c_custkey"))
    fresh = posts.join(t.labels, "doc_id", "left_anti").join(t.customer.select("c_custkey", F.lit(True).alias("known")), "c_custkey", "left")
    return fresh.select("conv_id", "turn", F.when(F.col("known"), F.col("c_custkey").cast("string")).otherwise("unmapped").alias("author"))


@query("SELECT a.o_orderstatus, a.o_orderpriority, a.n AS source, b.n AS copy FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) a LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice < 400000 GROUP BY ALL) b USING (o_orderstatus, o_orderpriority) WHERE a.n IS DISTINCT FROM b.n")
def copy_verification(t: Tables) -> DataFrame:
    """A table beside one that lacks some of its rows: counts that differ."""
    return I.verified(t.orders, t.orders.filter("o_totalprice < 400000"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def copied_table(t: Tables) -> DataFrame:
    """A table copied into an empty place, verified there before it is put in place."""
    path = f"{scratch(t.spark)}/orders"
    I.guarded_copy(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"])
    return t.spark.read.parquet(path)


@query(
    "WITH n AS (SELECT 'nation' AS kind, CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 5 = 1 THEN 'created' ELSE 'existing' END AS outcome, '' AS fields FROM nation), s AS (SELECT 'supplier', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 4 = 0 THEN 'created' WHEN s_suppkey % 9 = 0 OR s_suppkey % 7 = 0 THEN 'conflict' ELSE 'existing' END, CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 63 = 0 THEN 's_name,s_phone' WHEN s_suppkey % 9 = 0 THEN 's_name' WHEN s_suppkey % 7 = 0 THEN 's_phone' ELSE '' END FROM supplier),"
    " a AS (SELECT * FROM n UNION ALL SELECT * FROM s) SELECT kind, key, outcome, fields, 0::BIGINT AS added FROM a"
)
def linked_registration(t: Tables) -> DataFrame:
    """Nations and suppliers offered for registration: what is new, known, or differs and in which field; as some differ, nothing is added."""
    kinds = [I.Kind("nation", "n_nationkey", ("n_name",)), I.Kind("supplier", "s_suppkey", ("s_name", "s_phone", "s_nationkey"), (("s_nationkey", "nation"),))]
    offered = {"nation": t.nation.select("n_nationkey", "n_name"), "supplier": t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, F.upper(F.concat("s_name", F.lit("x")))).otherwise(F.col("s_name")).alias("s_name"), F.when(F.col("s_suppkey") % 7 == 0, F.lit(None)).otherwise(F.col("s_suppkey").cast("string")).alias("s_phone"), "s_nationkey")}
    known = {"nation": offered["nation"].filter("n_nationkey % 5 <> 1"), "supplier": t.supplier.filter("s_suppkey % 4 <> 0").select("s_suppkey", "s_name", F.col("s_suppkey").cast("string").alias("s_phone"), "s_nationkey")}
    found, fresh = I.register_linked(kinds, known, offered)
    added = sum(df.count() for df in fresh.values())
    return found.select("kind", "key", "outcome", "fields", F.lit(added).cast("long").alias("added"))


@query("SELECT source AS work, count(DISTINCT lang) AS chapters, count(*) AS entries FROM documents GROUP BY 1")
def released_tables(t: Tables) -> DataFrame:
    """Two releases of several tables, one that the gates refuse, and a rollback: the coverage of the first is active again."""
    sealed = F.sha2(F.concat_ws("|", "source", "lang", "doc_id", "text"), 256)
    rows = t.documents.select("source", "lang", "doc_id", "text").withColumn("checksum", sealed)
    store, head, none = R.Releases(t.spark, scratch(t.spark)), {"status": "verified", "errors": 0, "edition": "e"}, t.spark.createDataFrame([], "code string, severity string")
    known = t.documents.select(F.col("source").alias("work")).distinct()
    publish = lambda df, head=head: store.publish(head, {"edition": "e"}, df, none, ["source", "lang", "doc_id"], "source", "lang", known, sealed, "checksum")
    publish(rows)
    publish(rows.filter("doc_id % 2 = 0"))
    try:
        publish(rows.withColumn("text", F.lit("altered")), head | {"status": "staged"})
    except R.Blocked as refused:
        if refused.codes != ["status", "checksum"]:
            raise
    store.rollback()
    return store.table("coverage")


@query("SELECT p_partkey, p_partkey AS first, coalesce(CASE WHEN p_size > 25 THEN p_partkey + p_size END, p_partkey) AS last, count(l_linenumber) AS held FROM part LEFT JOIN lineitem ON l_orderkey BETWEEN p_partkey AND coalesce(CASE WHEN p_size > 25 THEN p_partkey + p_size END, p_partkey) GROUP BY p_partkey, p_size")
def range_resolution(t: Tables) -> DataFrame:
    """Ranges whose end may be missing: then they end where they start. Ranges of at most fifty are unfolded, so they meet their places by equality."""
    last = F.coalesce(F.when(F.col("p_size") > 25, F.col("p_partkey") + F.col("p_size")), F.col("p_partkey"))
    ranges = t.part.select("p_partkey", F.col("p_partkey").alias("first"), last.alias("last"))
    places = t.lineitem.groupBy(F.col("l_orderkey").alias("at")).agg(F.count("*").alias("n"))
    joined = ranges.withColumn("at", F.explode(F.sequence("first", "last"))).join(places, "at", "left")
    return joined.groupBy("p_partkey", "first", "last").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("held"))


@query("SELECT n_name, sha256('{\"comment\":null,\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') AS etag FROM nation")
def entity_tags(t: Tables) -> DataFrame:
    """The digest of canonical JSON: keys in order, nulls kept."""
    return t.nation.select("n_name", T.entity_tag(F.lit(None).cast("string").alias("comment"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("etag"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(o_orderdate) - 7200000000 ELSE 0 END AS at FROM orders")
def coerced_times(t: Tables) -> DataFrame:
    """Times with Z, with another offset, and none."""
    plain = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(plain, F.lit("Z"))).when(F.col("o_orderkey") % 3 == 1, F.concat(plain, F.lit("+02:00"))).otherwise("never")
    return t.orders.select("o_orderkey", F.unix_micros(T.utc(said)).alias("at"))


@query("SELECT source, side FROM (SELECT source, 'declared' AS side FROM (SELECT DISTINCT source FROM documents WHERE lang = 'fr' EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'es' AND n_chars > 5000) UNION ALL SELECT source, 'observed' FROM (SELECT DISTINCT source FROM documents WHERE lang = 'es' AND n_chars > 5000 EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'fr' AND n_chars > 3000))")
def difference_both_ways(t: Tables) -> DataFrame:
    """What one set has and the other lacks, each way; equal sets give nothing."""
    of = lambda lang, size: t.documents.filter((F.col("lang") == lang) & (F.col("n_chars") > size)).select("source").distinct()
    return Q.only_in(of("fr", -1), of("es", 5000), "declared").unionByName(Q.only_in(of("es", 5000), of("fr", 3000), "observed"))


#: Frozen totals of a release, by group.
RELEASE = {0: (5, 300), 1: (4, 250), 2: (5, 10)}


@query("SELECT n_regionkey AS part, works, customers, CASE WHEN n_regionkey > 2 THEN 'unexpected_group' WHEN works <> CASE n_regionkey WHEN 1 THEN 4 ELSE 5 END THEN 'works_differ' WHEN customers < CASE n_regionkey WHEN 0 THEN 300 WHEN 1 THEN 250 ELSE 10 END THEN 'customers_short' ELSE 'as_frozen' END AS verdict FROM (SELECT n_regionkey, count(DISTINCT n_nationkey) AS works, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def release_audit(t: Tables) -> DataFrame:
    """Totals of each group beside the frozen ones; a handful of constants, so they are literals."""
    totals = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_regionkey").alias("part")).agg(F.countDistinct("n_nationkey").alias("works"), F.count("c_custkey").alias("customers"))
    frozen = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in RELEASE.items() for x in (k, v[i])]), F.col("part"))
    verdict = F.when(frozen(0).isNull(), "unexpected_group").when(F.col("works") != frozen(0), "works_differ").when(F.col("customers") < frozen(1), "customers_short").otherwise("as_frozen")
    return totals.withColumn("verdict", verdict)


@query("WITH k AS (SELECT l_partkey AS name FROM lineitem UNION SELECT p_partkey FROM part), n AS (SELECT name, row_number() OVER (ORDER BY name) AS number FROM k) SELECT l_suppkey, count(DISTINCT number) AS linked, min(number) AS first FROM lineitem JOIN n ON l_partkey = name GROUP BY 1")
def backfilled_links(t: Tables) -> DataFrame:
    """Dense numbers for all names, then carried back to the edges that named them."""
    names = t.lineitem.select(F.col("l_partkey").alias("name")).union(t.part.select("p_partkey"))
    none = t.part.limit(0).select(F.col("p_partkey").alias("name"), F.lit(0).cast("long").alias("number"))
    numbers = I.find_or_create(none, names, "name", "number")
    return t.lineitem.join(numbers, F.col("l_partkey") == F.col("name")).groupBy("l_suppkey").agg(F.countDistinct("number").alias("linked"), F.min("number").alias("first"))
