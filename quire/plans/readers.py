"""What readers of the catalogue ask: single rows, pages, optional filters, private rows, views of a chapter, aliases, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import rights as R
from quire.operators import scope as S
from quire.plans.registry import Tables, query


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17")
def point_lookup(t: Tables) -> DataFrame:
    return S.point(t.documents, "doc_id", 17).select("doc_id", "lang", "source", "n_chars")


@query("SELECT 'any' AS asked, count(*) AS n FROM documents UNION ALL SELECT 'FR', count(*) FROM documents WHERE upper(lang) = 'FR'")
def optional_filter(t: Tables) -> DataFrame:
    """One reader with and without its optional filter."""
    parts = [t.documents.filter(S.optional_equal(F.col("lang"), asked)).agg(F.count("*").alias("n")).select(F.lit(asked.upper() if asked else "any").alias("asked"), "n") for asked in (None, "fr")]
    return parts[0].unionByName(parts[1])


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%m%l%ri%'")
def segments_like(t: Tables) -> DataFrame:
    return t.part.filter(S.holds_in_order(F.col("p_name"), ["M", "l", "Ri"])).select("p_partkey", "p_name")


@query("SELECT d.doc_id, l.quality IS NULL AS unread FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL OR l.quality IS NOT NULL AND l.quality = 0")
def null_filters(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.filter(F.col("toxic").isNull() | (F.col("quality").isNotNull() & (F.col("quality") == 0))).select("doc_id", F.col("quality").isNull().alias("unread"))


@query("SELECT event_id, event_type, value FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def owner_scope(t: Tables) -> DataFrame:
    """Private rows of one owner; the filter reaches the scan."""
    user = t.events.agg(F.min("user_id")).first()[0]
    return S.owned(t.events, "user_id", user).select("event_id", "event_type", "value")


@query("SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'public' WHEN event_type = 'click' THEN 'unlisted' WHEN event_type = 'error' THEN NULL ELSE 'private' END AS visibility FROM events WHERE user_id = 3 OR event_type IN ('view', 'click')")
def visibility_policy(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "public").when(F.col("event_type") == "click", "unlisted").when(F.col("event_type") == "error", F.lit(None)).otherwise("private")
    return t.events.withColumn("visibility", kind).filter(S.visible(F.col("user_id"), F.col("visibility"), 3)).select("event_id", "user_id", "visibility")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 40")
def newest_page(t: Tables) -> DataFrame:
    """Newest first; a limit beyond 100 is put right."""
    return S.page(t.orders, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 40, 5000).select("o_orderkey", "o_orderdate")


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, user_id DESC, event_id LIMIT 64")
def newest_bounded(t: Tables) -> DataFrame:
    bought = t.events.filter("event_type = 'purchase'")
    return S.page(bought, [F.col("ts").desc(), F.col("user_id").desc(), F.col("event_id")], -5, 900, most=64).select("event_id", "user_id", "ts")


_notes = "SELECT doc_id AS id, source AS work, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE doc_id % 5 END AS chapter, CASE WHEN doc_id % 7 = 0 OR doc_id % 23 = 0 THEN NULL ELSE doc_id % 40 END AS first, CASE WHEN doc_id % 7 = 0 OR doc_id % 23 = 0 THEN NULL ELSE doc_id % 40 + doc_id % 3 END AS last, text FROM documents"


def notes(t: Tables) -> DataFrame:
    """Documents as commentary: a note on verses of a chapter, an introduction to a chapter (no verses) or to a book (no chapter)."""
    id_, whole = F.col("doc_id"), F.col("doc_id") % 23 == 0
    bare = whole | (id_ % 7 == 0)
    return t.documents.select(id_.alias("id"), F.col("source").alias("work"), F.when(~whole, id_ % 5).alias("chapter"), F.when(~bare, id_ % 40).alias("first"), F.when(~bare, id_ % 40 + id_ % 3).alias("last"), "text")


READING = ["chapter", "first", "last"]


@query(f"SELECT * EXCLUDE (n), n > 12 AS truncated FROM (SELECT id, chapter, first, last, row_number() OVER (ORDER BY chapter NULLS FIRST, first NULLS FIRST, last NULLS FIRST, id) AS position, count(*) OVER () AS n FROM ({_notes}) WHERE work = 'src3' AND (chapter = 2 OR chapter IS NULL)) WHERE position <= 12")
def chapter_view(t: Tables) -> DataFrame:
    """A chapter's notes with the book's introduction, what has no place first; one row more than asked tells that more follow."""
    found = notes(t).filter("work = 'src3' AND (chapter = 2 OR chapter IS NULL)").select("id", *READING)
    return S.cut(found, [*(F.col(c).asc_nulls_first() for c in READING), F.col("id")], 12)


@query(f"WITH o AS (SELECT id, work, length(text) AS size, row_number() OVER (ORDER BY array_position(['src5', 'src2'], work), chapter NULLS FIRST, first NULLS FIRST, last NULLS FIRST, id) AS n FROM ({_notes}) WHERE work IN ('src5', 'src2') AND (chapter = 1 OR chapter IS NULL)), b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o) SELECT id, work, CAST(least(size, 20000 - before) AS BIGINT) AS kept, n AS position FROM b WHERE n <= 50 AND before < 20000")
def budget_across_sources(t: Tables) -> DataFrame:
    """Entries and characters budgeted over the sources in the order asked for: the second gets what the first leaves. Only the first entries are ordered together."""
    asked = notes(t).filter("work IN ('src5', 'src2') AND (chapter = 1 OR chapter IS NULL)")
    order = [F.when(F.col("work") == "src5", 0).otherwise(1), *(F.col(c).asc_nulls_first() for c in READING), F.col("id")]
    few = S.cut(asked.withColumn("size", F.length("text")).drop("text"), order, 50)
    before = F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return few.withColumn("before", before).filter("before < 20000").select("id", "work", F.least("size", 20000 - F.col("before")).cast("long").alias("kept"), "position")


@query("WITH o AS (SELECT event_id, length(props) + length(event_type) AS size FROM events WHERE user_id = 7), b AS (SELECT event_id, sum(size) OVER (ORDER BY event_id) AS total FROM o) SELECT event_id, CAST(total AS BIGINT) AS total FROM b WHERE event_id < coalesce((SELECT min(event_id) FROM b WHERE total > 300), 9223372036854775807)")
def size_budget(t: Tables) -> DataFrame:
    """One owner's records while their running size fits; the first that doesn't ends the list."""
    total = F.sum(F.length("props") + F.length("event_type")).over(Window.partitionBy("user_id").orderBy("event_id"))
    return S.owned(t.events, "user_id", 7).withColumn("total", total).filter("total <= 300").select("event_id", "total")


@query("SELECT c_custkey, n_name, CASE WHEN (lower(c_name) LIKE '%9%' OR lower(n_name) LIKE '%9%' OR list_has_any(list_transform(string_split(c_mktsegment, 'I'), lambda x: lower(x)), ['build'])) THEN 1 ELSE 0 END AS hit FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 OR c_acctbal > 5000 AND list_contains(string_split(c_mktsegment, 'I'), 'BU')")
def facet_filter(t: Tables) -> DataFrame:
    """Facets together: free text over several fields, arrays among them, a region, membership of an array."""
    tags = F.split("c_mktsegment", "I")
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("tags", tags)
    said = F.contains(F.lower("c_name"), F.lit("9")) | F.contains(F.lower("n_name"), F.lit("9")) | F.exists("tags", lambda x: F.lower(x) == "build")
    return joined.filter((F.col("n_regionkey") == 2) | ((F.col("c_acctbal") > 5000) & F.array_contains("tags", "BU"))).select("c_custkey", "n_name", said.cast("int").alias("hit"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'metal' WHEN p_size > 40 THEN 'large' ELSE 'other' END AS category FROM part WHERE CASE WHEN p_type LIKE 'PROMO%' THEN 'metal' WHEN p_size > 40 THEN 'large' ELSE 'other' END <> 'other'")
def category_filter(t: Tables) -> DataFrame:
    category = F.when(F.col("p_type").like("PROMO%"), "metal").when(F.col("p_size") > 40, "large").otherwise("other")
    return t.part.select("p_partkey", category.alias("category")).filter("category <> 'other'")


@query("SELECT source, CASE WHEN CAST(substring(source, 4) AS INT) < 12 THEN 'old' ELSE 'new' END AS testament, bool_or(lang = 'de') AS de, bool_or(lang = 'en') AS en, bool_or(lang = 'de') AND NOT bool_or(lang = 'en') AS only_de FROM documents GROUP BY source")
def canon_labels(t: Tables) -> DataFrame:
    """Labels of a book, and in which canons it stands."""
    has = lambda x: F.bool_or(F.col("lang") == x)
    age = F.when(F.substring("source", 4, 9).cast("int") < 12, "old").otherwise("new")
    return t.documents.groupBy("source").agg(F.first(age).alias("testament"), has("de").alias("de"), has("en").alias("en"), (has("de") & ~has("en")).alias("only_de"))


@query("WITH r AS (SELECT s_suppkey, ' ' || upper(n_name) || '  x' AS a, n_name AS b, r_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT s_suppkey, contains(trim(regexp_replace(upper(a), '\\s+', ' ', 'g')), upper(b)) OR contains(upper(b), trim(regexp_replace(upper(a), '\\s+', ' ', 'g'))) AS same, contains(upper(b), upper(c)) OR contains(upper(c), upper(b)) AS wider FROM r")
def reference_match(t: Tables) -> DataFrame:
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    loud = F.concat(F.lit(" "), F.upper("n_name"), F.lit("  x"))
    return joined.select("s_suppkey", S.same_reference(loud, F.col("n_name")).alias("same"), S.same_reference(F.col("n_name"), F.col("r_name")).alias("wider"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 1 THEN 'rule' WHEN json_array_length('[' || CASE WHEN o_totalprice > 300000 THEN '\"high\"' ELSE '' END || ']') > 0 THEN 'marked' ELSE 'plain' END AS bias FROM orders")
def bias_markers(t: Tables) -> DataFrame:
    """A rule by coordinate, else whether a JSON list of markers holds any. The rules are few and literal, so they are broadcast."""
    rules = t.spark.createDataFrame([(1, "rule")], "at int, rule string")
    marks = F.concat(F.lit("["), F.when(F.col("o_totalprice") > 300000, F.lit('"high"')).otherwise(""), F.lit("]"))
    joined = t.orders.withColumn("at", (F.col("o_orderkey") % 50).cast("int")).join(F.broadcast(rules), "at", "left")
    return joined.select("o_orderkey", F.coalesce("rule", F.when(F.json_array_length(marks) > 0, "marked").otherwise("plain")).alias("bias"))


@query("WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders), g AS (SELECT min(o_custkey) AS k FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 5)) SELECT o_orderkey, ordinal FROM c JOIN g ON o_custkey = k WHERE ordinal BETWEEN 2 AND 4")
def ordinal_interval(t: Tables) -> DataFrame:
    """From one event to another of the same group, both included; unknown, mixed, reversed and half-open intervals are refused."""
    group = t.orders.groupBy("o_custkey").count().filter("count >= 5").agg(F.min("o_custkey")).first()[0]
    placed = t.orders.filter(F.col("o_custkey") == F.lit(group)).withColumn("ordinal", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long"))
    ends = {r["ordinal"]: r["o_orderkey"] for r in placed.filter("ordinal IN (2, 4)").collect()}
    return S.interval(placed, "o_orderkey", "o_custkey", "ordinal", ends.get(2), ends.get(4)).select("o_orderkey", "ordinal")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ri') OR contains(lower(p_brand), 'ri') OR contains(lower(p_type), 'ri')")
def title_or_alias(t: Tables) -> DataFrame:
    return t.part.filter(S.named_like(F.col("p_name"), F.array("p_brand", "p_type"), "  RI ")).select("p_partkey")


@query("SELECT source, list_contains(list_transform(list(DISTINCT upper(lang)), lambda x: lower(x)), 'es') AS tagged FROM documents GROUP BY source")
def tag_membership(t: Tables) -> DataFrame:
    tags = t.documents.groupBy("source").agg(F.collect_set(F.upper("lang")).alias("tags"))
    return tags.select("source", F.array_contains(F.transform("tags", F.lower), "es").alias("tagged"))


def aliases(t: Tables) -> DataFrame:
    """Names of books: each source as it is, and by its number, in another case and spacing."""
    books = t.documents.select("source").distinct()
    return books.select(F.col("source").alias("alias"), F.concat(F.lit("work-"), F.substring("source", 4, 9)).alias("work")).unionByName(books.select(F.concat(F.lit("Book  "), F.substring("source", 4, 9)).alias("alias"), F.concat(F.lit("work-"), F.substring("source", 4, 9)).alias("work")))


_aliases = "SELECT DISTINCT lower(source) AS alias, 'work-' || substring(source, 4) AS work FROM documents UNION SELECT DISTINCT 'book ' || substring(source, 4), 'work-' || substring(source, 4) FROM documents"


@query(f"WITH a AS ({_aliases}) SELECT doc_id, work FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'BOOK ' || substring(source, 4) WHEN doc_id % 3 = 1 THEN lower(source) ELSE 'unknown' END AS label FROM documents) LEFT JOIN a ON lower(label) = alias")
def alias_join(t: Tables) -> DataFrame:
    """Labels in any case and spacing; what no alias names stays, without a work."""
    number = F.substring("source", 4, 9)
    label = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" BOOK   "), number)).when(F.col("doc_id") % 3 == 1, F.upper("source")).otherwise("unknown")
    return S.resolve(t.documents.select("doc_id", label.alias("label")), "label", aliases(t)).select("doc_id", "work")


@query("WITH w AS (SELECT lang, 'work-' || substring(source, 4) AS work, min(doc_id) AS first FROM documents WHERE n_chars > 7000 GROUP BY ALL) SELECT d.doc_id, w.first FROM documents d LEFT JOIN w ON w.lang = d.lang AND w.work = 'work-' || substring(d.source, 4)")
def work_source_join(t: Tables) -> DataFrame:
    """Passages beside the source of their work in their edition: a composite key of which one part is computed by the aliases."""
    works = S.resolve(t.documents.filter("n_chars > 7000"), "source", aliases(t)).groupBy("lang", "work").agg(F.min("doc_id").alias("first"))
    return S.resolve(t.documents.select("doc_id", "lang", "source"), "source", aliases(t)).join(works, ["lang", "work"], "left").select("doc_id", "first")


@query("SELECT c_custkey, n_name, s.n AS sources FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON s_nationkey = n_nationkey")
def coverage_join(t: Tables) -> DataFrame:
    sources = t.supplier.filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("sources"))
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(sources, "n_nationkey", "left").select("c_custkey", "n_name", "sources")


@query("SELECT n_name, count(s_suppkey) AS entries, min(s_name) AS first FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'EUROPE' GROUP BY n_name")
def reverse_bridge(t: Tables) -> DataFrame:
    """From a canon back over the bridge to its works' entries."""
    bridge = t.nation.join(t.region.filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return bridge.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("s_suppkey").alias("entries"), F.min("s_name").alias("first"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE (n_regionkey = 1 AND s_acctbal > 1000) OR (n_name LIKE 'C%' AND s_acctbal > 0) OR (n_regionkey = 3 AND s_acctbal < 0)")
def either_eligible(t: Tables) -> DataFrame:
    """An inner join with alternatives beside its key."""
    ok = ((F.col("n_regionkey") == 1) & (F.col("s_acctbal") > 1000)) | (F.col("n_name").startswith("C") & (F.col("s_acctbal") > 0)) | ((F.col("n_regionkey") == 3) & (F.col("s_acctbal") < 0))
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).filter(ok).select("s_suppkey", "n_name")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT l_orderkey AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1) p ON p.k = l_orderkey AND p.s = l_suppkey WHERE o_orderstatus = 'F' AND l_linestatus = 'F'")
def active_publication(t: Tables) -> DataFrame:
    """Source, publication and edition on a composite key, only where one is active and the other published."""
    chosen = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    active = t.lineitem.filter("l_linestatus = 'F'").join(chosen, ["l_orderkey", "l_suppkey"])
    return t.orders.filter("o_orderstatus = 'F'").join(active, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@query("SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN NULL ELSE text END AS text FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) >= 3)")
def restricted_text(t: Tables) -> DataFrame:
    """Passages of an edition's books, those of restricted codes without their text."""
    wide = t.documents.groupBy("source").agg(F.countDistinct("lang").alias("n")).filter("n >= 3")
    shown = F.when(~F.col("lang").isin("de", "fr"), F.col("text"))
    return t.documents.join(wide, "source", "left_semi").select("doc_id", shown.alias("text"))


@query("WITH e AS (SELECT DISTINCT l_partkey % 500 AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 40) SELECT d.doc_id, r.doc_id AS related FROM documents d JOIN e ON d.doc_id IN (e.a, e.b) AND e.a <> e.b JOIN documents r ON r.doc_id = CASE WHEN e.a = d.doc_id THEN e.b ELSE e.a END WHERE d.source = 'src1'")
def related_passages(t: Tables) -> DataFrame:
    """Both ends of cross-references in one join: the passages at the other end."""
    edges = t.lineitem.filter("l_quantity > 40").select((F.col("l_partkey") % 500).alias("a"), F.col("l_suppkey").alias("b")).distinct().filter("a <> b")
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("b").alias("related")), F.struct(F.col("b").alias("doc_id"), F.col("a").alias("related")))).alias("e")).select("e.*")
    known = t.documents.select(F.col("doc_id").alias("related"))
    return ends.join(t.documents.filter("source = 'src1'").select("doc_id"), "doc_id").join(known, "related", "left_semi").select("doc_id", "related")


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS posts, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def loaded_counts(t: Tables) -> DataFrame:
    posts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("posts"), F.max("o_orderkey").alias("last"))
    return t.customer.join(posts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("posts", F.lit(0)).alias("posts"), "last")


@query("WITH v AS (SELECT source, lang, doc_id // 10 AS verse, min(doc_id) AS id FROM documents GROUP BY ALL) SELECT b.source, b.verse, coalesce(d.id, f.id) AS id, d.id IS NULL AND f.id IS NULL AS omitted, CASE WHEN d.id IS NOT NULL THEN 'de' WHEN f.id IS NOT NULL THEN 'fr' END AS edition FROM v b LEFT JOIN v d ON d.lang = 'de' AND d.source = b.source AND d.verse = b.verse LEFT JOIN v f ON f.lang = 'fr' AND f.source = b.source AND f.verse = b.verse WHERE b.lang = 'en'")
def verse_alignment(t: Tables) -> DataFrame:
    """Each verse of the baseline in another edition, else in a third; what neither has is flagged."""
    verses = t.documents.groupBy("source", "lang", F.floor(F.col("doc_id") / 10).alias("verse")).agg(F.min("doc_id").alias("id"))
    others = verses.filter("lang IN ('de', 'fr')").groupBy("source", "verse").agg(F.min(F.struct("lang", "id")).alias("best"))
    joined = verses.filter("lang = 'en'").select("source", "verse").join(others, ["source", "verse"], "left")
    return joined.select("source", "verse", F.col("best.id").alias("id"), F.col("best").isNull().alias("omitted"), F.col("best.lang").alias("edition"))


@query("WITH m AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(role || ' @Customer-' || lpad(CAST(conv_id AS VARCHAR), 9, '0') || ' mail a@bcd', '@([A-Za-z0-9_-]{3,50})', 1)) AS name FROM conversations) SELECT conv_id, turn, lower(name) AS name FROM m WHERE lower(name) LIKE 'customer-%'")
def mention_lookup(t: Tables) -> DataFrame:
    """Mentions and whom they name; an @ inside a word names nobody."""
    said = F.concat(F.col("role"), F.lit(" @Customer-"), F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lit(" mail a@bcd"))
    named = t.conversations.select("conv_id", "turn", F.explode(T.mentions(said)).alias("name"))
    people = t.conversations.select(F.lower(F.concat(F.lit("customer-"), F.lpad(F.col("conv_id").cast("string"), 9, "0"))).alias("known")).distinct()
    return named.join(people, F.lower("name") == F.col("known")).select("conv_id", "turn", F.col("known").alias("name"))


_publications = """SELECT p_partkey AS pub, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'draft' ELSE 'active' END AS status, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_size % 25 END AS pub_edition, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 29 <> 0 END AS approved, CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 31 <> 0 END AS public, CASE WHEN p_partkey % 37 = 0 THEN 99 ELSE p_partkey % 6 END AS lic,
n_nationkey AS ed, CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN 0 ELSE p_partkey END AS selected,
r_regionkey AS l, CASE WHEN p_partkey % 47 = 0 THEN -1 ELSE p_size % 25 END AS l_ed, CASE WHEN p_partkey % 7 <> 0 THEN 1 END AS reviewer, CASE WHEN p_partkey % 53 <> 0 THEN 1 END AS verified, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 10 <> 1 END AS commercial, CASE WHEN p_partkey % 14 <> 0 THEN p_partkey % 15 <> 1 END AS display, CASE WHEN p_partkey % 21 <> 0 THEN p_partkey % 22 <> 1 END AS redistribution, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 2 = 0 END AS required, CASE WHEN p_partkey % 12 = 2 THEN NULL WHEN p_partkey % 12 = 6 THEN ' ' || chr(9) || chr(10) ELSE p_brand END AS attribution
FROM part JOIN nation ON p_size % 25 = n_nationkey LEFT JOIN region ON p_partkey % 6 = r_regionkey"""
_codes = """list_filter([CASE WHEN status IS DISTINCT FROM 'active' THEN 'publication_not_active' END, CASE WHEN selected IS DISTINCT FROM pub THEN 'publication_not_selected' END, CASE WHEN pub_edition IS NULL OR pub_edition <> ed THEN 'edition_mismatch' END, CASE WHEN approved IS DISTINCT FROM TRUE THEN 'validation_not_approved' END, CASE WHEN public IS DISTINCT FROM TRUE THEN 'not_public' END, CASE WHEN l IS NULL THEN 'license_missing' END,
CASE WHEN l IS NOT NULL AND (lic <> l OR l_ed <> ed OR pub_edition IS NULL OR l_ed <> pub_edition) THEN 'license_mismatch' END, CASE WHEN l IS NOT NULL AND (reviewer IS NULL OR verified IS NULL) THEN 'rights_not_reviewed' END, CASE WHEN l IS NOT NULL AND commercial IS DISTINCT FROM TRUE THEN 'commercial_use_not_allowed' END, CASE WHEN l IS NOT NULL AND display IS DISTINCT FROM TRUE THEN 'display_not_allowed' END, CASE WHEN l IS NOT NULL AND redistribution IS DISTINCT FROM TRUE THEN 'redistribution_not_allowed' END, CASE WHEN l IS NOT NULL AND required IS NULL THEN 'attribution_requirement_unknown' END, CASE WHEN l IS NOT NULL AND required AND length(trim(replace(replace(coalesce(attribution, ''), chr(9), ''), chr(10), ''))) = 0 THEN 'attribution_missing' END], lambda x: x IS NOT NULL)"""


def publications(t: Tables) -> DataFrame:
    """Parts as publications, nations as their editions, regions as licence records; every right is at times denied and at times unknown."""
    k = F.col("p_partkey")
    off = lambda n, r=0: k % n == r
    tri = lambda unknown, denied: F.when(~off(unknown), ~off(*denied))
    edition = F.col("p_size") % 25
    publication = F.struct(
        k.alias("id"), F.when(off(11), None).when(off(17), "draft").otherwise("active").alias("status"), F.when(~off(19), edition).alias("source_edition_id"), tri(13, (29,)).alias("validation_approved"), tri(23, (31,)).alias("public_visibility"),
        F.when(off(37), 99).otherwise(k % 6).alias("license_record_id"),
    )
    joined = t.part.join(t.nation, edition == F.col("n_nationkey")).join(t.region, k % 6 == F.col("r_regionkey"), "left")
    licence = F.struct(
        F.col("r_regionkey").alias("id"), F.when(off(47), -1).otherwise(edition).alias("source_edition_id"), F.when(~off(7), 1).alias("reviewer_id"), F.when(~off(53), 1).alias("verification_date"), tri(9, (10, 1)).alias("commercial_use_allowed"),
        tri(14, (15, 1)).alias("display_allowed"), tri(21, (22, 1)).alias("redistribution_allowed"), F.when(~off(8), off(2)).alias("attribution_required"), F.when(off(12, 2), None).when(off(12, 6), F.lit(" \t\n")).otherwise(F.col("p_brand")).alias("required_attribution_text"),
    )
    selected = F.struct(F.col("n_nationkey").alias("id"), F.when(off(41), None).when(off(43), 0).otherwise(k).alias("active_publication_id"))
    return joined.select("p_partkey", publication.alias("publication"), selected.alias("edition"), F.when(F.col("r_regionkey").isNotNull(), licence).alias("licence"))


@query(f"SELECT pub AS p_partkey, array_to_string({_codes}, ',') AS reasons FROM ({_publications})")
def publication_reasons(t: Tables) -> DataFrame:
    """All thirteen reasons, each at some row."""
    return publications(t).select("p_partkey", F.array_join(R.gate_reasons(), ",").alias("reasons"))


@query(f"SELECT pub AS p_partkey FROM ({_publications}) WHERE status = 'active' AND selected = pub AND pub_edition = ed AND approved AND public AND lic = l AND l_ed = ed AND reviewer IS NOT NULL AND verified IS NOT NULL AND commercial AND display AND redistribution AND (NOT required OR required AND length(trim(replace(replace(attribution, chr(9), ''), chr(10), ''))) > 0)")
def publications_open(t: Tables) -> DataFrame:
    return publications(t).filter(R.gate_open()).select("p_partkey")


