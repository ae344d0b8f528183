"""Lookups, joins and aggregates over the catalogue (documents as passages, lang as edition, source as book)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import quality as Q
from quire.plans.registry import Tables, query


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 100 OFFSET 20")
def passage_page(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").offset(20).limit(100)


@query("SELECT doc_id, source || ' ' || CAST(doc_id // 100 AS BIGINT) || ':' || CAST(doc_id % 100 AS BIGINT) AS reference, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS excerpt FROM documents WHERE lower(lang) = 'en' AND n_chars BETWEEN 200 AND 4000 AND source IN ('src0', 'src1', 'src2')")
def passage_scope(t: Tables) -> DataFrame:
    """Case-blind equality, a range and a list, all pushed to the scan but the first."""
    scoped = t.documents.filter((F.lower("lang") == "en") & F.col("n_chars").between(200, 4000) & F.col("source").isin("src0", "src1", "src2"))
    label = T.reference(F.col("source"), F.floor(F.col("doc_id") / 100), F.col("doc_id") % 100)
    return scoped.select("doc_id", label.alias("reference"), T.excerpt(F.col("text"), 200, "...").alias("excerpt"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def edition_left_join(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'unavailable' WHEN l.quality = 1 THEN 'available' ELSE 'restricted' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def passage_availability(t: Tables) -> DataFrame:
    marks = t.labels.select("doc_id", "quality", F.lit(True).alias("found"))
    state = F.when(F.col("found").isNull(), "unavailable").when(F.col("quality") == 1, "available").otherwise("restricted")
    return t.documents.select("doc_id", "lang").join(marks, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), state.alias("state"))


@query("SELECT lang, count(*) AS passages FROM documents GROUP BY lang")
def edition_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("passages"))


@query("SELECT DISTINCT source FROM documents")
def distinct_sources(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct()


@query("SELECT lang, count(DISTINCT source) AS books, count(*) AS passages, sum(n_chars)::BIGINT AS characters, CASE WHEN count(DISTINCT source) = 20 THEN 'complete' WHEN count(DISTINCT source) > 0 THEN 'partial' ELSE 'none' END AS status FROM documents GROUP BY lang")
def edition_coverage(t: Tables) -> DataFrame:
    status = F.when(F.col("books") == 20, "complete").when(F.col("books") > 0, "partial").otherwise("none")
    return t.documents.groupBy("lang").agg(F.countDistinct("source").alias("books"), F.count("*").alias("passages"), F.sum("n_chars").alias("characters")).withColumn("status", status)


@query("SELECT n_regionkey, min(struct_pack(p := n_nationkey, c := n_name)).c AS recommended, count(*) AS editions FROM nation JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 0) ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def recommended_per_group(t: Tables) -> DataFrame:
    """The eligible edition with the smallest (priority, name) of each group."""
    eligible = t.nation.join(t.customer.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    return eligible.groupBy("n_regionkey").agg(F.min(F.struct("n_nationkey", "n_name"))["n_name"].alias("recommended"), F.count("*").alias("editions"))


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def canon_matrix(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS editions, bool_or(lang = 'es') AND NOT bool_or(lang = 'fr') AS only_es FROM documents GROUP BY source")
def membership_lists(t: Tables) -> DataFrame:
    has = lambda x: F.bool_or(F.col("lang") == x)
    return t.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("editions"), (has("es") & ~has("fr")).alias("only_es"))


@query("SELECT l_orderkey, array_to_string(list_transform(list_sort(list(l_linenumber)), lambda x: CAST(x AS VARCHAR)), ',') AS lines, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey")
def grouped_positions(t: Tables) -> DataFrame:
    lines = F.array_sort(F.collect_list("l_linenumber"))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(lines.cast("array<string>"), ",").alias("lines"), F.max("l_linenumber").alias("last"))


@query("SELECT l_orderkey, count(*) AS size, (count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*)) AS exact FROM lineitem GROUP BY l_orderkey")
def coverage_exactness(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"), F.count("*").alias("size"))
    return lines.select("l_orderkey", "size", (Q.exact_coverage(F.col("lines"), F.col("size")) & (F.element_at("lines", -1) == F.col("size"))).alias("exact"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_docs_anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def labelled_docs_semi(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.filter("toxic = 1"), "doc_id", "left_semi")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey AS p_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def expected_minus_observed(t: Tables) -> DataFrame:
    return t.part.select("p_partkey").subtract(t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey AS c_custkey FROM orders")
def declared_and_observed(t: Tables) -> DataFrame:
    return t.customer.filter("c_acctbal < 0").select("c_custkey").intersect(t.orders.select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT lang, source FROM documents WHERE lang = 'en' UNION SELECT lang, source FROM documents WHERE n_chars > 5000")
def scope_union(t: Tables) -> DataFrame:
    pairs = t.documents.select("lang", "source")
    return pairs.filter("lang = 'en'").union(t.documents.filter("n_chars > 5000").select("lang", "source")).distinct()


@query("SELECT coalesce(a.source, b.source) AS source, a.n AS before, b.n AS after FROM (SELECT source, count(*) AS n FROM documents WHERE n_chars < 2000 GROUP BY source) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE n_chars >= 2000 GROUP BY source) b ON a.source = b.source WHERE a.n IS DISTINCT FROM b.n")
def snapshot_counts(t: Tables) -> DataFrame:
    from quire.operators.lineage import snapshot_diff

    return snapshot_diff(t.documents.filter("n_chars < 2000"), t.documents.filter("n_chars >= 2000"), ["source"])


@query("SELECT c_mktsegment, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'i') OR contains(lower(c_mktsegment), 'm') GROUP BY ALL")
def facet_counts(t: Tables) -> DataFrame:
    """Terms over several columns, with the distinct values of the facets it leaves."""
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.filter(F.contains(F.lower("n_name"), F.lit("i")) | F.contains(F.lower("c_mktsegment"), F.lit("m"))).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("customers"))


@query("WITH k AS (SELECT n_nationkey, n_name, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS key FROM nation), s AS (SELECT s_suppkey, s_name, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) || CASE WHEN s_suppkey % 4 = 3 THEN 'x' ELSE '' END AS key, CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN replace(n_name, '_', ' - ') ELSE n_name || 'x' END AS given FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, k.n_nationkey, CASE WHEN s.given = k.n_name THEN 'exact' ELSE 'normalised' END AS how FROM s JOIN k USING (key)")
def fallback_name_join(t: Tables) -> DataFrame:
    """An exact match by name, else one by letters and digits alone; names that are neither match nothing."""
    names = t.nation.select("n_nationkey", F.col("n_name").alias("name"), T.bare_key(F.col("n_name")).alias("key"))
    kind = F.col("s_suppkey") % 4
    given = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.lower("n_name")).when(kind == 2, F.replace("n_name", F.lit("_"), F.lit(" - "))).otherwise(F.concat("n_name", F.lit("x")))
    given = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", given.alias("given"), T.bare_key(given).alias("key"))
    exact = given.join(names, F.col("given") == F.col("name")).select("s_suppkey", names["n_nationkey"], F.lit("exact").alias("how"))
    rest = given.join(exact.select("s_suppkey"), "s_suppkey", "left_anti").join(names, "key").select("s_suppkey", "n_nationkey", F.lit("normalised").alias("how"))
    return exact.unionByName(rest)


@query("SELECT c.conv_id, c.turn, n.turn AS following, n.role AS role FROM conversations c LEFT JOIN conversations n ON c.conv_id = n.conv_id AND n.turn = c.turn + 1")
def position_join(t: Tables) -> DataFrame:
    following = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("following"), "role")
    return t.conversations.select("conv_id", "turn").join(following, ["conv_id", "turn"], "left")


@query("WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), 1) AS position FROM benchmark) SELECT w.item_id, w.position, w.word, l.quality FROM w LEFT JOIN labels l ON l.doc_id = w.position")
def position_token_join(t: Tables) -> DataFrame:
    """Each word of a passage with the annotation of its place."""
    placed = t.benchmark.select("item_id", F.posexplode(T.words(F.col("text"))).alias("at", "word")).withColumn("position", (F.col("at") + 1).cast("long"))
    return placed.join(t.labels.select(F.col("doc_id").alias("position"), "quality"), "position", "left").select("item_id", "position", "word", "quality")


@query("SELECT c.conv_id, c.turn, r.turn AS start, count(*) OVER (PARTITION BY c.conv_id, c.turn) AS covering FROM conversations c JOIN conversations r ON c.conv_id = r.conv_id AND r.role = 'user' AND r.turn <= c.turn AND r.turn + 2 >= c.turn")
def interval_join(t: Tables) -> DataFrame:
    """All ranges (a user's turn and the two after it) that hold a turn: equal keys first, then the interval."""
    ranges = t.conversations.filter("role = 'user'").select("conv_id", F.col("turn").alias("start"), (F.col("turn") + 2).alias("end"))
    held = t.conversations.select("conv_id", "turn").join(ranges, "conv_id").filter("start <= turn AND end >= turn")
    return held.select("conv_id", "turn", "start", F.count("*").over(Window.partitionBy("conv_id", "turn")).alias("covering"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 99 END AS section, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 99 END, c_name, c_custkey) AS place FROM customer")
def canon_order(t: Tables) -> DataFrame:
    """A given order of sections, unknown ones last, then names."""
    section = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(99)
    window = Window.partitionBy("c_nationkey").orderBy("section", "c_name", "c_custkey")
    return t.customer.withColumn("section", section).select("c_custkey", "section", F.row_number().over(window).alias("place"))


@query("SELECT user_id, count(*) AS total, count(DISTINCT event_type) AS kinds, count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN event_type END) AS available, max(ts) AS last FROM events GROUP BY user_id")
def study_progress(t: Tables) -> DataFrame:
    some = F.when(F.col("event_type").isin("view", "click"), F.col("event_type"))
    return t.events.groupBy("user_id").agg(F.count("*").alias("total"), F.countDistinct("event_type").alias("kinds"), F.countDistinct(some).alias("available"), F.max("ts").alias("last"))


@query("SELECT doc_id, translate(lower(source), 'src', 'SRC') || ':' || doc_id AS key, upper(lang) AS edition, replace(source, 'src', 'book ') AS book, length(trim(source)) AS size FROM documents")
def scalar_basics(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.translate(F.lower("source"), "src", "SRC"), F.lit(":"), F.col("doc_id")).alias("key"), F.upper("lang").alias("edition"), F.replace(F.col("source"), F.lit("src"), F.lit("book ")).alias("book"), F.length(F.trim("source")).cast("long").alias("size"))
