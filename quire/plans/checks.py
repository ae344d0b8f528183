"""Data-quality rules, lineage, audits and rights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lineage as L
from quire.operators import quality as Q
from quire.operators import rights as R
from quire.plans.registry import Tables, query

@query("WITH p AS (SELECT DISTINCT user_id, (event_id // 7) + 1 AS p FROM events), m AS (SELECT user_id, p FROM p UNION SELECT user_id, max(p) + 1 FROM p GROUP BY user_id), g AS (SELECT user_id, p, coalesce(lag(p) OVER (PARTITION BY user_id ORDER BY p), 0) AS b FROM m) SELECT user_id, b + 1 AS first, p - 1 AS last FROM g WHERE p > b + 1")
def gap_ranges(t: Tables) -> DataFrame:
    """Missing positions of each key as ranges; leading gaps too."""
    return Q.gap_ranges(t.events.select("user_id", (F.floor(F.col("event_id") / 7) + 1).alias("position")), ["user_id"], "position")


@query("WITH r AS (SELECT DISTINCT l_suppkey, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem), f AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r) SELECT l_suppkey, s, e FROM f WHERE s <= far")
def overlap_flags(t: Tables) -> DataFrame:
    ranges = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"))
    return Q.overlaps(ranges, ["l_suppkey"], "s", "e")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS occurrence, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1 AS repeated FROM orders")
def occurrence_numbers(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return Q.occurrences(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "occurrence", "repeated")


@query("SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_positions(t: Tables) -> DataFrame:
    return Q.duplicates(t.lineitem, ["l_orderkey", "l_returnflag"])


@query("SELECT sha256(text) AS checksum, count(DISTINCT doc_id) AS positions, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def duplicate_text_checksums(t: Tables) -> DataFrame:
    return Q.repeated_texts(t.documents, "doc_id", "text")


@query("SELECT position, count(*) - 1 AS excess, sum(CASE WHEN text = firsttext THEN 1 ELSE 0 END)::BIGINT - 1 AS exact FROM (SELECT n_chars AS position, text, first_value(text) OVER (PARTITION BY n_chars ORDER BY doc_id) AS firsttext FROM documents) GROUP BY position HAVING count(*) > 1")
def duplicate_audit(t: Tables) -> DataFrame:
    """Rows beyond the first of a position, and how many of them say the same. The first is a minimum by id, so a hot position is reduced before it is shuffled."""
    first = t.documents.groupBy("n_chars").agg(F.min(F.struct("doc_id", F.sha2("text", 256).alias("sum")))["sum"].alias("first"))
    same = t.documents.select("n_chars", F.sha2("text", 256).alias("sum")).join(first, "n_chars")
    return same.groupBy(F.col("n_chars").alias("position")).agg((F.count("*") - 1).alias("excess"), (F.count_if(F.col("sum") == F.col("first")) - 1).alias("exact")).filter("excess > 0")


@query("SELECT p_partkey, CASE WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem) THEN 'missing_work' ELSE 'missing_chapter' END AS code FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O')")
def missing_positions(t: Tables) -> DataFrame:
    """What is expected but not observed; a work that is missing altogether is said to be so, not its parts."""
    lines = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    parts = Q.missing(t.part, lines.filter("l_returnflag = 'N' AND l_linestatus = 'O'"), ["p_partkey"])
    works = lines.select("p_partkey", F.lit(True).alias("known")).distinct()
    return parts.join(works, "p_partkey", "left").select("p_partkey", F.when(F.col("known").isNull(), "missing_work").otherwise("missing_chapter").alias("code"))


@query("SELECT doc_id, CASE WHEN n_chars > 15000 THEN 'unsafe_row' WHEN regexp_matches(text, '<[!?]') OR regexp_matches(text, '</?[A-Za-z_:][^<]*>') THEN 'unsafe_text' WHEN regexp_matches(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '^[.\\-_ ]*$') THEN 'placeholder_text' WHEN length(text) < 20 THEN 'short_text' END AS code FROM documents WHERE n_chars > 15000 OR regexp_matches(text, '<[!?]') OR regexp_matches(text, '</?[A-Za-z_:][^<]*>') OR length(text) < 20")
def row_faults(t: Tables) -> DataFrame:
    """The first fault of each row."""
    code = Q.first_fault([("unsafe_row", F.col("n_chars") > 15000), ("unsafe_text", T.has_markup(F.col("text"))), ("placeholder_text", T.is_placeholder(F.col("text"))), ("short_text", F.length("text") < 20)])
    return t.documents.select("doc_id", code.alias("code")).filter("code IS NOT NULL")


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest, regexp_matches(html, '<[!?]') AS declared FROM pages")
def stripped_digest(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("digest"), F.col("html").rlike("<[!?]").alias("declared"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS before, count(*) FILTER (l_returnflag = 'N') AS now, count(*) FILTER (l_returnflag = 'N') * 20 < count(*) FILTER (l_returnflag = 'A') * 19 AS regressed FROM lineitem GROUP BY l_suppkey")
def count_regressions(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("before"), F.count_if(F.col("l_returnflag") == "N").alias("now"))
    return counts.withColumn("regressed", Q.regressed(F.col("now"), F.col("before")))


@query("SELECT l_shipmonth, normalized, provider - excluded + introductions AS expected, normalized - (provider - excluded + introductions) AS variance FROM (SELECT date_trunc('month', l_shipdate)::DATE AS l_shipmonth, count(*) AS provider, count(*) FILTER (l_returnflag = 'R') AS excluded, count(*) FILTER (l_linenumber = 1) AS introductions, count(DISTINCT (l_orderkey, l_partkey)) FILTER (l_returnflag <> 'R') + count(DISTINCT l_orderkey) FILTER (l_linenumber = 1) AS normalized FROM lineitem GROUP BY 1)")
def reconciliation(t: Tables) -> DataFrame:
    """normalised = provider - excluded + introductions; what was normalised is counted by its own keys, so lines that became one show as variance."""
    month = F.to_date(F.trunc(F.to_date("l_shipdate"), "month"))
    sums = t.lineitem.groupBy(month.alias("l_shipmonth")).agg(F.count("*").alias("provider"), F.count_if(F.col("l_returnflag") == "R").alias("excluded"), F.count_if(F.col("l_linenumber") == 1).alias("introductions"), (F.countDistinct(F.when(F.col("l_returnflag") != "R", F.struct("l_orderkey", "l_partkey"))) + F.countDistinct(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")))).alias("normalized"))
    expected = F.col("provider") - F.col("excluded") + F.col("introductions")
    return sums.select("l_shipmonth", "normalized", expected.alias("expected"), (F.col("normalized") - expected).alias("variance"))


@query("SELECT 'duplicate_text' AS code, 'warning' AS severity, first AS at, positions AS detail, 1::BIGINT AS rank FROM (SELECT min(doc_id) AS first, count(DISTINCT doc_id) AS positions FROM documents GROUP BY sha256(text) HAVING count(DISTINCT doc_id) > 1) UNION ALL SELECT 'short_text', 'error', doc_id, n_chars, 0 FROM (SELECT DISTINCT doc_id, n_chars FROM documents WHERE n_chars < 20) UNION ALL SELECT 'unlabelled', 'warning', doc_id, 0, 2 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def quality_report(t: Tables) -> DataFrame:
    one = lambda df, code, severity, at, detail: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(at).alias("at"), detail.cast("long").alias("detail"))
    repeated = Q.repeated_texts(t.documents, "doc_id", "text")
    parts = [one(repeated, "duplicate_text", "warning", "first", F.col("positions")), one(t.documents.filter("n_chars < 20"), "short_text", "error", "doc_id", F.col("n_chars")), one(Q.missing(t.documents, t.labels, ["doc_id"]), "unlabelled", "warning", "doc_id", F.lit(0))]
    return Q.findings(parts, {"short_text": 0, "duplicate_text": 1, "unlabelled": 2})


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_version(t: Tables) -> DataFrame:
    return L.latest(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS version, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def predecessor_version(t: Tables) -> DataFrame:
    return L.predecessors(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_custkey", "o_orderkey", "version", "previous")


@query("SELECT c_custkey, coalesce(max(l_linenumber), 0) + 1 AS next FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey")
def next_version(t: Tables) -> DataFrame:
    joined = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("c_custkey").agg((F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).alias("next"))


@query("WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal < 6000), b AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 1000 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_acctbal > 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS action FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def seed_sync(t: Tables) -> DataFrame:
    """What to insert, update and delete so that the target equals the seed."""
    target = t.customer.filter("c_acctbal < 6000").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    seed = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") < 1000, "NEW").otherwise(F.col("c_mktsegment")).alias("v"))
    return L.sync(target, seed, "k", "v")


@query("SELECT lang, count(*) AS rows, CAST(sum(CAST(('0x' || substring(sha256(text), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM documents GROUP BY lang")
def table_digest(t: Tables) -> DataFrame:
    return L.table_digest(t.documents, ["lang"], "text")


@query("SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'publication_inactive' END, CASE WHEN s_suppkey % 3 = 0 THEN 'not_validated' WHEN s_suppkey % 7 = 0 THEN 'validation_unknown' END, CASE WHEN n_regionkey = 0 THEN 'licence_denied' WHEN n_regionkey = 1 THEN 'licence_unknown' END, CASE WHEN length(trim(n_name)) = 0 THEN 'attribution_missing' END], lambda x: x IS NOT NULL), ',') AS reasons FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def eligibility_reasons(t: Tables) -> DataFrame:
    rows = _rights(t)
    return rows.select("s_suppkey", F.array_join(R.reasons(RULES), ",").alias("reasons"))


@query("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AND n_regionkey > 1 AND length(trim(n_name)) > 0")
def eligible_only(t: Tables) -> DataFrame:
    return _rights(t).filter(R.eligible(RULES)).select("s_suppkey")


RULES = [R.Right("active", "publication_inactive"), R.Right("validated", "not_validated", "validation_unknown"), R.Right("licensed", "licence_denied", "licence_unknown"), R.Right("attributed", "attribution_missing")]


def _rights(t: Tables) -> DataFrame:
    """Suppliers as publications; a right may be granted, denied or unknown."""
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    validated = F.when(F.col("s_suppkey") % 3 == 0, False).when(F.col("s_suppkey") % 7 == 0, F.lit(None)).otherwise(True)
    licensed = F.when(F.col("n_regionkey") == 0, False).when(F.col("n_regionkey") == 1, F.lit(None)).otherwise(True)
    return joined.select("s_suppkey", (F.col("s_acctbal") >= 0).alias("active"), validated.alias("validated"), licensed.alias("licensed"), R.filled(F.col("n_name")).alias("attributed"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'restricted' ELSE 'public' END AS class, CASE WHEN p_type LIKE 'PROMO%' THEN NULL ELSE p_name END AS text, CASE WHEN p_type LIKE 'PROMO%' THEN 'licence required' END AS denial FROM part")
def licence_gate(t: Tables) -> DataFrame:
    closed = F.col("p_type").like("PROMO%")
    return t.part.select("p_partkey", F.when(closed, "restricted").otherwise("public").alias("class"), F.when(~closed, F.col("p_name")).alias("text"), F.when(closed, "licence required").alias("denial"))


@query("SELECT coalesce(o.o_custkey, c.c_custkey) AS custkey, o.n AS ordered, c.c_acctbal IS NOT NULL AS known FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 500) c ON o.o_custkey = c.c_custkey WHERE o.n IS NULL OR c.c_custkey IS NULL")
def set_equality_audit(t: Tables) -> DataFrame:
    """Keys that stand on one side only."""
    ordered = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("ordered"))
    known = t.customer.filter("c_acctbal > 500").select(F.col("c_custkey").alias("custkey"), F.lit(True).alias("known"))
    return ordered.join(known, "custkey", "full").filter("ordered IS NULL OR known IS NULL").select("custkey", "ordered", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT o_orderpriority, code, n, CASE WHEN n > 100 THEN 'review' ELSE 'accept' END AS disposition FROM (SELECT o_orderpriority, o_orderstatus AS code, count(*) AS n FROM orders GROUP BY ALL)")
def warning_dispositions(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_orderpriority", F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    return counts.withColumn("disposition", F.when(F.col("n") > 100, "review").otherwise("accept"))


@query("SELECT r_name, count(DISTINCT n_nationkey) AS works, count(*) AS customers, round(sum(CAST(c_acctbal AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name")
def release_scope(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("works"), F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total"))


@query("WITH k AS (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT source || '.' || lang AS key, first, row_number() OVER (PARTITION BY lang ORDER BY first) AS number FROM k")
def canonical_ids(t: Tables) -> DataFrame:
    """One id for each key, numbered within its edition in order of first appearance."""
    keys = t.documents.groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    return keys.select(F.concat_ws(".", "source", "lang").alias("key"), "first", F.row_number().over(Window.partitionBy("lang").orderBy("first")).cast("long").alias("number"))
