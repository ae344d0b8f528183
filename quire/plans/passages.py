"""Passages across editions: complete coverage, budgets over several sources, alignment, precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import documents as D
from quire.functions import text as T
from quire.operators import lineage as L
from quire.operators import retrieval as R
from quire.plans.registry import Tables, query


@query("WITH e AS (SELECT l_orderkey, max(l_linenumber) AS size FROM lineitem GROUP BY 1), c AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL) SELECT e.l_orderkey, arg_min(l_returnflag, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) AS edition FROM e JOIN c ON e.l_orderkey = c.l_orderkey AND n = size GROUP BY 1")
def complete_edition(t: Tables) -> DataFrame:
    """The most trusted edition that has every verse of a passage."""
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    size = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("size"))
    held = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.countDistinct("l_linenumber").alias("n"))
    full = held.join(size, "l_orderkey").filter("n = size")
    return full.groupBy("l_orderkey").agg(F.min_by("l_returnflag", rank).alias("edition"))


@query("WITH r AS (SELECT conv_id, turn, role, length(text) AS size, coalesce(sum(length(text)) OVER w, 0) AS before, row_number() OVER w2 AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY role DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY conv_id ORDER BY role DESC, turn)) SELECT conv_id, turn, role, least(size, 900 - before) AS kept FROM r WHERE n <= 5 AND before < 900")
def carried_budget(t: Tables) -> DataFrame:
    """Entries and characters budgeted across sources in their order: what one leaves, the next may use."""
    order = Window.partitionBy("conv_id").orderBy(F.col("role").desc(), "turn")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = t.conversations.withColumn("before", before).withColumn("n", F.row_number().over(order)).filter("n <= 5 AND before < 900")
    return rows.select("conv_id", "turn", "role", F.least(F.length("text"), 900 - F.col("before")).alias("kept"))


@query("SELECT e.source, e.n AS baseline, f.n AS other, f.n IS NULL AS omitted FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) e LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'es' AND n_chars > 6000 GROUP BY 1) f ON e.source = f.source")
def baseline_alignment(t: Tables) -> DataFrame:
    """A baseline edition beside another; what that one omits is flagged."""
    count = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    base, other = count(t.documents.filter("lang = 'en'"), "baseline"), count(t.documents.filter("lang = 'es' AND n_chars > 6000"), "other")
    return base.join(other, "source", "left").withColumn("omitted", F.col("other").isNull())


@query("SELECT p.p_partkey, coalesce(r.v, n.v, b.v, 'none') AS context, CASE WHEN r.v IS NOT NULL THEN 'rule' WHEN n.v IS NOT NULL THEN 'note' WHEN b.v IS NOT NULL THEN 'lexicon' ELSE 'none' END AS origin FROM part p LEFT JOIN (SELECT p_partkey, 'size ' || p_size AS v FROM part WHERE p_size > 45) r USING (p_partkey) LEFT JOIN (SELECT l_partkey AS p_partkey, 'order ' || min(l_orderkey) AS v FROM lineitem WHERE l_quantity >= 48 GROUP BY 1) n USING (p_partkey) LEFT JOIN (SELECT p_partkey, p_brand AS v FROM part WHERE p_retailprice > 1200) b USING (p_partkey)")
def precedence_chain(t: Tables) -> DataFrame:
    """The first of several sources that knows a word."""
    rule = t.part.filter("p_size > 45").select("p_partkey", F.concat(F.lit("size "), "p_size").alias("rule"))
    note = t.lineitem.filter("l_quantity >= 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.concat(F.lit("order "), F.min("l_orderkey")).alias("note"))
    lexicon = t.part.filter("p_retailprice > 1200").select("p_partkey", F.col("p_brand").alias("lexicon"))
    joined = t.part.select("p_partkey").join(rule, "p_partkey", "left").join(note, "p_partkey", "left").join(lexicon, "p_partkey", "left")
    origin = F.when(F.col("rule").isNotNull(), "rule").when(F.col("note").isNotNull(), "note").when(F.col("lexicon").isNotNull(), "lexicon").otherwise("none")
    return joined.select("p_partkey", F.coalesce("rule", "note", "lexicon", F.lit("none")).alias("context"), origin.alias("origin"))


@query("SELECT c.c_custkey, min(o_orderkey) AS bias FROM customer c LEFT JOIN orders o ON o_custkey = c_custkey AND contains(o_orderpriority, CASE WHEN c_mktsegment = 'BUILDING' THEN 'URGENT' ELSE 'LOW' END) GROUP BY 1")
def substring_bias(t: Tables) -> DataFrame:
    """A join on equal keys with a substring condition beside them; customers without a match stay."""
    wanted = F.when(F.col("c_mktsegment") == "BUILDING", "URGENT").otherwise("LOW")
    joined = t.customer.withColumn("wanted", wanted).join(t.orders, (F.col("o_custkey") == F.col("c_custkey")) & F.contains("o_orderpriority", "wanted"), "left")
    return joined.groupBy("c_custkey").agg(F.min("o_orderkey").alias("bias"))


@query("SELECT conv_id, position, d.doc_id, d.source FROM (SELECT conv_id, unnest(ids) AS doc_id, generate_subscripts(ids, 1) - 1 AS position FROM (SELECT conv_id, list(turn * 7 + conv_id ORDER BY turn DESC) AS ids FROM conversations GROUP BY 1)) r JOIN documents d ON r.doc_id = d.doc_id")
def ordered_lookup(t: Tables) -> DataFrame:
    """Rows by lists of ids, each with its place in the list."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("turn", (F.col("turn") * 7 + F.col("conv_id")).alias("id"))), asc=False), lambda x: x["id"])
    asked = t.conversations.groupBy("conv_id").agg(ids.alias("ids")).select("conv_id", F.posexplode("ids").alias("position", "doc_id"))
    return asked.join(t.documents.select("doc_id", "source"), "doc_id").select("conv_id", F.col("position").cast("long").alias("position"), "doc_id", "source")


@query("WITH a AS (SELECT conv_id % 40 AS thread, conv_id * 100 + turn AS place, role || ' ' || CASE WHEN turn % 2 = 0 THEN upper(text) ELSE '  ' || text END AS said FROM conversations UNION ALL SELECT conv_id % 40, conv_id * 100 + turn + 50, upper(role || ' ' || text) FROM conversations), f AS (SELECT thread, replace(lower(trim(said)), 'ß', 'ss') AS k, min(place) AS place FROM a WHERE length(trim(said)) BETWEEN 1 AND 300 GROUP BY ALL) SELECT thread, place, length(k) AS size FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY place) AS n FROM f) WHERE n <= 5")
def related_once(t: Tables) -> DataFrame:
    """The first five of each thread that differ by more than case and outer white space, whole; empty ones and those beyond 300 characters are left out."""
    place, start = F.col("conv_id") * 100 + F.col("turn"), F.col("text")
    rows = t.conversations.withColumn("thread", F.col("conv_id") % 40)
    once = rows.select("thread", place.alias("place"), F.concat("role", F.lit(" "), F.when(F.col("turn") % 2 == 0, F.upper(start)).otherwise(F.concat(F.lit("  "), start))).alias("said"))
    again = rows.select("thread", (place + 50).alias("place"), F.upper(F.concat("role", F.lit(" "), start)).alias("said"))
    return R.first_distinct(once.unionByName(again), "thread", "place", "said", 5, 300).select("thread", "place", F.length("k").cast("long").alias("size"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_acctbal > 9000) DESC, (c_mktsegment = 'AUTOMOBILE') DESC, c_custkey) AS n FROM customer) WHERE n <= 4 AND (c_acctbal > 9000 OR c_mktsegment = 'AUTOMOBILE' OR n <= 2)")
def selection_fill(t: Tables) -> DataFrame:
    """Selected and preferred editions, at least two and at most four a group."""
    chosen, preferred = F.col("c_acctbal") > 9000, F.col("c_mktsegment") == "AUTOMOBILE"
    ranked = R.top_per_group(t.customer, "c_nationkey", [chosen.desc(), preferred.desc(), F.col("c_custkey")], 4)
    return ranked.filter(chosen | preferred | (F.col("position") <= 2)).select("c_nationkey", "c_custkey")


@query("SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'repeated_key' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'unknown_key' WHEN 4 THEN 'not_json' WHEN 5 THEN 'too_many_members' WHEN 6 THEN 'too_deep' WHEN 7 THEN 'missing' END AS fault FROM events")
def strict_json(t: Tables) -> DataFrame:
    """Every fault at some row."""
    many, deep = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("1"), 101), ","), F.lit("]")), F.concat(F.repeat(F.lit("["), F.lit(13)), F.repeat(F.lit("]"), F.lit(13)))
    spoilt = [F.lit('{"k": 1, "k": 2}'), F.lit('{"k": NaN}'), F.lit('{"other": 1}'), F.lit('{"k": '), many, deep, F.lit(None).cast("string")]
    props = F.col("props")
    for i, bad in enumerate(spoilt, 1):
        props = F.when(F.col("event_id") % 9 == i, bad).otherwise(props)
    return t.events.select("event_id", D.json_fault(props, ["k"]).alias("fault"))


@query("SELECT s_suppkey, CASE WHEN abs(s_acctbal / 60) <= 90 THEN round(s_acctbal / 60, 6) END AS latitude, coalesce(nullif(trim(CASE WHEN s_acctbal > 5000 THEN '' ELSE s_name END), ''), 'unnamed') AS name FROM supplier")
def coordinate_checks(t: Tables) -> DataFrame:
    place = D.coordinates((F.col("s_acctbal") / 60).cast("string"), F.lit("12.5"))
    name = D.first_filled(F.when(F.col("s_acctbal") > 5000, F.lit("")).otherwise(F.col("s_name")), F.lit("unnamed"))
    return t.supplier.select("s_suppkey", F.round(place["latitude"], 6).alias("latitude"), name.alias("name"))


@query("SELECT lang, bool_and(known) AS equal FROM (SELECT d.lang, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) GROUP BY lang")
def set_equality(t: Tables) -> DataFrame:
    known = t.labels.select("doc_id", F.lit(True).alias("known")).distinct()
    return t.documents.join(known, "doc_id", "left").groupBy("lang").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("equal"))


@query("SELECT doc_id, CASE WHEN n_chars < 50 THEN 'no_entry' WHEN n_chars < 500 THEN 'coverage_incomplete' WHEN lang <> 'en' THEN 'wider_range' ELSE 'available' END AS state, source || ' — ' || lang || CASE WHEN n_chars > 500 THEN ' (' || n_chars || ')' ELSE '' END AS label FROM documents")
def availability_labels(t: Tables) -> DataFrame:
    state = F.when(F.col("n_chars") < 50, "no_entry").when(F.col("n_chars") < 500, "coverage_incomplete").when(F.col("lang") != "en", "wider_range").otherwise("available")
    label = F.concat("source", F.lit(" — "), "lang", F.when(F.col("n_chars") > 500, F.concat(F.lit(" ("), "n_chars", F.lit(")"))).otherwise(""))
    return t.documents.select("doc_id", state.alias("state"), label.alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'grand' WHEN o_totalprice > 100000 THEN 'usual' ELSE 'small' END || ':' || lower(replace(o_orderpriority, ' ', '_')) AS category, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def derived_categories(t: Tables) -> DataFrame:
    size = F.when(F.col("o_totalprice") > 400000, "grand").when(F.col("o_totalprice") > 100000, "usual").otherwise("small")
    return t.orders.select("o_orderkey", F.concat(size, F.lit(":"), F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("_")))).alias("category"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("WITH a AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT source, lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL) SELECT a.source, a.lang, a.n AS before, b.n AS after FROM a LEFT JOIN b ON a.source = b.source AND a.lang = b.lang WHERE a.n IS DISTINCT FROM b.n")
def catalogue_compare(t: Tables) -> DataFrame:
    """Grouped counts of a catalogue against those of a copy."""
    return L.snapshot_diff(t.documents, t.documents.join(t.labels.select("doc_id"), "doc_id"), ["source", "lang"])


@query("SELECT doc_id, array_to_string(list_slice(list_distinct_ordered, 1, 8), ' ') AS tokens FROM (SELECT doc_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT doc_id, list_filter(string_split_regex(lower(source || ' ' || lang || ' and the ' || source || ' passage'), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('and', 'the')) AS w FROM documents))")
def question_tokens(t: Tables) -> DataFrame:
    said = F.concat_ws(" ", "source", "lang", F.lit("and the"), "source", F.lit("passage"))
    return t.documents.select("doc_id", F.array_join(T.tokens(said), " ").alias("tokens"))
