"""Retrieval, grounding, graphs, text functions and windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import graph as G
from quire.operators import grounding as N
from quire.operators import retrieval as R
from quire.plans.registry import Tables, query
from quire.streaming import limits as S

#: The question and the vector that the registered retrievals ask.
QUESTION = ["src1", "then", "house", "that", "les", "der"]
VECTOR = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
V = "[" + ", ".join(f"{x!r}::DOUBLE" for x in VECTOR) + "]"
_score = " + ".join(f"CASE WHEN lower(source) = '{w}' THEN 100 WHEN contains(lower(source), '{w}') THEN 50 WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in QUESTION)
_cos = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), {v})"


@query(f"SELECT doc_id, lang, source, substring(text, 1, 240) AS excerpt, CAST(score AS BIGINT) AS score FROM (SELECT *, {_score} AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 24")
def lexical_topk(t: Tables) -> DataFrame:
    """The 24 best passages in scope; eligibility comes before the limit."""
    best = R.lexical_top(t.documents, t.labels.filter("quality = 1"), ["doc_id"], QUESTION, "source", "text", ["doc_id"])
    return best.select("doc_id", "lang", "source", T.excerpt(F.col("text"), 240).alias("excerpt"), "score")


@query(f"SELECT vec_id, round({_cos.format(v=V)}, 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def cosine_topk(t: Tables) -> DataFrame:
    return R.vector_top(t.embeddings, VECTOR, "embedding", "vec_id", 10)


@query(f"SELECT vec_id, label, round({_cos.format(v=V)}, 6) AS similarity FROM embeddings WHERE round({_cos.format(v=V)}, 6) >= 0.1")
def cosine_threshold(t: Tables) -> DataFrame:
    scored = t.embeddings.select("vec_id", "label", F.round(R.cosine(F.col("embedding"), R.literal_vector(VECTOR)), 6).alias("similarity"))
    return scored.filter("similarity >= 0.1")


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v, label AS l, vec_id AS i FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS similarity FROM embeddings, q WHERE vec_id <> i AND label <> l ORDER BY 2 DESC, 1 LIMIT 5")
def similar_exclude_label(t: Tables) -> DataFrame:
    """Neighbours of a row, itself and its label left out; the row is looked up and becomes a literal."""
    row = t.embeddings.orderBy("vec_id").first()
    if row is None:
        return t.embeddings.select("vec_id", F.lit(0.0).alias("similarity"))
    rest = t.embeddings.filter((F.col("vec_id") != row["vec_id"]) & (F.col("label") != row["label"]))
    return R.vector_top(rest, list(row["embedding"]), "embedding", "vec_id", 5)


_three = [[((i * m) % 13 - 6) / 6.0 for i in range(64)] for m in (5, 7, 9)]
_union = " UNION ALL ".join(f"SELECT * FROM (SELECT vec_id, round({_cos.format(v='[' + ', '.join(f'{x!r}::DOUBLE' for x in q) + ']')}, 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 6)" for q in _three)


@query(f"SELECT vec_id, max(similarity) AS similarity FROM ({_union}) GROUP BY vec_id ORDER BY 2 DESC, 1 LIMIT 12")
def multi_query_dedup(t: Tables) -> DataFrame:
    """Several queries, each with its own limit; an id keeps its best score."""
    found = [R.vector_top(t.embeddings, q, "embedding", "vec_id", 6) for q in _three]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("vec_id").agg(F.max("similarity").alias("similarity")).orderBy(F.col("similarity").desc(), "vec_id").limit(12)


@query("WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS p FROM documents), b AS (SELECT d.doc_id, row_number() OVER (PARTITION BY source ORDER BY quality DESC, d.doc_id) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, round(sum(1.0 / (60 + p)), 9)::DOUBLE AS fused FROM (SELECT * FROM a WHERE p <= 50 UNION ALL SELECT * FROM b WHERE p <= 50) GROUP BY doc_id")
def rrf_fusion(t: Tables) -> DataFrame:
    """Two rankings, by length within editions and by quality within books, fused by reciprocal ranks."""
    a = R.top_per_group(t.documents.select("doc_id", "lang", "n_chars"), "lang", [F.col("n_chars").desc(), F.col("doc_id")], 50)
    b = R.top_per_group(t.documents.select("doc_id", "source").join(t.labels, "doc_id"), "source", [F.col("quality").desc(), F.col("doc_id")], 50)
    return R.reciprocal_ranks([a, b], "doc_id")


@query("WITH u AS (SELECT 'documents' AS grp, doc_id AS id, source AS title, substring(text, 1, 60) AS excerpt, '/documents/' || doc_id AS url FROM documents WHERE contains(lower(text), 'the') UNION ALL SELECT 'messages', conv_id, role, substring(text, 1, 60), '/messages/' || conv_id || '/' || turn FROM conversations WHERE contains(lower(text), 'the') UNION ALL SELECT 'parts', p_partkey, p_brand, p_name, '/parts/' || p_partkey FROM part WHERE contains(lower(p_name), 'e')) SELECT grp, id, title, excerpt, url, p AS position FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id, url) AS p FROM u) WHERE p <= 10 ORDER BY grp, p LIMIT 40")
def group_capped_search(t: Tables) -> DataFrame:
    """One search over unlike tables: each group capped, then the whole."""
    row = lambda df, grp, id, title, excerpt, url: df.select(F.lit(grp).alias("grp"), F.col(id).cast("long").alias("id"), F.col(title).alias("title"), F.substring(excerpt, 1, 60).alias("excerpt"), url.alias("url"))  # noqa: A002, E731
    has = lambda df, c, x: df.filter(F.contains(F.lower(c), F.lit(x)))
    found = row(has(t.documents, "text", "the"), "documents", "doc_id", "source", "text", F.concat(F.lit("/documents/"), "doc_id"))
    found = found.unionByName(row(has(t.conversations, "text", "the"), "messages", "conv_id", "role", "text", F.concat(F.lit("/messages/"), "conv_id", F.lit("/"), "turn")))
    found = found.unionByName(row(has(t.part, "p_name", "e"), "parts", "p_partkey", "p_brand", "p_name", F.concat(F.lit("/parts/"), "p_partkey")))
    return R.cap_groups(found, "grp", [F.col("id"), F.col("url")], 40)


@query("SELECT conv_id, turn, b + length(text) > 600 AS truncated, substring(text, 1, CAST(600 - b AS BIGINT)) AS text FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b < 600")
def budget_prefix(t: Tables) -> DataFrame:
    return R.budget_prefix(t.conversations, ["conv_id"], ["turn"], "text", 600).select("conv_id", "turn", "truncated", "text")


_classes = {"LOCATION": ["where", "place|city", "th(e|at)"], "PERSON": ["who", "he|she"], "HISTORICAL": ["when", "year|time", "was"]}
_hit = {k: " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INT)" for p in v) for k, v in _classes.items()}


@query(f"SELECT conv_id, turn, CASE WHEN l >= p AND l >= h AND l > 0 THEN 'LOCATION' WHEN p >= h AND p > 0 THEN 'PERSON' WHEN h > 0 THEN 'HISTORICAL' ELSE 'GENERAL' END AS class FROM (SELECT conv_id, turn, {_hit['LOCATION']} AS l, {_hit['PERSON']} AS p, {_hit['HISTORICAL']} AS h FROM conversations)")
def question_class(t: Tables) -> DataFrame:
    """The class with most patterns that occur; the order of the classes breaks ties."""
    scores = [(k, T.pattern_hits(F.lower("text"), v)) for k, v in _classes.items()]
    return t.conversations.select("conv_id", "turn", R.argmax_class(scores, "GENERAL").alias("class"))


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(generate_series(0, CAST(greatest(0, ceil((len(w) - 350) / 310.0)) AS BIGINT))) AS chunk FROM w WHERE len(w) > 0) SELECT doc_id, chunk, len(w[chunk * 310 + 1 : chunk * 310 + 350]) AS words, md5(array_to_string(w[chunk * 310 + 1 : chunk * 310 + 350], ' ')) AS digest FROM s")
def chunk_passages(t: Tables) -> DataFrame:
    return R.chunk_words(t.documents, "doc_id", "text", 350, 40).select("doc_id", "chunk", "words", F.md5("body").alias("digest"))


_plain = "trim(regexp_replace(replace(lower(nfc_normalize({})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
#: Statements of every length: whole ones, and the first word, two or four words of each fifth.
_asked = "SELECT item_id, text AS said FROM benchmark UNION ALL SELECT item_id + 100000 * n AS item_id, array_to_string(list_slice(string_split(text, ' '), 1, n), ' ') AS said FROM benchmark CROSS JOIN (SELECT unnest([1, 2, 4]) AS n) WHERE item_id % 5 = 0"


def statements(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    lengths = F.array(*map(F.lit, (1, 2, 4)))
    short = t.benchmark.filter("item_id % 5 = 0").withColumn("n", F.explode(lengths))
    return t.benchmark.select("item_id", F.col("text").alias("said")).unionByName(short.select((F.col("item_id") + 100_000 * F.col("n")).alias("item_id"), F.array_join(F.slice(words, 1, F.col("n")), " ").alias("said")))



@query(f"SELECT DISTINCT b.item_id, d.doc_id FROM (SELECT item_id, {_plain.format('said')} AS s FROM ({_asked})) b JOIN (SELECT doc_id, {_plain.format('text')} AS t FROM documents) d ON contains(d.t, b.s) WHERE b.s <> ''")
def extractive_support(t: Tables) -> DataFrame:
    return N.supported(statements(t), t.documents, "said", "text", "item_id", "doc_id")


@query(f"WITH s AS (SELECT b.item_id, count(DISTINCT d.doc_id) AS n FROM (SELECT item_id, {_plain.format('text')} AS s FROM benchmark) b JOIN (SELECT doc_id, {_plain.format('text')} AS t FROM documents) d ON contains(d.t, b.s) WHERE b.s <> '' GROUP BY b.item_id) SELECT b.item_id, coalesce(n, 0) AS sources, CASE WHEN n > 0 THEN 'supported' WHEN length(b.text) > 300 THEN 'synthesis' ELSE 'dropped' END AS status FROM benchmark b LEFT JOIN s ON b.item_id = s.item_id")
def grounding_status(t: Tables) -> DataFrame:
    claims = t.benchmark.select("item_id", F.when(F.length("text") > 300, "synthesis").otherwise("quotation").alias("kind"))
    return N.settled(claims, N.supported(t.benchmark, t.documents, "text", "text", "item_id", "doc_id"), "item_id", "kind")


@query("WITH c AS (SELECT conv_id, list_distinct(list(turn % 5)) AS cited, list_distinct(list(turn % 3)) AS known FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_sort(list_intersect(cited, known)), ',') AS kept, len(list_intersect(cited, known)) = len(cited) AS valid FROM c")
def citation_validity(t: Tables) -> DataFrame:
    ids = t.conversations.groupBy("conv_id").agg(F.collect_set(F.col("turn") % 5).alias("cited"), F.collect_set(F.col("turn") % 3).alias("known"))
    checked = ids.withColumn("c", N.valid_citations(F.col("cited"), F.col("known")))
    return checked.select("conv_id", F.array_join(F.array_sort("c.kept").cast("array<string>"), ",").alias("kept"), F.col("c.valid").alias("valid"))


@query("WITH RECURSIVE a AS (SELECT conv_id * 4294967296 + turn AS node, conv_id * 4294967296 + turn - 1 AS ancestor, 1::BIGINT AS depth FROM conversations WHERE turn > (SELECT min(turn) FROM conversations) UNION ALL SELECT a.node, a.ancestor - 1, a.depth + 1 FROM a JOIN conversations c ON c.conv_id * 4294967296 + c.turn = a.ancestor WHERE c.turn > (SELECT min(turn) FROM conversations) AND a.depth < 64) SELECT * FROM a")
def thread_ancestry(t: Tables) -> DataFrame:
    least = t.conversations.agg(F.min("turn")).first()[0]
    node = F.col("conv_id") * (1 << 32) + F.col("turn")
    return G.ancestry(t.conversations.select(node.alias("node"), F.when(F.col("turn") > least, node - 1).alias("parent")), "node", "parent")


@query("SELECT DISTINCT l_partkey AS at, l_suppkey AS other FROM lineitem UNION SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def edges_both_directions(t: Tables) -> DataFrame:
    return G.both_ways(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("WITH p AS (SELECT DISTINCT l_orderkey AS i, l_returnflag AS s, l_linenumber AS n FROM lineitem) SELECT a.s AS from_system, a.n AS from_place, b.s AS to_system, b.n AS to_place, count(*) AS n FROM p a JOIN p b ON a.i = b.i AND a.s <> b.s GROUP BY ALL")
def cross_system_map(t: Tables) -> DataFrame:
    """Places of one system in the others, by the identity they share."""
    places = t.lineitem.select("l_orderkey", "l_returnflag", "l_linenumber").distinct()
    return G.cross_map(places, "l_returnflag", "l_linenumber", "l_orderkey").groupBy("from_system", "from_place", "to_system", "to_place").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING') DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def default_system(t: Tables) -> DataFrame:
    """The default of each group, else its first."""
    return R.top_per_group(t.customer, "c_nationkey", [(F.col("c_mktsegment") == "BUILDING").desc(), F.col("c_custkey")], 1).select("c_nationkey", "c_custkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
def nfc_normalised(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(T.nfc(F.col("text")), 256).alias("digest"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_matches(url, '^https://[A-Za-z0-9.-]+(:[0-9]+)?(/[^?#@[:space:]]*)?$') AS safe, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def url_checks(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("host"), T.safe_url(url).alias("safe"), T.slug(url).alias("slug"))


@query("SELECT doc_id, lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) AS key, sha256('[\"' || source || '\",\"' || lang || '\",' || doc_id || ']') AS checksum FROM documents")
def row_checksums(t: Tables) -> DataFrame:
    """Checksums of typed sequences, as a compact JSON list has them."""
    return t.documents.select("doc_id", T.bare_key(F.col("source")).alias("key"), T.sequence_checksum(T.json_text(F.col("source")), T.json_text(F.col("lang")), F.col("doc_id").cast("string")).alias("checksum"))


@query("SELECT conv_id, greatest(0, 95 - CASE WHEN n > 6 THEN 40 ELSE 0 END - CASE WHEN users < n / 2 THEN 20 ELSE 0 END - CASE WHEN size > 3000 THEN 10 ELSE 0 END) AS score, array_to_string(list_filter([CASE WHEN n > 6 THEN 'long' END, CASE WHEN users < n / 2 THEN 'one_sided' END, CASE WHEN size > 3000 THEN 'wordy' END], lambda x: x IS NOT NULL), ',') AS warnings FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users, sum(length(text)) AS size FROM conversations GROUP BY conv_id)")
def rule_score(t: Tables) -> DataFrame:
    facts = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.sum(F.length("text")).alias("size"))
    rules = [("long", F.col("n") > 6, 40), ("one_sided", F.col("users") < F.col("n") / 2, 20), ("wordy", F.col("size") > 3000, 10)]
    lost = sum((F.when(rule, cost).otherwise(0) for _, rule, cost in rules), F.lit(0))
    return facts.select("conv_id", F.greatest(F.lit(0), F.lit(95) - lost).alias("score"), F.array_join(F.array_compact(F.array(*[F.when(rule, name) for name, rule, _ in rules])), ",").alias("warnings"))


@query("WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM conversations), b AS (SELECT conv_id, arg_min(w, turn) AS b FROM w GROUP BY conv_id) SELECT conv_id, max(greatest(len(list_filter(w, lambda x: NOT list_contains(b, x))), len(list_filter(b, lambda x: NOT list_contains(w, x))))) AS difference FROM w JOIN b USING (conv_id) GROUP BY conv_id")
def word_diff(t: Tables) -> DataFrame:
    """The largest difference in words between the first turn and any other, in either direction."""
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    turns = t.conversations.select("conv_id", "turn", w.alias("w"))
    base = turns.groupBy("conv_id").agg(F.min_by("w", "turn").alias("b"))
    size = F.greatest(F.size(F.array_except("w", "b")), F.size(F.array_except("b", "w")))
    return turns.join(base, "conv_id").groupBy("conv_id").agg(F.max(size).alias("difference"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(t: Tables) -> DataFrame:
    return S.hourly_counts(t.events, "ts", "event_type")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS load FROM events")
def rate_limit_windows(t: Tables) -> DataFrame:
    return S.window_loads(t.events, "user_id", "ts", 86_400).select("event_id", "load")


@query()
def rate_limited(t: Tables) -> DataFrame:
    """Three events a user and day; what is refused uses no quota, so each verdict hangs on those before it. Tested against a plain loop."""
    return S.limited(t.events, "user_id", "ts", 3, 86_400)


@query()
def two_window_limits(t: Tables) -> DataFrame:
    """Events of each user under two limits at once, three a minute and fifty a day. Tested against a plain loop, and the stream against that."""
    return S.limited_by_windows(t.events, "user_id", "ts")


@query("SELECT user_id, event_type, min(ts) AS ts FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL")
def notifications_once(t: Tables) -> DataFrame:
    notes = t.events.select("user_id", "event_type", "ts")
    return S.sent_once(notes, "user_id", "event_type", "ts", t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")))


@query("SELECT c.conv_id, c.turn, p.role AS recipient FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1 WHERE p.role <> c.role")
def notification_fanout(t: Tables) -> DataFrame:
    """Who is told of a reply: the author before, never oneself."""
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("recipient"))
    return t.conversations.join(before, ["conv_id", "turn"]).filter("recipient <> role").select("conv_id", "turn", "recipient")


@query("SELECT conv_id, turn, role, length(text) AS size FROM conversations")
def shared_snapshot(t: Tables) -> DataFrame:
    """A thread frozen as JSON and unfolded again, row for row."""
    frozen = t.conversations.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("snapshot"))
    rows = frozen.select("conv_id", F.explode(F.from_json("snapshot", "array<struct<turn: long, role: string, text: string>>")).alias("r"))
    return rows.select("conv_id", "r.turn", "r.role", F.length("r.text").alias("size"))


_words = ["worthless", "house", "pathetic", "that"]


@query("WITH k AS (SELECT unnest(['worthless', 'house', 'pathetic', 'that']) AS word), f AS (SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS n FROM k JOIN (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM documents) USING (word)) SELECT doc_id, array_to_string(list_sort(list(word)), ',') AS words FROM f WHERE n <= 3 GROUP BY doc_id")
def keyword_retrieval(t: Tables) -> DataFrame:
    """The first three passages of each keyword, each passage once."""
    found = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).filter(F.col("word").isin(_words))
    return R.top_per_group(found, "word", [F.col("doc_id")], 3).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("word")), ",").alias("words"))


@query("SELECT conv_id, turn, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 'repeat' ELSE 'change' END AS step FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def role_changes(t: Tables) -> DataFrame:
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.when(before.eqNullSafe(F.col("role")), "repeat").otherwise("change").alias("step"))
