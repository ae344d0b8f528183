"""Indexes, chunks, digests and range joins that keep their shape at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chunks as C
from quire.operators import merkle as M
from quire.operators import postings as P
from quire.operators import ranges as G
from quire.operators.graph import settled
from quire.operators.vectorindex import VectorIndex
from quire.plans.files import scratch
from quire.plans.registry import Tables, query


def _index(t: Tables) -> VectorIndex:
    return VectorIndex.build(t.embeddings, scratch(t.spark), "vec_id", "embedding", recall=0.95)


@query()
def indexed_vectors(t: Tables) -> DataFrame:
    """The ten nearest of every fiftieth vector, by an inverted-file index that probes as few lists as find 95 % of them."""
    return _index(t).search(t.embeddings.filter("vec_id % 50 = 0"), 10)


@query("SELECT query, vec_id, similarity, position FROM (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS position FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE position <= 10")
def indexed_vectors_whole(t: Tables) -> DataFrame:
    """The same with all lists probed, which finds all."""
    index = _index(t)
    return index.search(t.embeddings.filter("vec_id % 50 = 0"), 10, probes=len(index.centroids))


_words = "len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))"
_chunks = f"""
WITH RECURSIVE a AS (SELECT lang, source, doc_id, text, {_words} AS w FROM documents),
g AS (SELECT lang, source, list(doc_id ORDER BY doc_id) AS ids, list(text ORDER BY doc_id) AS texts, list(CAST(w AS BIGINT) ORDER BY doc_id) AS ws FROM a WHERE w > 0 GROUP BY ALL),
p AS (SELECT *, len(ids) AS n, list_concat([0::BIGINT], list_transform(range(1, len(ids) + 1), lambda i: CAST(list_sum(ws[1:i]) AS BIGINT))) AS sums FROM g),
c AS (SELECT lang, source, 0::BIGINT AS chunk, 1::BIGINT AS s, (SELECT 1) AS one FROM p
  UNION ALL SELECT lang, source, chunk + 1, s2, 1 FROM (
    SELECT x.lang, x.source, x.chunk, e, n, coalesce(list_min(list_filter(range(x.s + 1, e + 1), lambda j: sums[e + 1] - sums[j] <= 40 AND sums[e + 2] - sums[j] <= 500)), e + 1) AS s2 FROM (
      SELECT c.*, p.n, p.sums, CASE WHEN sums[e1 + 1] - sums[s] > 500 AND e1 > s THEN e1 - 1 ELSE e1 END AS e FROM (SELECT c.*, coalesce(list_min(list_filter(range(s, n + 1), lambda i: sums[i + 1] - sums[s] >= 350)), n) AS e1 FROM c JOIN p USING (lang, source)) c JOIN p USING (lang, source)) x) WHERE e < n),
f AS (SELECT c.lang, c.source, chunk, s, ids, texts, sums, n, coalesce(list_min(list_filter(range(s, n + 1), lambda i: sums[i + 1] - sums[s] >= 350)), n) AS e1 FROM c JOIN p USING (lang, source)),
h AS (SELECT *, CASE WHEN sums[e1 + 1] - sums[s] > 500 AND e1 > s THEN e1 - 1 ELSE e1 END AS e FROM f)
"""


def _chunked(t: Tables) -> DataFrame:
    return C.anchored_chunks(t.documents, ["lang", "source"], "doc_id", "text")


@query(_chunks + "SELECT lang, source, chunk, e - s + 1 AS anchors, sums[e + 1] - sums[s] AS words, ids[s] AS first, ids[e] AS last, sha256(array_to_string(texts[s:e], chr(10))) AS digest FROM h")
def anchored_chunks(t: Tables) -> DataFrame:
    """Documents as the anchors of a division: chunks of whole anchors, with the digest of each whole chunk."""
    return _chunked(t).withColumn("digest", F.sha2("body", 256)).drop("body")


@query(_chunks + "SELECT lang, source, 'document' AS boundary, sha256(array_to_string(texts[s:e], chr(10))) AS digest, count(*) AS copies, min(chunk) AS chunk FROM h GROUP BY ALL")
def chunk_keys(t: Tables) -> DataFrame:
    """Chunks of one edition and division with one boundary and digest are one."""
    return C.keyed(_chunked(t), ["lang", "source"], "document", ["chunk"])


_row = "concat_ws(';', " + ", ".join(f"CASE WHEN {c} IS NULL THEN 'n' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")"
_blocks = f"WITH RECURSIVE l AS (SELECT k0, sha256(h || ':' || count(*)) AS leaf, count(*) AS n FROM (SELECT doc_id AS k0, sha256({_row}) AS h FROM documents) GROUP BY k0, h), b AS (SELECT *, count(*) FILTER (WHERE starts_with(leaf, '00')) OVER (ORDER BY k0 NULLS FIRST, leaf) AS block FROM l), d AS (SELECT block, arg_min_null(k0, nth) AS first, arg_max_null(k0, nth) AS last, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(leaf, '' ORDER BY nth)) AS digest FROM (SELECT *, row_number() OVER (ORDER BY k0 NULLS FIRST, leaf) AS nth FROM b) GROUP BY block)"
#: As long as they are more than ROOT, the digests in their order are cut into blocks again, each with the digest of its own.
_levels = f"v AS (SELECT 0 AS level, block, digest FROM d UNION ALL SELECT level + 1, b, sha256(string_agg(digest, '' ORDER BY block)) FROM (SELECT *, count(*) OVER () AS n, count(*) FILTER (WHERE starts_with(digest, '{M.OPENS}')) OVER (ORDER BY block) AS b FROM v) WHERE n > {M.ROOT} GROUP BY level, b)"


def _tree(t: Tables, df: DataFrame) -> DataFrame:
    return M.blocks(df, ["doc_id"], ["doc_id", "text", "lang", "source", "n_chars"])


@query(f"{_blocks}, {_levels} SELECT block, first, last, rows, digest FROM d UNION ALL SELECT -1, (SELECT min(first) FROM d), (SELECT max(last) FROM d), (SELECT CAST(sum(rows) AS BIGINT) FROM d), sha256(coalesce(string_agg(digest, '' ORDER BY block), '')) FROM v WHERE level = (SELECT max(level) FROM v)")
def ordered_digest(t: Tables) -> DataFrame:
    """Blocks of a table in its order with their digests, and as block -1 the digest of all."""
    found = settled(_tree(t, t.documents).select("block", F.col("first.doc_id").alias("first"), F.col("last.doc_id").alias("last"), "rows", "digest"))
    whole = found.agg(F.lit(-1).cast("long").alias("block"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows")).withColumn("digest", F.lit(M.root(found)))
    return found.unionByName(whole)


@query("SELECT count(*) AS differ FROM documents WHERE doc_id % 1000 = 500")
def digest_changes(t: Tables) -> DataFrame:
    """Two states of a table compared by their blocks; only in the ranges that differ are rows compared."""
    now = t.documents.withColumn("text", F.when(F.col("doc_id") % 1000 == 500, F.concat(F.coalesce("text", F.lit("")), F.lit(" mended"))).otherwise(F.col("text")))
    spans = M.changed(_tree(t, t.documents), _tree(t, now)).select(F.lit("here").alias("which"), F.col("first.doc_id").alias("low"), F.col("last.doc_id").alias("high"))
    found = lambda df: G.range_join(spans, df.select("doc_id", F.sha2("text", 256).alias("digest")), ["which"], [], "low", "high", "doc_id")
    return found(t.documents).join(found(now).withColumnRenamed("digest", "other"), "doc_id").filter("digest <> other").agg(F.count("*").alias("differ"))


_ranges = "SELECT user_id AS event, 'src' || event_id % 20 AS source, event_id // 2 AS low, event_id // 2 + event_id % 5 + CASE WHEN event_id % 40 = 0 THEN 100 ELSE 0 END AS high FROM events"


def _told(t: Tables) -> DataFrame:
    id_ = F.col("event_id")
    high = F.floor(id_ / 2) + id_ % 5 + F.when(id_ % 40 == 0, 100).otherwise(0)
    return t.events.select(F.col("user_id").alias("event"), F.concat(F.lit("src"), (id_ % 20).cast("string")).alias("source"), F.floor(id_ / 2).alias("low"), high.alias("high"))


@query(f"SELECT DISTINCT event, doc_id FROM ({_ranges}) r JOIN documents d ON d.source = r.source AND d.doc_id BETWEEN r.low AND r.high")
def event_ranges(t: Tables) -> DataFrame:
    """Events and the passages they tell of: any of several ranges, each of a book; ranges overlap, pairs come once."""
    return G.range_join(_told(t), t.documents.select("doc_id", "source"), ["event"], ["source"], "low", "high", "doc_id").select("event", "doc_id")


_trust = ["en", "de", "fr", "es"]


@query(
    "WITH r AS (SELECT event_id % 5000 AS event, doc_id % 2 AS half, event_id % 5000 % 90 AS low, event_id % 5000 % 90 + event_id // 5000 % 3 AS high FROM events JOIN (SELECT DISTINCT doc_id % 2 AS doc_id FROM documents) h ON h.doc_id = event_id % 2), w AS (SELECT DISTINCT event, half, unnest(generate_series(low, high)) AS p FROM r), n AS (SELECT event, count(*) AS wanted FROM w GROUP BY 1),"
    " f AS (SELECT event, half, p, lang, min(doc_id) AS id FROM w JOIN documents ON doc_id % 2 = half AND doc_id // 8 = p GROUP BY ALL), k AS (SELECT event, lang, list_position(['en', 'de', 'fr', 'es'], lang) AS rank, count(*) AS held, array_to_string(list(id ORDER BY half, p), ',') AS ids FROM f GROUP BY 1, 2) SELECT event, arg_min(lang, rank) AS lang, arg_min(ids, rank) AS ids FROM k JOIN n USING (event) WHERE held = wanted AND rank > 0 GROUP BY event"
)
def range_editions(t: Tables) -> DataFrame:
    """Of each event the most trusted edition that has every verse of all its ranges."""
    id_ = F.col("event_id")
    told = t.events.select((id_ % 5000).alias("event"), (id_ % 2).alias("half"), (id_ % 5000 % 90).alias("low"), (id_ % 5000 % 90 + F.floor(id_ / 5000) % 3).alias("high"))
    placed = t.documents.select("doc_id", "lang", (F.col("doc_id") % 2).alias("half"), F.floor(F.col("doc_id") / 8).alias("verse"))
    pairs = G.range_join(told, placed, ["event"], ["half"], "low", "high", "verse")
    best = G.complete_editions(pairs, told, ["event"], ["half"], "low", "high", "verse", "lang", "doc_id", _trust)
    return best.select("event", "lang", F.array_join(F.col("rows").cast("array<string>"), ",").alias("ids"))


_spaced = lambda column: f"' ' || array_to_string(list_filter(string_split_regex(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' '"
_kinds = ["LOCATION", "PERSON", "CONCEPTUAL", "HISTORICAL", "TEXTUAL", "GENERAL"]
_held = f"""
WITH t AS (SELECT 'note' AS kind, doc_id AS id, {_spaced("text")} AS said FROM documents UNION ALL SELECT 'lexicon', conv_id, {_spaced("text")} FROM conversations UNION ALL SELECT 'place', page_id, {_spaced("html")} FROM pages),
w AS (SELECT item_id AS question, string_split(trim({_spaced("text")}), ' ') AS words FROM benchmark),
e AS (SELECT question, nth, words[2 * nth + 1] || ' ' || words[2 * nth + 2] AS phrase FROM (SELECT *, unnest(range(len(words) // 2)) AS nth FROM w)),
h AS (SELECT DISTINCT phrase, kind, id FROM (SELECT DISTINCT phrase FROM e) JOIN t ON contains(said, ' ' || phrase || ' '))
"""


def _texts(t: Tables) -> DataFrame:
    of = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("text"))
    return of(t.documents, "note", "doc_id", "text").unionByName(of(t.conversations, "lexicon", "conv_id", "text")).unionByName(of(t.pages, "place", "page_id", "html"))


def _pairs(t: Tables) -> DataFrame:
    """Each benchmark item as a question, its words two by two as its entities."""
    words = t.benchmark.select(F.col("item_id").alias("question"), P.terms(F.col("text")).alias("words")).filter("size(words) > 1")
    starts = words.select("question", "words", F.explode(F.sequence(F.lit(0), F.floor(F.size("words") / 2).cast("int") - 1)).alias("nth"))
    return starts.select("question", "nth", F.array_join(F.slice("words", F.col("nth") * 2 + 1, F.lit(2)), " ").alias("phrase"))


@query(_held + "SELECT phrase, kind, count(*) AS texts, min(id) AS first, max(id) AS last FROM h GROUP BY ALL")
def indexed_phrases(t: Tables) -> DataFrame:
    """How many documents, conversations and pages hold each two words of the benchmark next to each other, by a stored index of places."""
    held = P.TextIndex.build(_texts(t), scratch(t.spark)).holding(_pairs(t).select("phrase"))
    return held.groupBy("phrase", "kind").agg(F.count("*").alias("texts"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(
    _held
    + f", r AS (SELECT * FROM (VALUES {', '.join(map(str, P.ROUTES))}) AS r(type, kind, each, most, counted, confidence)), "
    + f"q AS (SELECT item_id AS question, {_kinds}[item_id % 6 + 1] AS type FROM benchmark), "
    + "n AS (SELECT *, row_number() OVER (PARTITION BY phrase, kind ORDER BY id) AS place FROM h), "
    + "f AS (SELECT question, n.kind, id, most, r.confidence, min(nth) AS nth FROM q JOIN e USING (question) JOIN r USING (type) JOIN n ON n.phrase = e.phrase AND n.kind = r.kind WHERE (counted = 0 OR nth < counted) AND place <= each GROUP BY ALL) "
    + "SELECT question, kind, id, position, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY question, kind ORDER BY nth, id) AS position FROM f) WHERE position <= most"
)
def typed_texts(t: Tables) -> DataFrame:
    """Context of questions of six types from three kinds of texts, over the same index."""
    index = P.TextIndex.build(_texts(t), scratch(t.spark))
    kinds = F.array(*[F.lit(k) for k in _kinds])
    questions = t.benchmark.select(F.col("item_id").alias("question"), F.element_at(kinds, (F.col("item_id") % 6 + 1).cast("int")).alias("type"))
    return P.typed_retrieval(index, questions, _pairs(t))
