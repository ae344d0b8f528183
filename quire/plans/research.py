"""Answers to questions: exact, chapter, event and lexical paths, typed retrieval, grounding of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import evidence as E
from quire.operators import grounding as N
from quire.operators import notices as W
from quire.operators import retrieval as R
from quire.plans.readers import aliases
from quire.plans.registry import Tables, query
from quire.plans.search import V, VECTOR, _cos

#: Questions that take each path: an exact reference, one that nothing answers, a chapter, words.
QUESTIONS = {"exact": "What does src3 1:5-40 say?", "empty": "What of src3 99:1 and the house?", "chapter": "Tell me of BOOK  4 2, please", "lexical": "Where's the house of src1 and les?"}
SCOPES = ("trusted", "editions")


def passages(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("book"), F.floor(F.col("doc_id") / 100).alias("chapter"), (F.col("doc_id") % 100).alias("verse"), "text", F.col("lang").alias("translation"))


def eligible(t: Tables) -> DataFrame:
    """Which books count in which translation: trusted translations have half of all books, other editions the works they are known to hold."""
    books = t.documents.select(F.col("source").alias("book")).distinct()
    number = F.substring("book", 4, 9).try_cast("int")
    trusted = books.filter(number % 2 == 1).withColumn("translation", F.explode(F.array(F.lit("en"), F.lit("fr"))))
    editions = t.documents.filter("lang IN ('de', 'es') AND n_chars > 3000").select(F.col("source").alias("book"), F.col("lang").alias("translation")).distinct()
    return E.scope({"trusted": trusted, "editions": editions}, SCOPES)


_passages = "SELECT doc_id AS id, source AS book, doc_id // 100 AS chapter, doc_id % 100 AS verse, text, lang AS translation FROM documents"
_eligible = "(SELECT DISTINCT source AS book, tr AS translation FROM documents, (SELECT unnest(['en', 'fr']) AS tr) WHERE CAST(substring(source, 4) AS INT) % 2 = 1 UNION SELECT DISTINCT source, lang FROM documents WHERE lang IN ('de', 'es') AND n_chars > 3000)"
_words = ["where's", "house", "src1", "les"]
_match = " + ".join(f"CASE WHEN lower(book) = '{w}' THEN 100 WHEN contains(lower(book), '{w}') THEN 50 WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END".replace("where's", "where''s") for w in _words)


@query(f"WITH p AS ({_passages}), e AS {_eligible}, s AS (SELECT p.* FROM p SEMI JOIN e ON p.book = e.book AND p.translation = e.translation), a AS (SELECT 'exact' AS asked, id, 1000 AS score, row_number() OVER (ORDER BY chapter, verse, upper(translation), id) AS position FROM p WHERE book = 'src3' AND chapter = 1 AND verse BETWEEN 5 AND 40), c AS (SELECT 'chapter' AS asked, id, 500 AS score, row_number() OVER (ORDER BY verse, upper(translation), id) AS position FROM s WHERE book = 'src4' AND chapter = 2), l AS (SELECT 'lexical' AS asked, id, score, row_number() OVER (ORDER BY score DESC, book, chapter, verse, upper(translation), id) AS position FROM (SELECT *, {_match} AS score FROM s) WHERE score > 0) SELECT asked, id, CAST(score AS BIGINT) AS score, position FROM (SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT * FROM l) WHERE position <= 12")
def evidence_paths(t: Tables) -> DataFrame:
    """Four questions, each on its path; a reference that nothing answers gives nothing and doesn't fall through to its words."""
    found = [E.evidence(passages(t), eligible(t), aliases(t), question, "study").select(F.lit(name).alias("asked"), "id", "score", "position") for name, question in QUESTIONS.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"WITH p AS ({_passages}), e AS {_eligible} SELECT book, translation, count(*) AS n FROM p SEMI JOIN e ON p.book = e.book AND p.translation = e.translation GROUP BY ALL")
def scope_eligibility(t: Tables) -> DataFrame:
    """Passages in scope, by trusted translations or by edition; the scope is a table, joined before any limit."""
    return E.in_scope(passages(t), eligible(t)).groupBy("book", "translation").agg(F.count("*").alias("n"))


@query("SELECT 'none' AS scopes, count(*) AS n FROM documents WHERE 0 = 1")
def empty_scope(t: Tables) -> DataFrame:
    """Without a scope nothing is eligible."""
    return E.in_scope(passages(t), E.scope({}, ())).agg(F.count("*").alias("n")).select(F.lit("none").alias("scopes"), "n")


@query("WITH i AS (SELECT user_id AS event, list('scripture:' || event_id // 3 ORDER BY ts, event_id)[1:40] AS ids FROM events GROUP BY 1), u AS (SELECT event, CAST(substring(x, 11) AS BIGINT) AS id, p FROM (SELECT event, unnest(ids) AS x, generate_subscripts(ids, 1) AS p FROM i)), f AS (SELECT event, id, min(p) AS p FROM u GROUP BY ALL), o AS (SELECT event, id, row_number() OVER (PARTITION BY event ORDER BY p) AS n FROM f) SELECT event, id, 33 - n AS score FROM o JOIN documents ON doc_id = id WHERE n <= 32")
def event_evidence(t: Tables) -> DataFrame:
    """Passages that events name by typed ids, in their order, each once: the first scores 32, the next one less."""
    ids = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: F.concat(F.lit("scripture:"), F.floor(x["event_id"] / 3))), 1, 40)
    events = t.events.groupBy(F.col("user_id").alias("event")).agg(ids.alias("ids"))
    return E.named_evidence(events, "event", "ids", "scripture", t.documents.select(F.col("doc_id").alias("id")))


@query("SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 3 AND regexp_matches(w, '^\\p{Lu}'))[1:10], ' ') AS entities, array_to_string(list_transform(string_split(text, ' ')[1:5], lambda w: lower(regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))), ' ') AS words FROM benchmark")
def question_entities(t: Tables) -> DataFrame:
    """Capitalised words, and the first words without punctuation at their ends."""
    first = F.transform(F.slice(F.split("text", " "), 1, 5), T.bare_word)
    return t.benchmark.select("item_id", F.array_join(T.capitalised(F.col("text")), " ").alias("entities"), F.array_join(first, " ").alias("words"))


_templates = [("light", m) for m in (3, 5, 7)] + [("water", m) for m in (11, 13, 15)]
_vectors = {(theme, m): [((i * m) % 13 - 6) / 6.0 for i in range(64)] for theme, m in _templates}
_themed = " UNION ALL ".join(f"SELECT * FROM (SELECT '{theme}' AS theme, vec_id, round({_cos.format(v='[' + ', '.join(f'{x!r}::DOUBLE' for x in v) + ']')}, 6) AS similarity FROM embeddings ORDER BY 3 DESC, 2 LIMIT 6)" for (theme, _), v in _vectors.items())


@query(f"SELECT theme, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY similarity DESC, vec_id) AS n FROM (SELECT theme, vec_id, max(similarity) AS similarity FROM ({_themed}) GROUP BY ALL)) WHERE n <= 10")
def thematic_search(t: Tables) -> DataFrame:
    """Three queries a theme, each with its share of the limit; an id keeps its best score in each theme. All queries score in one pass."""
    vectors = {f"{theme}/{m}": v for (theme, m), v in _vectors.items()}
    return E.thematic(t.embeddings, vectors, "embedding", "vec_id", 6, 10)


@query(f"WITH t AS (SELECT vec_id, round({_cos.format(v=V)}, 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20), g AS (SELECT vec_id, similarity, label FROM t JOIN embeddings USING (vec_id)) SELECT label, count(*) AS n, max(similarity) AS best FROM g GROUP BY label")
def neighbours_by_label(t: Tables) -> DataFrame:
    near = R.vector_top(t.embeddings, VECTOR, "embedding", "vec_id", 20)
    return near.join(t.embeddings.select("vec_id", "label"), "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.max("similarity").alias("best"))


@query("SELECT vec_id, round(sum(((s + i) % 997) / 997.0), 6)::DOUBLE AS total FROM (SELECT n_nationkey AS vec_id, list_sum(list_transform(string_split(n_name, ''), lambda c: ascii(c)))::BIGINT AS s FROM nation), (SELECT unnest(generate_series(0, 15)) AS i) GROUP BY 1")
def demo_embedding(t: Tables) -> DataFrame:
    """Sixteen numbers that a text's letters give, the same for the same text: for tests without a model."""
    return t.nation.select(F.col("n_nationkey").alias("vec_id"), F.round(F.aggregate(E.demo_vector(F.col("n_name")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_types = [("LOCATION", "n_name", 2, 5, 0.9), ("PERSON", "s_name", 3, 6, 0.8), ("HISTORICAL", "p_name", 1, 4, 0.7)]


@query("WITH w AS (SELECT DISTINCT source AS entity FROM documents), a AS (SELECT 'LOCATION' AS type, n_nationkey AS id, substring(n_name, 8) AS tail, 2 AS each, 5 AS most, 0.9 AS confidence FROM nation UNION ALL SELECT 'PERSON', s_suppkey, right(s_name, 1), 3, 6, 0.8 FROM supplier UNION ALL SELECT 'HISTORICAL', p_partkey, CAST(p_size AS VARCHAR), 1, 4, 0.7 FROM part), h AS (SELECT type, entity, id, each, most, confidence, row_number() OVER (PARTITION BY type, entity ORDER BY id) AS n FROM a JOIN w ON substring(entity, 4) = tail), d AS (SELECT type, id, most, confidence, row_number() OVER (PARTITION BY type ORDER BY id) AS p FROM (SELECT DISTINCT type, id, most, confidence FROM h WHERE n <= each)) SELECT type, id, CAST(confidence AS DOUBLE) AS confidence FROM d WHERE p <= most")
def typed_context(t: Tables) -> DataFrame:
    """Context by the question's type: a table of parameters (per entity, at most, confidence) drives one retrieval."""
    entities = t.documents.select(F.substring("source", 4, 9).alias("tail")).distinct()
    of = lambda df, kind, key, tail: df.select(F.lit(kind).alias("type"), F.col(key).cast("long").alias("id"), tail.alias("tail"))
    sources = of(t.nation, "LOCATION", "n_nationkey", F.substring("n_name", 8, 99)).unionByName(of(t.supplier, "PERSON", "s_suppkey", F.right("s_name", F.lit(1)))).unionByName(of(t.part, "HISTORICAL", "p_partkey", F.col("p_size").cast("string")))
    limits = t.spark.createDataFrame([(kind, each, most, confidence) for kind, _, each, most, confidence in _types], "type string, each int, most int, confidence double")
    return E.by_type(entities, sources, limits, "tail")


@query("SELECT conv_id, turn, CASE WHEN m > 0 THEN 'CONCEPTUAL' WHEN l >= p AND l >= c AND l >= h AND l >= x AND l > 0 THEN 'LOCATION' WHEN p >= c AND p >= h AND p >= x AND p > 0 THEN 'PERSON' WHEN c >= h AND c >= x AND c > 0 THEN 'CONCEPTUAL' WHEN h >= x AND h > 0 THEN 'HISTORICAL' WHEN x > 0 THEN 'TEXTUAL' ELSE 'GENERAL' END AS class FROM (SELECT conv_id, turn, contains(s, 'eaux')::INT AS m, contains(s, 'the')::INT + contains(s, 'th')::INT AS l, contains(s, 'er')::INT + contains(s, 'ich')::INT AS p, contains(s, 'tion')::INT AS c, contains(s, 'ado')::INT AS h, contains(s, 'ent')::INT + contains(s, 'ing')::INT AS x FROM (SELECT conv_id, turn, lower(text) AS s FROM conversations))")
def question_classes(t: Tables) -> DataFrame:
    """Five classes by their patterns, one pattern that overrides them, ties by the order of the classes."""
    said = F.lower("text")
    patterns = {"LOCATION": ["the", "th"], "PERSON": ["er", "ich"], "CONCEPTUAL": ["tion"], "HISTORICAL": ["ado"], "TEXTUAL": ["ent", "ing"]}
    best = R.argmax_class([(k, T.pattern_hits(said, v)) for k, v in patterns.items()], "GENERAL")
    return t.conversations.select("conv_id", "turn", F.when(F.contains(said, F.lit("eaux")), "CONCEPTUAL").otherwise(best).alias("class"))


@query("WITH c AS (SELECT conv_id AS id, list_distinct(list(turn + conv_id)) AS cited, max(role) = 'user' AND conv_id % 3 = 0 AS synthesis, CASE WHEN count(*) > 4 THEN 'high' ELSE 'medium' END AS confidence FROM conversations WHERE conv_id % 4 > 0 OR turn < 1 GROUP BY conv_id), k AS (SELECT doc_id AS source FROM labels WHERE quality = 1) SELECT id, array_to_string(kept, ',') AS kept, CASE WHEN len(kept) < len(cited) OR len(kept) = 0 THEN 'low' ELSE confidence END AS confidence FROM (SELECT *, list_sort(list_intersect(cited, (SELECT list(source) FROM k))) AS kept FROM c) WHERE len(kept) > 0 OR synthesis")
def claim_validation(t: Tables) -> DataFrame:
    """Claims without a known source go unless they are synthesis; those that lose some are of low confidence."""
    rows = t.conversations.filter("conv_id % 4 > 0 OR turn < 1").groupBy(F.col("conv_id").alias("id"))
    claims = rows.agg(F.collect_set(F.col("turn") + F.col("conv_id")).alias("cited"), ((F.max("role") == "user") & (F.col("id") % 3 == 0)).alias("synthesis"), F.when(F.count("*") > 4, "high").otherwise("medium").alias("confidence"))
    settled = N.settled_claims(claims, t.labels.filter("quality = 1").select(F.col("doc_id").alias("source")))
    return settled.select("id", F.array_join("kept", ",").alias("kept"), "confidence")


@query("WITH r AS (SELECT user_id AS id, list_distinct(list(event_id % 9)) AS ids FROM events GROUP BY 1) SELECT id, len(list_filter(ids, lambda x: x > 7)) = 0 AS stays FROM r UNION ALL SELECT -1, FALSE")
def timeline_rows(t: Tables) -> DataFrame:
    """Rows stay if they name sources and all are known."""
    known = F.array(*[F.lit(i).cast("long") for i in range(8)])
    rows = t.events.groupBy(F.col("user_id").alias("id")).agg(F.collect_set(F.col("event_id") % 9).alias("ids"))
    bare = t.events.limit(1).select(F.lit(-1).cast("long").alias("id"), F.array().cast("array<long>").alias("ids"))
    return rows.unionByName(bare).select("id", N.all_known(F.col("ids"), known).alias("stays"))


@query("WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM conversations), b AS (SELECT conv_id, arg_min(w, turn) AS b FROM w GROUP BY conv_id) SELECT conv_id, turn, len(list_filter(w, lambda x: NOT list_contains(b, x))) AS flagged FROM w JOIN b USING (conv_id)")
def token_flags(t: Tables) -> DataFrame:
    """Tokens of each turn that the first one lacks, repeats counted."""
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    turns = t.conversations.select("conv_id", "turn", w.alias("w"))
    base = turns.groupBy("conv_id").agg(F.min_by("w", "turn").alias("b"))
    return turns.join(base, "conv_id").select("conv_id", "turn", F.size(F.filter("w", lambda x: ~F.array_contains("b", x))).alias("flagged"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(m, 'promo|small') THEN 'retail' END, CASE WHEN regexp_matches(m, 'ring|gear|bolt') THEN 'metal' END, CASE WHEN regexp_matches(m, 'brand#[12]\\d') THEN 'house' END], lambda x: x IS NOT NULL), ',') AS categories FROM (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand) AS m FROM part)")
def metadata_categories(t: Tables) -> DataFrame:
    said = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    rules = {"retail": "promo|small", "metal": "ring|gear|bolt", "house": r"brand#[12]\d"}
    return t.part.select("p_partkey", F.array_join(F.array_compact(F.array(*[F.when(said.rlike(p), k) for k, p in rules.items()])), ",").alias("categories"))


@query("WITH p AS (SELECT event_id, user_id, event_id - 1 - event_id % 3 AS parent FROM events), t AS (SELECT p.event_id, p.user_id, q.user_id AS recipient, 'reply' AS kind FROM p JOIN events q ON q.event_id = p.parent UNION ALL SELECT event_id, user_id, event_id % 97, 'mention' FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id, event_id % 11, 'mention' FROM events WHERE event_type = 'view') SELECT event_id, recipient, max(kind) AS kind FROM t WHERE recipient <> user_id GROUP BY 1, 2")
def reply_and_mention_fanout(t: Tables) -> DataFrame:
    """Who is told of each post, by reply or mention, once and never of their own."""
    posts = t.events.select("event_id", "user_id", (F.col("event_id") - 1 - F.col("event_id") % 3).alias("parent"))
    named = t.events.filter("event_type = 'view'").select("event_id", F.explode(F.array(F.col("event_id") % 97, F.col("event_id") % 11)).alias("who"))
    return W.fanout(posts, named, "event_id", "user_id", "parent", "who")


@query("SELECT doc_id, lag(n_chars) OVER w AS before, n_chars - lag(n_chars) OVER w AS step FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)")
def edition_steps(t: Tables) -> DataFrame:
    before = F.lag("n_chars").over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return t.documents.select("doc_id", before.alias("before"), (F.col("n_chars") - before).alias("step"))


@query(f"WITH e AS (SELECT vec_id, embedding, source, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 0)), a AS (SELECT vec_id, row_number() OVER (ORDER BY round({_cos.format(v=V)}, 6) DESC, vec_id) AS p FROM e), b AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS p FROM (SELECT vec_id, CASE WHEN lower(source) = 'src1' THEN 100 WHEN contains(lower(source), 'src1') THEN 50 WHEN contains(lower(text), 'src1') THEN 1 ELSE 0 END + CASE WHEN lower(source) = 'the' THEN 100 WHEN contains(lower(source), 'the') THEN 50 WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END AS s FROM e) WHERE s > 0) SELECT vec_id, fused FROM (SELECT vec_id, round(sum(1.0 / (60 + p)), 9)::DOUBLE AS fused FROM (SELECT * FROM a WHERE p <= 40 UNION ALL SELECT * FROM b WHERE p <= 40) GROUP BY 1) ORDER BY fused DESC, vec_id LIMIT 24")
def hybrid_retrieval(t: Tables) -> DataFrame:
    """What is eligible first; then a vector and a word ranking of it, fused by reciprocal ranks, ties by id."""
    scope = t.labels.filter("toxic = 0").select(F.col("doc_id").alias("vec_id"))
    rows = t.embeddings.join(scope, "vec_id", "left_semi").join(t.documents.select(F.col("doc_id").alias("vec_id"), "source", "text"), "vec_id")
    near = rows.select("vec_id", F.round(R.cosine(F.col("embedding"), R.literal_vector(VECTOR)), 6).alias("score")).filter("score IS NOT NULL")
    said = rows.select("vec_id", R.lexical_score(F.col("source"), F.col("text"), ["src1", "the"]).alias("score")).filter("score > 0")
    ranked = [E.ranked(df, [F.col("score").desc(), F.col("vec_id")], 40) for df in (near, said)]
    return R.reciprocal_ranks(ranked, "vec_id").orderBy(F.col("fused").desc(), "vec_id").limit(24)
