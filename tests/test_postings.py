import random
import re

from pyspark.sql import functions as F

from quire.operators import postings as P


def plain(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def test_phrases_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    words = ["a", "Be", "sea", "seas", "x1", "über", "the"]
    texts = [(rng.choice(["note", "place"]), i // 2, rng.choice(", |  |. |\n").join(rng.choices(words, k=rng.randrange(0, 30))), i) for i in range(200)]
    texts += [("note", 500, "sea the", 0), ("note", 500, "sea the", 0), ("note", 501, "a be", 0), ("note", 501, "sea seas", 0), ("note", 502, None, 0), (None, 1, "sea", 0), ("note", None, "sea", 0), ("note", 503, "the " * 50_000 + "end", 0)]
    df = spark.createDataFrame(texts, "kind string, id long, text string, term int")
    P.TextIndex.build(df, f"{tmp_path}/i")
    index = P.TextIndex(spark, f"{tmp_path}/i")  # as another session would
    phrases = [" ".join(rng.choices(words, k=k)) for k in (1, 2, 3, 4) for _ in range(20)] + ["be sea", "the end", "the the", "", None, "!?"]
    got = sorted(tuple(r) for r in index.holding(spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect())
    holds = lambda t, p: f" {' '.join(plain(p))} " in f" {' '.join(plain(t))} "
    want = sorted({(p, k, i) for p in phrases if p and plain(p) for k, i, t, _ in texts if k and i is not None and t and holds(t, p)})
    assert got == want and len(want) > 200
    assert ("the end", "note", 503) in got and ("be sea", "note", 501) not in got


def test_empty_tables(spark, tmp_path):
    index = P.TextIndex.build(spark.createDataFrame([("note", 1, "word")], "kind string, id long, text string"), f"{tmp_path}/i")
    assert index.holding(spark.createDataFrame([], "phrase string")).count() == 0
    questions, entities = spark.createDataFrame([], "question long, type string"), spark.createDataFrame([], "question long, nth int, phrase string")
    assert P.typed_retrieval(index, questions, entities).count() == 0


def test_types_limits_and_thresholds(spark, tmp_path):
    texts = [(kind, i, f"{w} {'also x' if i % 2 else ''}") for kind in ("note", "place", "lexicon") for w, ids in (("nile", range(0, 20)), ("moses", range(20, 23)), ("law", range(30, 40)), ("ark", range(50, 52))) for i in ids]
    index = P.TextIndex.build(spark.createDataFrame(texts, "kind string, id long, text string"), f"{tmp_path}/i")
    types = ["LOCATION", "PERSON", "CONCEPTUAL", "HISTORICAL", "TEXTUAL", "GENERAL", "OTHER", None]
    questions = spark.createDataFrame(list(enumerate(types)), "question int, type string")
    named = [(q, n, w) for q in range(8) for n, w in enumerate(["Nile", "moses", "law", "also x", "ark"])] + [(None, 0, "nile"), (0, 7, None)]
    near = [(q, i, s) for q in range(8) for i, s in enumerate([0.9, 0.65, 0.7, 0.5, *[0.8] * (12 if q == 1 else 3)])] + [(2, 99, None)]
    out = P.typed_retrieval(index, questions, spark.createDataFrame(named, "question int, nth int, phrase string"), spark.createDataFrame(near, "question int, id long, similarity double"))
    got = {}
    for r in out.orderBy("question", "kind", "position").collect():
        got.setdefault((r.question, r.kind), []).append(r.id)
    assert got[0, "place"] == [0, 1, 2, 20, 21] and got[0, "note"] == [0, 1, 20, 21, 30]
    assert got[1, "lexicon"] == [0, 1, 2, 20, 21, 22, 30, 31] and got[2, "lexicon"] == [0, 1, 20, 21, 30, 31, 3, 50]  # 1 comes with its first entity, once
    assert got[4, "lexicon"] == [0, 1, 2, 3, 20, 21, 22, 30] and got[5, "note"] == [0, 20]
    assert got[0, "passage"] == [0, 4, 5, 6, 2] and got[1, "passage"] == [0, *range(4, 13)]  # 0.7 is enough; ten at the most
    assert got[2, "passage"] == got[5, "passage"] == [0, 4, 5, 6, 2, 1]
    assert {q for q, _ in got} == set(range(6)) and (5, "place") not in got and (4, "note") not in got
    assert {r.confidence for r in out.filter(F.col("question") == 3).collect()} == {0.82}


def test_a_term_of_a_segment_is_one_row(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("note", i, "sea the " * 500 + f"x{i}") for i in range(40)], "kind string, id long, text string").coalesce(1)
    index = P.TextIndex.build(df, f"{tmp_path}/i")
    assert index.rows().filter("bucket >= 0").count() == 42 and index.rows().filter("bucket = -1").count() == 40
    monkeypatch.setattr(P, "PHRASES", 2)  # several passes
    got = {(r.phrase, r.id) for r in index.holding(spark.createDataFrame([("Sea  the",), ("the x7",), ("x7 sea",), ("the sea the",), ("x1",)], "phrase string")).collect()}
    assert got == {(p, i) for p in ("Sea  the", "the sea the") for i in range(40)} | {("the x7", 7), ("x1", 1)}
