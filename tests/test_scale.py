import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import merkle as M
from quire.operators import ranges as G
from quire.operators.chunks import Cutter, anchored_chunks, keyed
from quire.operators.retrieval import vector_top
from quire.operators.vectorindex import VectorIndex
from quire.plans import ORACLES, QUERIES
from tests.compare import connect, differences


def vectors(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[rng.integers(12)] + 0.6 * rng.normal(size=16)]) for i in range(n)]
    return rows + [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, rows[0][1])]


def test_recall_of_the_vector_index(spark, tmp_path):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, v array<double>, list string").repartition(5)
    VectorIndex.build(df, f"{tmp_path}/i", "id", "v", recall=0.95)
    index = VectorIndex.open(spark, f"{tmp_path}/i")  # as another session would
    assert 1 < len(index.centroids) <= 40 and index.probes < len(index.centroids)
    asked = df.filter("id % 50 = 0")
    got = {}
    for r in index.search(asked, 10).collect():
        got.setdefault(r["query"], []).append((r["position"], r["id"], r["similarity"]))
    hits = total = 0
    for r in asked.filter("id < 1500").collect():
        true = {x["id"] for x in vector_top(df.filter("id < 1500 OR id = 1503"), list(r["v"]), "v", "id", 10).collect()}
        found = sorted(got[r["id"]])
        assert [p for p, *_ in found] == list(range(1, len(found) + 1)) and [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
        hits, total = hits + len(true & {i for _, i, _ in found}), total + len(true)
    assert hits >= 0.9 * total
    whole = {(r["query"], r["id"]) for r in index.search(asked.filter("id IN (0, 100)"), 10, probes=len(index.centroids)).collect()}
    assert whole == {(q, x["id"]) for q in (0, 100) for x in vector_top(df.filter("id < 1500 OR id = 1503"), list(rows[q][1]), "v", "id", 10).collect()}
    assert index.rows().count() == 1501  # what has no direction is in no list
    assert "PartitionFilters" in index.search(asked, 10)._jdf.queryExecution().executedPlan().toString()


def test_vector_index_of_nothing_and_many_queries(spark, tmp_path, monkeypatch):
    from quire.operators import vectorindex

    empty = spark.createDataFrame([], "id long, v array<double>")
    assert VectorIndex.build(empty, f"{tmp_path}/e", "id", "v").search(empty, 3).count() == 0
    df = spark.createDataFrame(vectors(200), "id long, v array<double>")
    index = VectorIndex.build(df, f"{tmp_path}/i", "id", "v")
    one = sorted(map(tuple, index.search(df, 3).collect()))
    monkeypatch.setattr(vectorindex, "QUERIES", 60)
    assert sorted(map(tuple, index.search(df, 3).collect())) == one and len(one) == 201 * 3
    assert index.search(empty, 3).count() == 0


def test_limits_of_chunks():
    rng = random.Random(1)
    for _ in range(300):
        target, most = rng.choice([(350, 500), (10, 14), (5, 5), (30, 90)])
        overlap = rng.randrange(target)
        sizes = [rng.choice([1, 2, 3, rng.randrange(1, 2 * most), rng.randrange(1, target + 1)]) for _ in range(rng.randrange(0, 60))]
        cutter = Cutter(target, most, overlap)
        chunks = [c for c in (cutter.add(i, w) for i, w in enumerate(sizes)) if c]
        chunks += [c for c in [cutter.end()] if c]
        assert sorted({p for c in chunks for p in c}) == list(range(len(sizes)))
        for c in chunks:
            assert c == list(range(c[0], c[-1] + 1)) and (sum(sizes[p] for p in c) <= most or len(c) == 1)
        for a, b in zip(chunks, chunks[1:]):
            shared = set(a) & set(b)
            assert sum(sizes[p] for p in shared) <= overlap and b[-1] > a[-1] and b[0] > a[0]
            size = sum(sizes[p] for p in a)
            assert size >= target or size + sizes[a[-1] + 1] > most  # no chunk is closed early
    with pytest.raises(ValueError):
        Cutter(10, 9, 0)


def test_chunks_of_rows(spark):
    rng = random.Random(2)
    rows = [(g, i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 3, 40, 120, 600])))) for g in ("a", None, "b") for i in range(60)]
    rows += [("a", None, "no place"), ("a", 5, rows[5][2]), ("c", 1, None), ("d", 1, "only"), ("d", 1, "one and another"), ("d", 1, "only")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, o long, t string, chunk int")
    got = [sorted(map(tuple, anchored_chunks(df.repartition(n), ["g"], "o", "t").collect()), key=str) for n in (1, 7)]
    assert got[0] == got[1]
    for g in ("a", "b", None):
        texts = {o: t for k, o, t in rows if k == g and o is not None and t and t.split()}
        chunks = sorted((c for c in got[0] if c[0] == g), key=lambda c: c[1])
        assert [c[1] for c in chunks] == list(range(len(chunks))) and {o for c in chunks for o in texts if c[4] <= o <= c[5]} == set(texts)
        for c in chunks:
            held = [o for o in sorted(texts) if c[4] <= o <= c[5]]
            assert c[6] == "\n".join(texts[o] for o in held) and c[2] == len(held) and c[3] == len(c[6].split())
    assert [c[2:4] for c in got[0] if c[0] == "d"] == [(2, 4)] and not [c for c in got[0] if c[0] == "c"]
    keys = keyed(anchored_chunks(df, ["g"], "o", "t"), ["g"], "verse", ["chunk"])
    assert keys.agg(F.sum("copies")).first()[0] == len(got[0])
    assert anchored_chunks(df.limit(0), ["g"], "o", "t").count() == 0


def tree(df):
    return M.blocks(df, ["k"], ["k", "v"])


def test_ordered_digest(spark, monkeypatch):
    rows = [(i if i % 50 else None, f"v{i % 700}", 0) for i in range(4000)] + [(7, "same", 0)] * 5
    df = spark.createDataFrame(rows, "k long, v string, block int")
    base = M.root(tree(df))
    assert all(M.root(tree(df.repartition(n))) == base for n in (1, 3, 11))
    assert tree(df).agg(F.sum("rows")).first()[0] == len(rows) and tree(df).count() > 5
    for other in (df.withColumn("v", F.when(F.col("k") == 1234, "changed").otherwise(F.col("v"))), df.filter("k IS NULL OR k <> 1234"), df.unionByName(df.filter("k = 1234"))):
        found = M.changed(tree(df), tree(other)).collect()
        assert M.root(tree(other)) != base and found and all(r["first"]["k"] is None or r["first"]["k"] <= 1234 <= r["last"]["k"] for r in found)
        assert sum(r["rows"] for r in found) < 3000
    swapped = df.withColumn("v", F.when(F.col("k") == 11, F.lit("v12")).when(F.col("k") == 12, F.lit("v11")).otherwise(F.col("v")))
    assert M.root(tree(swapped)) != base  # the same values in another order
    assert M.changed(tree(df), tree(df.repartition(5))).count() == 0
    monkeypatch.setattr(M, "ROOT", 1)
    deep = M.root(tree(df))
    assert deep == M.root(tree(df.repartition(6)))
    assert tree(df.limit(0)).count() == 0 and M.root(tree(df.limit(0))) == M.root(tree(df.limit(0)))


def test_tasks_hand_on_the_best_of_a_query_only(spark, tmp_path):
    """Copies in great number tie at every place; a task gives k rows a query, not all that tie."""
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(3000)], "id long, v array<double>").coalesce(1)
    index = VectorIndex.build(df, f"{tmp_path}/i", "id", "v", lists=2)
    asked = df.filter("id < 4")
    found = index._pass(asked.select(F.col("id").alias("query"), "v").toPandas(), 5, 2, asked.select(F.col("id").alias("query")))
    assert found.count() <= 4 * 5 * index.rows().rdd.getNumPartitions()
    got = index.search(asked, 5, probes=2).orderBy("query", "position").collect()
    assert [r["id"] for r in got] == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9] * 2


def test_ordered_digest_of_several_levels_against_sql(spark, monkeypatch):
    """Few blocks are joined at once as a table of many thousands would have them."""
    sql = ORACLES["ordered_digest"]
    monkeypatch.setattr(M, "ROOT", 1)
    folder = "/root/testdata/sf0.01"
    assert "n > 1024" in sql and differences(spark, connect(folder), folder, QUERIES["ordered_digest"], sql.replace("n > 1024", "n > 1")) == ""


def test_range_join_against_brute_force(spark):
    rng = random.Random(4)
    ranges = [(rng.randrange(6), rng.choice("ab"), lo, lo + rng.choice([0, 1, 5, 300, 5000, -1])) for lo in (rng.randrange(-500, 6000) for _ in range(80))] + [(9, "a", None, 3), (9, "a", 1, None)]
    places = [(i, rng.choice("abc"), rng.choice([rng.randrange(-600, 12000), None, 1024, 2047])) for i in range(3000)]
    r, p = spark.createDataFrame(ranges, "e int, book string, low long, high long"), spark.createDataFrame(places, "id int, book string, at long")
    got = [tuple(x) for x in G.range_join(r, p, ["e"], ["book"], "low", "high", "at").select("e", "id").collect()]
    want = {(e, i) for e, b, lo, hi in ranges if lo is not None and hi is not None for i, c, at in places if at is not None and b == c and lo <= at <= hi}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    largest = G.range_join(spark.createDataFrame([(1, "a", 0, 1 << 20)], "e int, book string, low long, high long"), p, ["e"], ["book"], "low", "high", "at")
    assert largest.count() == sum(c == "a" and at is not None and at >= 0 for _, c, at in places)


def test_complete_editions(spark):
    ranges = spark.createDataFrame([(1, "g", 1, 2), (1, "g", 2, 3), (2, "g", 1, 4), (3, "g", 9, 9)], "e int, book string, low long, high long")
    rows = [(10, "en", 1), (11, "en", 3), (12, "de", 1), (13, "de", 2), (14, "de", 3), (15, "de", 2), (16, "xx", 9), (17, "fr", 1), (18, "fr", 2), (19, "fr", 3), (20, "fr", 4)]
    placed = spark.createDataFrame([(i, t, "g", v) for i, t, v in rows], "id int, lang string, book string, verse long")
    pairs = G.range_join(ranges, placed, ["e"], ["book"], "low", "high", "verse")
    best = G.complete_editions(pairs, ranges, ["e"], ["book"], "low", "high", "verse", "lang", "id", ["en", "de", "fr"])
    assert sorted((r["e"], r["lang"], r["rows"]) for r in best.collect()) == [(1, "de", [12, 13, 14]), (2, "fr", [17, 18, 19, 20])]
