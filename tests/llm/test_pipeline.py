import random

import corpus_pipeline as C
from quire.llm.simhash import fingerprint_of


def rows():
    rng = random.Random(2)
    sound = {"en": "the of and water house walk river stone".split(), "fr": "le de et eau maison marche pierre été".split()}
    out = []
    for i in range(200):
        lang = rng.choice(["en", "fr"])
        out.append((i, " ".join(rng.choices(sound[lang], k=60)), lang, "big" if i % 3 else f"s{i % 4}", 0))
    out += [(300 + i, out[i][1], out[i][2], out[i][3], 0) for i in range(20)]
    out += [(400, None, "en", "s1", 0), (401, "12 34 !!", None, "s1", 0), (402, "", "fr", None, 0)]
    out.append((403, "the water and the house of stone token = 'Zx9Qw8Er7Ty6Ui5Op4As3Df2' by the river walk", "en", None, 0))
    out.append((404, "long " * 9000, "en", "s2", 0))
    return [*out, out[0]]


def test_stages(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    text = {r[0]: r[1] for r in rows()}
    step = C.language_id(spark, df, "")
    kept = sorted(r.doc_id for r in step.collect())
    assert kept == sorted(r[0] for r in rows() if r[0] not in (400, 401, 402))
    step = C.near_dedup(spark, step, "")
    ids = [r.doc_id for r in step.collect()]
    prints = {i: fingerprint_of(text[i]) for i in set(kept)}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(ids) == sorted({find(i) for i in prints})
    step = C.secret_scan(spark, step, "")
    got = {r.doc_id: r for r in step.collect()}
    assert got[403].text == "the water and the house of stone [SECRET]' by the river walk" and got[403].n_chars == len(got[403].text)
    assert all(r.text == text[i] for i, r in got.items() if i != 403) and step.columns == df.columns
    step = C.mix_sources(spark, step, "")
    assert {r.doc_id for r in step.collect()} == set(got) and step.columns == df.columns
    packed = C.pack(spark, step, "").toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096 and set(packed.doc_id) == set(got)


def test_run(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() > 0
    assert C.queries()["pipeline"] is C.run and C.ORACLE_SQL is None


NAMES = "doc_id long, text string, lang string, source string, n_chars long, key int, doc int, h0 int, row int, found int, spans int, _tokens int, lang_pred int"


def test_null_and_shared_ids_and_clashing_names(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(500)], k=80))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (3, a), (None, None), (4, None), (5, b.upper())]
    df = spark.createDataFrame([(i, t, "en", "s", 0, *[7] * 8) for i, t in rows], NAMES)
    kept = C.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert got == sorted([(1, a), (2, c), (2, d), (4, ""), (5, rows[-1][1])])
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns and stage(spark, df.limit(0), "").count() == 0
    assert C.pack(spark, df.limit(0), "").count() == 0
    assert sorted(r.doc_id or 0 for r in C.secret_scan(spark, df, "").collect()) == sorted(i or 0 for i, _ in rows)
    assert all(r.key == 7 and r.found == 7 for r in C.secret_scan(spark, df, "").collect())
