import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm.common import fold
from quire.llm.language import identify, viterbi

WORDS = {"en": "the house stands by water where people walk and speak under trees", "fr": "la maison près de l'eau où les gens marchent et parlent sous les arbres", "ru": "дом стоит у воды где люди ходят и говорят под деревьями"}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, k = rng.integers(1, 7), rng.integers(1, 4)
        s = -rng.random((n, k)) * 6
        s -= s.max(axis=1, keepdims=True)
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(value(p) for p in itertools.product(range(k), repeat=n))
        assert abs(value(viterbi(s, 3.0)) - best) < 1e-9


def rows():
    rng = random.Random(5)
    out = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang].split(), k=12)), lang, "clash"))
    mixed = WORDS["en"] * 3 + " " + WORDS["ru"]
    return [*out, (900, None, "en", None), (901, "", None, ""), (902, "12 %% !", "fr", ""), (903, mixed, None, ""), (904, "ελληνικά", None, ""), (None, "the water", None, ""), (905, "the house " * 30000, "en", "")]


def test_languages(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, score string")
    got = identify(df, F.coalesce(fold("doc_id", 3) != 1, F.lit(False)), most=100).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows())
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows()[:240]) and by[905].lang_pred == "en"
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred == "en" and "ru" in by[903].spans and by[904].lang_pred in WORDS and 0 <= by[904].score <= 1
    assert identify(df.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in identify(df, F.lit(False)).collect()} == {"und"}


def test_spans_of_mixed_texts_and_letters_beyond_the_first_plane(spark):
    """Spans of six to twenty words of one language after another: nine of ten words get theirs; letters of any plane count."""
    deseret = "".join(chr(c) for c in range(0x10428, 0x10450))
    rng = random.Random(4)
    words = {k: v.split() for k, v in WORDS.items()} | {"xx": ["".join(rng.choices(deseret, k=rng.randint(2, 7))) for _ in range(12)]}
    learned = [(i, " ".join(rng.choices(words[lang], k=20)), lang) for i in range(200) for lang in [list(words)[i % 4]]]
    mixed, truth = [], {}
    for i in range(60):
        said, langs = [], []
        for lang in rng.sample(list(words), 3):
            part = rng.choices(words[lang], k=rng.randint(6, 20))
            said += part
            langs += [lang] * len(part)
        mixed.append((1000 + i, " ".join(said), None))
        truth[1000 + i] = langs
    df = spark.createDataFrame(learned + mixed, "doc_id long, text string, lang string")
    right = total = 0
    for r in identify(df, F.col("doc_id") < 1000).collect():
        if r.doc_id < 1000:
            assert r.lang_pred == learned[r.doc_id][2]
            continue
        for span in r.spans.split(","):
            lang, begin, end = span.split(":")
            right += sum(x == lang for x in truth[r.doc_id][int(begin) : int(end)])
        total += len(truth[r.doc_id])
    assert right / total > 0.9, right / total
