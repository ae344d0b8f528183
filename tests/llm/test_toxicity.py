import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import toxicity as T
from quire.llm.common import fold


def brute(s, t, n, decay):
    """The kernel by listing all subsequences."""
    import itertools

    def weights(w):
        out = {}
        for c in itertools.combinations(range(len(w)), n):
            key = "".join(w[i] for i in c)
            out[key] = out.get(key, 0) + decay ** (c[-1] - c[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(a[k] * b.get(k, 0) for k in a)


def test_kernel_against_all_subsequences():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcd", k=rng.randint(3, 8))) for _ in range(40)]
    a, _ = T.coded(words[:20])
    b, _ = T.coded(words[20:])
    got = T.raw_kernel(a, b)
    want = [brute(s, t, T.ORDER, T.DECAY) for s, t in zip(words[:20], words[20:])]
    assert np.allclose(got, want)


def test_second_kernel_against_all_subsequences():
    rng = random.Random(2)
    landmarks = ["abc", "abcd", "dcbad", "abcdabd"]
    words = ["".join(rng.choices("abcd", k=rng.randint(3, 10))) for _ in range(60)] + landmarks + ["#".join(w) for w in landmarks]
    kernel = T.Kernel(landmarks)
    got = kernel.of(words)[:, len(landmarks) :]
    for j, mark in enumerate(landmarks):
        order = min(T.LONG, len(mark))
        share = lambda w: brute(w, mark, order, T.DECAY) / brute(mark, mark, order, T.DECAY)  # noqa: E731, B023
        assert np.isclose(kernel.spread[j], share("#".join(mark)))
        want = [v if set(mark) <= set(w) and (v := share(w)) >= T.NEARLY * kernel.spread[j] - 1e-9 else 0 for w in words]
        assert np.allclose(got[:, j], want)


INSULTS = ["scum", "trash", "clown", "idiot", "moron", "stupid", "blockhead", "numbskull"]


def clean_words(rng, n=120):
    return ["".join(rng.choices("aeioubfgvwzhlr", k=rng.randint(2, 7))) for _ in range(n)]


def rows():
    """300 labelled texts, a third with one to three insults, and texts that aren't labelled."""
    rng = random.Random(4)
    sound = clean_words(rng)
    out, labels = [], []
    for i in range(300):
        words = rng.choices(sound, k=30)
        if i % 3 == 0:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(30)] = rng.choice(INSULTS)
        out.append((i, " ".join(words) + ".", 0.5))
        labels.append((i, int(i % 3 == 0)))
    more = ["you b l o c k h e a d now", "you blyockhead now", "you num-bsk-ull", "blockhad", "kind words"]
    return [*out, *((1000 + j, t, 0.0) for j, t in enumerate(more)), (2000, None, 0.0), (2001, "", 0.0), (2001, "", 0.0), (2002, "fine " * 50000, 0.0), (None, "blockhead", 0.0)], [*labels, (None, 1), (5, None)]


def test_scores(spark):
    data, labels = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = T.toxicity(docs, marks, fold("doc_id", 5) != 0).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    truth = dict(labels[:300])
    held = [i for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum(by[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert [by[i].predicted for i in range(1000, 1005)] == [1, 1, 1, 1, 0]
    assert by[2000].score == by[2001].score == by[2002].score < 0.5
    assert T.toxicity(docs.limit(0), marks, F.lit(True)).count() == 0
    assert np.allclose([r.score for r in T.toxicity(docs, marks.limit(0), F.lit(True)).collect()], 0.5)


def test_one_altered_insult_is_enough(spark):
    """Any letter put in, left out, doubled or changing places with the next, or one put into every gap, in a text that training never saw; no altered word is trained on."""
    data, labels = rows()
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    bent = {
        "in": [w[:i] + rng.choice(letters) + w[i:] for w in INSULTS for i in range(1, len(w))],
        "out": [w[:i] + w[i + 1 :] for w in INSULTS for i in range(len(w))],
        "doubled": [w[:i] + w[i] + w[i:] for w in INSULTS for i in range(len(w))],
        "swapped": [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in INSULTS for i in range(len(w) - 1)],
        "gapped": [c.join(w) for w in INSULTS for c in "xyqj"] + ["".join(x + rng.choice(letters) for x in w)[:-1] for w in INSULTS for _ in range(4)],
        "plain": INSULTS,
    }
    sound = clean_words(random.Random(9))
    cases = [(kind, " ".join([*rng.choices(sound, k=12), w, *rng.choices(sound, k=12)])) for kind, ws in bent.items() for w in ws]
    cases += [("clean", " ".join(rng.choices(sound, k=25))) for _ in range(200)]
    docs = spark.createDataFrame(data + [(10_000 + i, t, 0.0) for i, (_, t) in enumerate(cases)], "doc_id long, text string, score double")
    by = {r.doc_id: r.predicted for r in T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") < 10_000).collect()}
    share = {kind: np.mean([by[10_000 + i] for i, (k, _) in enumerate(cases) if k == kind]) for kind in [*bent, "clean"]}
    assert share["plain"] == 1 and min(share[k] for k in bent) >= 0.8 and share["clean"] <= 0.02, share


def test_near_copies_count_once(spark):
    """A word that only copies of one toxic text hold is no landmark."""
    data, labels = rows()
    rng = random.Random(3)
    base = rng.choices(clean_words(rng), k=60)
    copies = [(3000 + i, " ".join([*base[:20], f"w{i}", *base[20:40], "zorblax", *base[40:]]), 0.0) for i in range(60)]
    docs = spark.createDataFrame([r for r in data if r[0] is not None] + copies, "id long, text string, score double")
    marks = spark.createDataFrame([x for x in labels if None not in x] + [(3000 + i, 1) for i in range(60)], "id long, label int")
    model = T.learn(docs.join(marks, "id"))
    assert set(model["landmarks"]) == set(INSULTS)


def test_long_and_odd_texts():
    reader = T.Reader(["blockhead", "r\u00e9eux"])
    plain, long, bare, apart, none = reader.near(["a blockhead", "word " * 300_000 + "blockhead", "x" * (2 * T.SLICE) + "blockhead", "re\u0301eux", "\U0001f600 \u65e5\u672c"])
    assert np.allclose([plain[0], long[0], apart[1]], 1) and bare[0] >= 0 and not none.any()
