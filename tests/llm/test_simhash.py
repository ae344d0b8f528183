import random

import numpy as np
import pytest
import xxhash

from quire.llm import simhash as S
from quire.llm.components import connected_components


def plain(text):
    words = [w for w in __import__("re").split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for t in ["", " \t", "One", "a b c", "a b c d", "A b\x0bc d e É", "x y z " * 30, "w1 w2 w3 w4 w5 " * 9000]:
        assert S.fingerprint_of(t) == plain(t)


@pytest.mark.parametrize("long_run,block", [(2048, 1024), (20, 7)])
def test_groups_against_all_pairs(spark, monkeypatch, long_run, block):
    monkeypatch.setattr(S, "LONG_RUN", long_run)
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0}
    for f in list(fps)[:30]:
        for _ in range(rng.choice([1, 3, 40])):
            g = f
            for b in rng.sample(range(64), rng.randint(0, 6)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    links = S.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)).collect()
    back = dict(zip(signed, fps))
    for r in links:
        assert (back[r.a] ^ back[r.b]).bit_count() <= 4
    got = roots(fps, [(back[r.a], back[r.b]) for r in links])
    want = roots(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4])
    assert got == want


def test_groups(spark):
    texts = [None, "", "a b c d e f g", "A B C D E F G", "  ", "other words stand here", "a b c d e f g"]
    df = spark.createDataFrame([(i + 5, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r.component_id for r in S.simhash_groups(df).collect()}
    assert got == {5: 5, 6: 5, 9: 5, 7: 7, 8: 7, 11: 7, 10: 10}
    assert S.simhash_groups(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(1000, x) for x in range(900, 1100)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()}
    ids = {x for l in links if l[0] != l[1] for x in l}
    assert got == roots(ids, [l for l in links if l[0] != l[1]])


def test_null_ids(spark):
    """A null id names a component only where all its ids are null."""
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "other words stand here now"), (None, "other words stand here now"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in S.simhash_groups(df).collect()))
    assert got == [(0, 0), (0, 0), (0, 4), (4, 4), (9, 9)]


def test_repeated_ids_of_unlike_texts(spark):
    one, other = ("alpha beta gamma delta " + "x1 x2 x3 " * 20), ("some wholly different words stand here " * 9)
    rows = [(1, one), (1, other), (2, one), (3, other), (4, "nothing like these at all " * 7)]
    got = {(r.doc_id, r.component_id) for r in S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
    rows = [(5, one), (5, other), (6, other)]
    assert sorted((r.doc_id, r.component_id) for r in S.simhash_groups(spark.createDataFrame(rows[1:] + [(7, one), (5, one)], "doc_id long, text string")).collect()) == [(5, 5), (5, 5), (6, 5), (7, 5)]
