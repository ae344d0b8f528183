import math
import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from quire.llm.mixing import SLICE, SLICES, Mix, draws


def place(*numbers):
    """The hash of seed, block if there is one, and id as text."""
    h = 42
    for data in (*(struct.pack("<i", x) for x in numbers[:-1]), str(numbers[-1]).encode()):
        h = xxhash.xxh64_intdigest(data, h)
    return (h & ((1 << 52) - 1)) / float(1 << 52)


def data():
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        source = rng.choices(["big", "mid", "small", None], [70, 20, 8, 2])[0]
        rows.append((i, " ".join(["w"] * rng.randint(0, 9)), source, 1))
    return [*rows, (3000, None, "empty", 1), (3001, "", "empty", 1), (3002, "x " * 4000, "small", 1)]


@pytest.mark.parametrize("mix", [Mix(), Mix(entropy=0.8, budget=30000.0), Mix(repeats=1.5), Mix(cover=True), Mix(entropy=1.0, repeats=50.0)])
def test_against_brute_force(spark, mix):
    rows = data()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight int").repartition(4)
    got = draws(df, mix).collect()
    tokens = {i: len((t or "").split()) for i, t, *_ in rows}
    docs = defaultdict(list)
    for i, _, s, _ in rows:
        docs[s].append(i)
    sums = {s: sum(tokens[i] for i in v) for s, v in docs.items()}
    total = sum(sums.values())
    weight = {r.source: r.weight for r in got}
    live = [s for s in sums if sums[s]]
    assert abs(sum(weight[s] for s in live) - 1) < 1e-9 and weight["empty"] == 0
    # one exponent gives all weights
    a = [math.log(weight[s] / weight["big"]) / math.log(sums[s] / sums["big"]) for s in live if s != "big"]
    assert max(a) - min(a) < 1e-6 and -1e-9 <= a[0] <= 1 + 1e-9
    budget = max(sums[s] / weight[s] for s in live) if mix.cover else mix.budget or total
    ratio = {s: weight[s] * budget / sums[s] for s in live}
    entropy = -sum(weight[s] * math.log(weight[s]) for s in live) / math.log(len(live))
    assert max(ratio.values()) <= mix.repeats + 1e-4
    if a[0] < 1:
        assert abs(entropy - mix.entropy) < 1e-4 or abs(max(ratio.values()) - mix.repeats) < 1e-3
    drawn = defaultdict(list)
    for r in got:
        drawn[r.source, r.block].append(r)
    for s in sums:
        whole = round(ratio[s], 9) if s in ratio else 1.0
        full = math.floor(whole)
        for b in range(full):
            assert sorted(r.doc_id for r in drawn[s, b]) == sorted(docs[s])
        slices = max(1, min(SLICES, math.ceil(len(docs[s]) / SLICE)))
        spent, want = 0, []
        for i in sorted(docs[s], key=lambda i: (math.floor(place(mix.seed, i) * slices), place(mix.seed, full, i), i)):
            if spent < (whole - full) * sums[s]:
                want.append(i)
            spent += tokens[i]
        assert sorted(want) == sorted(r.doc_id for r in drawn[s, full])
    assert all(0 <= r.draw_at < 1 + 1e-9 for r in got)
    if mix.cover:
        assert {r.doc_id for r in got} == set(tokens)
    assert all(r.n_tokens == tokens[r.doc_id] for r in got)
    kept = draws(df, mix, keep=True)
    assert kept.columns == [*df.columns, "draw_at"] and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert draws(df).count() == 0
    one = spark.createDataFrame([(1, None, "a"), (1, None, "a")], "doc_id long, text string, source string")
    assert draws(one).count() == 2
