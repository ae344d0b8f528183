import random
import time

import numpy as np
import pytest

from quire.operators import grounding
from quire.operators.grounding import automaton_of, supported, width_of, window_hashes


def both(spark, statements, sources):
    """The result by the automaton; by hashes it is the same."""
    asked, said = spark.createDataFrame(statements, "k long, s string"), spark.createDataFrame(sources, "d long, t string")
    found = [sorted((tuple(r) for r in supported(asked, said, "s", "t", "k", "d", automaton=most).collect()), key=repr) for most in (10**9, 0)]
    assert found[0] == found[1]
    return found[0]


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "be", "sea", "seas", "Ünï", "x1", "long­word", "\U0001f600"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    asked = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(80)] + [t[3:20] for t in texts]
    got = both(spark, list(enumerate(asked)), list(enumerate(texts)))
    from pyspark.sql import functions as F

    from quire.functions.text import folded
    plain = lambda xs: [r[0] for r in spark.createDataFrame(list(enumerate(xs)), "i long, x string").orderBy("i").select(folded(F.col("x"))).collect()]
    want = sorted(((i, j) for i, s in enumerate(plain(asked)) for j, t in enumerate(plain(texts)) if s and s in t), key=repr)
    assert got == want and len(want) > 100


def test_nulls_repeated_rows_and_no_statement(spark):
    sources = [(1, "One two three."), (1, "Four"), (2, None), (None, "two"), (3, ""), (4, "one  TWO"), (4, "one  TWO")]
    got = set(both(spark, [(9, "two"), (9, "two"), (8, None), (7, "  "), (5, "four"), (None, "one")], sources))
    assert got == {(9, 1), (9, 4), (9, None), (5, 1), (None, 1), (None, 4)}
    assert both(spark, [], sources) == [] and both(spark, [(1, "x")], []) == []


def test_statements_longer_than_the_longest_window(spark):
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(3000))
    asked = [(0, text[100:9000]), (1, text[100:8999] + "z"), (2, text), (3, text + " more")]
    assert both(spark, asked, [(1, text), (2, text[::-1])]) == [(0, 1), (2, 1)]


@pytest.mark.parametrize("n", [10_000, 100_000])
def test_many_statements(spark, n):
    asked = spark.range(n).selectExpr("id AS k", "concat('statement number ', id * 7919, ' of many') AS s")
    said = spark.range(400).selectExpr("id AS d", "concat('before it statement number ', id * 7919 * 17, ' of many and after, statement number 7919 of many') AS t")
    got = {(r[0], r[1]) for r in supported(asked, said, "s", "t", "k", "d").collect()}
    assert got == {(17 * d, d) for d in range(400) if 17 * d < n} | {(1, d) for d in range(400)}


def test_time_grows_with_the_text_only():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    asked = tuple(" ".join(rng.choice(words) for _ in range(8)) for _ in range(5000))
    text = " ".join(rng.choice(words) for _ in range(200_000))
    automaton_of(asked)

    def took(t):
        began = time.process_time()
        assert not list(automaton_of(asked).iter(t))
        return time.process_time() - began

    took(text)
    assert took(text) < 40 * max(took(text[: len(text) // 10]), 0.001)  # ten times the text; a quadratic way would take a hundred


def test_window_hashes():
    text = "abcabc \U0001f600abc"
    for w, h in window_hashes(text, [1, 2, 4, 8, 16]):
        assert len(h) == len(text) - w + 1
        windows = [text[i : i + w] for i in range(len(h))]
        assert len(set(h.tolist())) == len(set(windows)) and all(next(window_hashes(x, [w]))[1][0] == v for x, v in zip(windows, h, strict=True))
    assert [width_of("x" * n) for n in (1, 2, 3, 1023, 1024, 9999)] == [1, 2, 2, 512, 1024, 1024]
    assert np.array_equal(grounding.powers(1024)[0] * grounding.powers(1024)[1], np.ones(1024, np.uint64))
