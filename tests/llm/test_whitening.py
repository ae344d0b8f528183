import math
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import whitening
from quire.llm.whitening import centred, decompose, limbs, pair_squares, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def exact(vectors):
    """x, n, sums and the covariance, by whole numbers and fractions."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    cov = [[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(d)] for i in range(d)]
    return x, n, sums, np.array(cov)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) + 7).astype(np.float32)
    rows = [(i, [float(c) for c in v], "x", 1) for i, v in enumerate(data)]
    out = whiten(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    x, n, sums, cov = exact(data)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    w = np.zeros((300, 32))
    for r in out:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == 300 and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    assert len(out) == 300 * 32
    want = (np.array(x) - np.array(sums) / n) @ vectors[:, :32] / np.sqrt(values[:32])
    signs = np.sign((want * w).sum(axis=0))
    assert np.abs(w - want * signs).max() < 1e-7
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9


def test_polarised_covariance_is_exact():
    rng = np.random.default_rng(2)
    for scale in (10, 10**6, 10**12):  # small numbers stay in 64 bits, large ones don't
        x = rng.integers(-scale, scale, size=(50, 6)) + 1_000_000
        n, sums = len(x), [int(s) for s in x.astype(object).sum(axis=0)]
        y = centred(x, np.array([s // n for s in sums]))
        got = decompose(n, sums, pair_squares(y), 6)
        z = x.astype(object) * n - np.array(sums, dtype=object)
        cov = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in z.T @ z])
        assert np.allclose(got.components @ np.diag(got.values) @ got.components.T, cov, rtol=1e-12, atol=1e-9 * cov.max())
        assert got.deviation(x) == [int(v) for v in (z * z).sum(axis=1)]


def test_limbs_round_trip():
    for v in (0, 1, -1, 2**39, 2**40, -(2**40), 3**100, -(3**100)):
        assert sum(x << (40 * i) for i, x in enumerate(limbs(v))) == v and all(0 <= x < 2**40 for x in limbs(v)[:-1])


def test_what_is_left_out_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -2.0]), (2**60 + 1, [-4.0, 0.5])]
    bad = [(5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [1.0, inf]), (10, [1.0, 2.0, 3.0])]
    out = whiten(spark.createDataFrame([(k, v, "x", 1) for k, v in fine + bad], SCHEMA)).collect()
    assert sorted(str(r["vec_id"]) for r in out) == sorted(str(k) for k, _ in fine for _ in range(2)) and {r["n"] for r in out} == {4}
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).collect() == []


def test_no_variance_no_component(spark):
    flat = [(i, [1.0, float(i % 3), 5.0], "x", 1) for i in range(30)]
    out = whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r["component"] for r in out} == {1} and len(out) == 30 and out[0]["explained"] == pytest.approx(1) and out[0]["identity_error"] < 1e-9
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0], "x", 1) for i in range(5)], SCHEMA)).collect() == []


def test_huge_components_are_held(spark):
    rows = [(i, [float(i) * 1e30 * (-1) ** i, 1.0 + i], "x", 1) for i in range(4)]
    with pytest.raises(Exception):  # noqa: B017 - the deviation does not fit a long
        whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    x = whitening.whole_numbers(__import__("pandas").Series([[1e300, -1e300, 0.5]]))
    assert x.tolist() == [[2**63 - 1, -(2**63) + 1 + 1_000_000, 1_000_032]]


def test_same_result_for_any_partitioning(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=5)], "x", 1) for i in range(200)], SCHEMA)
    a, b = ({(r["vec_id"], r["component"]): (r["whitened"], r["deviation"]) for r in whiten(df.repartition(k)).collect()} for k in (1, 9))
    assert a == b
