import numpy as np

from quire.llm import vectors as V


def data(seed=1):
    rng = np.random.default_rng(seed)
    rows, key = [], 0
    for _ in range(250):
        x = rng.normal(size=64)
        label = int(rng.integers(3))
        for _ in range(rng.choice([1, 1, 2, 3, 30], p=[0.5, 0.2, 0.15, 0.13, 0.02])):
            y = x + rng.normal(size=64) * rng.choice([0.0, 0.1, 0.3, 0.4])
            rows.append((key, [float(np.float32(z)) for z in y], label if rng.random() > 0.02 else None))
            key += 1
    odd = [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] * 64, [1.0, 2.0], [2.0, 4.0], [1.0] * 64]
    rows += [(key + i, v, 1) for i, v in enumerate(odd)]
    return rows


def brute(rows):
    units = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v)
            units[i] = x / np.sqrt((x * x).sum()), label
    links = [(a, b) for a in units for b in units if a < b and units[a][1] == units[b][1] and len(units[a][0]) == len(units[b][0]) and units[a][0] @ units[b][0] >= 0.93]
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = dict.fromkeys(root, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i in root}


def test_against_brute_force(spark, monkeypatch):
    for block in (4096, 40):
        monkeypatch.setattr(V, "BLOCK", block)
        rows = data()
        df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, rep int").repartition(3)
        got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(df).collect()}
        want = brute(rows)
        assert sorted(got) == sorted(want)
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(g[0] for g in got.values()) >= 0.995 * sum(w[0] for w in want.values())
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert V.near_vectors(df).count() == 0


def test_traversal_order():
    rng = np.random.default_rng(0)
    grid = V.Grid(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)))
    x = rng.normal(size=(9, 8))
    cells = grid.cells(x, 12)
    sums = V.distances(x[:, :4], grid.first)[:, :, None] + V.distances(x[:, 4:], grid.second)[:, None, :]
    for row, all_sums in zip(cells, sums.reshape(9, -1)):
        assert np.allclose(all_sums[row], np.sort(all_sums)[:12])


def test_null_and_repeated_ids(spark):
    one, two, far = [1.0, 0.0], [0.99, 0.05], [0.0, 1.0]
    rows = [(1, one, 1), (1, one, 1), (None, one, 1), (None, far, 2), (2, two, 1), (None, two, 3), (3, None, 1)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=str)
    assert len(got) == len(rows)
    assert [g for g in got if g[0] == 1] == [(1, 3, 1, True)] * 2 and (2, 3, 1, False) in got and (3, 0, 3, True) in got


def test_repeated_ids_of_different_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v, i: [x + 0.05 * (j == i) for j, x in enumerate(v)]
    rows = [(1, a, 1), (1, b, 1), (2, near(a, 1), 1), (3, near(b, 2), 1), (4, near(b, 0), 1), (5, [0.0, 0.0, 1.0], 1), (5, [0.05, 0.0, 1.0], 1), (6, a, 2), (6, a, 3)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True), (6, 0, 6, True)]


def test_many_rows_of_one_vector(spark):
    df = spark.range(9000).selectExpr("id AS vec_id", "CASE WHEN id % 3 > 0 THEN array(1.0, 2.0) ELSE array(cos(id), sin(id)) END AS embedding", "1 AS label")
    assert V.near_vectors(df).filter("vec_id % 3 > 0").selectExpr("min(n_links) AS a", "max(n_links) AS b", "count(*) AS n").first()["n"] == 6000


def test_visits_grow_until_the_recall_holds():
    rng = np.random.default_rng(3)
    flat = rng.normal(size=(4000, 48))
    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
    grid = V.fit(flat, 500_000, 0.75)
    assert grid.visits > V.FIRST_CELLS
    x = flat[:500]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = 0.75 * x + (1 - 0.75**2) ** 0.5 * away / np.linalg.norm(away, axis=1, keepdims=True)
    cx, cy = grid.cells(x), grid.cells(y)
    assert ((cx == cy[:, :1]).any(axis=1) | (cy == cx[:, :1]).any(axis=1)).mean() > 0.97
