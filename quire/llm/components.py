"""Connected components of a link table, by rounds of joins; nothing but two numbers a round reaches the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpoint


def spanning_links(left: np.ndarray, right: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what `near` connects between left and right (the same array for one set): fewer than there are items. near: matrix of a block of left against a block of right."""
    n, m = len(left), len(right)
    todo_left, todo_right = np.ones(n, bool), np.ones(m, bool)
    a, b = [], []
    step = 256
    for at in range(n):  # grows a tree from each left item that isn't yet in one
        if not todo_left[at]:
            continue
        todo_left[at] = False
        edge = np.array([at])
        while len(edge):
            fresh = []
            for s in range(0, len(edge), step):
                rows = edge[s : s + step]
                open_right = np.flatnonzero(todo_right)
                if not len(open_right):
                    break
                hit = near(left[rows], right[open_right])
                some = hit.any(axis=0)
                cols = open_right[some]
                a.append(left[rows[hit[:, some].argmax(axis=0)]])
                b.append(right[cols])
                todo_right[cols] = False
                fresh.append(cols)
            cols = np.concatenate(fresh) if fresh else np.zeros(0, int)
            nxt = []
            for s in range(0, len(cols), step):
                rows = cols[s : s + step]
                open_left = np.flatnonzero(todo_left)
                if not len(open_left):
                    break
                hit = near(right[rows], left[open_left])
                some = hit.any(axis=0)
                got = open_left[some]
                a.append(left[got])
                b.append(right[rows[hit[:, some].argmax(axis=0)]])
                todo_left[got] = False
                nxt.append(got)
            edge = np.concatenate(nxt) if nxt else np.zeros(0, int)
    a, b = (np.concatenate(x) if x else left[:0] for x in (a, b))
    other = a != b
    return a[other], b[other]


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links (u, v): the smallest id reachable.

    Alternates large stars (an id's larger neighbours are tied to its smallest one) and small stars (its smaller ones and itself) until no link changes; each round is cut off in the checkpoint folder. Null ends and self-links are left out; an empty table gives an empty result.
    """
    edges = checkpoint(links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
