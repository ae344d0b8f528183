"""Edges read in both directions, ancestry of trees, and identities across numbering systems."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, computed and cut off in the folder that spark.checkpoint.dir names; in one of our own only where none is set and all runs on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quire-checkpoints"))
    return df.checkpoint()


def both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Each edge from either end: (at, other, ...)."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    ahead = edges.select(F.col(src).alias("at"), F.col(dst).alias("other"), *rest)
    return ahead.unionByName(edges.select(F.col(dst).alias("at"), F.col(src).alias("other"), *rest)).distinct()


def ancestry(nodes: DataFrame, key: str, parent: str, most: int = 64) -> DataFrame:
    """(key, ancestor, depth) up to `most` steps; a node that would be met twice on the way ends it.

    Doubling: after each join every node knows ancestors twice as far, so a chain of n takes log n joins, each settled before the next.
    """
    known = nodes.filter(F.col(parent).isNotNull() & (F.col(parent) != F.col(key))).select(F.col(key).alias("at"), F.col(parent).alias("up"), F.lit(1).cast("long").alias("depth"))
    reach, step = settled(known), 1
    while step < most:
        far = reach.filter(F.col("depth") == step).select(F.col("at"), F.col("up").alias("mid"))
        more = far.join(reach.select(F.col("at").alias("mid"), "up", F.col("depth").alias("d")), "mid").select("at", "up", (F.col("d") + step).alias("depth"))
        more = settled(more.filter((F.col("at") != F.col("up")) & (F.col("depth") <= most)))
        if not more.limit(1).count():
            break
        reach, step = reach.unionByName(more), 2 * step
    nearest = reach.groupBy("at", "up").agg(F.min("depth").alias("depth"))
    return nearest.select(F.col("at").alias(key), F.col("up").alias("ancestor"), "depth")


def cross_map(positions: DataFrame, system: str, place: str, identity: str) -> DataFrame:
    """(from_system, from_place, to_system, to_place) of places that share an identity."""
    a = positions.select(F.col(identity).alias("_i"), F.col(system).alias("from_system"), F.col(place).alias("from_place"))
    b = positions.select(F.col(identity).alias("_i"), F.col(system).alias("to_system"), F.col(place).alias("to_place"))
    return a.join(b, "_i").filter("from_system <> to_system").drop("_i")
