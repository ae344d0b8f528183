"""A trie of conversations by their prefixes, built by ROLLUP over positional turn-id columns.

A turn is a 128-bit id of its role and text. A conversation becomes rows of WIDTH turn-id columns; each further row is keyed by the node where the row before ended. GROUP BY key, ROLLUP(t1, ..., tw) then aggregates all prefixes of all rows together, and grouping_id tells how deep a group is: no round of joins for each depth, whatever the length of conversations.

Sums over subtrees need no walk from the leaves up either. A node is booked on its smallest member, which holds the nodes below it down to its own end. What is booked on all members of a node is its subtree and, of what lies above it, only the nodes with the same smallest member: a second ROLLUP adds up what is booked, a running sum along one conversation takes off what lies above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, joined_by_hot_key

#: Turn-id columns of a row; conversation ids of a piece of a list, at the most.
WIDTH, PIECE = 8, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, id (16 bytes for role and text) and chars (code points of the text) of every turn of a named conversation; null roles and texts are empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    known = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), known.alias("id"), F.length(text).alias("chars"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows to be put in order: conv_id, own (whether the turn is the conversation's), at (its place among the turns lent to it, 0 for a row without turn that every conversation has), skip (own turns to leave out), turn, role, id, chars.

    Conversation c begins with the first h turns of conversation c - c % 100, h = crc32(c) % 6, and goes on with its own turns after its first h.
    """
    lent = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    first = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "id")
    heads = turns.filter("conv_id % 100 = 0").withColumn("at", F.row_number().over(first)).filter("at <= 5")
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "id", "chars"))).alias("head"))
    named = turns.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left")
    mark = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("int").alias("chars")))
    lent_turns = F.when(F.col("head").isNull(), mark).otherwise(F.concat(mark, F.slice(F.col("head"), F.lit(1), lent.cast("int"))))
    none = [F.lit(None).cast("long").alias("turn"), F.lit("").alias("role")]
    heads = named.select("conv_id", F.lit(False).alias("own"), F.explode(lent_turns).alias("h")).select("conv_id", "own", "h.at", *none, "h.id", "h.chars")
    own = turns.select("conv_id", F.lit(True).alias("own"), F.lit(0).alias("at"), "turn", "role", "id", "chars")
    return heads.unionByName(own).withColumn("skip", lent.cast("int"))


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of WIDTH turns: conv_id, block (from 0), key (the node where the row before ended; empty for the first), t1 ... tw (id and chars, null past the end) and last (the node where the conversation ends, null unless in this row).

    Every conversation has a row, be it without turns. The turns of one are read in order, one at a time: memory is bounded whatever its length.
    """
    turn = pa.struct([("id", pa.binary()), ("chars", pa.int32())])
    names = ["conv_id", "block", "key", *[f"t{i}" for i in range(1, WIDTH + 1)], "last"]
    types = [pa.int64(), pa.int32(), pa.binary(), *[turn] * WIDTH, pa.binary()]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        conv, block, key, held, left = None, 0, b"", [], 0

        def node() -> bytes:
            return hashlib.md5(key + b"".join(t["id"] for t in held)).digest() if held else key

        def close(last: bytes | None) -> None:
            made.append((conv, block, key, *held, *[None] * (WIDTH - len(held)), last))

        for batch in batches:
            for c, own, skip, at, tid, chars in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "own", "skip", "at", "id", "chars")], strict=True):
                if conv != c:
                    if conv is not None:
                        close(node())
                    conv, block, key, held, left = c, 0, b"", [], skip
                if own:
                    left -= 1
                    if left >= 0:
                        continue
                elif not at:
                    continue
                if len(held) == WIDTH:
                    close(None)
                    key, block, held = node(), block + 1, []
                held.append({"id": tid, "chars": chars})
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names=names)
                made = []
        if conv is not None:
            close(node())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    order = ["conv_id", "own", "at", F.asc_nulls_first("turn"), "role", "id"]
    placed = rows.repartition("conv_id").sortWithinPartitions(*order)
    schema = "conv_id long, block int, key binary, " + ", ".join(f"t{i} struct<id: binary, chars: int>" for i in range(1, WIDTH + 1)) + ", last binary"
    return placed.mapInArrow(chain, schema)


def prefixes(rows: DataFrame, aggregates: str) -> DataFrame:
    """aggregates (SQL) over the rows of every node: node (its 16-byte id, empty for the root), parent, depth and chars (of its last turn) come with them. rows: key, block, t1 ... tw and what is aggregated."""
    ts = [f"t{i}" for i in range(1, WIDTH + 1)]
    grouped = rows.sparkSession.sql(f"SELECT block, key, {', '.join(ts)}, grouping_id() AS g, {aggregates} FROM {{rows}} GROUP BY block, key, ROLLUP({', '.join(ts)})", rows=rows)
    # rolled-up columns are the last ones: the group is as deep as columns are left
    deep = grouped.withColumn("deep", F.lit(WIDTH) - F.bit_count("g"))
    last = F.coalesce(*[F.when(F.col("deep") == i, F.col(t)) for i, t in enumerate(ts, 1)])
    # a null that isn't rolled up is the end of a conversation: no node; a further block's own key is the node of the block before
    deep = deep.withColumn("last", last).filter(F.col("last.id").isNotNull() | ((F.col("deep") == 0) & (F.col("block") == 0)))
    ids = [F.coalesce(F.col(t)["id"], F.lit(b"")) for t in ts]
    node = F.when(F.col("deep") == 0, F.col("key")).otherwise(F.unhex(F.md5(F.concat("key", *ids))))
    above = [F.when(F.col("deep") > i, x).otherwise(F.lit(b"")) for i, x in enumerate(ids, 1)]
    parent = F.when(F.col("deep") == 1, F.col("key")).when(F.col("deep") > 1, F.unhex(F.md5(F.concat("key", *above))))
    others = [c for c in grouped.columns if c not in {"block", "key", "g", *ts}]
    return deep.select(node.alias("node"), parent.alias("parent"), (F.col("block").cast("long") * WIDTH + F.col("deep")).alias("depth"), F.coalesce("last.chars", F.lit(0)).alias("chars"), *others)


def end_lists(rows: DataFrame) -> DataFrame:
    """node and ends_sha256 for every node where a conversation ends. Ids are joined in pieces of at most PIECE; a node's pieces pass through the digest in order, one at a time, as a digest needs."""
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = rows.filter("last IS NOT NULL").groupBy(F.col("last").alias("node"), F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, found = [], []
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != node:
                    if state:
                        nodes.append(node)
                        found.append(state.hexdigest())
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], names=["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; turns with equal numbers by role, then by the id of role and text, so equal rows stand together. Rows without conv_id are left out. Null roles and texts are empty; texts may have any length, only their ids are shuffled. Other columns are ignored whatever their names; an empty table has no conversation and gives no rows, not even a root.
    """
    turns = checkpoint(turn_ids(conversations))
    rows = checkpoint(blocks(rebuilt(turns)))
    ts = [f"t{i}" for i in range(1, WIDTH + 1)]
    # copies become one row before they are rolled up
    alike = rows.groupBy("block", "key", *ts).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    nodes = checkpoint(prefixes(alike, "sum(n) AS n_convs, min(conv_id) AS conv_id"))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = checkpoint(nodes.withColumn("above", F.coalesce(F.sum("own").over(above), F.lit(0))))
    booked = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    under = prefixes(rows.join(booked, "conv_id"), "sum(saved) AS saved, sum(leaves) AS n_leaves").select("node", "saved", "n_leaves")
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows"))
    found = joined_by_hot_key(nodes, parents, "parent", "_rows").join(under, "node").join(end_lists(rows), "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
