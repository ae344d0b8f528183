import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quire.llm import conversations
from quire.llm.common import checkpoint, joined_by_hot_key

SCHEMA = "conv_id long, turn long, role string, text string, node string, block int, key string"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[:3], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}

    def walk(p):
        below = [walk(k) for k in kids.get(p, [])]
        leaves = sum(x[0] for x in below) or 1
        saved = sum(x[1] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if whole[c] == p)
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        walk(())
    return sorted(out.values(), key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in conversations.prefix_trie(df).collect()), key=str)


def rows_of(rng, convs, turns, words):
    rows = []
    for c in convs:
        for turn in range(rng.choice(turns)):
            text = rng.choice(words)
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "ab"[turn % 2], text, "x", 1, "k"))
    rng.shuffle(rows)
    return rows


def test_trie_against_brute_force(spark):
    rng = random.Random(3)
    rows = rows_of(rng, [*range(60), *range(95, 130), 400, 9_000_000_000_017, -5, -100, -101], [1, 2, 3, 5, 8, 9, 16, 17, 25], ["hello", "", None, "Ünï\U0001f600", "a longer text of some words"])
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert found(df) == want
    assert found(df.repartition(13)) == want
    assert max(r[1] for r in want) > 2 * conversations.WIDTH


def test_copies_ties_and_repeated_rows(spark):
    rows = [(c, t, "u", f"turn {t}", "", 0, "") for c in range(1, 300) for t in range(20)]
    rows += [(500, 3, "u", "same", "", 0, "")] * 4 + [(501, None, "b", "later", "", 0, ""), (501, None, "a", "earlier", "", 0, ""), (None, 1, "u", "nobody's", "", 0, "")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_very_long_conversation_and_a_very_long_text(spark):
    rows = [(7, t, "u", f"{t}", "", 0, "") for t in range(3000)] + [(8, 0, "u", "z" * 3_000_000, "", 0, ""), (9, 0, "u", "z" * 3_000_000, "", 0, "")]
    got = {(r[0], r[1]): r for r in found(spark.createDataFrame(rows, SCHEMA))}
    deep = max(d for c, d in got if c == 7)
    assert deep >= 2994 and all(got[7, d][5] == 1 for d in range(1, deep + 1))


def test_conversation_without_turns_and_empty_table(spark):
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "u", "lent away", "", 0, "")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_ids_of_a_node_are_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 3)
    rows = [(c, 0, "u", "same", "", 0, "") for c in [*range(-20, 40), 3_000_000_000]]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_join_by_hot_keys(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 5000).cast("long").alias("k"), "id")
    table = checkpoint(rows.filter("k IS NOT NULL AND k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    got = joined_by_hot_key(rows, table, "k", "n")
    want = rows.join(table.drop("n"), "k", "left")
    assert got.columns == ["k", "id", "top"] and got.count() == 20_000
    assert got.exceptAll(want.select("k", "id", "top")).count() == 0
    assert table.filter("n * 1000 > 20000").count() > 0  # some key is hot, and most are not
