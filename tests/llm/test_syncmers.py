import hashlib
import random
import re
import string
import struct

import xxhash

from quire.llm.syncmers import ENDS, K, S, SYMBOL, fingerprints, in_ranges


def folded(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        seed = seed
    return seed - (1 << 64) if seed >> 63 else seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def symbols(text):
    out = []
    for run in re.findall(r"[^ \t-\r]+", text):
        if len(run) <= SYMBOL:
            out.append(run)
            continue
        piece = ""
        for c in run:
            if ord(c) > 127:
                out += [piece] * bool(piece) + [c]
                piece = ""
                continue
            piece += c
            if c in ENDS or c in string.punctuation:
                out.append(piece)
                piece = ""
        out += [piece] * bool(piece)
    return out


def anchors(text):
    sym = [0] * (K - 1) + [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in symbols(text)]
    out = []
    for i in range(len(sym) - K + 1):
        pairs = [folded(sym[j : j + S]) for j in range(i, i + K - S + 1)]
        if min(pairs) in (pairs[0], pairs[-1]):
            out.append((folded(sym[i : i + K]) & 0xFFFFFFFF, i))
    return out


def near(a, b):
    best = 0.0
    for f in (lambda x: x[0], lambda x: x):
        x, y = set(map(f, a)), set(map(f, b))
        best = max(best, len(x & y) / len(x | y) if x | y else 1.0)
    return best


def test_against_brute_force(spark):
    rng = random.Random(7)
    texts = {i * 3: " ".join(rng.choices("alpha beta gamma déltà 日本 incomprehensibilities x a+b=c;//q03-z_9{}[]!kkkkkkkkkkkkkkkkkkkk 日本語の文章は空白がないので長い".split(), k=rng.choice([0, 1, 3, 9, 200]))) for i in range(450)}
    texts[7], texts[8], texts[4000] = None, "   ", "repeat " * 40000
    rows = [(k, t, "clash") for k, t in texts.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, _range string").repartition(5)
    got = {r.doc_id: r for r in fingerprints(df).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for key, following in zip(order, order[1:] + order[:1]):
        text, after = texts[key] or "", texts[following] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r, a, b, c = got[key], anchors(text), anchors(edited), anchors(after)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{h:08x}" for h, _ in a) and r.edited_fingerprint == "".join(f"{h:08x}" for h, _ in b)
        assert abs(r.near_edited - near(a, b)) < 1e-9 and abs(r.near_next - near(a, c)) < 1e-9


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c d"), (1, "e f"), (1, "e f")], "doc_id long, text string")
    assert fingerprints(df).count() == 4
    assert fingerprints(df.limit(0)).count() == 0
    one = fingerprints(df.filter("text = 'a b'")).first()
    assert one.near_next == 1.0 and one.n_chars == 3


def test_many_rows_of_one_id_and_of_none(spark):
    """50,000 rows of one id and as many of none: ranges stay small, and each row still meets its successor."""
    n = 50_000
    hot = spark.range(2 * n).selectExpr("CASE WHEN id % 2 = 0 THEN 777 END AS doc_id", "concat('text ', id, ' of many words') AS text")
    rest = spark.range(20_000).selectExpr("id AS doc_id", "concat('other ', id) AS text")
    df = hot.unionByName(rest).repartition(4)
    rows = df.selectExpr("doc_id AS _id", f"coalesce(doc_id, {-(1 << 63)}) AS _k", "text AS _text")
    sizes = in_ranges(rows).groupBy("_range").count()
    assert sizes.agg({"count": "max"}).first()[0] < 2000 and sizes.agg({"count": "sum"}).first()[0] < 123_000
    import pyspark.sql.functions as F

    got = fingerprints(df).select("doc_id", "n_chars", "edited_sha256")
    order = sorted((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["h"], r["text"]) for r in df.withColumn("h", F.xxhash64("text")).collect())
    want = []
    for (k, _, text), (_, _, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 4
        want.append((None if k < 0 else k, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_anchors_hang_on_nothing_outside_them(spark):
    """One character put in front moves no other anchor, with or without spaces."""
    rng = random.Random(5)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1200))
    code = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=3000))
    spaced = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 20))) for _ in range(300))
    texts = [x for t in (chinese, code, spaced) for x in (t, "q" + t)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in fingerprints(df).collect()}
    assert min(near[0], near[2], near[4]) > 0.9 and max(near[1], near[3]) < 0.1
