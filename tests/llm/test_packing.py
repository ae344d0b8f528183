import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.bpe import merger, token_counts
from quire.llm.packing import Bins, encoder, pack_counts, pack_documents, reduce_by_dominance

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " ", "a<|endoftext|>b <|x", "ΑΣ ß é", "a\x1cb", "it's we'll", "word " * 9000, "word " * 9000, "日本語😀", "x" * 3000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string")


def optimum(lengths, capacity):
    """Fewest bins, by trying all."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= lengths[i]:
                go(i + 1, [*bins[:j], bins[j] - lengths[i], *bins[j + 1 :]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_packs_whole_and_near_the_optimum(lengths):
    counts = {x: lengths.count(x) for x in lengths}
    bins = pack_counts(counts, 12)
    seen = {}
    for content, n in bins.groups:
        assert sum(a * b for a, b in content) <= 12
        for a, b in content:
            seen[a] = seen.get(a, 0) + b * n
    assert seen == counts
    assert sum(n for _, n in bins.groups) <= optimum(sorted(lengths, reverse=True), 12) + 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.sampled_from([12, 20, 30]))
def test_reduction_keeps_the_optimum(lengths, capacity):
    lengths = [x for x in lengths if x <= capacity]
    left, bins = Counter(lengths), Bins()
    reduce_by_dominance(left, capacity, bins)
    assert sum(n for _, n in bins.groups) + optimum(sorted(left.elements(), reverse=True), capacity) == optimum(sorted(lengths, reverse=True), capacity)
    assert Counter(x for content, n in bins.groups for x, copies in content for _ in range(copies * n)) + left == Counter(lengths)


def test_sets_of_three_and_of_small_items_are_fixed():
    left, bins = Counter([14, 9, 7]), Bins()
    reduce_by_dominance(left, 30, bins)
    assert not left and bins.groups == [([(14, 1), (9, 1), (7, 1)], 1)]
    left, bins = Counter({10: 400, 20: 100, 15: 7}), Bins()
    reduce_by_dominance(left, 30, bins)
    assert sum(n for _, n in bins.groups) + optimum(list(left.elements()), 30) == 100 + 100 + 4


def test_pieces_against_library(spark):
    library = Tokenizer.from_file(PATH)
    got = pack_documents(docs(spark, TEXTS), PATH).toPandas()
    for i, text in enumerate(TEXTS):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 4096 and (g.offset == g.length.cumsum() - g.length).all()


def test_no_rows(spark):
    assert pack_documents(docs(spark, []), PATH).count() == 0
    assert token_counts(docs(spark, []), PATH).count() == 0


def test_counts_against_library(spark):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in token_counts(docs(spark, TEXTS), PATH).collect()}
    for i, text in enumerate(TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 2048)


def test_every_code_point_and_random_strings_as_the_library_has_them():
    with open(PATH, encoding="utf-8") as file:
        vocabulary = file.read()
    library, encode, count = Tokenizer.from_file(PATH), encoder(vocabulary).ids, merger(vocabulary).count
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rng = random.Random(1)
    pools = [points, points[:0x250], points[0x300:0x370] + list("aeiou AEß"), points[0x530:0x600], points[0x1100:0x1200] + points[0x2000:0x2070], list(" 's'T'LL'd09\x1c\x1f\x85\t")]
    texts = ["a{}b".format(c) for c in points[:0x3000]] + ["".join(points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 14))) for _ in range(10_000)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == np.array(found.ids, dtype="<u4").tobytes() and count(text) == len(found.ids), text


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in pack_documents(df, PATH).collect()) == [(0, 2), (1, 3), (1, 3)]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(df, PATH).collect()) == [(0, 1), (1, 2), (1, 2)]
