import hashlib
import random
import re

from quire.llm.secrets import base_spans, listed, looks_random, more_spans, redact, secret_scan

HEX40 = "ffc3105535f423f352535e4ac53b5fefe076ac6d"
OWN = "Zx9Qw8Er7Ty6Ui5Op4As3Df2"
TEXTS = [
    (1, f'a token = "{HEX40}" end', "s1", "en"), (2, "secret=token:abcdefgh", "s1", "en"), (3, None, "s2", None), (4, "", None, "en"),
    (5, "AKIA" + "A1" * 10 + " AKIASHORT é日 PASSWORD: 'hunter22'", "s2", "de"), (6, f"bare {OWN} here", "s3", "en"), (7, f"bare {HEX40}", "s4", "en"), (8, f"x {HEX40}", "s5", "en"),
    (8, f"x {HEX40}", "s5", "en"), (9, "ſecret=abcdefgh api_key=abcdefg apikey : abc", "s1", "fr"), (10, "word " * 40000 + "passwd=zzzzzz9", "s1", "en"),
]


def brute(text):
    """The base by its wording: match everything, then drop."""
    text = text or ""
    spans = []
    for kind, pattern, test in (
        (0, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        spans += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if test(m)]
    return listed(spans)


def frame(spark):
    return spark.createDataFrame([(*x, 1) for x in TEXTS], "doc_id long, text string, source string, lang string, value int")


def test_base_against_brute_force():
    for _, text, *_ in TEXTS:
        assert listed(base_spans(text or "")) == brute(text)


def test_scan(spark):
    got = sorted(map(tuple, secret_scan(frame(spark)).collect()))
    assert len(got) == len(TEXTS)
    for row, (key, text, *_) in zip(got, sorted(TEXTS, key=lambda x: x[0])):
        base = brute(text)
        kinds = [x.split(":")[0] for x in base.split(",") if x]
        assert row[:5] == (key, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest())
        assert set(filter(None, base.split(","))) <= set(row[5].split(","))
    by = {r[0]: r for r in got}
    assert "token:5:29" in by[6][5] and by[6][6] == 1
    assert by[1][6] == 0 and by[1][7] == 2  # three owners hold it


def test_redact(spark):
    df = frame(spark)
    got = redact(df).collect()
    assert redact(df).columns == df.columns and len(got) == len(TEXTS)
    by = {r.doc_id: r.text for r in got}
    assert by[6] == "bare [SECRET] here" and by[3] is None and by[7] == f"bare {HEX40}" and by[4] == ""
    assert secret_scan(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0


def test_random_values_of_any_length_are_live(spark):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    values = ["".join(rng.choices(letters, k=n)) for n in range(6, 13) for _ in range(20)]
    texts = [f"password={v} end" for v in values] + ["key " + "".join(rng.choices("0123456789abcdef", k=n)) + " end" for n in (24, 32, 40) for _ in range(40)]
    df = spark.createDataFrame([(i, t, f"s{i}", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    assert all((r.n_live, r.n_example) == (1, 0) for r in secret_scan(df).collect())
    assert all("[SECRET]" in r.text for r in redact(df).collect())


def test_bare_tokens_are_random_for_their_alphabet():
    rng = random.Random(5)
    for alphabet, n in (("0123456789ABCDEF", 20), ("0123456789ABCDEF", 32), ("0123456789abcdefghijklmnopqrstuvwxyz", 20), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64)):
        assert sum(looks_random("".join(rng.choices(alphabet, k=n))) for _ in range(500)) >= 498
    assert not looks_random("a1" * 20) and not looks_random("0" * 30 + "a")


def test_copies_over_one_owners_repositories_are_examples(spark):
    data = [(i, f"password={OWN} end", "s1", f"l{i % 5}") for i in range(10)] + [(20 + i, f"bare {OWN[::-1]} end", "s1", f"l{i}") for i in range(3)]
    data += [(40 + i, "api_key=abc123 end", "s1", f"l{i}") for i in range(2)] + [(50, f"bare {HEX40} end", "s1", None), (51, f"bare {HEX40} end", "s1", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: (r.n_live, r.n_example) for r in secret_scan(df).collect()}
    assert all(got[i] == (0, 1) for i in range(10))
    assert all(got[i] == (0, 0) for i in (20, 21, 22))  # no span is added
    assert all(got[i] == (1, 0) for i in (40, 41, 50, 51))
    text = {r.doc_id: r.text for r in redact(df).collect()}
    assert text[0] == data[0][1] and text[20] == data[10][1] and text[40] == "[SECRET] end" and text[50] == "bare [SECRET] end"


def test_ownership_against_brute_force(spark):
    """Which spans are live, by counting owners and repositories of every value over all rows."""
    rng = random.Random(12)
    values = ["".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789", k=22)) + str(i) for i in range(25)]
    rows = []
    for i in range(400):
        held = rng.sample(values[: 1 + i % 25], k=min(2, 1 + i % 25))
        text = " ".join(["x", f"token={held[0]}", "and", held[-1]])
        rows.append((i, text, rng.choice(["hot"] * 8 + ["s1", "s2", None]), rng.choice(["en", "fr", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    where = {}
    found = {i: [(k, v) for k, _, _, v in [*base_spans(t), *more_spans(t, base_spans(t))]] for i, t, *_ in rows}
    for i, _, source, lang in rows:
        for _, v in found[i]:
            owners, repositories = where.setdefault(v, (set(), set()))
            owners.add(source)
            repositories.add((source, lang))
    few = 2
    live = lambda v: len(where[v][0]) <= few and len(where[v][1]) <= few
    got = {r.doc_id: r for r in secret_scan(df).collect()}
    redacted = {r.doc_id: r.text for r in redact(df).collect()}
    for i, text, *_ in rows:
        stays = [(k, v) for k, v in found[i] if k < 3 or (live(v) and len(where[v][0]) == 1)]
        assert got[i].n_live == sum(live(v) for _, v in stays) and got[i].n_example == len(stays) - got[i].n_live
        assert (redacted[i] == text) == (not any(live(v) for _, v in stays))
    assert any(r.n_live for r in got.values()) and any(r.n_example for r in got.values())
