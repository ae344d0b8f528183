import hashlib
import json
import random
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import graph, quality, rights
from quire.streaming import limits


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("Genesis 3:16-18", ("Genesis", 3, 16, 18)), ("1 Samuel 2.4", ("1 Samuel", 2, 4, 4)), ("nothing", (None, None, None, None))])
def test_reference(spark, text, want):
    assert tuple(one(spark, T.parsed_reference(F.col("t")), t=text)) == want


@pytest.mark.parametrize("text,want", [("Sa. 1000.7", ("Sa", 1000, 7, 7)), ("S 12345:1234", ("S", 12345, 1234, 1234)), ("S 99999999999:1", ("S", None, 1, 1))])
def test_reference_of_many_chapters(spark, text, want):
    assert tuple(one(spark, T.parsed_reference(F.col("t")), t=text)) == want


@pytest.mark.parametrize("text,want", [("src 1000:99-102", ("src", 1000, 99, 102)), ("src 1:998-1001", ("src", 1, 998, 1001)), ("src 1:2-99999999999", ("src", 1, 2, None))])
def test_reference_of_long_ranges(spark, text, want):
    assert tuple(one(spark, T.parsed_reference(F.col("t")), t=text)) == want


def test_scalars(spark):
    assert one(spark, T.mentions(F.col("t")), t="@abc x@def @ghi-1 @abc") == ["abc", "ghi-1"]
    assert one(spark, T.citations(F.col("t")), t="a [scripture:1] [x] [scripture:1] [note_b:22]") == ["scripture:1", "note_b:22"]
    assert [one(spark, T.roman(F.col("t")), t=x) for x in ("IV", "mcmxcix", "X", "")] == [4, 1999, 10, 0]
    assert one(spark, T.tokens(F.col("t")), t="What did the Prophets' scribe say, prophets? Straße isn't an ox_cart") == ["prophets", "scribe", "strasse", "isn't", "cart"]
    assert one(spark, T.path_segment(F.col("t")), t="a b/c") == "a%20b%2Fc"
    assert one(spark, T.nfc(F.col("t")), t="é") == "é" and one(spark, T.folded(F.col("t")), t="Straße, Ⅷ!") == "strasse viii"
    assert one(spark, T.name_id("work", F.col("t")), t="k") == str(uuid.uuid5(uuid.NAMESPACE_URL, "work:k"))
    assert [one(spark, T.has_markup(F.col("t")), t=x) for x in ("a < b", "<b>x", "<!x", "1 <2>")] == [False, True, True, False]
    assert [one(spark, T.is_placeholder(F.col("t")), t=x) for x in ("...", "[text missing]", " TBD. ", "Awaiting the source", "no text available in this chapter", "text")] == [True] * 5 + [False]
    assert one(spark, T.has_control(F.col("t")), t="a\x07") and not one(spark, T.has_control(F.col("t")), t="aé")
    assert [one(spark, T.safe_url(F.col("t")), t=x) for x in ("https://a.b/c", "http://a.b", "https://u:p@a.b/", "https://a.b/?q")] == [True, False, False, False]


def test_python_normalises_only_what_it_must(spark):
    """Python gets no other texts; those left to Spark are as Python would give them, over all of the first characters."""
    texts = [f"A{chr(i)}b {chr(i)}" for i in range(1, 0x350)] + ["é", "é", "straße ÀÞ", None, "", "ﬁ x²"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    assert df.select(T._where(F.col("t"), T._UNLIKE, counted, F.col("t"))).collect() and seen.value == sum(bool(re.search(T._UNLIKE, t or "")) for t in texts) < len(texts)
    got = df.select("t", T.nfc(F.col("t")).alias("n"), T.casefolded(F.col("t")).alias("c"), T.folded(F.col("t")).alias("f")).collect()
    assert all((r.n, r.c) == (unicodedata.normalize("NFC", r.t), r.t.casefold()) for r in got if r.t is not None)
    kept = [unicodedata.normalize("NFKC", r.t).casefold() for r in got if r.t is not None and not re.search(T._UNLIKE, r.t)]
    assert [r.f for r in got if r.t is not None and not re.search(T._UNLIKE, r.t)] == [re.sub(r"[\W_]+", " ", k).strip() for k in kept]
    assert [(r.n, r.c, r.f) for r in got if r.t is None] == [(None, None, None)]


def test_checksum_is_json(spark):
    values = ['a"b\\c', "x\ny\t\x00\x0b\x1f\x7f", "é"]
    want = hashlib.sha256(json.dumps([*values, None, 3], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    got = one(spark, T.sequence_checksum(T.json_text(F.col("a")), T.json_text(F.col("b")), T.json_text(F.col("c")), T.json_text(F.lit(None).cast("string")), F.lit("3")), a=values[0], b=values[1], c=values[2])
    assert got == want


def test_quality_rules(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 2), ("a", 5), ("b", 1), ("b", None)], "k string, n int")
    assert sorted(tuple(r) for r in quality.gap_ranges(rows, ["k"], "n").collect()) == [("a", 1, 1), ("a", 3, 4)]
    last = spark.createDataFrame([("a", 7), ("b", 1)], "k string, last int")
    assert sorted(tuple(r) for r in quality.gap_ranges(rows, ["k"], "n", last).collect()) == [("a", 1, 1), ("a", 3, 4), ("a", 6, 7)]
    spans = spark.createDataFrame([("a", 1, 4), ("a", 4, 6), ("a", 7, 9), ("a", 1, 4)], "k string, s int, e int")
    assert [tuple(r) for r in quality.overlaps(spans, ["k"], "s", "e").collect()] == [("a", 4, 6)]
    counts = spark.createDataFrame([(95, 100), (94, 100)], "a int, b int")
    assert [r.x for r in counts.select(quality.regressed(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True]


def test_rights_forms_agree(spark):
    import itertools

    rules = [rights.Right("a", "no_a", "unknown_a"), rights.Right("b", "no_b")]
    rows = spark.createDataFrame(list(itertools.product([True, False, None], repeat=2)), "a boolean, b boolean")
    for r in rows.select(rights.eligible(rules).alias("e"), rights.reasons(rules).alias("r")).collect():
        assert r.e == (not r.r)


def test_ancestry_with_cycle(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (8, 9), (9, 8)], "k long, p long")
    got = sorted(tuple(r) for r in graph.ancestry(nodes, "k", "p").collect())
    assert got == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 1, 3), (4, 2, 2), (4, 3, 1), (5, 1, 4), (5, 2, 3), (5, 3, 2), (5, 4, 1), (8, 9, 1), (9, 8, 1)]


def plain_limit(events, limit, span):
    seen, out = {}, []
    for key, at in sorted(events):
        recent = [x for x in seen.get(key, []) if x > at - span]
        ok = len(recent) < limit
        out.append((key, at, ok, 0 if ok else recent[0] + span - at))
        seen[key] = recent + [at] * ok
    return out


def test_limiter_against_plain_loop(spark):
    rng = random.Random(1)
    events = [(str(rng.randrange(5)), rng.randrange(400) * 1_000_000) for _ in range(600)]
    df = spark.createDataFrame(events, "k string, us long").select("k", F.timestamp_micros("us").alias("ts")).repartition(4)
    got = sorted(tuple(r) for r in limits.limited(df, "k", "ts", 3, 20).collect())
    assert got == sorted(plain_limit(events, 3, 20_000_000))


def test_streams(spark, tmp_path):
    rows = [("u1", i * 10_000_000, "k") for i in range(30)]  # state goes after two silent windows, which these never leave
    source = spark.createDataFrame(rows, "k string, us long, n string").select("k", F.timestamp_micros("us").alias("ts"), "n")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(tuple(r) for r in run(limits.limited(stream, "k", "ts", 2, 60), "lim", "append")) == sorted(plain_limit([(k, u) for k, u, _ in rows], 2, 60_000_000))
    muted = spark.createDataFrame([("u9",)], "k string")
    assert len(run(limits.sent_once(stream, "k", "n", "ts", muted), "once", "append")) == 1
    assert sum(r.n for r in run(limits.hourly_counts(stream, "ts", late="10 minutes"), "hours", "complete")) == 30


def test_prose():
    from quire.functions.prose import is_markup

    assert [x for x in ("a < b", "1<2 and 3>2", "x</ y>", "so a<zz>c holds", "<", "a <unknown", "no") if is_markup(x)] == []
    assert [x for x in ("<!x", "<?y", "<b>", "</q>", "<x/>", "<my-tag>z", "<a:b>", "<p", "x <foo> y", "a<foo z=1>b") if not is_markup(x)] == []


def test_gate_forms_agree(spark):
    """The predicate holds exactly where no reason is given, for rights at random."""
    rng = random.Random(2)
    tri = lambda: rng.choice([True, True, True, True, False, None])
    rows = []
    for i in range(600):
        licence = None if rng.random() < 0.1 else (rng.choice([1, 1, 1, None, 2]), rng.choice([5, 5, 5, 6]), rng.choice([9, 9, None]), rng.choice([1, 1, None]), tri(), tri(), tri(), tri(), rng.choice(["x", " \t", None, "y"]))
        rows.append((i, (i, rng.choice(["active", "active", "draft", None]), rng.choice([5, 5, 5, None]), tri(), tri(), 1), (5, rng.choice([i, i, i, None])), licence))
    right = "boolean"
    df = spark.createDataFrame(rows, f"i int, publication struct<id: int, status: string, source_edition_id: int, validation_approved: {right}, public_visibility: {right}, license_record_id: int>, edition struct<id: int, active_publication_id: int>, licence struct<id: int, source_edition_id: int, reviewer_id: int, verification_date: int, commercial_use_allowed: {right}, display_allowed: {right}, redistribution_allowed: {right}, attribution_required: {right}, required_attribution_text: string>")
    got = df.select(rights.gate_open().alias("e"), rights.gate_reasons().alias("r")).collect()
    assert all(r.e == (not r.r) for r in got) and any(r.e for r in got)
    assert len({x for r in got for x in r.r}) == 13


def test_statements_of_any_length_by_both_ways(spark):
    from quire.operators import grounding

    texts = ["The quick brown fox jumps over it", "Straße und Haus, no fox", "quick brown", "", None, "Ω φῶς ἱλαρόν here"]
    asked = ["fox", "brown fox jumps", "QUICK", "strasse und haus", "rown fox ju", "φῶσ", "absent words entirely here", "quick brown fox jumps over", "", None]
    sources = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    statements = spark.createDataFrame(list(enumerate(asked)), "k int, s string")
    plain = lambda x: " ".join("".join(c if c.isalnum() else " " for c in __import__("unicodedata").normalize("NFKC", x or "").casefold()).split())
    want = sorted((i, j) for i, s in enumerate(asked) for j, t in enumerate(texts) if plain(s) and plain(s) in plain(t))
    for most in (10_000, 0):
        assert sorted(tuple(r) for r in grounding.supported(statements, sources, "s", "t", "k", "d", automaton=most).collect()) == want


def test_intervals_and_clamps(spark):
    from quire.operators import scope

    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "a", 3)], "id int, g string, n int")
    assert [r.id for r in scope.interval(rows, "id", "g", "n", 1, 2).collect()] == [1, 2]
    for first, last in ((1, 9), (1, 3), (2, 1), (None, 1)):
        with pytest.raises(scope.RangeError):
            scope.interval(rows, "id", "g", "n", first, last)
    assert [r.id for r in scope.page(rows, [F.col("id").desc()], -3, 0).collect()] == [4]
    assert scope.owned(rows, "g", None).count() == 0 and scope.point(rows, "id", 7).count() == 0
    with pytest.raises(ValueError):
        scope.named_like(F.col("g"), F.array("g"), "x" * 5000)
