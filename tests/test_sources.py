import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators.lineage import Publications
from quire.sources import files as S


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)


def test_bundles(spark, tmp_path):
    archive(tmp_path / "a.zip", {"data/index.json": "[]", "data/jonah.json": json.dumps([{"c": 1, "v": [{"n": 1, "t": "Now"}, {"n": 3, "t": "But"}]}])})
    archive(tmp_path / "bad.zip", {"../x.json": "[]"})
    (tmp_path / "no.zip").write_bytes(b"none")
    members = S.archive_members(spark, str(tmp_path / "*.zip"))
    assert {(r.path.rsplit("/", 1)[1], r.fault) for r in members.collect() if r.fault} == {("bad.zip", "unsafe name"), ("no.zip", "BadZipFile")}
    rows = S.array_bundle(members)
    assert [(r.book, r.chapter, r.verse, r.text) for r in rows.orderBy("verse").collect()] == [("jonah", 1, 1, "Now"), ("jonah", 1, 3, "But")]
    assert [r.complete for r in S.contiguous(rows, ["book", "chapter"]).collect()] == [False]
    declared = spark.createDataFrame([("jonah", 1, 2)], "book string, chapter int, verse int")
    assert [r.complete for r in S.contiguous(rows, ["book", "chapter"], declared).collect()] == [True]
    archive(tmp_path / "b.zip", {"ruth.json": json.dumps({"book": "ruth", "editions": {"e1": {"chapters": [{"number": 2, "verses": [{"number": 4, "text": "And"}]}]}}})})
    got = S.object_bundle(S.archive_members(spark, str(tmp_path / "b.zip"))).first()
    assert (got.edition, got.book, got.chapter, got.verse, got.text, got.locator) == ("e1", "ruth", 2, 4, "And", "ruth.json#2:4")


def test_archive_limits():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(S.MEMBERS + 1):
            z.writestr(str(i), "")
    assert S.unsafe(zipfile.ZipFile(data)) == "too many members"


def test_lines_prose_json_xml(spark, tmp_path):
    (tmp_path / "t.vpl").write_text("GEN 1:1 In the\nGEN 1:2\nnothing\n")
    assert [tuple(r) for r in S.verse_lines(spark, str(tmp_path / "t.vpl")).orderBy("verse").collect()] == [("GEN", 1, 1, "In the", False), ("GEN", 1, 2, "", True)]
    docs = spark.createDataFrame([(1, "CHAPTER II.\n1 First words\ngo on. 2 Second.\n\nIX\nHead 1) Other")], "k int, t string")
    assert sorted(tuple(r) for r in S.prose(docs, "k", "t").collect()) == [(1, 2, 1, "First words go on."), (1, 2, 2, "Second."), (1, 9, 0, "Head"), (1, 9, 1, "Other")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert sorted(r.a for r in S.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "x.xml").write_text('<l><entry id="H7"><w>ab</w></entry><entry id="x8"><w>bc</w></entry></l>')
    rows = S.xml_entries(spark, str(tmp_path / "x.xml"), "entry", "_id string, w string").withColumn("n", S.lexicon_number(F.col("_id"), "H"))
    assert sorted((r.n, r.w) for r in rows.collect()) == [("H7", "ab"), ("H8", "bc")]


def test_commentary(spark, tmp_path):
    book = {"id": "gen", "introduction": "About", "chapters": [{"number": 1, "introduction": "", "content": [{"type": "verse", "number": "1-3", "content": ["a", "b"]}, {"type": "heading", "number": None, "content": ["h"]}, {"type": "verse", "number": "4", "content": ["c"]}]}]}
    (tmp_path / "c.json").write_text(json.dumps({"books": [book]}))
    got = sorted(S.commentary(spark, str(tmp_path / "c.json")).collect(), key=str)
    assert {tuple(r) for r in got} == {("gen", None, None, None, "book_intro", "About"), ("gen", 1, 1, 3, "note", "a\nb"), ("gen", 1, 4, 4, "note", "c")}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "p")
    S.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "e string, n int"), path, "e")
    S.replace_partitions(spark.createDataFrame([("b", 3)], "e string, n int"), path, "e")
    assert sorted((r.e, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    snap = str(tmp_path / "s")
    S.append_snapshot(spark.createDataFrame([(1, "x")], "v int, t string"), snap, "v")
    with pytest.raises(ValueError):
        S.append_snapshot(spark.createDataFrame([(1, "y")], "v int, t string"), snap, "v")
    assert [r.value for r in S.canonical_json(spark.createDataFrame([(1, None)], "b int, a string")).collect()] == ['{"a":null,"b":1}']


def test_publications(spark, tmp_path):
    store = Publications(spark, str(tmp_path / "pub"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, t string")
    assert store.publish(frame((1, "a")), "k") == 1
    assert store.publish(frame((1, "a")), "k") == 1
    assert store.publish(frame((1, "b")), "k") == 2
    assert store.publish(frame((1, "c"), (2, "d")), "k") == 3
    assert store.rollback() == 4 and store.active().first().t == "b"
    assert store.rollback() == 5 and store.active().first().t == "a"
    with pytest.raises(ValueError):
        store.rollback()
    for rows, faults in ((frame((1, "x"), (1, "y")), None), (frame(), None), (frame((1, "z")), spark.createDataFrame([("error",)], "severity string"))):
        with pytest.raises(ValueError):
            store.publish(rows, "k", faults)
    assert store.active().first().t == "a" and len(store.history()) == 5


def test_crash_before_the_pointer_moves_loses_nothing(spark, tmp_path, monkeypatch):
    store = Publications(spark, str(tmp_path / "pub"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, t string")
    store.publish(frame((1, "a")), "k")

    def crash(history):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, "_point", crash)
        with pytest.raises(OSError):
            store.publish(frame((1, "b")), "k")
    assert [h["version"] for h in store.history()] == [1] and store.active().first().t == "a"
    assert store.publish(frame((1, "c")), "k") == 2 and store.active().first().t == "c"
    assert store.rollback() == 3 and store.active().first().t == "a"


def test_archives_by_digest(spark):
    members = spark.createDataFrame([("a", "x.json", "[1]"), ("a", "y.json", "[2]"), ("b", "x.json", "[3]")], "book string, member string, body string")
    one, two = (S.zipped(m, "book", "member", "body").orderBy("path").collect() for m in (members, members.orderBy("body", ascending=False)))
    assert [bytes(r.content) for r in one] == [bytes(r.content) for r in two]
    archives = S.zipped(members, "book", "member", "body")
    declared = archives.filter("path = 'a'").select("path", F.sha2("content", 256).alias("sha256"))
    got = sorted(((r.path, r.body or "", r.fault or "") for r in S.unzipped(archives, declared=declared).collect()))
    assert got == [("a", "[1]", ""), ("a", "[2]", ""), ("b", "", "another digest")]


def test_other_databases(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "k int, t string")
    rows.write.format("jdbc").options(url=url, dbtable="posts", **driver).save()
    assert S.table(spark, url, "posts", 7, ("k", 0, 40, 4), **driver).count() == 40
    found = S.tables_there(spark, url, {"posts": "k int, t string", "votes": "k int"}, "SELECT TABLENAME AS NAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'", **driver)
    assert found["posts"].count() == 40 and found["votes"].count() == 0
    S.reload(rows, str(tmp_path / "r"), 2)
    S.reload(rows.limit(3), str(tmp_path / "r"), 2)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
