import os

import pytest
from pyspark.sql import functions as F

from quire.operators import ingest as I
from quire.operators.releases import Blocked, Conflict, Releases

def sealed():
    return F.sha2(F.concat_ws("|", "work", "first", "last", "text"), 256)


KEY = ["work", "chapter", "first", "last"]


def setup(spark, rows):
    df = spark.createDataFrame([(*r, f"text {r}") for r in rows], "work string, chapter int, first int, last int, text string").withColumn("checksum", sealed())
    return df, spark.createDataFrame([("a",), ("b",)], "work string"), spark.createDataFrame([("gap", "warning")], "code string, severity string")


HEAD, MANIFEST = {"status": "verified", "errors": 0, "edition": "e"}, {"edition": "e", "licence": "open"}


def publish(store, df, known, findings, head=HEAD, manifest=MANIFEST, base=None):
    return store.publish(head, manifest, df, findings, KEY, "work", "chapter", known, sealed(), "checksum", base)


def test_releases_of_several_tables(spark, tmp_path):
    store = Releases(spark, str(tmp_path))
    one, known, findings = setup(spark, [("a", 1, 1, 3), ("a", 1, 4, 4), ("b", 2, 1, 1)])
    two, *_ = setup(spark, [("a", 1, 1, 3), ("a", 2, 1, 1)])
    assert store.state() == 0 and publish(store, one, known, findings) == 1
    assert publish(store, one, known, findings) == 1  # the same content
    assert publish(store, two, known, findings, manifest=MANIFEST | {"counts": {"a": 2}}) == 2
    assert sorted(map(tuple, store.table("coverage").collect())) == [("a", 2, 2)]
    assert sorted(map(tuple, store.table("coverage", 1).collect())) == [("a", 1, 2), ("b", 1, 1)]
    assert store.rollback() == 3
    assert {name: store.table(name).count() for name in ("rows", "coverage", "metadata", "findings")} == {"rows": 3, "coverage": 2, "metadata": 2, "findings": 1}
    with pytest.raises(ValueError):
        store.rollback()
    assert publish(store, two, known, findings) == 4 and store.table("rows").count() == 2


def test_every_gate(spark, tmp_path):
    store = Releases(spark, str(tmp_path))
    good, known, findings = setup(spark, [("a", 1, 1, 3), ("a", 1, 4, 4)])
    cases = {
        "status": dict(head=HEAD | {"status": "staged"}), "recorded_errors": dict(head=HEAD | {"errors": 2}), "error_findings": dict(findings=findings.withColumn("severity", F.lit("error"))), "no_rows": dict(df=good.limit(0)),
        "repeated_places": dict(df=good.unionByName(good)), "unknown_work": dict(known=known.filter("work = 'b'")), "checksum": dict(df=good.withColumn("checksum", F.when(F.col("last") == 3, F.col("checksum")))), "manifest_edition": dict(manifest={"edition": "other"}), "counts": dict(manifest=MANIFEST | {"counts": {"a": 3}}),
    }
    for code, change in cases.items():
        with pytest.raises(Blocked) as refused:
            publish(store, **(dict(df=good, known=known, findings=findings) | change))
        assert refused.value.codes == [code]
    assert store.state() == 0 and not [n for n in os.listdir(tmp_path) if n.startswith("release")]


def test_two_writers_and_a_crash(spark, tmp_path, monkeypatch):
    store, other = Releases(spark, str(tmp_path)), Releases(spark, str(tmp_path))
    one, known, findings = setup(spark, [("a", 1, 1, 3)])
    two, *_ = setup(spark, [("a", 1, 1, 2)])
    three, *_ = setup(spark, [("a", 1, 1, 9)])
    publish(store, one, known, findings)
    seen = other.state()
    publish(store, two, known, findings)
    with pytest.raises(Conflict):
        publish(other, three, known, findings, base=seen)
    real = Releases.state
    monkeypatch.setattr(Releases, "state", lambda self: seen)  # the other looks just before the first one puts its pointer in place
    with pytest.raises(Conflict):
        publish(other, three, known, findings, base=seen)
    monkeypatch.setattr(Releases, "state", real)
    assert store.table("rows").first()["last"] == 2
    monkeypatch.setattr(Releases, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        publish(store, three, known, findings)
    assert store.state() == 2 and store.table("rows").first()["last"] == 2


def test_guarded_copy(spark, tmp_path, monkeypatch):
    source = spark.range(50).selectExpr("id", "id % 3 AS g", "CASE WHEN id > 5 THEN 'x' END AS s")
    path = f"{tmp_path}/t"
    monkeypatch.setattr(I, "verified", lambda a, b, g: a.limit(1))
    with pytest.raises(ValueError):
        I.guarded_copy(source, path, ["g"])
    assert not os.listdir(tmp_path)  # neither target nor what was staged
    monkeypatch.undo()
    assert I.guarded_copy(source, path, ["g"]) == 50 and spark.read.parquet(path).exceptAll(source).count() == 0
    with pytest.raises(ValueError):
        I.guarded_copy(source, path, ["g"])
    assert I.guarded_copy(source.limit(0), f"{tmp_path}/none", ["g"]) == 0
    assert I.guarded_copy(source, f"{tmp_path}/none", ["g"]) == 50  # a folder without rows is filled


def test_linked_registration(spark):
    kinds = [I.Kind("work", "w", ("title",)), I.Kind("text", "t", ("w", "lang"), (("w", "work"),))]
    works, texts = "w string, title string", "t string, w string, lang string"
    df = spark.createDataFrame
    known = {"work": df([("a", "A"), ("n", None)], works), "text": df([("1", "a", "en")], texts)}
    found, fresh = I.register_linked(kinds, known, {"work": df([("a", "A"), ("n", None), ("b", "B"), ("b", "B"), (None, "x")], works), "text": df([("1", "a", "en"), ("2", "b", None)], texts)})
    first = {(r["kind"], r["key"]): (r["outcome"], r["fields"], r["id"]) for r in found.collect()}
    assert {k: v[:2] for k, v in first.items()} == {("work", "a"): ("existing", ""), ("work", "n"): ("existing", ""), ("work", "b"): ("created", ""), ("text", "1"): ("existing", ""), ("text", "2"): ("created", "")}
    after = {k: known[k].unionByName(fresh[k]) for k in known}
    again, none = I.register_linked(kinds, after, {"work": df([("a", "A"), ("b", "B")], works), "text": df([("2", "b", None)], texts)})
    assert {r["outcome"] for r in again.collect()} == {"existing"} and all(d.count() == 0 for d in none.values())
    assert {(r["kind"], r["key"]): r["id"] for r in again.collect()}.items() <= {k: v[2] for k, v in first.items()}.items()
    bad, nothing = I.register_linked(kinds, known, {"work": df([("a", "Other"), ("n", "N"), ("c", "C"), ("c", "D")], works), "text": df([("1", "a", None), ("3", "lost", "en"), ("4", None, "en")], texts)})
    assert {(r["key"]): (r["outcome"], r["fields"]) for r in bad.collect()} == {"a": ("conflict", "title"), "n": ("conflict", "title"), "c": ("conflict", "title"), "1": ("conflict", "lang"), "3": ("conflict", "link w"), "4": ("created", "")}
    assert all(d.count() == 0 for d in nothing.values())


def test_numbers_of_new_keys(spark):
    known = spark.createDataFrame([("b", 7), ("d", 3)], "k string, n long")
    wanted = spark.range(5000).selectExpr("concat('k', lpad(id, 5, '0')) AS k").unionByName(known.select("k")).unionByName(spark.createDataFrame([(None,)], "k string")).repartition(9)
    got = {r["k"]: r["n"] for r in I.find_or_create(known, wanted, "k", "n").collect()}
    assert got == {"b": 7, "d": 3} | {f"k{i:05d}": 8 + i for i in range(5000)}
