import duckdb
import pytest

from quire.plans import ORACLES, QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, con, name):
    if name in ORACLES:
        assert differences(spark, con, FOLDER, QUERIES[name], ORACLES[name]) == ""
    else:
        assert QUERIES[name](spark, FOLDER).count()


@pytest.mark.parametrize("name", ["reference_parts", "abbreviated_references"])
def test_references_to_sources_of_any_name(spark, tmp_path, name):
    sources = ["src3", "src12", "src1c", "SRC12", "web_3", "archive", "src 1-abcdefghijkl", " \u03a9mega\n2 ", "", None]
    rows = [(i, s, 5) for k, s in enumerate(sources) for i in (k, 10 + k, 99_890 + k, 5_000_000 + k)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(spark, con, tmp_path, QUERIES[name], ORACLES[name]) == ""


def test_references_of_texts_of_any_length(spark, tmp_path):
    rows = [(i, "src3", n) for i, n in enumerate([0, 99_999, 100_000, 100_001, 5_000_000_000, None])]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert QUERIES["reference_parts"](spark, str(tmp_path)).count() == len(rows)
    assert differences(spark, con, tmp_path, QUERIES["reference_parts"], ORACLES["reference_parts"]) == ""
