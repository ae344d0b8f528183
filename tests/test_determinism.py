import pytest

from quire.plans import QUERIES
from tests.compare import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["lexical_topk", "rrf_fusion", "quality_report", "table_digest", "extractive_support", "overlap_flags"])
def test_same_for_any_partitioning(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name](spark, FOLDER)
            found.append(rows(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
