import json

import pytest
from pyspark.sql import functions as F

from quire.functions import documents as D


@pytest.mark.parametrize("text,fault", [('{"a": [1, 2]}', None), ('{"a": 1, "a": 2}', "repeated_key"), ("{", "not_json"), ('{"a": NaN}', "not_finite"), ('{"b": 1}', "unknown_key"), (json.dumps(list(range(101))), "too_many_members"), ("[" * 20 + "]" * 20, "too_deep"), (None, "missing"), ("[" * 100_000, "not_json")])
def test_faults(text, fault):
    assert D.fault_of(text, frozenset("a")) == fault


def test_too_many_values():
    assert D.fault_of(json.dumps([[0] * 100] * 60)) == "too_many_values"


def test_coordinates(spark):
    rows = spark.createDataFrame([("12.5", "100"), ("91", "0"), ("x", "1"), (None, "1")], "a string, b string")
    got = [r.c for r in rows.select(D.coordinates(F.col("a"), F.col("b")).alias("c")).collect()]
    assert tuple(got[0]) == (12.5, 100.0) and got[1:] == [None] * 3
