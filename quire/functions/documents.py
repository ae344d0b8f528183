"""Strict reading of JSON documents, where Spark's own reader is lenient."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Limits of a document: values in all, depth, members of one list or object.
VALUES, DEPTH, MEMBERS = 5000, 12, 100


def fault_of(text: str | None, allowed: frozenset[str] | None = None, values: int = VALUES, depth: int = DEPTH, members: int = MEMBERS) -> str | None:
    """Why a document is refused, null if it isn't: no JSON, a repeated key, a number that isn't finite, a key that isn't allowed, or beyond a limit."""
    if text is None:
        return "missing"
    found: list[str] = []

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            found.append("repeated_key")
        return dict(items)

    try:
        document = json.loads(text, object_pairs_hook=pairs, parse_constant=lambda _: found.append("not_finite"))
    except (ValueError, RecursionError):
        return "not_json"
    if found:
        return found[0]
    todo, met = [(document, 1)], 0
    while todo:
        value, level = todo.pop()
        met += 1
        if met > values:
            return "too_many_values"
        if level > depth:
            return "too_deep"
        if isinstance(value, (dict, list)):
            if len(value) > members:
                return "too_many_members"
            if isinstance(value, dict) and allowed is not None and not value.keys() <= allowed:
                return "unknown_key"
            todo += [(v, level + 1) for v in (value.values() if isinstance(value, dict) else value)]
    return None


def json_fault(text: Column, allowed: list[str] | None = None) -> Column:
    keys = frozenset(allowed) if allowed is not None else None

    @F.pandas_udf(StringType())
    def fault(texts: pd.Series) -> pd.Series:
        return pd.Series([fault_of(None if pd.isna(x) else x, keys) for x in texts], dtype=object)

    return fault(text)


def coordinates(latitude: Column, longitude: Column) -> Column:
    """Struct of both as doubles, null unless both are numbers on the globe."""
    a, b = latitude.try_cast("double"), longitude.try_cast("double")
    return F.when(a.between(-90, 90) & b.between(-180, 180), F.struct(a.alias("latitude"), b.alias("longitude")))


def first_filled(*fields: Column) -> Column:
    """The first field that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields])
