"""Who may see which rows, in what order and how many: filters, pages, references and names that every reader uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with a key, pushed to the scan; no rows where there is none."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def optional_equal(column: Column, value: str | None) -> Column:
    """Equal without regard to case; everything if no value is asked for. Decided while the plan is built."""
    return F.lit(True) if value is None else F.upper(column) == value.upper()


def owned(df: DataFrame, owner: str, user: object) -> DataFrame:
    """Private rows of one user; none for nobody."""
    return df.filter(F.col(owner).eqNullSafe(F.lit(user)) & F.col(owner).isNotNull())


def visible(owner: Column, visibility: Column, user: object) -> Column:
    """Own rows, and those that are unlisted or public."""
    return F.coalesce(owner == F.lit(user), F.lit(False)) | F.coalesce(visibility.isin("unlisted", "public"), F.lit(False))


def page(df: DataFrame, order: Sequence[Column], skip: int, limit: int, most: int = 100) -> DataFrame:
    """A page in a total order; a limit outside 1 to `most` and a negative skip are put right."""
    return df.orderBy(*order).offset(max(0, skip)).limit(min(most, max(1, limit)))


def cut(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows with position and truncated, whether there are more: one row beyond is read, nothing is counted."""
    few = df.orderBy(*order).limit(limit + 1)
    everywhere = Window.partitionBy(F.lit(0))  # of limit + 1 rows
    placed = few.withColumn("position", F.row_number().over(everywhere.orderBy(*order)).cast("long"))
    return placed.withColumn("truncated", F.count("*").over(everywhere) > limit).filter(F.col("position") <= limit)


def holds_in_order(column: Column, parts: Sequence[str]) -> Column:
    """Whether a text holds all parts, one after another, in any case."""
    escaped = [p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for p in parts]
    return column.ilike("%" + "%".join(escaped) + "%")


def same_reference(a: Column, b: Column) -> Column:
    """Equal, or one holds the other, in upper case with white space as one space."""
    a, b = F.upper(T.squeeze(a)), F.upper(T.squeeze(b))
    return (a == b) | F.contains(a, b) | F.contains(b, a)


def alias_key(label: Column) -> Column:
    return F.lower(T.squeeze(label))


def resolve(df: DataFrame, label: str, aliases: DataFrame) -> DataFrame:
    """df with work, the target of its label in aliases (alias, work) without regard to case and white space; null where there is none. Aliases are a dictionary: one work for each."""
    known = aliases.groupBy(alias_key(F.col("alias")).alias("_alias")).agg(F.min("work").alias("work"))
    return df.withColumn("_alias", alias_key(F.col(label))).join(known, "_alias", "left").drop("_alias")


class RangeError(ValueError):
    """An interval that can't be: unknown, of two groups, reversed or incomplete."""


def interval(catalogue: DataFrame, key: str, group: str, ordinal: str, first: object | None, last: object | None) -> DataFrame:
    """The rows of one group from one key to another by their ordinals, both included. Two rows are looked up while the plan is built."""
    if (first is None) != (last is None):
        raise RangeError("incomplete")
    if first is None:
        return catalogue.orderBy(group, ordinal)
    ends = {r[key]: r for r in catalogue.filter(F.col(key).isin(first, last)).select(key, group, ordinal).collect()}
    if first not in ends or last not in ends:
        raise RangeError("unknown")
    a, b = ends[first], ends[last]
    if a[group] != b[group]:
        raise RangeError("of two groups")
    if a[ordinal] > b[ordinal]:
        raise RangeError("reversed")
    return catalogue.filter((F.col(group) == a[group]) & F.col(ordinal).between(a[ordinal], b[ordinal])).orderBy(ordinal)


def named_like(title: Column, aliases: Column, needle: str, raw: int = 4096, most: int = 256) -> Column:
    """Whether a title or one of its aliases holds the needle, case folded and with single spaces; an empty needle is everywhere, a long one refused."""
    plain = " ".join(needle.casefold().split())
    if len(needle) > raw or len(plain) > most:
        raise ValueError("the needle is too long")
    return F.exists(F.concat(F.array(title), aliases), lambda x: F.contains(F.lower(T.squeeze(x)), F.lit(plain)))
