"""Keyed joins.

Plain equi-joins: Spark chooses broadcast (by measured size, never by hint
for tables that grow with the data) or sort-merge; AQE splits skewed join
partitions. NULL keys never match (unlike pandas merge, S6), so rows with a
NULL key are dropped before inner joins where the reference did so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class JoinCardinalityError(ValueError):
    pass


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows with a NULL in any key column."""
    return df.dropna(subset=keys)


def mart(base: DataFrame, parts: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    """Chain of joins ``(table, keys, how)`` onto ``base``."""
    return reduce(lambda acc, p: acc.join(p[0], p[1], p[2]), parts, base)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q1: keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                 validate: str = "one_to_one") -> DataFrame:
    """Join after asserting key uniqueness on the sides ``validate``
    names (one_to_one, many_to_one, one_to_many). The check is one
    aggregate per side; only a count reaches the driver."""
    checks = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[validate]
    for side in checks:
        n = duplicate_keys(side.select(*on), on).limit(1).count()
        if n:
            raise JoinCardinalityError(f"join keys {on} are not unique ({validate})")
    return left.join(right, on, how)


def realign(pred: DataFrame, template: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """Predictions onto the template rows (left join on the keys), the
    template ordinal carried for an ordered sink."""
    return template.join(pred, keys, "left")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], cols: dict, default=None) -> DataFrame:
    """Map lookup with a default (left join + coalesce)."""
    j = df.join(table.select(*keys, *cols.keys()), keys, "left")
    if default is None:
        return j.withColumnsRenamed(cols)
    return j.withColumns({out: F.coalesce(F.col(src), F.lit(default)) for src, out in cols.items()}).drop(
        *[s for s, o in cols.items() if s != o]
    )


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not yet present (anti join)."""
    return rows.join(existing.select(*keys), keys, "left_anti")


def exists_flag(rows: DataFrame, ids: DataFrame, keys: list[str], out: str = "exists") -> DataFrame:
    """Boolean column: key present in ``ids`` (join on distinct ids)."""
    d = ids.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return rows.join(d, keys, "left").withColumn(out, F.col("_hit").isNotNull()).drop("_hit")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows with the same key, append the others (MERGE on a
    table format that has it; here anti join + union)."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
