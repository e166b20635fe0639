"""Query registry.

``@query(id, sql=...)`` registers a builder ``fn(spark, sf_dir) -> DataFrame``
and, optionally, the DuckDB SQL that must give the same rows. Every computed
column is aliased to the same name on both sides; doubles are rounded the
same way on both sides because summation order differs between engines.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_SQL: dict[str, str] = {}
_DOCS: dict[str, str] = {}

PLAN_MODULES = (
    "station",
    "formulas",
    "marts",
    "aggregates",
    "ranking",
    "encoding",
    "blending",
    "spatial",
    "quality",
    "models",
    "registry",
)


def query(qid: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if qid in _QUERIES:
            raise ValueError(f"duplicate query id {qid}")
        _QUERIES[qid] = fn
        _DOCS[qid] = (fn.__doc__ or "").strip()
        if sql is not None:
            _SQL[qid] = sql.strip()
        return fn

    return deco


def _load() -> None:
    for m in PLAN_MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"{__package__}.{m}":
                raise


def queries() -> dict[str, Builder]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def docs() -> dict[str, str]:
    _load()
    return dict(_DOCS)
