"""Helpers shared by the operators: table reads, intermediate tables in the
cluster's shared folder, and shipping of task code to Python workers."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def ship(module: str) -> None:
    """Pickle a module's functions by value, so that Python workers need not
    find this repository on their own path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of
    ``spark.checkpoint.dir`` and read it back: cuts lineage, survives lost
    executors, keeps columnar statistics. The folder goes when the
    application ends, or earlier through :func:`discard`."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    where = f"{root}/limnospark-{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(where)
    path = _path(spark, where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._limno_path = where
    if (run := _run.get()) is not None:
        run.append(where)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    if where := getattr(df, "_limno_path", None):
        _delete(df.sparkSession, where)


def _delete(spark: SparkSession, where: str) -> None:
    path = _path(spark, where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables made by the pipeline stage that is being built, if any.
_run: ContextVar[list[str] | None] = ContextVar("_run", default=None)


def settled(stage: Callable[[], DataFrame], label: str) -> DataFrame:
    """The result of ``stage`` written; the tables that the stage itself made
    have then done their work and are deleted, no others."""
    made: list[str] = []
    token = _run.set(made)
    try:
        df = stage()
        out = written(df, label)
    finally:
        _run.reset(token)
    for where in made:
        if where != out._limno_path:
            _delete(df.sparkSession, where)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks(spark: SparkSession) -> int:
    """Partition count for keyed work: the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(col: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def fold_of(col: Column, k: int) -> Column:
    """crc32 of a key's decimal text, modulo ``k`` (the hold-out rule)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(k)
