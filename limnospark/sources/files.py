"""File scans and sinks.

Paths are under a shared folder (the cluster's checkpoint / warehouse
location), never a machine-local temporary folder.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location, deleted when the
    application ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/limnospark-out/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A1: CSV with a header and a declared schema (no inference); a bad
    cell becomes NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV sink with a header (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Overwrite or append a Parquet table."""
    df.write.mode(mode).parquet(path)
    return path


def append_log(spark: SparkSession, row: DataFrame, path: str) -> DataFrame:
    """Append rows to a metric log; create it when absent; columns
    missing on either side are added (union by name)."""
    row.write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system that holds ``path``, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, root: str) -> DataFrame:
    """Replace the table under ``root``: ``df`` is written to a version folder
    of its own, then a pointer file that names it gets its final name by a
    rename, which is atomic and meets no file of that name. The pointer whose
    name is last (by time) counts. A writer that fails leaves no pointer; of
    two writers the later one's version counts, and both are whole. Returns
    that version."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    new = f"{root}/_new-{version}"
    write_text(spark, new, version)
    fs, p = _fs(spark, new)
    if not fs.rename(p, _fs(spark, f"{root}/_pointer-{time.time_ns():020d}-{version}")[1]):
        raise OSError(f"{new} could not be renamed")
    return spark.read.parquet(f"{root}/{version}")


def current_version(spark: SparkSession, root: str) -> str | None:
    """Folder of the version that the last pointer names, if there is one."""
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    last = max((n for n in names if n.startswith("_pointer-")), default=None)
    return None if last is None else f"{root}/v-{last.rsplit('-', 1)[1]}"


def read_published(spark: SparkSession, root: str) -> DataFrame | None:
    """The table under ``root``: the pointer is followed once, so a reader
    stays with one version whatever is published meanwhile."""
    where = current_version(spark, root)
    return None if where is None else spark.read.parquet(where)


def expire(spark: SparkSession, root: str) -> None:
    """Delete what nobody reads any more: all versions and pointers but the
    current ones. Not for a folder that is being published to."""
    now = current_version(spark, root)
    fs, p = _fs(spark, root)
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if now and name.startswith(("v-", "_pointer-")) and not name.endswith(now.rsplit("/", 1)[1]):
            fs.delete(s.getPath(), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through the file system that holds the path."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def cached(spark: SparkSession, name: str, inputs: list[str], build) -> DataFrame:
    """The table that ``build()`` makes, kept as Parquet under a path that
    follows from its name and from its inputs' paths, sizes and times, so that
    a later call finds it and a changed input does not."""
    stamp = []
    for path in sorted(inputs):
        fs, p = _fs(spark, path)
        for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().toString()):
            stamp.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    key = hashlib.sha256(repr((name, stamp)).encode()).hexdigest()[:16]
    where = f"{ensure_checkpoint_dir(spark).rstrip('/')}/limnospark-cache/{name}-{key}"
    found = read_published(spark, where)
    return found if found is not None else publish(build(), where)


def raw_schema(spark: SparkSession, name: str) -> str:
    """A database of this application's own (its id is in the name), whose
    tables lie in a part of the shared folder that is deleted, as the database
    is dropped, when the application ends."""
    own = f"{name}_{re.sub('[^A-Za-z0-9]', '_', spark.sparkContext.applicationId)}"
    where = f"{ensure_checkpoint_dir(spark).rstrip('/')}/limnospark-{own}"
    fs, p = _fs(spark, where)
    fs.deleteOnExit(p)
    if not spark.catalog.databaseExists(own):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {own} LOCATION '{where}'")
        atexit.register(_drop_schema, spark, own)
    return own


def _drop_schema(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:  # still running
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def create_or_replace_table(df: DataFrame, table: str) -> DataFrame:
    """Create or replace a table as select. The rows are published
    (:func:`publish`) beside the database's tables, and the name is a view on
    the version, replaced in one step of the catalog: readers see the old
    table or the new one, never half of it."""
    spark = df.sparkSession
    schema, name = table.split(".")
    home = spark.sql(f"DESCRIBE DATABASE {schema}").where("info_name = 'Location'").first()["info_value"]
    root = f"{home.rstrip('/')}/_published/{name}"
    publish(df, root)
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM parquet.`{current_version(spark, root)}`")
    return spark.table(table)


def with_audit_time(df: DataFrame, col: str = "created_at") -> DataFrame:
    """A10: audit timestamp default."""
    return df.withColumn(col, F.current_timestamp())
