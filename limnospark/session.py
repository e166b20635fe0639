"""Session helpers: building a local session for tests/bench, and intermediate
tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "limnospark") -> SparkSession:
    """Local session used by tests and bench. On a cluster, build the session
    with the cluster's own settings and pass it to the operators instead."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("LIMNOSPARK_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster has to name it (a shared file system); a temporary folder is
    made only where the master is local, as in tests."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="limnospark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back:
    survives executor loss, cuts the plan, keeps columnar statistics. The
    folder is deleted when the application ends."""
    spark = df.sparkSession
    where = f"{ensure_checkpoint_dir(spark).rstrip('/')}/limnospark-{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._limno_table = where
    for made in _scratch():
        made[where] = out
    return out


_HELD = threading.local()


def _scratch() -> list[dict[str, DataFrame]]:
    """The tables of this thread's open :func:`scratch` blocks."""
    if not hasattr(_HELD, "open"):
        _HELD.open = []
    return _HELD.open


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are deleted at its end, and so are the shuffle files
    of plans that nothing holds any more; what is read later has to be
    :func:`kept`."""
    made: dict[str, DataFrame] = {}
    _scratch().append(made)
    try:
        yield
    finally:
        _scratch().pop()  # blocks end in the reverse of their order
        for table in made.values():
            drop_table(table)
        made.clear()
        gc.collect()
        spark._jvm.System.gc()


def kept(table: DataFrame) -> DataFrame:
    """A table of :func:`materialize` that outlives the :func:`scratch` blocks
    it was made in."""
    for made in _scratch():
        made.pop(table._limno_table, None)
    return table


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._limno_table)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """:func:`materialize` for the rounds of an iteration."""
    return materialize(df, "round")
