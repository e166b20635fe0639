"""Run artifacts: JSON run reports / configs scanned over run folders (A2,
A3, P13), metric text lines (P14).

Reports are read with an explicit schema in PERMISSIVE mode: a broken file
becomes a row with ``_corrupt_record`` set instead of failing the scan, and
``_metadata.file_path`` names the run folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC = T.StructType([
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("folds", T.ArrayType(T.DoubleType())),
])

# Run report: target name -> {mean, std, folds[]}.
REPORT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("model_family", T.StringType()),
    T.StructField("y_mode_drp", T.StringType()),
    T.StructField("features", T.StringType()),  # list or {"columns": [...]} kept as JSON text
    T.StructField("cv", T.MapType(T.StringType(), METRIC)),
    T.StructField("config", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_reports(spark: SparkSession, pattern: str, schema: T.StructType = REPORT_SCHEMA) -> DataFrame:
    """A2: every JSON report under ``pattern`` (glob), broken files kept as
    corrupt rows, file path attached."""
    df = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", True)
        .json(pattern)
    )
    return df.withColumn("file_path", F.col("_metadata.file_path")).withColumn(
        "file_mtime", F.col("_metadata.file_modification_time")
    )


def manifest_count(json_text) -> F.Column:
    """A3: number of features in a manifest that is either a JSON list or an
    object with a ``columns`` (else ``features``) list, else the object's own
    keys."""
    c = F.col(json_text) if isinstance(json_text, str) else json_text
    as_list = F.try_parse_json(c)
    n_list = F.when(F.schema_of_variant(as_list).startswith("ARRAY"), F.size(F.from_json(c, "array<string>")))
    n_cols = F.size(F.from_json(F.get_json_object(c, "$.columns"), "array<string>"))
    n_feats = F.size(F.from_json(F.get_json_object(c, "$.features"), "array<string>"))
    n_keys = F.size(F.json_object_keys(c))
    pos = lambda x: F.when(x >= 0, x)  # noqa: E731  size(NULL) is -1
    return F.coalesce(pos(n_list), pos(n_cols), pos(n_feats), pos(n_keys), F.lit(0))


def cv_long(reports: DataFrame, key: str = "run_id") -> DataFrame:
    """(run, target, mean, std, n_folds) rows from the report map."""
    return reports.select(key, F.explode("cv").alias("target", "m")).select(
        key, "target", F.col("m.mean").alias("mean"), F.col("m.std").alias("std"),
        F.size("m.folds").alias("n_folds"),
    )


#: Fixed value: a printed score line, ``name | mean=x ± y | folds=[a b c]``
#: (``+/-`` stands for ``±`` too).
METRIC_LINE = r"([^|\n]+?)\s*\|\s*mean=([-\d.]+)\s*(?:±|\+/-)\s*([-\d.]+)\s*\|\s*folds=\[([^\]]+)\]"


def parse_metric_lines(df: DataFrame, col: str) -> DataFrame:
    """Every score line in a text -> target, mean, std, number of folds,
    mean over the folds. Text that is no score line gives no row; a number
    that cannot be read is NULL."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(METRIC_LINE), F.lit(0))).alias("line"))
    part = lambda k: F.regexp_extract("line", METRIC_LINE, k)
    folds = F.transform(F.split(F.trim(part(4)), r"\s+"), lambda x: x.try_cast("double"))
    return found.select(
        F.trim(part(1)).alias("target"), part(2).try_cast("double").alias("mean"), part(3).try_cast("double").alias("std"),
        F.size(folds).cast("long").alias("n_folds"), folds.alias("folds"),
    )
