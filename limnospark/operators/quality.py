"""Data-quality checks (Q1-Q6). Every check is one aggregate; only check
rows (a handful) are produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import duplicate_keys


def key_integrity(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Q1 + Q2: rows, rows with a NULL key, duplicate key groups and the rows
    in them, for one table (one row)."""
    null_any = F.lit(False)
    for k in keys:
        null_any = null_any | F.col(k).isNull()
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(null_any).alias("n_null_keys"))
    dup = duplicate_keys(df.select(*keys), keys).agg(
        F.count(F.lit(1)).alias("dup_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("dup_rows")
    )
    return base.crossJoin(dup).select(F.lit(table).alias("table_name"), "*")


def range_verdict(checks: DataFrame, value: str = "value", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Q3: PASS when lo <= value <= hi (a NULL bound is open), per check."""
    ok = F.coalesce(F.col(value) >= F.col(lo), F.lit(True)) & F.coalesce(F.col(value) <= F.col(hi), F.lit(True))
    return checks.withColumn("status", F.when(F.col(value).isNull(), "FAIL").when(ok, "PASS").otherwise("FAIL"))


def overall_verdict(verdicts: DataFrame) -> DataFrame:
    """Q3: PASS if all pass, FAIL if none pass, else PARTIAL."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(F.col("status") == "PASS").alias("n_pass"),
    ).withColumn(
        "overall",
        F.when(F.col("n_pass") == F.col("n_checks"), "PASS").when(F.col("n_pass") == 0, "FAIL").otherwise("PARTIAL"),
    )


def output_contract(out: DataFrame, template: DataFrame, keys: list[str], row_id: str, targets: list[str],
                    non_negative: list[str]) -> DataFrame:
    """Q4: one row: row counts, NULL predictions, negative values, keys not
    in the template (and back), rows whose position differs from the
    template's, column order as expected."""
    o = out.select(row_id, *keys, *targets)
    null_any = F.lit(False)
    for t in targets:
        null_any = null_any | F.col(t).isNull()
    neg_any = F.lit(False)
    for t in non_negative:
        neg_any = neg_any | (F.col(t) < 0)
    stats = o.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(null_any).alias("rows_with_null"),
        F.count_if(neg_any).alias("rows_negative"),
    )
    tk = template.select(row_id, *keys)
    extra = o.select(row_id, *keys).exceptAll(tk).agg(F.count(F.lit(1)).alias("rows_not_in_template"))
    missing = tk.exceptAll(o.select(row_id, *keys)).agg(F.count(F.lit(1)).alias("template_rows_missing"))
    res = stats.crossJoin(extra).crossJoin(missing).crossJoin(
        template.agg(F.count(F.lit(1)).alias("template_rows"))
    )
    expected = [*keys, *targets]
    order_ok = [c for c in out.columns if c in expected] == expected
    passed = (
        (F.col("n_rows") == F.col("template_rows"))
        & (F.col("rows_with_null") == 0)
        & (F.col("rows_negative") == 0)
        & (F.col("rows_not_in_template") == 0)
        & (F.col("template_rows_missing") == 0)
        & F.lit(order_ok)
    )
    return res.withColumn("columns_in_order", F.lit(order_ok)).withColumn("passed", passed)


def column_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q5: for every column of either side: whether each side has it, and the
    share of its rows that hold a value (NULL where the column is missing)."""

    def filled(df: DataFrame, name: str) -> DataFrame:
        shares = df.agg(*[F.try_divide(F.count(c), F.count(F.lit(1))).alias(c) for c in df.columns])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in df.columns]))
        return shares.select(each.alias("s")).select("s.*", F.lit(True).alias(f"in_{name[-1]}"))

    j = filled(a, "filled_a").join(filled(b, "filled_b"), "column", "full")
    return j.select("column", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"),
                    "filled_a", "filled_b")


def file_profile(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """Q6: shape, total NULL cells, min and max over the numeric columns."""
    nulls = sum(F.count_if(F.col(c).isNull()) for c in cols)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        nulls.alias("n_null_cells"),
        F.least(*[F.min(F.col(c).cast("double")) for c in cols]).alias("min_value"),
        F.greatest(*[F.max(F.col(c).cast("double")) for c in cols]).alias("max_value"),
    ).select(F.lit(name).alias("file"), F.lit(len(df.columns)).alias("n_cols"), "*")
