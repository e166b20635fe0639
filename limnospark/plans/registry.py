"""Sources, sinks and registry jobs.

Run artifacts are produced by Spark from the driver tables (one run per
order priority; fold metrics from the orders of that priority) into a
fresh folder under the shared checkpoint location, together with one broken
file, and then scanned back like real run folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import row_mean
from ..operators import aggregates as AG
from ..operators import joins as J
from ..sources import artifacts as AR
from ..sources import files as FS
from ..session import materialize
from ..sources.tables import TABLES
from .catalog import query
from .common import r, t
from .marts import ORDER_REV_SQL

TARGETS = ["TA", "EC", "DRP"]

# Oracle side: the same run metrics computed straight from orders.
_FOLD_SQL = """(SELECT p, target, round(avg(m), 6) AS mean FROM (
    SELECT substr(o_orderpriority, 1, 1) AS p, s.target, o_orderkey % 5 AS fold, round(avg(o_totalprice * s.scale), 6) AS m
    FROM orders, (VALUES ('TA', 1e-6), ('EC', 2e-6), ('DRP', 5e-7)) s(target, scale) GROUP BY 1, 2, 3) GROUP BY p, target)"""
INDEX_SQL = f"""(SELECT 'exp_2026010' || p AS experiment_id,
    round((max(mean) FILTER (WHERE target = 'TA') + max(mean) FILTER (WHERE target = 'EC')
           + max(mean) FILTER (WHERE target = 'DRP')) / 3, 6) AS cv_mean,
    round(max(mean) FILTER (WHERE target = 'DRP'), 6) AS drp_cv,
    CASE WHEN CAST(p AS INTEGER) % 2 = 0 THEN 'RandomForest' ELSE 'ExtraTrees' END AS model_family,
    CASE WHEN CAST(p AS INTEGER) <= 2 THEN 'log1p' ELSE 'none' END AS y_mode_drp,
    CASE WHEN CAST(p AS INTEGER) >= 4 THEN 3 ELSE 5 END AS feature_count_drp,
    'submissions/exp_2026010' || p || '.csv' AS submission_path,
    '2026-01-0' || p || 'T12:00:00' AS created,
    max(mean) FILTER (WHERE target = 'TA') AS ta, max(mean) FILTER (WHERE target = 'EC') AS ec,
    max(mean) FILTER (WHERE target = 'DRP') AS drp
  FROM {_FOLD_SQL} GROUP BY p)"""


def _fold_metrics(spark, sf_dir):
    """(priority, target, mean, std, folds[]) from orders: per fold
    (o_orderkey % 5) the mean of a target-specific scaled price."""
    o = t(spark, sf_dir, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("p"), (F.col("o_orderkey") % 5).alias("fold"), "o_totalprice")
    scale = {"TA": 1e-6, "EC": 2e-6, "DRP": 5e-7}
    long = o.select("p", "fold", F.explode(F.array(*[F.struct(F.lit(k).alias("target"), (F.col("o_totalprice") * v).alias("v"))
                                                     for k, v in scale.items()])).alias("s")).select("p", "fold", "s.*")
    per_fold = long.groupBy("p", "target", "fold").agg(r(F.avg("v"), 6).alias("m"))
    return per_fold.groupBy("p", "target").agg(
        r(F.avg("m"), 6).alias("mean"), r(F.stddev_pop("m"), 6).alias("std"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "m"))), lambda x: x["m"]).alias("folds"))


def _config(p, legacy: bool):
    """A run's configuration as JSON text, in the layout of its time: per
    target, or (legacy) one mode for all and no model."""
    mode = F.when(p <= 2, "sqrt").when(p == 3, "log1p").otherwise("none")
    if legacy:
        return F.to_json(F.struct(F.lit("legacy").alias("layout"), F.struct(mode.alias("y_mode")).alias("targets")))
    name = lambda v: F.struct(F.struct(v.alias("name")).alias("DRP"))
    cv = F.when(p == 2, "HistGradientBoostingRegressor").otherwise("ExtraTreesRegressor")
    return F.to_json(F.struct(
        F.lit("metadata").alias("layout"), F.struct(F.struct(mode.alias("DRP")).alias("y_mode_by_target")).alias("targets"),
        F.struct(name(cv).alias("cv_by_target"), F.when(p != 3, name(F.lit("ExtraTreesRegressor"))).alias("final_by_target")).alias("model")))


#: What the reported runs were meant to use, and the model of a
#: run that names none.
INTENDED = {"y_mode": "sqrt", "cv_model": "ExtraTreesRegressor", "final_model": "ExtraTreesRegressor"}
DEFAULT_MODEL = "ExtraTreesRegressor"


def run_configs(spark, sf_dir):
    """(experiment_id, created, layout, y_mode, cv_model, final_model) of every
    run, whatever the layout of its configuration."""
    rep = reports(spark, sf_dir).where(F.col("cv").isNotNull())
    at = lambda path: F.get_json_object("config", path)
    return rep.select(
        F.col("run_id").alias("experiment_id"), "created", at("$.layout").alias("layout"),
        F.coalesce(at("$.targets.y_mode_by_target.DRP"), at("$.targets.y_mode"), F.lit("unknown")).alias("y_mode"),
        F.coalesce(at("$.model.cv_by_target.DRP.name"), F.lit(DEFAULT_MODEL)).alias("cv_model"),
        F.coalesce(at("$.model.final_by_target.DRP.name"), F.lit(DEFAULT_MODEL)).alias("final_model"))


def write_runs(spark, sf_dir) -> str:
    """Write the run reports (JSON, one folder per run) and a broken file;
    returns the glob of the report files."""
    base = FS.scratch_path(spark, "runs")
    fm = _fold_metrics(spark, sf_dir)
    runs = fm.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("target", F.struct("mean", "std", "folds")))).alias("cv"))
    pv = F.col("p").cast("int")
    legacy = pv >= 4
    out = runs.select(
        F.concat(F.lit("exp_2026010"), F.col("p")).alias("run_id"),
        F.concat(F.lit("2026-01-0"), F.col("p"), F.lit("T12:00:00")).alias("created"),
        F.when(pv % 2 == 0, "RandomForest").otherwise("ExtraTrees").alias("model_family"),
        F.when(pv <= 2, "log1p").otherwise("none").alias("y_mode_drp"),
        F.when(legacy, F.to_json(F.array(*[F.lit(f"f{i}") for i in range(3)])))
        .otherwise(F.to_json(F.struct(F.array(*[F.lit(f"f{i}") for i in range(5)]).alias("columns")))).alias("features"),
        "cv",
        F.when(legacy, _config(pv, True)).otherwise(_config(pv, False)).alias("config"),
    )
    out.write.mode("overwrite").partitionBy("run_id").json(base)
    FS.write_text(spark, base + "/run_id=exp_broken/part-broken.json", '{"run_id": "exp_broken", "cv": {"TA": {"mean": \n')
    return base + "/run_id=*/*.json"


def reports(spark, sf_dir):
    """A2 over the written run folders; run id recovered from the path."""
    df = AR.read_reports(spark, write_runs(spark, sf_dir))
    return df.withColumn("run_id", F.regexp_extract("file_path", r"run_id=([^/]+)/", 1))


@query("A2", f"SELECT experiment_id AS run_id, false AS is_corrupt, 3 AS n_targets FROM {INDEX_SQL} UNION ALL SELECT 'exp_broken', true, 0")
def a2_json_scan(spark, sf_dir):
    """A2: JSON report scan over run folders; broken files kept as flagged
    rows instead of failing."""
    rep = reports(spark, sf_dir)
    return rep.select("run_id", F.col("_corrupt_record").isNotNull().alias("is_corrupt"),
                      F.size(F.coalesce(F.map_keys("cv"), F.array())).alias("n_targets"))


@query("A3", f"SELECT experiment_id AS run_id, feature_count_drp AS n_features FROM {INDEX_SQL}")
def a3_manifest_count(spark, sf_dir):
    """A3: feature manifest count (JSON list, or object with columns /
    features)."""
    rep = reports(spark, sf_dir).where(F.col("cv").isNotNull())
    return rep.select("run_id", AR.manifest_count("features").cast("int").alias("n_features"))


def index_table(spark, sf_dir):
    rep = reports(spark, sf_dir).where(F.col("cv").isNotNull())
    return rep.select(
        F.col("run_id").alias("experiment_id"),
        # The mean of the targets that are present.
        r(row_mean([F.try_element_at("cv", F.lit(tg))["mean"] for tg in TARGETS]), 6).alias("cv_mean"),
        r(F.try_element_at("cv", F.lit("DRP"))["mean"], 6).alias("drp_cv"),
        "model_family", "y_mode_drp",
        AR.manifest_count("features").cast("int").alias("feature_count_drp"),
        F.concat(F.lit("submissions/"), F.col("run_id"), F.lit(".csv")).alias("submission_path"),
        "created", "file_mtime",
    )


@query("R1", f"SELECT experiment_id, cv_mean, drp_cv, model_family, y_mode_drp, feature_count_drp, submission_path FROM {INDEX_SQL}")
def r1_rebuild_index(spark, sf_dir):
    """Experiment index rebuilt from run artifacts (both layouts)."""
    return index_table(spark, sf_dir).drop("created", "file_mtime")


@query("R2", f"SELECT experiment_id AS run_id, model_family, round(ta, 6) AS TA_mean, round(ec, 6) AS EC_mean, round(drp, 6) AS DRP_mean, cv_mean FROM {INDEX_SQL}")
def r2_audit(spark, sf_dir):
    """R2: full-history audit, per-target means, sorted by the mean."""
    rep = reports(spark, sf_dir).where(F.col("cv").isNotNull())
    cols = [r(F.try_element_at("cv", F.lit(tg))["mean"], 6).alias(f"{tg}_mean") for tg in TARGETS]
    idx = index_table(spark, sf_dir).select(F.col("experiment_id").alias("run_id"), "cv_mean")
    return rep.select("run_id", "model_family", *cols).join(idx, "run_id").orderBy(F.desc_nulls_last("cv_mean"), "run_id")


@query("R3", f"SELECT experiment_id, y_mode_drp, y_mode_drp = 'log1p' AS as_intended FROM {INDEX_SQL} ORDER BY created DESC, experiment_id DESC LIMIT 15")
def r3_intended_config(spark, sf_dir):
    """Intended-configuration check on the last 15 runs (expected DRP
    mode 'log1p')."""
    idx = index_table(spark, sf_dir).orderBy(F.desc("created"), F.desc("experiment_id")).limit(15)
    return idx.select("experiment_id", "y_mode_drp", (F.col("y_mode_drp") == "log1p").alias("as_intended"))


_CONFIG_SQL = f"""(SELECT experiment_id, created, CASE WHEN p >= 4 THEN 'legacy' ELSE 'metadata' END AS layout,
  CASE WHEN p <= 2 THEN 'sqrt' WHEN p = 3 THEN 'log1p' ELSE 'none' END AS y_mode,
  CASE WHEN p = 2 THEN 'HistGradientBoostingRegressor' ELSE 'ExtraTreesRegressor' END AS cv_model, 'ExtraTreesRegressor' AS final_model
  FROM (SELECT *, CAST(right(experiment_id, 1) AS INTEGER) AS p FROM {INDEX_SQL}))"""


@query("R1_layouts", f"SELECT experiment_id, layout, y_mode, cv_model, final_model FROM {_CONFIG_SQL}")
def r1_layouts(spark, sf_dir):
    """Configurations of both layouts read into one table."""
    return run_configs(spark, sf_dir).drop("created")


@query("R3_fields", f"""SELECT experiment_id, y_mode, cv_model, final_model, y_mode = 'sqrt' AND cv_model = 'ExtraTreesRegressor'
  AND final_model = 'ExtraTreesRegressor' AS as_intended FROM {_CONFIG_SQL} ORDER BY created DESC, experiment_id DESC LIMIT 15""")
def r3_fields(spark, sf_dir):
    """The last 15 runs against the intended mode, CV model and final
    model, read from their configurations."""
    c = run_configs(spark, sf_dir).orderBy(F.desc("created"), F.desc("experiment_id")).limit(15)
    same = F.lit(True)
    for name, value in INTENDED.items():
        same = same & (F.col(name) == value)
    return c.select("experiment_id", *INTENDED, same.alias("as_intended"))


def write_outputs(spark, sf_dir) -> str:
    """A CSV folder of predictions per run; returns the folder over them."""
    base = FS.scratch_path(spark, "outputs")
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.explode(F.array(*[F.lit(k) for k in range(1, 5)])).alias("p"))
    out = o.select(F.concat(F.lit("exp_2026010"), F.col("p")).alias("run_id"), "o_orderkey", _output(F.col("p")).alias("pred"))
    out.write.partitionBy("run_id").option("header", True).csv(base)
    return base


def _output(p):
    return F.col("o_totalprice").cast("double") * (1 + p * (F.col("o_orderkey") % 7 - 3) / 100)


_SIM_SQL = """(SELECT 'exp_2026010' || p AS entry, round(corr(o_totalprice, pred), 6) AS anchor_corr, round(avg(abs(pred - o_totalprice)), 4) AS anchor_mae
  FROM (SELECT p, o_totalprice, CAST(o_totalprice AS DOUBLE) * (1 + p * (o_orderkey % 7 - 3) / 100.0) AS pred FROM orders, range(1, 5) t(p)) GROUP BY p)"""


@query("R5_similarity", f"""SELECT i.experiment_id AS entry, i.cv_mean, s.anchor_corr, s.anchor_mae FROM {INDEX_SQL} i LEFT JOIN {_SIM_SQL} s ON s.entry = i.experiment_id""")
def r5_similarity(spark, sf_dir):
    """The state table's runs with the similarity of their outputs to the
    anchor's (correlation, mean absolute difference); runs without outputs
    have NULLs."""
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("pred", T.DoubleType())])
    out = FS.read_csv(spark, write_outputs(spark, sf_dir) + "/run_id=*", schema).withColumn("entry", F.regexp_extract(F.col("_metadata.file_path"), r"run_id=([^/]+)/", 1))
    anchor = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("anchor"))
    sim = out.join(anchor, "o_orderkey").groupBy("entry").agg(r(F.corr("anchor", "pred")).alias("anchor_corr"), r(F.avg(F.abs(F.col("pred") - F.col("anchor"))), 4).alias("anchor_mae"))
    idx = index_table(spark, sf_dir).select(F.col("experiment_id").alias("entry"), "cv_mean")
    return idx.join(sim, "entry", "left")


@query("R4", f"""SELECT model_family, round(avg(lift), 6) AS mean, min(lift) AS min, count(lift) AS count FROM (
  SELECT model_family, round(cv_mean - (SELECT cv_mean FROM {INDEX_SQL} WHERE experiment_id = 'exp_20260105'), 6) AS lift
  FROM {INDEX_SQL}) GROUP BY model_family""")
def r4_batch_analysis(spark, sf_dir):
    """Lift of every run against a baseline run, then group means."""
    idx = index_table(spark, sf_dir)
    base = idx.where(F.col("experiment_id") == "exp_20260105").select(F.col("cv_mean").alias("_base"))
    lift = idx.crossJoin(F.broadcast(base)).withColumn("lift", r(F.col("cv_mean") - F.col("_base"), 6))
    return AG.group_profile(lift, ["model_family"], "lift").select("model_family", r("mean", 6), "min", "count")


@query("R5", f"""SELECT experiment_id AS entry, 'run' AS kind, cv_mean, created, model_family = 'ExtraTrees' AS registered FROM {INDEX_SQL}
UNION ALL SELECT 'reference_' || r_name, 'reference', NULL, '2026-01-01T00:00:00', false FROM region""")
def r5_master_state(spark, sf_dir):
    """Master state: runs plus reference outputs (U1), registry flag
    (J8), latest row per run (G17)."""
    idx = index_table(spark, sf_dir)
    runs = idx.select(F.col("experiment_id").alias("entry"), F.lit("run").alias("kind"), "cv_mean", "created")
    refs = t(spark, sf_dir, "region").select(F.concat(F.lit("reference_"), "r_name").alias("entry"), F.lit("reference").alias("kind"),
                                              F.lit(None).cast("double").alias("cv_mean"), F.lit("2026-01-01T00:00:00").alias("created"))
    allr = AG.latest_per_key(runs.unionByName(refs), ["entry"], "created")
    registry = idx.where(F.col("model_family") == "ExtraTrees").select(F.col("experiment_id").alias("entry"))
    return J.exists_flag(allr, registry, ["entry"], "registered").orderBy("kind", F.desc_nulls_last("cv_mean"), "entry")


_REV_SQL_LIT = ORDER_REV_SQL.replace("'", "''")


@query("R6", f"SELECT 'order_revenue' AS table_name, count(DISTINCT l_orderkey) AS n_rows, sha256('{_REV_SQL_LIT}') AS sql_sha256 FROM lineitem")
def r6_build_registry(spark, sf_dir):
    """Feature-build registry rows: table, rows built, SHA-256 of the
    build statement, audit time (A10)."""
    built = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").count()
    row = built.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("order_revenue").alias("table_name"), "n_rows", F.sha2(F.lit(ORDER_REV_SQL), 256).alias("sql_sha256"))
    return FS.with_audit_time(row).drop("created_at")


@query("R7", f"SELECT experiment_id, cv_mean, model_family FROM {INDEX_SQL}")
def r7_register_run(spark, sf_dir):
    """Run registration: index rows appended to a registry table with
    an audit timestamp (A10), read back."""
    path = FS.scratch_path(spark, "registry")
    idx = index_table(spark, sf_dir).select("experiment_id", "cv_mean", "model_family")
    FS.with_audit_time(idx.limit(0)).write.mode("overwrite").parquet(path)
    FS.with_audit_time(idx).write.mode("append").parquet(path)
    return spark.read.parquet(path).drop("created_at")


def _r8_sql() -> str:
    from .blending import PAIR_SQL

    src = f"(SELECT o_orderkey, a, b, b - a AS delta, n_lines, round(avg_disc, 9) AS avg_disc, avg_tax, round(avg_qty, 9) AS avg_qty FROM {PAIR_SQL})"
    pn = ["p01", "p05", "p10", "p25", "p50", "p75", "p90", "p95", "p99"]
    pv = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]

    def profile(col, series):
        stats = ["CAST(count({c}) AS DOUBLE) AS count", "min({c}) AS min", "max({c}) AS max", "avg({c}) AS mean",
                 "quantile_cont({c}, 0.5) AS median", "stddev_samp({c}) AS std"] + [f"quantile_cont({{c}}, {v}) AS {n}" for v, n in zip(pv, pn)]
        sel = ", ".join(x.format(c=col) for x in stats)
        names = ", ".join(["count", "min", "max", "mean", "median", "std", *pn])
        return (f"SELECT 'profile_' || stat AS metric, '{series}' AS series, value FROM (SELECT {sel} FROM {src}) "
                f"UNPIVOT (value FOR stat IN ({names}))")

    delta = (f"SELECT 'delta_' || stat, 'delta', value FROM (SELECT avg(abs(delta)) AS mean_abs, max(delta) AS max, min(delta) AS min, "
             f"stddev_samp(delta) AS std FROM {src}) UNPIVOT (value FOR stat IN (mean_abs, max, min, std))")
    bands = (f"SELECT 'delta_by_disc_band_' || CAST(band AS VARCHAR), 'delta', avg(delta) FROM (SELECT delta, "
             f"len(list_filter(e, lambda x: avg_disc > x)) AS band FROM {src}, (SELECT list_distinct([quantile_cont(avg_disc, 0.25), "
             f"quantile_cont(avg_disc, 0.5), quantile_cont(avg_disc, 0.75)]) AS e FROM {src})) GROUP BY band")
    bins = (f"SELECT 'delta_by_qty_bin_' || CAST(bin AS VARCHAR), 'delta', avg(delta) FROM (SELECT delta, CAST(least(coalesce(greatest(0, "
            f"ceil((avg_qty - mn) / nullif((mx - mn) / 6, 0)) - 1), 0), 5) AS BIGINT) AS bin FROM {src}, (SELECT min(avg_qty) AS mn, "
            f"max(avg_qty) AS mx FROM {src})) GROUP BY bin")
    corr = " UNION ALL ".join(f"SELECT 'corr_{x}', 'delta', corr({x}, delta) FROM {src}" for x in ["n_lines", "avg_disc", "avg_tax", "avg_qty"])
    top = f"SELECT * FROM (SELECT 'top_change_' || CAST(o_orderkey AS VARCHAR), 'delta', delta FROM {src} ORDER BY abs(delta) DESC, o_orderkey LIMIT 5)"
    body = " UNION ALL ".join([profile("a", "old"), profile("b", "new"), delta, bands, bins, corr, top])
    return f"SELECT metric, series, round(value, 4) AS value FROM ({body}) t(metric, series, value)"


R8_SQL = _r8_sql()


@query("R8", R8_SQL)
def r8_change_audit(spark, sf_dir):
    """Change audit of an old vs new prediction table (per order):
    profiles (G12, G13), quantile bands and bins of the context (T8, T9),
    proxy correlations (E5), top changes (L2), as (metric, series, value)."""
    from ..operators import evaluate as EV
    from ..operators import ranking as RK
    from .blending import pair

    # Context proxies snapped to 9 decimals (same in the oracle) so band and
    # bin edges compare equal values on both engines.
    # Read by every part: joined and grouped once.
    p = materialize(pair(spark, sf_dir).withColumn("delta", F.col("b") - F.col("a")).withColumns(
        {"avg_disc": r("avg_disc", 9), "avg_qty": r("avg_qty", 9)}).select(
        "o_orderkey", "a", "b", "delta", "n_lines", "avg_disc", "avg_tax", "avg_qty"), "audit")
    parts = [
        AG.vector_profile(p, "a").select(F.concat(F.lit("profile_"), "stat").alias("metric"), F.lit("old").alias("series"), "value"),
        AG.vector_profile(p, "b").select(F.concat(F.lit("profile_"), "stat").alias("metric"), F.lit("new").alias("series"), "value"),
        AG.delta_profile(p, "delta").select(F.concat(F.lit("delta_"), "stat").alias("metric"), F.lit("delta").alias("series"), "value"),
    ]
    banded = RK.quantile_bands(p, "avg_disc", "band", 4)
    parts.append(banded.groupBy("band").agg(F.avg("delta").alias("value")).select(
        F.concat(F.lit("delta_by_disc_band_"), F.col("band").cast("string")).alias("metric"), F.lit("delta").alias("series"), "value"))
    binned = RK.equal_width_bins(p, "avg_qty", "bin", 6)
    parts.append(binned.groupBy("bin").agg(F.avg("delta").alias("value")).select(
        F.concat(F.lit("delta_by_qty_bin_"), F.col("bin").cast("string")).alias("metric"), F.lit("delta").alias("series"), "value"))
    parts.append(EV.proxy_correlations(p, "delta", ["n_lines", "avg_disc", "avg_tax", "avg_qty"]).select(
        F.concat(F.lit("corr_"), "proxy").alias("metric"), F.lit("delta").alias("series"), F.col("corr").alias("value")))
    top = p.orderBy(F.desc(F.abs("delta")), "o_orderkey").limit(5)
    parts.append(top.select(F.concat(F.lit("top_change_"), F.col("o_orderkey").cast("string")).alias("metric"),
                            F.lit("delta").alias("series"), F.col("delta").alias("value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("metric", "series", r("value", 4))


@query("R9", f"SELECT experiment_id, model_family, y_mode_drp, feature_count_drp FROM {INDEX_SQL} ORDER BY created DESC LIMIT 1")
def r9_newest_run(spark, sf_dir):
    """Newest run (by the run's own stamp, then file modification time)
    and its config summary."""
    idx = index_table(spark, sf_dir)
    return idx.agg(F.max_by(F.struct("experiment_id", "model_family", "y_mode_drp", "feature_count_drp"),
                            F.struct("created", "file_mtime")).alias("n")).select("n.*")


# ---------------------------------------------------------------------------
# File sources and sinks
# ---------------------------------------------------------------------------

ORDERS_CSV = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.DateType()),
])


@query(
    "A1_A7",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate
FROM orders""",
)
def a1_a7_csv_roundtrip(spark, sf_dir):
    """A7 CSV sink then A1 CSV scan with a header and a declared schema."""
    path = FS.scratch_path(spark, "orders_csv")
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                          F.to_date("o_orderdate").alias("o_orderdate"))
    FS.write_csv(o, path)
    back = FS.read_csv(spark, path, ORDERS_CSV)
    return back.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("A8_A9", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLES))
def a8_a9_overwrite_load(spark, sf_dir):
    """Create or replace every listed table of the raw schema from
    its file (missing files skipped) and read the loaded tables back."""
    raw = FS.raw_schema(spark, "limnospark_raw")
    parts = []
    for name in [*TABLES, "not_delivered"]:
        src = f"{sf_dir.rstrip('/')}/{name}.parquet"
        if FS.exists(spark, src):
            loaded = FS.create_or_replace_table(spark.read.parquet(src), f"{raw}.{name}")
            parts.append(loaded.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query(
    "A11",
    """SELECT o_orderpriority AS priority, count(*) AS n_orders, NULL::DOUBLE AS mean_price FROM orders GROUP BY 1
UNION ALL SELECT o_orderpriority, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY 1""",
)
def a11_append_log(spark, sf_dir):
    """Append to a metric log, created when absent; a later row with
    an extra column widens the log (union by name)."""
    path = FS.scratch_path(spark, "metric_log")
    o = t(spark, sf_dir, "orders")
    first = o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n_orders"))
    FS.append_log(spark, first, path)
    second = o.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n_orders"), r(F.avg("o_totalprice"), 4).alias("mean_price"))
    return FS.append_log(spark, second, path)


@query(
    "A12",
    """SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey""",
)
def a12_mart_cache(spark, sf_dir):
    """Model-ready cache: build the mart once as Parquet, reuse it when
    present."""
    src = f"{sf_dir.rstrip('/')}/lineitem.parquet"
    return FS.cached(spark, "lines_per_order", [src], lambda: t(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines")))


@query("A10", f"SELECT experiment_id, true AS has_audit_time FROM {INDEX_SQL}")
def a10_insert_audit(spark, sf_dir):
    """A10: rows inserted into a registry table get the audit timestamp by
    default; checks every inserted row has one."""
    table = f"{FS.raw_schema(spark, 'limnospark_raw')}.registry_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TABLE {table} (experiment_id STRING, cv_mean DOUBLE, created_at TIMESTAMP DEFAULT current_timestamp()) USING parquet")
    index_table(spark, sf_dir).select("experiment_id", "cv_mean").createOrReplaceTempView("_registry_rows")
    spark.sql(f"INSERT INTO {table} (experiment_id, cv_mean) SELECT experiment_id, cv_mean FROM _registry_rows")
    back = spark.table(table)
    return back.select("experiment_id", F.col("created_at").isNotNull().alias("has_audit_time"))
