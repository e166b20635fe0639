"""Hand-made tables with known answers (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from limnospark.functions import formulas as FX
from limnospark.functions.common import ratio
from limnospark.functions.keys import parse_date
from limnospark.operators import blend as BL
from limnospark.operators import encoding as EN
from limnospark.operators import folds as FO
from limnospark.operators import ranking as RK
from limnospark.operators import spatial as SP
from limnospark.operators import windows as W


def _series_df(spark, rows, schema="station long, d date, v double"):
    return spark.createDataFrame(rows, schema)


def _days(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("split", [None, 1])
def test_window_does_not_cross_stations(spark, split):
    df = _series_df(spark, [(1, _days(0), 1.0), (1, _days(1), 2.0), (2, _days(0), 10.0), (2, _days(1), 20.0)])
    s = W.series(df, ["station"], ["d"], lookback=3, split_rows=split)
    out = s.finish(s.frame.select(*s.frame.columns, W.prior_sum(s, "v", 3).alias("p3")))
    got = [r["p3"] for r in out.orderBy("station", "d").collect()]
    assert got == [None, 1.0, None, 10.0]


@pytest.mark.parametrize("split", [None, 2])
def test_dry_streak(spark, split):
    vals = [0.0, 0.05, 5.0, None, 0.0]
    df = _series_df(spark, [(1, _days(i), v) for i, v in enumerate(vals)])
    s = W.series(df, ["station"], ["d"], lookback=0, split_rows=split, carry_predicates={"wet": W.wet_predicate("v", 0.1)})
    out = s.finish(s.frame.select(*s.frame.columns, W.dry_streak(s, "v", 0.1, carry="wet").alias("dry")))
    assert [r["dry"] for r in out.orderBy("d").collect()] == [0, 1, 2, 0, 1]


def test_dry_spell_count(spark):
    df = _series_df(spark, [(1, _days(i), v) for i, v in enumerate([0.0, 5.0, 0.0])])
    s = W.series(df, ["station"], ["d"], lookback=14)
    out = s.frame.select("d", W.dry_spell_count(s, "v", 14, 0.1).alias("n"))
    assert [r["n"] for r in out.orderBy("d").collect()] == [None, 2, 2]


def test_monthly_lag(spark):
    rows = [(1, dt.date(2024, 1, 15), 1.0), (1, dt.date(2024, 2, 15), 2.0), (1, dt.date(2024, 4, 15), 3.0)]
    df = _series_df(spark, rows)
    s = W.series(df, ["station"], ["d"], lookback=1)
    out = s.frame.select("d", W.monthly_lag(s, "v", "d").alias("lag1"))
    assert [r["lag1"] for r in out.orderBy("d").collect()] == [None, 1.0, None]


def test_two_date_formats(spark):
    df = spark.createDataFrame([("01-09-2014",), ("2014-09-01",), ("x",)], "s string")
    got = [r["d"] for r in df.select(parse_date("s").alias("d")).collect()]
    assert got == [dt.date(2014, 9, 1), dt.date(2014, 9, 1), None]


def test_linear_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "y double")
    q = RK.quantiles(df, "y", [0.01, 0.99], ["lo", "hi"]).first()
    assert q["lo"] == pytest.approx(1.02) and q["hi"] == pytest.approx(3.96)


@pytest.mark.parametrize("buckets", [1, 2, 64])
def test_average_rank_with_ties(spark, buckets):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 30.0)], "id long, x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)  # as many ranges
    out = RK.with_rank(df, "x", "r", "avg")
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["r"] for r in out.orderBy("id").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_held_out_basin_encoding_is_overall_mean(spark):
    rows = [(i, i % 4, float(i * 3 % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, basin long, y double")
    df = FO.group_folds(df, "basin", 4)
    tr, va = EN.oof_mean(df, df, ["basin"], "y", "fold", "te", "overall")
    overall = sum(r[2] for r in rows) / len(rows)
    vals = {round(r["te"], 9) for r in tr.collect()}
    assert vals == {round(overall, 9)}
    # the valid side uses the full per-basin map
    by_basin = {b: sum(y for _, bb, y in rows if bb == b) / 10 for b in range(4)}
    for r in va.collect():
        assert r["te"] == pytest.approx(by_basin[r["basin"]])


def test_rank_blend_zero_weight_returns_base(spark):
    rows = [(i, float(i * 37 % 101), float(i * 11 % 53)) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    out = BL.rank_interpolate(df, "k", "a", "b", 0.0)
    got = {r["k"]: r["blend"] for r in out.collect()}
    assert all(got[k] == pytest.approx(a) for k, a, _ in rows)


def test_simplex_grid_has_66_points(spark):
    w = BL.simplex_weights(spark).collect()
    assert len(w) == 66
    assert all(abs(r["w1"] + r["w2"] + r["w3"] - 1.0) < 1e-12 for r in w)


def test_ratio_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert df.select(ratio("a", "b").alias("r")).first()["r"] is None


def test_point_in_square(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0)], "id long, x double, y double")
    sq = spark.createDataFrame([(7, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])],
                               "poly long, ring array<struct<x:double,y:double>>")
    out = {r["id"]: r["poly"] for r in SP.points_in_polygons(pts, sq, "x", "y", "ring").collect()}
    assert out == {1: 7, 2: None}


def test_regime_flags_null_is_false(spark):
    df = spark.createDataFrame([(12, None, 600.0)], "month int, pet double, dist_main_km double")
    r = df.select(*[v.alias(k) for k, v in FX.regime_flags().items()]).first()
    assert r["is_pet_high"] == 0 and r["pet_low"] is True and r["is_dist_high_x_m12"] == 1
