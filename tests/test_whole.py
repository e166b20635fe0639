"""Operators that must cover their whole table or every formula."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnospark.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def test_j15_folds_query_every_row(spark):
    """Every row is a query in every fold; neighbours come from the training
    folds only and equal brute force on both sides."""
    got = QUERIES["J15_folds"](spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, v = e["vec_id"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(float)
    assert len(got) == 5 * 20 * len(ids)
    assert not (got["nn_vec_id"] % 5 == got["fold"]).any()
    by = {k: g.sort_values("rank")["nn_vec_id"].tolist() for k, g in got.groupby(["fold", "role", "vec_id"])}
    assert len(by) == 5 * len(ids)
    for f in range(5):
        tr = ids % 5 != f
        for i in range(0, len(ids), 23):
            d = np.sqrt(((v[tr] - v[i]) ** 2).sum(1))
            near = ids[tr][np.lexsort((ids[tr], d))]
            role, skip = ("train", 1) if tr[i] else ("valid", 0)
            assert by[f, role, ids[i]] == near[skip:skip + 20].tolist()


@pytest.mark.parametrize("qid, n, filled", [
    ("F10_whole", 14, ["upstream_ppt_obs90_mean_transport"]),
    ("F11_whole", 10, ["upstream_cropland_pressure", "upstream_urban_pressure"]),
    ("F13_whole", 7, ["upstream_cropland_pressure", "upstream_urban_pressure"]),
    ("F14_whole", 11, ["upstream_pressure_index"]),
    ("F17_whole", 12, ["A_roll_precip_over_pet"]),
    ("F19_whole", 10, ["cropland_x_ppt", "cropland_x_area", "cropland_x_slope", "urban_x_area", "organic_x_clay"]),
])
def test_every_formula_of_a_pack_runs(spark, qid, n, filled):
    """All outputs are there, and those of the joined inputs hold values."""
    got = QUERIES[qid](spark, SF).toPandas()
    assert len(got.columns) == 1 + n
    for c in filled:
        assert (got[c].fillna(0) != 0).any(), c


def test_fold_steps_do_not_read_the_held_out_target(spark):
    """Other held-out targets leave every encoding and prediction as it was;
    encodings equal their definition; the basin's level, which no raw column
    shows, is learnt through them."""
    from limnospark.operators import models as M
    from limnospark.operators import training as TN

    rnd = random.Random(6)
    rows = []
    for i in range(240):
        b = i % 6
        rows.append((i, b, i % 24, i // 6 % 2, -30.0 + 2 * b + (i % 24) / 100, 20.0 + 2 * b, rnd.gauss(0, 1), 10.0 * b + rnd.random()))
    d = spark.createDataFrame(rows, "id long, basin long, station long, fold int, lat double, lon double, a double, y double")
    tr, va = d.where("fold = 0"), d.where("fold = 1")
    got = []
    for held in (va, va.withColumn("y", F.lit(1e6) + F.col("id"))):
        etr, eva, more = TN.encode(tr, held, "y", ["id"], "lat", "lon", "basin", "station", with_basin=True)
        got.append((etr, eva))
    assert more == ["te_cell_0", "te_cell_1", "te_basin", "station_obs_count", "knn_global", "knn_basin"]
    of = [[np.array(x.orderBy("id").select("id", *more).collect(), float) for x in pair] for pair in got]
    assert all(len(a) == 120 and np.allclose(a, b, equal_nan=True) for a, b in zip(*of))
    p = [TN.fit(got[0][0], x, ["a", *more], "y", M.random_forest(10, 5), "log1p", pruned=True, clipped=True).orderBy("id").collect()
         for x in (got[0][1], got[0][1].withColumn("y", F.lit(1e6) + F.col("id")))]
    assert [r["pred"] for r in p[0]] == [r["pred"] for r in p[1]]
    side, held = got[0][0].collect(), p[0]
    assert 1 - sum((r["pred"] - r["y"]) ** 2 for r in held) / sum((r["y"] - 25.5) ** 2 for r in held) > 0.8
    overall = np.mean([x[7] for x in rows if x[3] == 0])
    assert all(abs(r["te_basin"] - overall) < 1e-9 for r in side)
    train = [x for x in rows if x[3] == 0]
    for r in held:
        x = rows[r["id"]]
        own = [z[7] for z in train if z[1] == x[1]]
        assert abs(r["te_basin"] - (np.mean(own) if own else overall)) < 1e-9
        assert r["station_obs_count"] == sum(z[2] == x[2] for z in train)
        assert 0 <= r["pred"] < 100


@pytest.mark.parametrize("mode", ["none", "winsor", "sqrt", "log1p"])
def test_target_transform_comes_back(spark, mode):
    from limnospark.operators import training as TN

    d = spark.createDataFrame([(float(v),) for v in range(101)], "y double")
    got = TN.forward(d, "y", mode, "f").select("y", TN.inverse("f", mode).alias("b")).collect()
    assert all(abs(r["b"] - (min(max(r["y"], 1.0), 99.0) if mode == "winsor" else r["y"])) < 1e-6 for r in got)
