"""k-means fits in common passes: Lloyd against a slow version, starting
centres, missing values, the number of jobs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnospark.operators import kmeans as KM


def blobs(spark, n=600, parts=4):
    rng = random.Random(1)
    mid = [(0, 0), (10, 0), (0, 10), (10, 10)]
    rows = [(i, mid[i % 4][0] + rng.gauss(0, 1), mid[i % 4][1] + rng.gauss(0, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double").repartition(parts), rows



def coords():
    return [F.col("a"), F.col("b")]


def test_finds_blobs_and_is_a_fixed_point(spark):
    df, rows = blobs(spark)
    got = KM.fit(df, "id", coords(), [2, 4], restarts=3)
    x = np.array([r[1:] for r in rows])
    for k, f in got.items():
        own = KM.distances(x, f.centres).argmin(1)
        assert np.allclose(f.centres, [x[own == e].mean(0) for e in range(k)], atol=1e-6)
        assert f.cost == pytest.approx(KM.distances(x, f.centres).min(1).sum())
        assert [list(c) for c in f.centres] == sorted(list(c) for c in f.centres)
    assert sorted(tuple(int(round(v, -1)) for v in c) for c in got[4].centres) == [(0, 0), (0, 10), (10, 0), (10, 10)]
    seen = {r["id"]: r["c"] for r in df.select("id", KM.assign(coords(), got[4].centres).alias("c")).collect()}
    assert seen == {r[0]: int(KM.distances(np.array([r[1:]]), got[4].centres).argmin()) for r in rows}


def test_same_on_any_partitioning(spark):
    a, b = (KM.fit(blobs(spark, parts=p)[0], "id", coords(), [3], restarts=2)[3].centres for p in (1, 7))
    assert (a == b).all()


def test_plus_plus_draws_by_distance(spark):
    """With one far row among many equal ones, the second centre is the far
    row in every restart."""
    df = spark.createDataFrame([(i, 0.0, 0.0) for i in range(200)] + [(999, 50.0, 50.0)], "id long, a double, b double")
    got = KM.fit(df, "id", coords(), [2, 5], restarts=4)
    assert got[2].centres.tolist() == [[0, 0], [50, 50]] and got[2].cost == 0
    assert got[5].centres.tolist() == [[0, 0], [50, 50]]  # no five different rows
    assert len(KM.fit(df.where("false"), "id", coords(), [2])[2].centres) == 0


def test_passes_do_not_grow_with_fits(spark):
    df, _ = blobs(spark)
    tracker = spark.sparkContext.statusTracker()
    count = []
    for restarts in (1, 6):
        spark.sparkContext.setJobGroup(f"km-{restarts}", "")
        KM.fit(df, "id", coords(), [4], restarts=restarts, rounds=2)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        count.append(len(tracker.getJobIdsForGroup(f"km-{restarts}")))
    assert count[0] == count[1]


def test_scaling_fills_with_training_medians(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 4.0), (3, float("nan"), 8.0), (4, 9.0, 6.0)], "id long, a double, b double")
    s = KM.scaling(df, ["a", "b"])
    assert s.fill == [2.0, 6.0]
    out = [tuple(r) for r in df.orderBy("id").select(*s.columns()).collect()]
    a, b = np.array([1, 2, 2, 9.0]), np.array([6, 4, 8, 6.0])
    assert np.allclose(out, np.column_stack([(a - a.mean()) / a.std(), (b - b.mean()) / b.std()]))
    raw = KM.scaling(df, ["a", "b"], scaled=False)
    assert [tuple(r) for r in df.orderBy("id").select(*raw.columns()).collect()] == list(zip(a, b))


def test_settled_fits_take_no_further_round(spark, monkeypatch):
    """The passes read blocks, and only of fits whose centres still move."""
    rows = [(i, float(i % 7) + i / 1000, float(i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double").coalesce(1)
    seen, plain = [], KM._sums

    def sums(table, centres, *rest):
        assert table.count() == 1
        seen.append(set(centres))
        return plain(table, centres, *rest)

    monkeypatch.setattr(KM, "_sums", sums)
    KM.fit(df, "id", [F.col("a"), F.col("b")], [1, 6], restarts=3)
    assert len(seen[0]) == 6 and len(seen[-1]) < 6
    assert all(b <= a for a, b in zip(seen, seen[1:]))
