"""Plan-shape guards: the properties that matter at scale."""

import re

import pytest

from limnospark.plans import catalog

SF = "/root/testdata/sf0.001"
Q = catalog.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("qid", ["J10", "J12", "J13", "G2", "J11"])
def test_spatial_joins_are_equi_joins(spark, qid):
    plan = _plan(Q[qid](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


def test_station_pack_shares_one_shuffle(spark):
    plan = _plan(Q["W_station_pack"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", plan)) == 1


def test_filters_reach_the_scan(spark):
    df = Q["P12"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan


@pytest.mark.parametrize("qid, table, most", [("D1", "orders", 3), ("T1", "lineitem", 3), ("G12", "lineitem", 3), ("E3", "lineitem", 3),
                                              ("E7", "lineitem", 3), ("B2", "lineitem", 6), ("B4", "lineitem", 6), ("B5", "lineitem", 6)])
def test_rank_queries_scan_their_table_few_times(spark, qid, table, most):
    """What the rank engine needs more than once is written once."""
    assert _plan(Q[qid](spark, SF)).count(f"{table}.parquet") <= most
