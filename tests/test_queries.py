"""Every registered query: SQL-backed ones must equal their DuckDB oracle
on sf0.001; the others must run and return rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from limnospark.plans import catalog
from limnospark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


def _canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("qid", sorted(SQL))
def test_query_matches_oracle(spark, duck, qid):
    got = QUERIES[qid](spark, SF).toPandas()
    want = duck.execute(SQL[qid]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


# Model operators are tested on small frames in test_models.py; the slower
# fits over the driver tables run with LIMNOSPARK_SLOW=1.
QUICK_MODELS = {"M2", "M4", "M7", "M17", "M19"}
SLOW = os.environ.get("LIMNOSPARK_SLOW") == "1"


@pytest.mark.parametrize("qid", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, qid):
    if qid.startswith("M") and qid not in QUICK_MODELS and not SLOW:
        pytest.skip("model fit: set LIMNOSPARK_SLOW=1")
    df = QUERIES[qid](spark, SF)
    assert df.count() >= 1


def test_linear_model_scores(spark):
    """The driver tables' prices carry no signal from the features
    (|corr| < 0.01), so fold R2 must be finite and close to 0; on a target
    that is a linear function of the features the same CV path must reach
    R2 close to 1."""
    from pyspark.sql import functions as F

    from limnospark.operators import models as M
    from limnospark.plans import models as PM

    s = QUERIES["M7"](spark, SF).where("model = 'ridge'").collect()
    assert len(s) == 5 and all(-0.1 < r["r2"] <= 1.0 for r in s)
    d = PM.dataset(spark, SF).withColumn("y2", 3 * F.col("l_quantity") + 100 * F.col("l_tax"))
    sc = M.cv_scores(d, PM.FEATS, "y2", "fold", list(range(5)), M.elastic_net(0.0, 0.0), PM.KEY).collect()
    assert all(r["r2"] > 0.99 for r in sc)


def test_entry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
