"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al. 2014): a constant number of joins per round,
logarithmically many rounds, nothing gathered per component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (u, v) -> (v, m): every kept neighbour is tied to the least
    member ``m`` of u's neighbourhood."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = pairs.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any orderable type -> (node, root): each node that has
    an edge, with the least node it can reach. Null ends and self loops are
    ignored; repeated edges count once."""
    e = edges.select("u", "v").where("u != v")
    now = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _signature(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).where("u != v").distinct()
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        then = written(small.where("u != v").distinct(), "edges")
        discard(now)
        now, was, seen = then, seen, _signature(then)
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
