"""Mixing sources to target weights by hierarchical budgeting (op 5).

Documents hang on a tree domain -> language -> source. A total of tokens is
divided from the root down: children share their parent's budget in
proportion to their weights, and no child gets more than its subtree can give
(its tokens times the epochs allowed). What a child cannot take goes to its
siblings, by the same weights; only when all of them are full does the
shortage show in their parent's capacity and so reach the parent's siblings.
Sorting siblings by capacity per weight gives this division in closed form:
the full ones are a prefix of that order.

A leaf with budget ``b`` and ``t`` tokens is taken ``b div t`` times whole,
then once more as a token-prefix: documents in the order of a seeded hash of
(epoch, key, text), as long as the running total stays within the rest. The
prefix's end is found from sums per hash range, so only one range of a leaf is
ever put in order, whatever the leaf's size. Selection is then a comparison
of hashes; texts are not shuffled.

Defined cases: null domain, language or source form a leaf of their own
("(none)"); a null text has no tokens; equal rows share their hash and go in
or out together; leaves without tokens get nothing; weights not named are 1,
a weight of 0 takes nothing; a total above the capacity takes all there is;
an empty table gives an empty table. Helper columns are prefixed ``_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import text_of, written

LEVELS = ["_mix_domain", "_mix_lang", "_mix_source"]
#: Hash ranges per leaf: 2 ** RANGE_BITS.
RANGE_BITS = 12


def tokens_of(text: str = "text") -> Column:
    """Words parted by white space."""
    return F.regexp_count(text_of(text), F.lit(r"\S+")).cast("long")


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("(none)"))


def _weight(path: list[Column], weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    return F.coalesce(F.element_at(table, F.concat_ws("/", *path)), F.lit(1.0))


def divide(children: DataFrame, parent: list[str], budget: str = "budget", cap: str = "cap", weight: str = "w") -> DataFrame:
    """children with their parent's ``budget``: replaced by each child's own."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    usable = F.col(weight) > 0
    ratio = F.when(usable, F.try_divide(cap, weight)).otherwise(F.lit(float("inf")))
    order = by.orderBy("_ratio", *[c for c in LEVELS if c in children.columns])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    w, c = F.when(usable, F.col(weight)).otherwise(0.0), F.when(usable, F.col(cap)).otherwise(0.0)
    d = children.withColumn("_ratio", ratio)
    d = d.withColumn("_cap_before", F.coalesce(F.sum(c).over(before), F.lit(0.0)))
    d = d.withColumn("_w_left", F.sum(w).over(by) - F.coalesce(F.sum(w).over(before), F.lit(0.0)))
    # Weight left may be a rounding error below the child's own weight.
    d = d.withColumn("_fill", F.try_divide(F.col(budget) - F.col("_cap_before"), F.greatest(F.col("_w_left"), w)))
    d = d.withColumn("_full", usable & (F.col("_ratio") <= F.col("_fill")))
    # All children that are not full share one level: that of the first of them, the highest.
    d = d.withColumn("_level", F.max(F.when(~F.col("_full") & usable, F.col("_fill"))).over(by))
    own = F.when(~usable, 0.0).when(F.col("_full"), F.col(cap)).otherwise(F.least(F.col(cap), F.col(weight) * F.greatest(F.col("_level"), F.lit(0.0))))
    return d.withColumn(budget, own).drop("_ratio", "_cap_before", "_w_left", "_fill", "_full", "_level")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, float], epochs: int) -> DataFrame:
    """leaves (levels, tokens) -> the leaf's token budget. ``total`` is an
    expression over ``all_tokens``."""
    cap = F.col("tokens").cast("double") * epochs
    paths = [[F.col(c) for c in LEVELS[: k + 1]] for k in range(3)]
    leaf = leaves.withColumn("cap", cap)
    root = leaf.agg(F.sum("cap").alias("root_cap"), F.sum("tokens").alias("all_tokens"))
    top = root.select(F.least(F.col("root_cap"), total.cast("double")).alias("budget"))
    nodes = top
    for k in range(3):
        level = leaf.groupBy(*LEVELS[: k + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        level = level.withColumn("w", _weight(paths[k], weights))
        joined = level.join(nodes, LEVELS[:k]) if k else level.crossJoin(F.broadcast(nodes))  # one row
        out = divide(joined, LEVELS[:k])
        nodes = out.select(*LEVELS[: k + 1], "budget", *(["tokens", "cap"] if k == 2 else []))
    return nodes


def _order(seed: int, epoch: Column, key: str, text: str) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("long"), F.col(key), F.crc32(text_of(text).cast("binary")))


def plan(docs: DataFrame, domain: Column, share: float, weights: dict[str, float], epochs: int, seed: int,
         key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per leaf: budget, whole epochs, and the hash up to which the last
    epoch's documents are taken. ``share``: total as a share of all tokens."""
    slim = written(docs.select(
        _named(domain).alias(LEVELS[0]), _named(F.col(lang)).alias(LEVELS[1]), _named(F.col(source)).alias(LEVELS[2]),
        tokens_of(text).alias("tokens"), F.col(key).alias("_key"), F.crc32(text_of(text).cast("binary")).alias("_crc"),
    ), "mix-slim")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, F.col("all_tokens") * share, weights, epochs).withColumn("budget", F.floor("budget"))
    whole = F.when(F.col("tokens") > 0, F.least(F.expr("budget div tokens"), F.lit(epochs).cast("long"))).otherwise(0)
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = written(plan, "mix-plan")
    o = F.xxhash64(F.lit(seed), F.col("whole") + 1, F.col("_key"), F.col("_crc"))
    rows = slim.withColumnRenamed("tokens", "n").join(plan.drop("tokens"), LEVELS)
    rows = rows.where("rest > 0").select(*LEVELS, "n", "rest", o.alias("o")).withColumn("range", F.shiftright("o", 64 - RANGE_BITS))
    sums = rows.groupBy(*LEVELS, "range").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"), F.max("o").alias("top"))
    to_here = W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("to", F.sum("n").over(to_here))
    cut = sums.where("to > rest").groupBy(*LEVELS).agg(F.min("range").alias("range"))
    inside = sums.where("to <= rest").groupBy(*LEVELS).agg(F.max("to").alias("before"), F.max("top").alias("top"))
    # Equal hashes count together (a RANGE frame), so they go in or out together.
    running = W.partitionBy(*LEVELS).orderBy("o").rangeBetween(W.unboundedPreceding, 0)
    edge = rows.join(cut, [*LEVELS, "range"]).withColumn("to", F.sum("n").over(running))
    edge = edge.join(inside.select(*LEVELS, "before"), LEVELS, "left").where(F.col("to") + F.coalesce("before", F.lit(0)) <= F.col("rest"))
    edge = edge.groupBy(*LEVELS).agg(F.max("o").alias("edge"))
    out = plan.join(inside.select(*LEVELS, "top"), LEVELS, "left").join(edge, LEVELS, "left")
    # The leaves' table is written: the size Spark sees decides whether it is broadcast.
    return written(out.select(*LEVELS, "budget", F.col("tokens").alias("leaf_tokens"), "whole", F.greatest("edge", "top").alias("cut")), "mix-cut")


def mix(docs: DataFrame, domain: Column, share: float, weights: dict[str, float], epochs: int = 1, seed: int = 5,
        key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The chosen rows of ``docs``, once per epoch they are taken in, with
    ``_mix_*`` columns: the leaf, its budget, tokens, and the epoch."""
    cuts = plan(docs, domain, share, weights, epochs, seed, key, text, lang, source)
    tagged = docs.select(
        "*", _named(domain).alias(LEVELS[0]), _named(F.col(lang)).alias(LEVELS[1]), _named(F.col(source)).alias(LEVELS[2]))
    cuts = cuts.select(*[F.col(c).alias(f"{c}_") for c in LEVELS], F.col("budget").alias("_mix_budget"),
                       F.col("whole").alias("_mix_whole"), F.col("cut").alias("_mix_cut"))
    rows = tagged.join(cuts, [F.col(c) == F.col(f"{c}_") for c in LEVELS])
    last = (_order(seed, F.col("_mix_whole") + 1, key, text) <= F.col("_mix_cut")).cast("long")
    taken = F.col("_mix_whole") + F.coalesce(last, F.lit(0))
    rows = rows.withColumn("_mix_taken", taken.cast("int")).where("_mix_taken > 0")
    return rows.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(1), F.col("_mix_taken")))).drop(
        *[f"{c}_" for c in LEVELS], "_mix_whole", "_mix_cut", "_mix_taken")
