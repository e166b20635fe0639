"""Group folds and leakage checks.

K2 (size-balanced group folds, largest group to the lightest fold) is
sequential over groups, but groups of one size differ by their order only, and
the fold with total ``t`` takes its j-th group of size ``s`` when the lightest
total is ``t + j * s``. So the folds of one size's groups are the merge of one
arithmetic progression per fold: it goes round the lightest folds, and a
further fold joins the round when the others have reached it. That is at most
``k`` stretches per size, worked out on the table (size, groups), which has at
most about sqrt(2 * rows) lines. Each group finds its fold from its rank among
the groups of its size; no group leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import cumulative_counts


def size_rounds(totals: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """For ``count`` groups of ``size`` rows: (first group, folds that take
    turns from there on). ``totals`` (rows per fold) is brought up to date."""
    k = len(totals)
    by_total = sorted(range(k), key=lambda f: (totals[f], f))
    rounds, at = [], 0
    for q in range(1, k + 1):
        low = totals[by_total[q - 1]]
        turn = sorted(by_total[:q], key=lambda f: ((totals[f] - low) % size, f))
        rounds.append((at, turn))
        if q < k:
            gap = totals[by_total[q]] - low
            at += sum(max(0, -(-(gap - (totals[f] - low) % size) // size)) for f in by_total[:q])
        if at >= count:
            break
    added = [0] * k
    for (start, turn), end in zip(rounds, [r[0] for r in rounds[1:]] + [count]):
        n = min(end, count) - start
        for place, f in enumerate(turn):
            added[f] += n // len(turn) + (place < n % len(turn))
    for f in range(k):
        totals[f] += added[f] * size
    return rounds


def group_folds(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """K2: fold per row, pure by group: largest group first (equal ones by
    key), into the fold with the fewest rows (the lowest index of equals).
    Rows without a group are one group, put into the last fold."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    # Written once, in ranges of (size, group): both the groups of each size
    # and a group's place among them are read from that table.
    ranked = cumulative_counts(sizes, group, by=["_size"])
    lines = ranked.groupBy("_size").agg(F.max("_total").alias("_m")).collect()
    totals = [0] * k
    rounds = [(r["_size"], size_rounds(totals, r["_size"], r["_m"])) for r in sorted(lines, key=lambda r: -r["_size"])]
    table = df.sparkSession.createDataFrame(rounds, "_size long, _rounds array<struct<at: long, turn: array<int>>>")
    ranked = ranked.select("_size", group, (F.col("_dense") - 1).alias("_i"))
    now = F.element_at(F.filter("_rounds", lambda x: x["at"] <= F.col("_i")), -1)
    fold = ranked.join(table, "_size").withColumn("_now", now)
    place = ((F.col("_i") - F.col("_now.at")) % F.size("_now.turn") + 1).cast("int")
    fold = fold.select(group, F.element_at("_now.turn", place).alias(out))
    j = df.join(fold, group, "left")
    return j.withColumn(out, F.when(F.col(group).isNull(), F.lit(k - 1)).otherwise(F.col(out)))


def split_frames(df: DataFrame, fold: str, k: int) -> DataFrame:
    """K3: one pass over all folds: each row appears once per fold index
    with role 'train' (fold != i) or 'valid' (fold == i)."""
    ex = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return ex.withColumn("role", F.when(F.col(fold) == F.col("_i"), "valid").otherwise("train")).withColumnRenamed(
        "_i", "split"
    )


def leakage(df: DataFrame, group: str, fold: str) -> DataFrame:
    """K4: groups that appear in more than one fold."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("n_folds")).where(F.col("n_folds") > 1)


def fold_report(df: DataFrame, group: str, fold: str, lat: str, lon: str) -> DataFrame:
    """K5: per fold: rows, groups, groups shared with other folds, and the
    coordinate ranges."""
    shared = leakage(df, group, fold).select(group, F.lit(1).alias("_shared"))
    j = df.join(shared, group, "left")
    return j.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(group).alias("n_groups"),
        F.countDistinct(F.when(F.col("_shared") == 1, F.col(group))).alias("n_split_groups"),
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"),
        F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"),
    )


def random_split(df: DataFrame, key: str, train_share: float = 0.7, seed: int = 42, out: str = "is_train"):
    """Deterministic train/test split by a hash of the row id (the same
    row lands on the same side on any cluster size or re-run): the first 32
    bits of the MD5 of ``seed:id``, modulo 10,000. A NULL id is a test row."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn(out, F.coalesce(h < int(round(train_share * 10_000)), F.lit(False)))
