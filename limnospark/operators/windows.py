"""Per-station sequence windows.

All features of one station series share ONE window spec, so Spark plans a
single Exchange(hash on station) + Sort for the whole feature pack.

Skew: a single station may hold a large share of all rows. A plain
``Window.partitionBy(station)`` would put that station into one task. When
``split_rows`` is given, stations with more rows than that are cut by row position into
pieces of about ``split_rows`` rows; every piece also receives a read-only
*halo* of the ``lookback`` rows that precede it, so bounded row frames
(``rowsBetween(-w, -1)``) stay exact. Prefix quantities over an unbounded
frame (last wet row, W7) get a carry-in value from a small per-piece summary.
Stations under the threshold keep one piece and need no halo. The hot-station
check is one aggregate over the key columns; when no station is hot the plan
is exactly the plain one.

Frames are counted in observations, not days (S3), and never cross stations
(S4).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import c, seq_asc
from ..session import materialize

_POS = "_ls_pos"
_CHUNK = "_ls_chunk"
_OWN = "_ls_own"
_KEY = "_ls_key"


@dataclass
class Series:
    """A station series ready for window features.

    ``w``     - the shared window spec (station [+ piece] ordered by time)
    ``pos``   - 1-based position of the row in its station series
    ``frame`` - the DataFrame to compute features on (may include halo rows)
    """

    frame: DataFrame
    keys: list[str]
    order: list[str]
    w: object
    split: bool = False
    carries: dict[str, str] = field(default_factory=dict)

    @property
    def pos(self) -> Column:
        if self.split:
            return F.coalesce(F.col(_POS), F.row_number().over(self.w).cast("long"))
        return F.row_number().over(self.w).cast("long")

    def rows(self, lo, hi):
        return self.w.rowsBetween(lo, hi)

    def carry(self, name: str) -> Column:
        if self.split and name in self.carries:
            return F.col(self.carries[name])
        return F.lit(None).cast("long")

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop halo rows and helper columns."""
        if not self.split:
            return df
        helpers = [_POS, _CHUNK, _OWN, _KEY, *self.carries.values()]
        return df.filter(F.col(_OWN)).drop(*helpers)


def series(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lookback: int = 0,
    split_rows: int | None = None,
    carry_predicates: dict[str, Column] | None = None,
) -> Series:
    """Build the shared window spec for ``keys`` ordered by ``order``.

    The full ``order`` list must be unique within a station.
    ``lookback`` is the largest number of preceding rows any feature reads.
    ``carry_predicates`` name row predicates whose last prior position is
    needed over an unbounded frame.
    """
    carry_predicates = carry_predicates or {}
    ordering = [F.col(o) for o in order]
    if split_rows is None:
        return Series(df, keys, order, Window.partitionBy(*keys).orderBy(*ordering))

    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > split_rows)
    n_hot = hot.agg(F.sum("_n")).first()[0]
    if not n_hot:  # the usual case writes nothing
        return Series(df, keys, order, Window.partitionBy(*keys).orderBy(*ordering))
    hot = materialize(hot, "hot")

    # A struct of the keys compares NULL with NULL as equal, so the series
    # without a station is split as any other.
    key = F.struct(*[F.col(k) for k in keys])
    hot_keys = hot.select(key.alias(_KEY))
    tagged = df.withColumn(_KEY, key)
    cold = tagged.join(hot_keys, _KEY, "left_anti").withColumn(_CHUNK, F.lit(-1).cast("long"))
    h = tagged.join(hot_keys, _KEY, "left_semi")
    # Pieces are ranges of (station, order): cut by row position, so a burst is
    # cut as well, and NULL times come first as the window sorts them. Written
    # once, since all that follows must see the same pieces.
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_hot // split_rows))
    h = h.repartitionByRange(n, *keys, *ordering).withColumn(_CHUNK, F.spark_partition_id().cast("long"))
    h = materialize(h, "pieces")
    keys = [_KEY]

    # Position inside each hot piece (pieces are bounded in size).
    wp = Window.partitionBy(*keys, _CHUNK).orderBy(*ordering)
    h = h.withColumn("_rn", F.row_number().over(wp).cast("long"))

    # Small per-piece summary: row count, start position, dense index, carries.
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    summ = h.groupBy(*keys, _CHUNK).agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy(_CHUNK)
    summ = summ.withColumn(
        "_start", F.coalesce(F.sum("_cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    ).withColumn("_pidx", F.row_number().over(ws).cast("long"))
    h = h.join(summ.select(*keys, _CHUNK, "_start", "_pidx"), [*keys, _CHUNK]).withColumn(
        _POS, F.col("_start") + F.col("_rn") - 1
    )

    carry_cols = {}
    if carry_predicates:
        agg = [F.max(F.when(p, F.col(_POS))).alias(f"_m_{n}") for n, p in carry_predicates.items()]
        cs = h.groupBy(*keys, _CHUNK).agg(*agg)
        sel = [*keys, _CHUNK]
        for n in carry_predicates:
            cname = f"_carry_{n}"
            carry_cols[n] = cname
            sel.append(F.max(f"_m_{n}").over(ws.rowsBetween(Window.unboundedPreceding, -1)).alias(cname))
        carry_tab = cs.select(*sel)

    # Halo pairs: piece q needs positions [start_q - lookback, start_q - 1].
    # Find the first source piece by an as-of lookup over the summary.
    starts = summ.select(*keys, F.col("_start").alias("_at"), F.col("_pidx").alias("_src"), F.lit(0).alias("_k"),
                         F.lit(None).cast("long").alias("_q"), F.lit(None).cast("long").alias("_qpidx"),
                         F.lit(None).cast("long").alias("_lo"))
    probes = summ.filter(F.col("_pidx") > 1).select(
        *keys,
        F.greatest(F.col("_start") - lookback, F.lit(1)).alias("_at"),
        F.lit(None).cast("long").alias("_src"),
        F.lit(1).alias("_k"),
        F.col(_CHUNK).alias("_q"),
        F.col("_pidx").alias("_qpidx"),
        (F.col("_start") - lookback).alias("_lo"),
    )
    wa = Window.partitionBy(*keys).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    pairs = (
        starts.unionByName(probes)
        .withColumn("_first", F.last("_src", ignorenulls=True).over(wa))
        .filter(F.col("_k") == 1)
        .select(*keys, "_q", "_lo", F.explode(seq_asc(F.col("_first").cast("long"), (F.col("_qpidx") - 1).cast("long"))).alias("_pidx"))
    )
    halo = (
        h.join(pairs, [*keys, "_pidx"])
        .filter(F.col(_POS) >= F.col("_lo"))
        .withColumn(_CHUNK, F.col("_q"))
        .withColumn(_OWN, F.lit(False))
        .drop("_q", "_lo")
    )
    own = h.withColumn(_OWN, F.lit(True))
    drop = ["_rn", "_start", "_pidx"]
    frame = (
        own.drop(*drop)
        .unionByName(halo.drop(*drop))
        .unionByName(cold.withColumn(_OWN, F.lit(True)).withColumn(_POS, F.lit(None).cast("long")))
    )
    if carry_predicates:
        frame = frame.join(carry_tab, [*keys, _CHUNK], "left")
    w = Window.partitionBy(*keys, _CHUNK).orderBy(*ordering)
    return Series(frame, keys, order, w, split=True, carries=carry_cols)


# --------------------------------------------------------------------------
# Feature expressions over a Series
# --------------------------------------------------------------------------

def lag(s: Series, col, n: int) -> Column:
    """Value n observations back in the same station."""
    return F.lag(c(col), n).over(s.w)


def prior_sum(s: Series, col, n: int) -> Column:
    """Sum of the n strictly-prior observations (NULL when none present)."""
    return F.sum(c(col)).over(s.rows(-n, -1))


def prior_max(s: Series, col, n: int) -> Column:
    """Max of the n strictly-prior observations."""
    return F.max(c(col)).over(s.rows(-n, -1))


def _mean(col, frame, digits):
    """Window mean; with ``digits`` the inputs are known to carry at most that
    many decimals, so the sum is snapped to them first (exact, and identical
    whatever the summation order)."""
    if digits is None:
        return F.avg(c(col)).over(frame)
    return F.try_divide(F.round(F.sum(c(col)).over(frame), digits), F.count(c(col)).over(frame))


def prior_mean(s: Series, col, n: int, min_count: int = 1, digits: int | None = None) -> Column:
    """Mean of the n strictly-prior observations with at least ``min_count``
    values present (W10 baseline, W14)."""
    frame = s.rows(-n, -1)
    return F.when(F.count(c(col)).over(frame) >= min_count, _mean(col, frame, digits))


def rolling_mean(s: Series, col, n: int, digits: int | None = None) -> Column:
    """Current-inclusive mean of the last n observations."""
    return _mean(col, s.rows(-(n - 1), 0), digits)


def offset_sum(s: Series, col, shift: int, roll: int) -> Column:
    """Shift by ``shift`` observations then sum a window of ``roll``:
    rows (-(shift+roll-1), -shift)."""
    return F.sum(c(col)).over(s.rows(-(shift + roll - 1), -shift))


def dry_spell_count(s: Series, col, n: int = 14, threshold: float = 0.1) -> Column:
    """Among the n prior observations, how many are dry (NULL counts as
    dry). Reproduces the reference quirk (S5): while fewer than n prior rows
    exist, the empty slot before the first row counts as one more dry value.
    NULL when no prior value is present."""
    frame = s.rows(-n, -1)
    dry = F.sum((F.coalesce(c(col), F.lit(0.0)) <= threshold).cast("long")).over(frame)
    return F.when(F.count(c(col)).over(frame) >= 1, dry + (s.pos <= n).cast("long"))


def wet_predicate(col, threshold: float = 0.1) -> Column:
    return F.coalesce(c(col), F.lit(0.0)) > threshold


def dry_streak(s: Series, col, threshold: float = 0.1, carry: str | None = None) -> Column:
    """Number of consecutive dry observations right before the row
    (NULL counts as dry). Gaps-and-islands: position minus the last wet
    position before the row."""
    last_wet = F.max(F.when(wet_predicate(col, threshold), s.pos)).over(s.rows(Window.unboundedPreceding, -1))
    if carry is not None:
        last_wet = F.greatest(last_wet, s.carry(carry))
    return (s.pos - 1 - F.coalesce(last_wet, F.lit(0))).cast("long")


def month_index(date) -> Column:
    return F.year(c(date)) * 12 + F.month(c(date))


def monthly_lag(s: Series, col, date) -> Column:
    """Previous observation's value only when it is from the previous
    calendar month."""
    ok = (month_index(date) - F.lag(month_index(date), 1).over(s.w)) == 1
    return F.when(ok, F.lag(c(col), 1).over(s.w))


def monthly_lag_pack(s: Series, col, date, prefix: str) -> dict[str, Column]:
    """W9 (legacy): lag 1, lag 2, delta and 3-row mean/std, each only when the
    two previous observations are the two previous calendar months."""
    mi = month_index(date)
    ok1 = (mi - F.lag(mi, 1).over(s.w)) == 1
    ok2 = ok1 & ((F.lag(mi, 1).over(s.w) - F.lag(mi, 2).over(s.w)) == 1)
    l1 = F.lag(c(col), 1).over(s.w)
    l2 = F.lag(c(col), 2).over(s.w)
    frame = s.rows(-2, 0)
    return {
        f"{prefix}_lag1": F.when(ok1, l1),
        f"{prefix}_lag2": F.when(ok2, l2),
        f"{prefix}_delta1": F.when(ok1, c(col) - l1),
        f"{prefix}_roll3_mean": F.when(ok2, F.avg(c(col)).over(frame)),
        f"{prefix}_roll3_std": F.when(ok2, F.stddev_samp(c(col)).over(frame)),
    }
