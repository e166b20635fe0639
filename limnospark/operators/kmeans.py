"""Many k-means fits on one table.

A fit is a value of k and a restart; all fits are rows of one table of centres
and take every pass together, so the passes depend on the largest k and the
slowest fit only, not on their number:

* starting centres by k-means++: the next centre is the row with the least
  ``-ln(u) / d2`` (u: a hash of seed, restart and row; d2: squared distance to
  the fit's centres so far), which draws rows in proportion to d2. One pass
  per centre, for all fits;
* Lloyd rounds: a task adds up rows and coordinates per (fit, centre), Spark
  sums them, the driver holds fits x k centres. A centre without rows stays.
  A fit whose centres stay takes no further round. Rounds end when no centre
  of any fit moves, or after ``rounds``;
* the restart of least cost is kept, its centres in the order of their
  coordinates, so labels are stable.

Coordinates are rounded to 2**-28 of their range, and sums are whole numbers:
results do not depend on partitioning. Rows with a missing coordinate are
filled with the training median, as :func:`prepare` does it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, materialize
from .ranking import cumulative_counts, quantiles
from .trees import matrix, uniform

# Tasks get this module's functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = 1 << 28


@dataclass
class Fit:
    """Centres on the table's own scale, cost, rounds taken."""

    k: int
    centres: np.ndarray
    cost: float
    rounds: int


@dataclass
class Scale:
    """Medians that stand in for missing values, centre and unit per column."""

    cols: list[str]
    fill: list[float]
    middle: np.ndarray
    unit: np.ndarray

    def columns(self) -> list[Column]:
        """The filled and scaled coordinates."""
        return [((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(f)) - float(m)) / float(u)).alias(c)
                for c, f, m, u in zip(self.cols, self.fill, self.middle, self.unit)]


def scaling(train: DataFrame, cols: list[str], scaled: bool = True) -> Scale:
    """Medians (exact) and, with ``scaled``, means and population deviations
    of the training rows; all columns in one counting pass."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("s"))
    got = {r["f"]: r["m"] for r in quantiles(None, "v", [0.5], ["m"], cc=cumulative_counts(long.select("s.f", "s.v").where(~F.isnan("v")), "v", ["f"]), by=["f"]).collect()}
    fill = [float(got.get(i, 0.0)) for i in range(len(cols))]
    full = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(f)) for c, f in zip(cols, fill)]
    row = train.agg(*[F.avg(v).alias(f"a{i}") for i, v in enumerate(full)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(full)]).first()
    d = range(len(cols))
    middle = np.array([row[f"a{i}"] or 0.0 for i in d]) if scaled else np.zeros(len(cols))
    unit = np.array([row[f"s{i}"] or 1.0 for i in d]) if scaled else np.ones(len(cols))
    return Scale(cols, fill, middle, unit)


def _packed(rows: DataFrame, d: int) -> DataFrame:
    """Rows (_id, _x) as blocks of up to 8192, written once: the passes read
    arrays, a coordinate after the other."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 8192):
                part = b.slice(at, 8192)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.ascontiguousarray(matrix(part.column(1), d).T)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids, x)], names=["ids", "x"])

    return materialize(rows.mapInArrow(task, "ids binary, x binary"), "kmeans")


def _rows(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for ids, x in zip(b.column(0), b.column(1)):
            yield np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(x.as_buffer()).reshape(d, -1).T


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, by differences (no cancellation)."""
    out = np.zeros((len(x), len(centres)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - centres[None, :, i]) ** 2
    return out


def fit(train: DataFrame, key: str, cols: list[Column], ks: list[int], restarts: int = 10, seed: int = 42, rounds: int = 100) -> dict[int, Fit]:
    """k -> the best of ``restarts`` fits on the coordinates ``cols`` of the
    rows (unique ``key``). Fewer different rows than k give fewer centres."""
    d = len(cols)
    rows = train.select(F.col(key).cast("long").alias("_id"), F.array(*cols).alias("_x"))
    plain = materialize(rows.where(F.col("_id").isNotNull()), "kmeans")
    ends = plain.agg(*[f(F.col("_x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("a", F.min), ("z", F.max))]).first()
    if ends["a0"] is None:
        return {k: Fit(k, np.zeros((0, d)), 0.0, 0) for k in ks}
    low = np.array([ends[f"a{i}"] for i in range(d)])
    step = np.array([max(ends[f"z{i}"] - ends[f"a{i}"], 1e-300) for i in range(d)]) / UNIT
    fits = [(k, r) for k in ks for r in range(restarts)]
    rows = _packed(plain, d)
    drop_table(plain)
    centres = _plus_plus(rows, fits, d, low, step, seed)
    took, open_ = 0, list(range(len(fits)))
    for took in range(1, rounds + 1):
        # A fit whose centres stay takes no further round.
        sums = _sums(rows, {i: centres[i] for i in open_}, d, low, step)
        moved = []
        for i in open_:
            own = centres[i]
            new = own.copy()
            for e, n, s in sums.get(i, []):
                new[e] = low + np.array([int(v) / n for v in s]) * step
            if (new != own).any():
                moved.append(i)
            centres[i] = new
        open_ = moved
        if not open_:
            break
    cost = _costs(rows, centres, d)
    drop_table(rows)
    out = {}
    for k in ks:
        best = min((cost[i], r, i) for i, (kk, r) in enumerate(fits) if kk == k)[2]
        own = centres[best]
        out[k] = Fit(k, own[np.lexsort(own.T[::-1])], cost[best], took)
    return out


def _plus_plus(rows: DataFrame, fits: list[tuple[int, int]], d: int, low, step, seed: int) -> list[np.ndarray]:
    centres = [np.zeros((0, d)) for _ in fits]
    for j in range(max(k for k, _ in fits)):
        open_ = [i for i, (k, _) in enumerate(fits) if j < k and len(centres[i]) == j]
        # Restarts of one number share their draws, whatever the k: each (restart, prefix) is drawn once.
        lead = {}
        for i in open_:
            lead.setdefault(fits[i][1], i)
        if not lead:
            break

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {r: (np.inf, None, None) for r in lead}
            for ids, x in _rows(batches, d):
                for r, i in lead.items():
                    w = distances(x, centres[i]).min(1) if j else np.ones(len(x))
                    u = np.maximum(uniform(seed, np.array([r]), np.array([j]), ids), 2.0 ** -60)
                    with np.errstate(divide="ignore"):
                        race = np.where(w > 0, -np.log(u) / np.where(w > 0, w, 1.0), np.inf)
                    at = np.lexsort((ids, race))[0]
                    if (race[at], ids[at]) < (best[r][0], np.inf if best[r][1] is None else best[r][1]) and race[at] < np.inf:
                        best[r] = (race[at], ids[at], x[at])
            found = [(r, float(t), int(i), v.tolist()) for r, (t, i, v) in best.items() if i is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["r", "t", "id", "x"])

        got = rows.mapInArrow(draw, "r long, t double, id long, x array<double>")
        for row in got.groupBy("r").agg(F.min(F.struct("t", "id", "x")).alias("b")).collect():
            for i in open_:
                if fits[i][1] == row["r"]:
                    centres[i] = np.vstack([centres[i], row["b"]["x"]])
    return centres


def _sums(rows: DataFrame, centres: dict[int, np.ndarray], d: int, low, step) -> dict[int, list]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {i: np.zeros(len(c), np.int64) for i, c in centres.items()}
        s = {i: np.zeros((len(c), d), np.int64) for i, c in centres.items()}
        for _, x in _rows(batches, d):
            w = np.rint((x - low) / step)
            for i, c in centres.items():
                own = distances(x, c).argmin(1)
                n[i] += np.bincount(own, minlength=len(c))
                for k in range(d):
                    s[i][:, k] += np.bincount(own, w[:, k], minlength=len(c)).astype(np.int64)
        out = [(i, int(e), int(n[i][e]), s[i][e].tolist()) for i in centres for e in np.flatnonzero(n[i])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["fit", "e", "n", "s"])

    got = rows.mapInArrow(task, "fit long, e long, n long, s array<long>")
    total = got.groupBy("fit", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(d)])
    out: dict[int, list] = {}
    for r in total.collect():  # fits x k rows
        out.setdefault(r["fit"], []).append((r["e"], r["n"], [r[f"s{k}"] for k in range(d)]))
    return out


def _costs(rows: DataFrame, centres: list[np.ndarray], d: int) -> list[float]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = np.zeros(len(centres))
        for _, x in _rows(batches, d):
            cost += [distances(x, c).min(1).sum() for c in centres]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(cost)], names=["fit", "c"])

    got = {r["fit"]: r["c"] for r in rows.mapInArrow(task, "fit long, c double").groupBy("fit").agg(F.sum("c").alias("c")).collect()}
    return [got.get(i, 0.0) for i in range(len(centres))]


def assign(cols: list[Column], centres: np.ndarray) -> Column:
    """Number of the nearest centre (the first of equals)."""
    x = F.array(*cols)
    best = [F.struct(sum(((x[i] - float(v)) * (x[i] - float(v)) for i, v in enumerate(c)), F.lit(0.0)).alias("d"), F.lit(e).alias("e")) for e, c in enumerate(centres)]
    return F.array_min(F.array(*best))["e"] if best else F.lit(None).cast("int")
