"""Residual kriging by conjugate gradients.

The kriging weights solve ``(K + noise / m) w = r`` over all distinct training
places (``m`` residuals at a place count as their mean with the noise divided
by ``m``, which is the same system solved smaller); ``K`` is a Gaussian kernel
of ``length``, cut at ``reach`` lengths. Nothing is solved per cell and no
matrix is held: places stand in blocks of at most ``BLOCK`` inside cells as
wide as the reach, and a step of the solver is

* an equi-join of every block with the blocks of the nine cells around it,
* the kernel products of the two blocks in a task (``BLOCK`` squared numbers),
* the sum of a block's parts, which come to its row one after another, and its
  share of the sums that the next step needs,

written as one table; the next step takes its vectors on as it reads them.

All systems (folds, or a choice of kernels) are columns of the same vectors
and are solved in the same steps; the driver sees four sums per system and
step. A denser table has more blocks of the same size, so a task's memory does
not grow.

``length`` and ``noise`` are chosen by held-out likelihood on a draw of at
most ``SAMPLE`` places (:func:`choose`): half of them predicts the other half
with its predictive variance. Residuals are divided by their deviation first
(:func:`krige`), coordinates are scaled to 0-1 by the training box.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import drop_table, materialize
from .spatial import real

# Tasks get this module's functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 256
BLOCKS = 4
SAMPLE = 1200
REACH = 4.0
LENGTHS = (0.05, 0.1, 0.2, 0.4)
NOISES = (1e-3, 1e-1, 1.0, 10.0)


@dataclass(frozen=True)
class Kernel:
    length: float
    noise: float


def gauss(ax, ay, bx, by, length: float, reach: float) -> np.ndarray:
    d2 = (ax[:, None] - bx[None]) ** 2 + (ay[:, None] - by[None]) ** 2
    return np.where(d2 <= (reach * length) ** 2, np.exp(-d2 / (2 * length * length)), 0.0)


def choose(x: np.ndarray, y: np.ndarray, r: np.ndarray, m: np.ndarray, lengths=LENGTHS, noises=NOISES, reach: float = REACH) -> Kernel:
    """The pair with the largest likelihood of the odd places given the even
    ones (a few hundred each), the smoothest of equals."""
    if len(x) < 4:
        return Kernel(0.2, 1.0)
    a, b = slice(0, None, 2), slice(1, None, 2)
    best = None
    for length in sorted(lengths, reverse=True):
        own = gauss(x[a], y[a], x[a], y[a], length, reach)
        cross = gauss(x[b], y[b], x[a], y[a], length, reach)
        for noise in sorted(noises, reverse=True):
            try:
                low = np.linalg.cholesky(own + np.diag(noise / m[a]))
            except np.linalg.LinAlgError:
                continue  # the cut kernel is not definite here
            half = np.linalg.solve(low, np.column_stack([r[a], cross.T]))
            mean = half[:, 1:].T @ half[:, 0]
            var = np.maximum(1 + noise / m[b] - (half[:, 1:] ** 2).sum(0), 1e-12)
            like = -0.5 * (np.log(2 * math.pi * var) + (r[b] - mean) ** 2 / var).sum()
            if best is None or like > best[0] + 1e-9:
                best = (like, Kernel(length, noise))
    return best[1] if best else Kernel(0.2, 1.0)


def _vectors(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    c = b.column(b.schema.names.index(name))
    flat, off = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(off, off[1:])]


def blocks_of(places: DataFrame, cell: float, vectors: dict[str, object]) -> DataFrame:
    """Places (``_x``, ``_y``) -> (blk, cx, cy, x, y, and an array per name of
    ``vectors``), ``BLOCK`` places at most to a block. A vector of several
    systems is an array column: its arrays stand end to end."""
    cx, cy = (F.floor(F.col(c) / cell).cast("long").alias(n) for c, n in (("_x", "cx"), ("_y", "cy")))
    rows = places.select("*", cx, cy)
    # A crowded cell is dealt over blocks by a hash, whose number follows from its count.
    sizes = rows.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)).cast("int").alias("_k"))
    rows = rows.join(sizes, ["cx", "cy"]).withColumn("_h", F.xxhash64("_x", "_y"))
    rows = rows.withColumn("_part", F.pmod("_h", "_k"))
    # More than BLOCK by chance: further blocks.
    rank = F.row_number().over(Window.partitionBy("cx", "cy", "_part").orderBy("_h", "_x", "_y")) - 1
    rows = rows.withColumn("_over", F.floor(rank / BLOCK)).withColumn("blk", F.concat_ws("/", "cx", "cy", "_part", "_over"))
    item = F.struct("_x", "_y", *[F.col(c).alias(f"_v{i}") for i, c in enumerate(vectors.values())])
    got = rows.groupBy("blk", "cx", "cy").agg(F.sort_array(F.collect_list(item)).alias("_p"))
    flat = lambda i, c: F.flatten(F.col(f"_p._v{i}")) if places.schema[c].dataType.typeName() == "array" else F.col(f"_p._v{i}")
    return got.select("blk", "cx", "cy", F.col("_p._x").alias("x"), F.col("_p._y").alias("y"), *[flat(i, c).alias(n) for i, (n, c) in enumerate(vectors.items())])


def parts(target: DataFrame, source: DataFrame, v: str, kernels: list[Kernel], reach: float, out: str) -> DataFrame:
    """(blk, ``out``): for the places of ``target``'s blocks the kernel
    products with the vector ``v`` of each of ``source``'s blocks around, all
    systems end to end; a row per pair of blocks."""
    s = len(kernels)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = source.select("cx", "cy", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(v).alias("sv"), F.explode(around).alias("d"))
    near = near.select((F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), "sx", "sy", "sv")
    pairs = target.select("blk", "cx", "cy", "x", "y").join(near, ["cx", "cy"]).select("blk", "x", "y", "sx", "sy", "sv")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            got = []
            for x, y, sx, sy, sv in zip(*(_vectors(b, c) for c in ("x", "y", "sx", "sy", "sv"))):
                w = sv.reshape(len(sx), s)
                y_ = np.zeros((len(x), s))
                for length in {k.length for k in kernels}:
                    own = [i for i, k in enumerate(kernels) if k.length == length]
                    y_[:, own] = gauss(x, y, sx, sy, length, reach) @ w[:, own]
                got.append(y_.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(got, pa.list_(pa.float64()))], names=["blk", out])

    return pairs.mapInArrow(multiply, f"blk string, {out} array<double>")


def with_product(rows: DataFrame, of: DataFrame, out: str, tasks: int, then=None, shape: str = "") -> DataFrame:
    """``rows`` (one per block) with the sum ``out`` of their parts ``of``, an
    empty array where nothing reaches a block. A block's parts come to its row
    one after another, in one shuffle. ``then``: what to make of a batch."""
    names, kind = rows.columns, of.schema[out].dataType
    both = rows.withColumns({out: F.lit(None).cast(kind), "_part": F.lit(0)}).unionByName(of.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    fields = [*names, out]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = None, None
        for b in batches:
            done, sums = [], []
            sent, values = b.column(b.schema.names.index("_part")).to_numpy(), _vectors(b, out)
            for i in range(len(b)):
                if sent[i]:
                    total = values[i] if total is None else total + values[i]
                    continue
                if row is not None:
                    done.append(row)
                    sums.append(total)
                row, total = b.slice(i, 1).select(names), None
            if done:
                yield whole(done, sums)
        if row is not None:
            yield whole([row], [total])

    def whole(done: list[pa.RecordBatch], sums: list) -> pa.RecordBatch:
        got = pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        empty = np.zeros(0)
        got = pa.RecordBatch.from_arrays([*got.columns, pa.array([empty if v is None else v for v in sums], pa.list_(pa.float64()))], names=fields)
        return then(got) if then else got

    shape = shape or StructType([*rows.schema.fields, StructField(out, kind)])
    return both.repartition(tasks, "blk").sortWithinPartitions("blk", "_part").mapInArrow(add, shape)


def task_count(blocks: DataFrame) -> int:
    """Tasks to add up a product over these blocks."""
    most = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, math.ceil(blocks.count() / BLOCKS)))


def solve(places: DataFrame, kernels: list[Kernel], reach: float = REACH, tolerance: float = 1e-9, steps: int = 500) -> tuple[DataFrame, int]:
    """Weights of all systems. ``places``: ``_x``, ``_y`` in 0-1, arrays
    ``_r`` (mean residual) and ``_m`` (residuals) with an entry per system
    (0 residuals: not in that system). Returns (blk, cx, cy, x, y, w) and the
    steps taken; a system ends when its error is ``tolerance`` of its
    residuals."""
    s = len(kernels)
    cell = reach * max(k.length for k in kernels) * (1 + 1e-12)
    state = blocks_of(places, cell, {"r": "_r", "m": "_m"})
    noise = np.array([k.noise for k in kernels])

    def advance(step: np.ndarray | None, turn: np.ndarray | None):
        """Task that takes w, r, p (and q = A p) one step on, or starts."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = [v.reshape(-1, s) for v in _vectors(b, "m")]
                r = [v.reshape(-1, s) for v in _vectors(b, "r")]
                if step is None:
                    r = [np.where(mm > 0, rr, 0.0) for rr, mm in zip(r, m)]
                    w, p = [np.zeros_like(v) for v in r], r
                else:
                    w, p, q = ([v.reshape(-1, s) for v in _vectors(b, c)] for c in ("w", "p", "q"))
                    w = [a + step * c for a, c in zip(w, p)]
                    r = [a - step * c for a, c in zip(r, q)]
                    p = [a + turn * c for a, c in zip(r, p)]
                base = [b.column(b.schema.names.index(c)) for c in ("blk", "cx", "cy", "x", "y", "m")]
                yield pa.RecordBatch.from_arrays([*base, *[pa.array([v.ravel() for v in vs], pa.list_(pa.float64())) for vs in (r, w, p)]],
                                                 names=["blk", "cx", "cy", "x", "y", "m", "r", "w", "p"])

        return task

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        """q = K p + noise / m p, on the rows of each system only, and the
        block's share of the four sums."""
        qs, dots = [], []
        for kp, r, p, m in zip(*(_vectors(b, c) for c in ("kp", "r", "p", "m"))):
            r, p, m = (v.reshape(-1, s) for v in (r, p, m))
            kp = kp.reshape(-1, s) if len(kp) else np.zeros_like(p)
            q = np.where(m > 0, kp + noise / np.maximum(m, 1) * p, 0.0)
            qs.append(q.ravel())
            dots.append(np.concatenate([(r * r).sum(0), (p * q).sum(0), (r * q).sum(0), (q * q).sum(0)]))
        keep = b.select([c for c in b.schema.names if c != "kp"])
        return pa.RecordBatch.from_arrays([*keep.columns, *[pa.array(v, pa.list_(pa.float64())) for v in (qs, dots)]], names=[*keep.schema.names, "q", "dots"])

    arrays = "x array<double>, y array<double>, m array<double>, r array<double>, w array<double>, p array<double>"
    shape = f"blk string, cx long, cy long, {arrays}"
    last = materialize(state, "krige")
    tasks = task_count(last)
    now = last.mapInArrow(advance(None, None), shape)
    first, took = None, 0
    for took in range(1, steps + 1):
        # A step is one pass: the last step's numbers are taken on while it reads them.
        full = materialize(with_product(now, parts(last, now, "p", kernels, reach, "kp"), "kp", tasks, finish,
                                        f"{shape}, q array<double>, dots array<double>"), "krige")
        drop_table(last)
        last = full
        sums = full.agg(*[F.sum(F.get("dots", F.lit(i))).alias(f"d{i}") for i in range(4 * s)]).first()  # four sums per system
        rr, pq, rq, qq = np.array([v or 0.0 for v in sums], float).reshape(4, s)
        first = rr if first is None else first
        going = (rr > tolerance ** 2 * first) & (pq > 0)
        step = np.where(going, rr / np.where(pq > 0, pq, 1.0), 0.0)
        left = np.maximum(rr - 2 * step * rq + step ** 2 * qq, 0.0)
        turn = np.where(going, left / np.where(rr > 0, rr, 1.0), 0.0)
        now = full.mapInArrow(advance(step, turn), shape)
        if not (left > tolerance ** 2 * first).any() or not going.any():
            break
    now = materialize(now, "krige")
    drop_table(last)
    return now.select("blk", "cx", "cy", "x", "y", "w"), took


def krige(df: DataFrame, idc: str, x: str, y: str, resids: list[str], outs: list[str], kernels: list[Kernel] | None = None,
          reach: float = REACH, tolerance: float = 1e-9) -> tuple[DataFrame, list[Kernel], int]:
    """``df`` with, per system, the kriged residual of every row's place.
    ``resids``: a residual column per system, NULL in the rows that it must
    not see (a fold's held-out rows). Kernels are chosen on a draw where not
    given. Returns the rows, the kernels and the solver's steps. A place that
    no training place reaches gets the mean residual; a row without a place,
    and a system without residuals, get 0."""
    ok = real(x, y)
    seen = df.where(ok & (F.greatest(*[F.col(c).isNotNull().cast("int") for c in resids], F.lit(0)) == 1))
    box = seen.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
                   *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(resids)], *[F.avg(c).alias(f"a{i}") for i, c in enumerate(resids)]).first()
    if box["x0"] is None:
        return df.withColumns({c: F.lit(0.0) for c in outs}), kernels or [Kernel(0.2, 1.0)] * len(resids), 0
    scale = lambda c, a, z: ((F.col(c) - a) / (z - a if z > a else 1.0))
    unit = [box[f"s{i}"] or 1.0 for i in range(len(resids))]
    mean = [box[f"a{i}"] or 0.0 for i in range(len(resids))]
    at = df.where(ok).withColumns({"_x": scale(x, box["x0"], box["x1"]), "_y": scale(y, box["y0"], box["y1"])})
    value = lambda i, c: (F.col(c) - mean[i]) / unit[i]
    places = at.groupBy("_x", "_y").agg(
        F.array(*[F.coalesce(F.avg(value(i, c)), F.lit(0.0)) for i, c in enumerate(resids)]).alias("_r"),
        F.array(*[F.count(c).cast("double") for c in resids]).alias("_m"))
    places = materialize(places, "places")
    if kernels is None:
        draw = places.orderBy(F.xxhash64("_x", "_y"), "_x", "_y").limit(SAMPLE).collect()
        kernels = []
        for i in range(len(resids)):
            own = np.array([(p["_x"], p["_y"], p["_r"][i], p["_m"][i]) for p in draw if p["_m"][i] > 0]).reshape(-1, 4)
            kernels.append(choose(*own.T, reach=reach))
    weights, took = solve(places, kernels, reach, tolerance)
    cell = reach * max(k.length for k in kernels) * (1 + 1e-12)
    asked = materialize(blocks_of(places, cell, {"m": "_m"}), "places")
    pred = with_product(asked.select("blk", "x", "y"), parts(asked, weights, "w", kernels, reach, "v"), "v", task_count(asked))
    s = len(kernels)
    each = pred.select(F.posexplode("x").alias("_i", "_x"), "y", "v")
    each = each.select("_x", F.get("y", F.col("_i")).alias("_y"), *[(F.coalesce(F.get("v", F.col("_i") * s + i), F.lit(0.0)) * unit[i] + mean[i]).alias(c) for i, c in enumerate(outs)])
    got = at.select(F.col(idc).alias("_id"), "_x", "_y").join(each, ["_x", "_y"]).drop("_x", "_y")
    out = df.join(got, F.col(idc) == F.col("_id"), "left").drop("_id")
    return out.fillna(0.0, outs), kernels, took


def krige_rows(train: DataFrame, test: DataFrame, idc: str, x: str, y: str, resid: str, out: str = "kriged", kernel: Kernel | None = None,
               reach: float = REACH) -> DataFrame:
    """:func:`krige` for one system with its rows apart: ``test`` with the
    residual kriged from ``train``."""
    seen = train.select(F.lit(None).cast(test.schema[idc].dataType).alias(idc), x, y, F.col(resid).alias("_resid"))
    asked = test.select(idc, x, y, F.lit(None).cast("double").alias("_resid"))
    got, _, _ = krige(seen.unionByName(asked), idc, x, y, ["_resid"], ["_out"], [kernel] if kernel else None, reach)
    return test.join(got.where(F.col(idc).isNotNull()).select(F.col(idc).alias("_id"), F.col("_out").alias(out)), F.col(idc) == F.col("_id"), "left").drop("_id").fillna(0.0, [out])
