"""Tree ensembles grown level by level on one table.

Every model (a target, the fold it does not see, its features) is grown in the
same passes: a level of all models' trees is one map over the table and one
grouped sum, so the number of jobs depends on rounds and depth only.

* Boosting (:func:`boost`) with squared, Poisson or logistic loss, as second
  order histogram boosting: features are cut into at most 255 bins at exact
  quantiles (a 256th holds missing values). Tasks add up rows, gradients and
  Hessians per (model, node, feature, bin); Spark sums the cells, prefix sums
  give both sides of every cut with the missing values on either side, and one
  row per node comes back. Jobs: one for the bins' table, one for the starting
  scores, ``rounds * depth`` for the levels and a table of scores every
  ``SAVE`` rounds.
* Extremely randomised trees (:func:`extra_trees`): per node and feature a
  minimum and maximum over the node's rows, one threshold drawn uniformly from
  [minimum, maximum), and a sum per drawn cut. One pass over a level sums both
  sides of its drawn cuts and takes the sides' minima and maxima, which are
  those of the next level's nodes. Jobs: one, and one per level for a group of
  ``GROUP`` trees of every model. Draws are hashes of (seed, model, tree, node,
  feature).

Sums are whole numbers: gradients and targets are rounded to ``UNIT`` steps of
a bound, so results do not depend on partitioning or the order of rows. The
bound of the squared loss is twice the target's range, of the Poisson loss
four times its largest value; a gradient beyond is cut there.

The passes read blocks (:func:`packed`): arrays of up to ``CHUNK`` rows, a
feature after the other, instead of rows. Rows find their leaf from the leaves
up, a choice between arrays of short numbers per node, in extremely randomised
trees for the ``TOP`` first levels; the values of a block are numbered in order,
so that a threshold is a number too. Rows without the model's target, or without a fold, train nothing. The driver
holds the models and one row per node (per node and feature for the draws).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import drop_table, materialize
from .ranking import cumulative_counts, quantiles

# Tasks get this module's functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MISSING = 255
UNIT = 1 << 28
SAVE = 5
GROUP = 64
CHUNK = 1 << 15
ABSENT = (1 << 16) - 1
HESSIAN = 1e-3
TOP = 5
PAIR = 2


@dataclass(frozen=True)
class Model:
    """One model to grow: index of its target, the fold it does not see (None:
    it sees all rows), indexes of its features."""

    target: int
    held: int | None
    feats: tuple[int, ...]


@dataclass
class Forest:
    """Nodes of many trees. ``feat`` -1: a leaf; else rows with ``x <= cut``
    go to ``left``, others to ``left + 1``; missing values go left where
    ``miss`` says so. ``gain``: what the split was worth, for importances."""

    feat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    miss: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def add(self, n: int) -> np.ndarray:
        """``n`` new leaves."""
        at = np.arange(len(self.feat), len(self.feat) + n)
        self.feat = np.append(self.feat, np.full(n, -1, np.int32))
        self.left = np.append(self.left, np.zeros(n, np.int32))
        self.miss = np.append(self.miss, np.zeros(n, bool))
        for name in ("cut", "value", "gain"):
            setattr(self, name, np.append(getattr(self, name), np.zeros(n)))
        return at

    def split(self, node: np.ndarray, feat: np.ndarray, cut: np.ndarray, gain: np.ndarray, miss=False) -> np.ndarray:
        """Splits leaves; the left children (each right one follows)."""
        kids = self.add(2 * len(node))[::2]
        self.feat[node], self.cut[node], self.left[node], self.gain[node], self.miss[node] = feat, cut, kids, gain, miss
        return kids

    def walk(self, x: np.ndarray, root: int, binned: bool) -> np.ndarray:
        """The leaf of each row below ``root``."""
        node = np.full(len(x), root, np.intp)
        if self.feat[root] < 0:
            return node
        flat, at = np.ascontiguousarray(x).ravel(), node.copy()
        live, base = None, np.arange(len(x)) * x.shape[1]  # None: all rows
        while len(at):
            v = flat.take(base + self.feat.take(at))
            right = ~(v <= self.cut.take(at))
            if binned:
                right = np.where(v == MISSING, ~self.miss.take(at), right)
            at = self.left.take(at) + right
            inner = self.feat.take(at) >= 0
            if inner.all():
                continue
            if live is None:
                live = np.arange(len(x))
            node[live[~inner]] = at[~inner]
            live, base, at = live[inner], base[inner], at[inner]
        return node


    def leaves(self, x: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of each row's leaf, leaves) below ``root``, from bins held
        feature by feature. From the leaves up: a comparison and a choice of
        short numbers per inner node."""
        found, todo = [], [root]
        while todo:
            a = todo.pop()
            if self.feat[a] < 0:
                found.append(a)
            else:
                todo += [self.left[a] + 1, self.left[a]]
        number = {a: i for i, a in enumerate(found)}
        kind = np.min_scalar_type(len(found)).type

        def below(a: int):
            if self.feat[a] < 0:
                return kind(number[a])
            low, high, v = below(self.left[a]), below(self.left[a] + 1), x[self.feat[a]]
            right = v > np.uint8(self.cut[a])
            if self.miss[a]:
                right &= v != MISSING
            if kind is not np.uint8:
                return np.where(right, high, low)
            chosen = np.negative(right.view(np.uint8))
            chosen &= low ^ high
            chosen ^= low
            return chosen

        return np.broadcast_to(below(root), x.shape[1:]), np.array(found)


def importance(forest: Forest, trees: int, feats: int) -> np.ndarray:
    """Shares of the splits' gains per feature."""
    inner = forest.feat >= 0
    total = np.bincount(forest.feat[inner], forest.gain[inner], minlength=feats)
    return total / total.sum() if total.sum() > 0 else total


# --------------------------------------------------------------------------
# The table
# --------------------------------------------------------------------------

def bin_edges(df: DataFrame, feats: list[str], bins: int = MISSING) -> list[np.ndarray]:
    """Per feature the upper ends of all bins but the last: midpoints where
    there are at most ``bins`` values, exact quantiles otherwise. At most
    2 * bins values a feature reach the driver."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(feats)])).alias("s"))
    long = long.select("s.f", "s.v").where(~F.isnan("v"))
    cc = cumulative_counts(long, "v", ["f"])
    step = lambda c: F.floor(c * bins / F.col("_total"))
    crosses = step(F.col("_cum")) > step(F.col("_cum") - F.col("_n"))
    got = cc.where((F.col("_dense") <= bins) | crosses).select("f", "v", "_dense", crosses.alias("c")).toPandas()
    out = []
    for i in range(len(feats)):
        mine = got[got["f"] == i].sort_values("_dense")
        v = mine["v"].to_numpy()
        if mine["_dense"].max() <= bins if len(mine) else True:
            out.append((v[1:] + v[:-1]) / 2 if len(v) else v)
        else:
            out.append(v[mine["c"].to_numpy()][:-1])
    return out


def prepare(df: DataFrame, feats: list[str], targets: list[str], fold: str | None, keep: list[str], edges: list[np.ndarray] | None = None) -> DataFrame:
    """``keep`` and ``_fold``, ``_y`` (targets), ``_x`` (features, NaN where
    missing) or, given bin edges, ``_b`` (a byte per feature); written once."""
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    x = F.array(*[num(c) for c in feats])
    f = (F.col(fold) if fold else F.lit(0)).cast("int").alias("_fold")
    rows = df.select(*keep, f, F.array(*[num(c) for c in targets]).alias("_y"), x.alias("_x"))
    if edges is not None:

        @F.arrow_udf("binary")
        def binned(x: pa.Array) -> pa.Array:
            v = matrix(x, len(edges))
            out = np.stack([np.where(np.isnan(v[:, i]), MISSING, np.searchsorted(e, v[:, i], "left")) for i, e in enumerate(edges)], axis=1)
            raw = out.astype(np.uint8).tobytes()
            return pa.array([raw[i * len(edges):(i + 1) * len(edges)] for i in range(len(x))], pa.binary())

        rows = rows.withColumn("_b", binned("_x")).drop("_x")
    return materialize(rows, "trees")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def chunks(batches: Iterator[pa.RecordBatch], width: int, n_y: int, models: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(features, targets, fold, scores) of ``CHUNK`` rows at a time; columns
    come as _b or _x, _y, _fold[, _s]."""
    for b in batches:
        for at in range(0, len(b), CHUNK):
            part = b.slice(at, CHUNK)
            first = part.column(0)
            if pa.types.is_binary(first.type):
                x = np.frombuffer(b"".join(first.to_pylist()), np.uint8).reshape(len(part), width)
            else:
                x = matrix(first, width)
            fold = part.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            yield x, matrix(part.column(1), n_y), fold, matrix(part.column(3), models) if models else None


@dataclass
class Block:
    """Up to ``CHUNK`` rows of the table, feature by feature: ``x`` bins, or
    numbers of the values in ``values`` (each feature's different values in
    order; ``ABSENT`` stands for a missing one), ``y`` target by target,
    ``fold``, ``s`` scores model by model."""

    x: np.ndarray
    values: list[np.ndarray]
    y: np.ndarray
    fold: np.ndarray
    s: np.ndarray | None


def packed(table: DataFrame, width: int, n_y: int) -> DataFrame:
    """The table of :func:`prepare` as one row per :class:`Block`, written
    once: the passes read arrays, not rows."""
    first = "_b" if "_b" in table.columns else "_x"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + len(b)
            if n >= CHUNK:
                whole = pa.Table.from_batches(held).combine_chunks()
                for at in range(0, n - n % CHUNK, CHUNK):
                    yield block(whole.slice(at, CHUNK))
                held, n = whole.slice(n - n % CHUNK).to_batches(), n % CHUNK
        if n:
            yield block(pa.Table.from_batches(held))

    def block(rows: pa.Table) -> pa.RecordBatch:
        parts = list(chunks(iter(rows.combine_chunks().to_batches()), width, n_y))
        x = np.concatenate([p[0] for p in parts]).T
        values = []
        if x.dtype != np.uint8:
            codes = np.empty(x.shape, np.uint16)
            for f, v in enumerate(x):
                own, code = np.unique(v + 0.0, return_inverse=True, equal_nan=True)
                values.append(own[~np.isnan(own)])
                codes[f] = np.where(np.isnan(v), ABSENT, code)
            x = codes
        y = np.ascontiguousarray(np.concatenate([p[1] for p in parts]).T)
        fold = np.concatenate([p[2] for p in parts]).astype(np.int32)
        cols = [np.ascontiguousarray(x).tobytes(), np.array([len(v) for v in values], np.int32).tobytes(),
                np.concatenate([*values, np.zeros(0)]).tobytes(), y.tobytes(), fold.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["x", "sizes", "vals", "y", "fold"])

    rows = table.select(first, "_y", "_fold").mapInArrow(task, "x binary, sizes binary, vals binary, y binary, fold binary")
    return materialize(rows, "blocks")


def opened(batches: Iterator[pa.RecordBatch], width: int, n_y: int, models: int = 0) -> Iterator[Block]:
    """Blocks of (x, sizes, vals, y, fold[, s])."""
    for b in batches:
        for i in range(len(b)):
            part = [c[i].as_buffer() for c in b.columns]
            fold = np.frombuffer(part[4], np.int32)
            n, sizes = len(fold), np.frombuffer(part[1], np.int32)
            x = np.frombuffer(part[0], np.uint16 if len(sizes) else np.uint8).reshape(width, n)
            yield Block(x, np.split(np.frombuffer(part[2]), np.cumsum(sizes)[:-1]), np.frombuffer(part[3]).reshape(n_y, n), fold,
                        np.frombuffer(part[5]).reshape(models, n) if models else None)


def seen(m: Model, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Rows that train the model."""
    ok = ~np.isnan(y[m.target])
    return ok if m.held is None else ok & (fold != m.held) & (fold >= 0)


def _trains(m: Model):
    y = F.col("_y")[m.target]
    ok = ~F.isnan(y)
    return ok if m.held is None else ok & (F.col("_fold") != m.held)


def _starts(table: DataFrame, models: list[Model], bounds: list[float]) -> list[tuple[int, float]]:
    """(training rows, mean target) of each model, from whole-number sums."""
    aggs = []
    for i, m in enumerate(models):
        step = F.round(F.col("_y")[m.target] / bounds[i] * UNIT).cast("long")
        aggs += [F.count_if(_trains(m)).alias(f"n{i}"), F.sum(F.when(_trains(m), step)).alias(f"s{i}")]
    row = table.agg(*aggs).first()
    return [(row[f"n{i}"], (row[f"s{i}"] or 0) / UNIT * bounds[i] / max(row[f"n{i}"], 1)) for i in range(len(models))]


def _ranges(table: DataFrame, models: list[Model]) -> list[tuple[float, float]]:
    """(least, largest) finite target of each model's rows."""
    aggs = []
    for i, m in enumerate(models):
        y = F.when(_trains(m), F.col("_y")[m.target])
        aggs += [F.min(y).alias(f"a{i}"), F.max(y).alias(f"z{i}")]
    row = table.agg(*aggs).first()
    return [(row[f"a{i}"] or 0.0, row[f"z{i}"] or 0.0) for i in range(len(models))]


# --------------------------------------------------------------------------
# Boosting
# --------------------------------------------------------------------------

#: loss -> (gradient, Hessian, start from the mean, score to prediction)
LOSSES: dict[str, tuple[Callable, Callable, Callable, Callable]] = {
    "squared": (lambda s, y: s - y, lambda s, y: np.ones(len(s)), lambda mean: mean, lambda s: s),
    "poisson": (lambda s, y: np.exp(s) - y, lambda s, y: np.exp(s), lambda mean: math.log(max(mean, 1e-12)), np.exp),
    "logistic": (lambda s, y: 1 / (1 + np.exp(-s)) - y, lambda s, y: np.maximum((e := np.exp(-np.abs(s))) / (1 + e) ** 2, 1e-16),
                 lambda mean: math.log(min(max(mean, 1e-9), 1 - 1e-9) / (1 - min(max(mean, 1e-9), 1 - 1e-9))), lambda s: 1 / (1 + np.exp(-s))),
}


@dataclass
class Boosted:
    """What :func:`boost` grew: per model its starting score and roots."""

    models: list[Model]
    forest: Forest
    start: list[float]
    roots: list[list[int]]
    loss: str
    edges: list[np.ndarray]
    width: int
    targets: int

    def scores(self, x: np.ndarray, s: np.ndarray, since: int, until: int) -> np.ndarray:
        """``s`` (model by model) and what the trees of rounds since..until
        add; ``x``: bins, feature by feature."""
        s = s.copy()
        for own, roots in zip(s, self.roots):
            for root in roots[since:until]:
                at, leaves = self.forest.leaves(x, root)
                own += self.forest.value[leaves].take(at)
        return s


def boost(table: DataFrame, models: list[Model], edges: list[np.ndarray], targets: int, loss: str = "squared", rounds: int = 40, depth: int = 4,
          rate: float = 0.1, l2: float = 0.5, min_leaf: int = 30) -> tuple[Boosted, DataFrame]:
    """Grows ``rounds`` trees of ``depth`` levels for every model on a table
    of :func:`prepare`. Returns them and the table with all rows' scores
    (``_s``, one per model)."""
    grad, hess, begin, _ = LOSSES[loss]
    ranges = _ranges(table, models)
    top = [max(abs(a), abs(z), 1e-300) for a, z in ranges]
    bound = {"squared": [2 * max(z - a, 1e-300) for a, z in ranges], "poisson": [4 * t for t in top], "logistic": [1.0] * len(models)}[loss]
    bound_h = bound if loss == "poisson" else [1.0] * len(models)
    starts = _starts(table, models, top)
    out = Boosted(models, Forest(), [begin(mean) for _, mean in starts], [[] for _ in models], loss, edges, len(edges), targets)
    n, start, limit = len(models), np.array(out.start), [math.log(b) if loss == "poisson" else np.inf for b in bound]

    def scored(blk: Block, since: int, until: int) -> np.ndarray:
        s = blk.s if since else np.repeat(start[:, None], len(blk.fold), axis=1)
        return out.scores(blk.x, s, since, until)

    def histogram(nodes: list[np.ndarray], since: int, until: int) -> Callable:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(m.feats), 3, len(own) * 256), np.int64) for own, m in zip(nodes, models)]
            for blk in opened(batches, out.width, targets, n if since else 0):
                s = scored(blk, since, until)
                for i, m in enumerate(models):
                    if not len(nodes[i]):
                        continue
                    leaf, leaves = out.forest.leaves(blk.x, out.roots[i][until])
                    place = np.searchsorted(nodes[i], leaves)
                    here = nodes[i].take(place, mode="clip") == leaves
                    ok = seen(m, blk.y, blk.fold)
                    r = np.flatnonzero(ok if here.all() else ok & here.take(leaf))
                    at, y = (place * 256).take(leaf[r]), blk.y[m.target][r]
                    sc = np.minimum(s[i][r], limit[i])
                    g = np.rint(np.clip(grad(sc, y) / bound[i], -1, 1) * UNIT)
                    h = None if loss == "squared" else np.rint(np.clip(hess(sc, y) / bound_h[i], 0, 1) * UNIT)
                    for own, f in zip(sums[i], m.feats):
                        cell, size = at + blk.x[f].take(r), own.shape[1]
                        own[0] += np.bincount(cell, minlength=size)
                        own[1] += np.bincount(cell, g, minlength=size).astype(np.int64)
                        if h is not None:
                            own[2] += np.bincount(cell, h, minlength=size).astype(np.int64)
            for i, m in enumerate(models):
                if loss == "squared":
                    sums[i][:, 2] = sums[i][:, 0] * UNIT
                for j, node in enumerate(nodes[i]):
                    own = np.ascontiguousarray(sums[i][:, :, j * 256:(j + 1) * 256])
                    if own.any():
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([int(node)]), pa.array([own.tobytes()], pa.binary())],
                                                         names=["m", "node", "sums"])

        return task

    def storing(since: int, until: int) -> Callable:
        """Task that gives the blocks with their scores after ``until`` rounds."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = [scored(blk, since, until).tobytes() for blk in opened(iter([b]), out.width, targets, n if since else 0)]
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s, pa.binary())], names=[*b.schema.names[:5], "s"])

        return task

    saved, since = packed(table, out.width, targets), 0
    for t in range(rounds):
        if t - since == SAVE:
            last, saved = saved, materialize(saved.mapInArrow(
                storing(since, t), "x binary, sizes binary, vals binary, y binary, fold binary, s binary"), "scores")
            drop_table(last)
            since = t
        for i in range(n):
            out.roots[i].append(int(out.forest.add(1)[0]))
        nodes = [np.array([out.roots[i][t]]) if starts[i][0] else np.zeros(0, np.int64) for i in range(n)]
        for _ in range(depth):
            rows = saved.mapInArrow(histogram(nodes, since, t), "m long, node long, sums binary")
            best = best_cuts(rows, models, bound, bound_h, l2, min_leaf)
            nodes = [np.zeros(0, np.int64) for _ in models]
            if not len(best):
                break
            for i in range(n):
                b = best[best["m"] == i]
                if not len(b):
                    continue
                kids = out.forest.split(b["node"].to_numpy(), b["f"].to_numpy(), b["bin"].to_numpy(), b["gain"].to_numpy(), b["miss"].to_numpy())
                out.forest.value[kids] = -rate * b["gl"].to_numpy() / (b["hl"].to_numpy() + l2)
                out.forest.value[kids + 1] = -rate * b["gr"].to_numpy() / (b["hr"].to_numpy() + l2)
                nodes[i] = np.sort(np.concatenate([kids, kids + 1]))
    drop_table(saved)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = pa.RecordBatch.from_arrays([b.column(b.schema.names.index(c)) for c in ("_b", "_y", "_fold")], names=list("byf"))
            s = [out.scores(np.ascontiguousarray(x.T), np.repeat(start[:, None], len(x), axis=1), 0, rounds).T
                 for x, *_ in chunks(iter([cols]), out.width, targets)]
            s = np.concatenate([*s, np.zeros((0, n))])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * n), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], names=[*b.schema.names, "_s"])

    return out, materialize(table.mapInArrow(final, StructType([*table.schema.fields]).add("_s", ArrayType(DoubleType()))), "scores")


def best_cuts(rows: DataFrame, models: list[Model], bound: list[float], bound_h: list[float], l2: float, min_leaf: int):
    """Tasks' sums (m, node, sums: feature x (n, g, h) x bin) -> per (m, node)
    the cut of largest gain (ties: lower feature, lower bin, missing values
    right), as a pandas frame with both sides' sums. Nodes without a cut are
    absent."""
    names = {"m": "long", "node": "long", "f": "long", "bin": "long", "miss": "boolean", "gain": "double",
             "gl": "double", "gr": "double", "hl": "double", "hr": "double"}

    def cut(m: int, node: int, total: np.ndarray) -> tuple | None:
        gone = total[:, :, MISSING]
        upto, every = np.cumsum(total[:, :, :MISSING], axis=2), total.sum(axis=2)[:, :, None]
        to = np.stack([upto, upto + gone[:, :, None]], axis=3)  # missing values right, left
        rest = every[..., None] - to
        gl, gr = to[:, 1] * (bound[m] / UNIT), rest[:, 1] * (bound[m] / UNIT)
        hl, hr = to[:, 2] * (bound_h[m] / UNIT), rest[:, 2] * (bound_h[m] / UNIT)
        ok = (to[:, 0] >= min_leaf) & (rest[:, 0] >= min_leaf) & (hl >= HESSIAN) & (hr >= HESSIAN)
        ok &= (total[:, 0, :MISSING] > 0)[..., None]
        ok[..., 1] &= (gone[:, 0] > 0)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - (gl + gr) * (gl + gr) / ((hl + hr) + l2)
        gain = np.where(ok & (gain > 1e-12), gain, -np.inf)
        best = gain.argmax()  # the first of equals
        if gain.flat[best] == -np.inf:
            return None
        f, b, miss = np.unravel_index(best, gain.shape)
        return m, node, models[m].feats[f], int(b), bool(miss), *[float(v.flat[best]) for v in (gain, gl, gr, hl, hr)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for m, node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 3, 256)
                if (m, node) in total:
                    total[m, node] += own
                else:
                    total[m, node] = own.copy()
        found = [c for (m, node), own in total.items() if (c := cut(m, node, own))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=list(names))

    got = rows.repartition("m", "node").mapInArrow(task, ", ".join(f"{c} {k}" for c, k in names.items()))
    return got.toArrow().to_pandas().sort_values(["m", "node"])


def own_prediction(scored: DataFrame, grown: Boosted, out: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``out``: the prediction of the model that does not see the
    row's fold (models: one per fold)."""
    s = F.lit(None).cast("double")
    for i, m in enumerate(grown.models):
        s = F.when(F.col("_fold") == m.held, F.col("_s")[i]).otherwise(s)
    return scored.select(*keep, predicted(s, grown.loss).alias(out))


def predicted(score, loss: str):
    """A score column on the target's scale."""
    return {"squared": score, "poisson": F.exp(score), "logistic": 1 / (1 + F.exp(-score))}[loss]


# --------------------------------------------------------------------------
# Extremely randomised trees
# --------------------------------------------------------------------------

def uniform(seed: int, *ids: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on ``seed`` and ``ids`` only (SplitMix64
    of each id in turn)."""
    def mix(z):
        z = z + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    with np.errstate(over="ignore"):
        h = mix(np.uint64(seed & 0xFFFFFFFFFFFFFFFF) + np.zeros(np.broadcast(*ids).shape, np.uint64))
        for i in ids:
            h = mix(h ^ mix(np.asarray(i).astype(np.uint64)))
    return (h >> np.uint64(11)) * 2.0 ** -53


@dataclass
class Trees:
    """What :func:`extra_trees` grew: per model the roots of its trees."""

    models: list[Model]
    forest: Forest
    roots: list[list[int]]
    width: int
    targets: int

    def predict(self, x: np.ndarray, model: int, known: dict | None = None) -> np.ndarray:
        """``known``: keeps the trees' own tables from call to call."""
        known = {} if known is None else known
        x, row, total = np.ascontiguousarray(x.T), np.arange(len(x)), np.zeros(len(x))
        for r in self.roots[model]:
            if r not in known:
                known[r] = _Grown(self.forest, r, np.zeros(0, np.intp), np.zeros(0, np.intp))
            total += known[r].value.take(known[r].leaf(x, row))
        return total / len(self.roots[model])


def extra_trees(table: DataFrame, models: list[Model], width: int, targets: int, trees: int = 100, depth: int = 10, min_leaf: int = 3,
                max_features: int | None = None, seed: int = 42) -> Trees:
    """``trees`` trees for every model on a table of :func:`prepare` (``_x``).
    A node takes its ``max_features`` (default: square root) first features,
    in a drawn order, that are not constant in it, and the best of their drawn
    cuts that leaves ``min_leaf`` rows on both sides. A missing value goes to
    the right."""
    ranges = _ranges(table, models)
    centre = [(a + z) / 2 for a, z in ranges]
    bound = [max((z - a) / 2, 1e-300) for a, z in ranges]
    out = Trees(models, Forest(), [[] for _ in models], width, targets)
    rows = packed(table, width, targets)
    whole = _whole(rows, out, centre, bound)
    for first in range(0, trees, GROUP):
        group = range(first, min(trees, first + GROUP))
        at = out.forest.add(len(models) * len(group))
        owner = np.repeat(np.arange(len(models)), len(group))
        number = np.tile(np.array(group), len(models))
        for i in range(len(models)):
            out.roots[i] += at[owner == i].tolist()
        roots = at
        path = np.ones(len(at), np.int64)  # a node's place in its tree: 1, then 2p and 2p + 1
        tree = np.arange(len(at))  # index into roots, owner and number
        frontier = at
        # Of the frontier's nodes, in its order: rows, sum of the target, ends of each feature (feature, node).
        n, g, lo, hi = (v[..., owner] for v in whole)
        for level in range(depth + 1):
            n_f = np.array([len(models[o].feats) for o in owner[tree]])
            o = owner[tree]
            scale = np.array(bound)[o] / UNIT
            mean = g.astype(np.float64) * scale / np.maximum(n, 1)
            out.forest.value[frontier] = np.where(n > 0, mean + np.array(centre)[o], 0.0)
            if level == depth:
                break
            ids = (o[:, None], number[tree][:, None], path[:, None], np.arange(max(n_f))[None])
            order = uniform(seed, *ids, np.zeros((1, 1)))
            low, high = lo[:max(n_f)].T, hi[:max(n_f)].T
            varies = (high > low) & (n >= 2 * min_leaf)[:, None]
            order = np.where(varies, order, 2.0)
            k = max_features or max(1, int(math.sqrt(min(n_f))))
            chosen = np.argsort(order, axis=1, kind="stable")[:, :k]
            ok = np.take_along_axis(order, chosen, 1) < 2.0
            cut = drawn(low, high, uniform(seed, *ids, np.ones((1, 1))))
            cut = np.where(ok, np.take_along_axis(cut, chosen, 1), np.nan)
            open_ = np.flatnonzero(ok.any(1))
            if not len(open_):
                break
            n_p, g_p, lo_p, hi_p = _parts(rows, out, roots, owner, tree[open_], frontier[open_], chosen[open_], cut[open_], centre, bound, level + 1 < depth)
            # A cut's left side: the parts that have its bit.
            k, n_o, g_o = chosen.shape[1], n[open_], g[open_]
            left = [[c for c in range(1 << PAIR) if c >> (j % PAIR) & 1] for j in range(k)]
            nl, gl = (np.stack([v[:, j // PAIR][:, left[j]].sum(1) for j in range(k)], axis=1) for v in (n_p, g_p))
            nr, gr = n_o[:, None] - nl, g_o[:, None] - gl
            fits = ok[open_] & (nl >= min_leaf) & (nr >= min_leaf)
            with np.errstate(divide="ignore", invalid="ignore"):
                gl_, gr_ = gl.astype(np.float64), gr.astype(np.float64)
                worth = np.where(fits, gl_ * gl_ / nl + gr_ * gr_ / nr - (g_o.astype(np.float64) ** 2 / np.maximum(n_o, 1))[:, None], -np.inf)
            best = worth.argmax(1)
            go = np.flatnonzero(worth[np.arange(len(open_)), best] > 0)
            best, all_ = best[go], open_[go]
            feats = np.array([models[m].feats[c] for m, c in zip(o[all_], chosen[all_, best])], np.int32)
            kids = out.forest.split(frontier[all_], feats, cut[all_, best], worth[go, best] * scale[all_] ** 2)
            frontier = np.concatenate([kids, kids + 1])
            tree, path = np.tile(tree[all_], 2), np.concatenate([2 * path[all_], 2 * path[all_] + 1])
            if not len(frontier):
                break
            n, g = (np.concatenate([v[go, best], w[go, best]]) for v, w in ((nl, nr), (gl, gr)))
            bits = (np.arange(1 << PAIR)[None] >> (best % PAIR)[:, None] & 1).astype(bool)
            lo, hi = (np.concatenate([end(np.where(side, v[:, go, best // PAIR], none), axis=2) for side in (bits, ~bits)], axis=1)
                      for v, end, none in ((lo_p, np.min, np.inf), (hi_p, np.max, -np.inf)))
    drop_table(rows)
    return out


def drawn(lo: np.ndarray, hi: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Thresholds in [lo, hi); where there is no interval, any number."""
    with np.errstate(invalid="ignore"):
        cut = lo + u * (hi - lo)
    return np.where(cut >= hi, lo, cut)


def _own(out: Trees, i: int, blk: Block, centre: list[float], bound: list[float]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(numbers of the values of the model's features, feature by feature,
    the values, rounded target) of the rows that train model ``i``."""
    m = out.models[i]
    r = np.flatnonzero(seen(m, blk.y, blk.fold))
    y, x = blk.y[m.target], blk.x
    if len(r) < len(y):
        y, x = y[r], [x[f].take(r) for f in m.feats]
    elif list(m.feats) != list(range(out.width)):
        x = x[list(m.feats)]
    return np.ascontiguousarray(x), [blk.values[f] for f in m.feats], np.rint((y - centre[i]) / bound[i] * UNIT)


def _ends(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest number of a value from each of ``first`` on, in order;
    ``ABSENT`` and -1 where there is no value."""
    least, most = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
    if most.max() == ABSENT:
        most = np.maximum.reduceat(np.where(v == ABSENT, 0, v + 1), first).astype(np.int64) - 1
    return least, most


class _Grown:
    """A tree by itself, its nodes numbered from the root, on the numbers of
    a block's values; leaves lead to themselves. ``columns``: the features
    that the rows hold (default: all), in their order."""

    def __init__(self, forest: Forest, root: int, frontier: np.ndarray, places: np.ndarray, columns: tuple[int, ...] | None = None):
        nodes, self.steps = [np.array([root])], 0
        while len(inner := nodes[-1][forest.feat[nodes[-1]] >= 0]):
            kids = forest.left[inner]
            nodes.append(np.stack([kids, kids + 1], axis=1).ravel())
            self.steps += 1
        nodes = np.concatenate(nodes)
        feat, order = forest.feat[nodes], np.argsort(nodes)
        self.places, self.inner, self.value = places, np.flatnonzero(feat >= 0), forest.value[nodes]
        self.feat, self.cut = np.maximum(feat, 0).astype(np.intp), forest.cut[nodes]
        if columns is not None:
            at = {f: i for i, f in enumerate(columns)}
            self.feat[self.inner] = [at[f] for f in self.feat[self.inner].tolist()]
            self.feat[feat < 0] = 0
        self.cut[feat < 0] = np.inf
        self.left = np.arange(len(nodes))
        self.left[self.inner] = order[np.searchsorted(nodes[order], forest.left[nodes[self.inner]])]
        # Rows that stand elsewhere: one place more.
        self.place = np.full(len(nodes), len(places))
        if len(places):
            self.place[order[np.searchsorted(nodes[order], frontier[places])]] = np.arange(len(places))

    def _top(self, right: Callable, a: int = 0, deep: int = 0):
        """Number of the node after ``TOP`` steps at most, from there up: a
        comparison and a choice of bytes per node."""
        if self.left[a] == a or deep == TOP:
            return np.uint8(a)
        kids = int(self.left[a])
        low, high = self._top(right, kids, deep + 1), self._top(right, kids + 1, deep + 1)
        chosen = np.negative(right(a).view(np.uint8))
        chosen &= low ^ high
        chosen ^= low
        return chosen

    def walk(self, x: np.ndarray, values: list[np.ndarray], row: np.ndarray) -> np.ndarray:
        if not self.steps:
            return np.full(len(row), self.place[0])
        # x <= cut, in numbers: below the first value beyond the cut.
        stop = np.full(len(self.feat), 1 << 16, np.int32)
        for f in np.unique(self.feat[self.inner]):
            own = self.inner[self.feat[self.inner] == f]
            stop[own] = np.searchsorted(values[f], self.cut[own], "right")
        at = self._top(lambda a: x[self.feat[a]] >= np.uint16(stop[a])).astype(np.intp)
        base, flat = self.feat * x.shape[1], x.ravel()
        for _ in range(self.steps - TOP):
            at = self.left.take(at) + (flat.take(base.take(at) + row) >= stop.take(at))
        return self.place.take(at)

    def bins(self, x: np.ndarray, row: np.ndarray, placed: bool = False) -> np.ndarray:
        """The leaf, or its place, of each row from bins, feature by feature."""
        if not self.steps:
            at = np.zeros(len(row), np.intp)
        else:
            at = self._top(lambda a: x[self.feat[a]] > np.uint8(self.cut[a])).astype(np.intp)
        base, flat = self.feat * x.shape[1], x.ravel()
        for _ in range(self.steps - TOP):
            at = self.left.take(at) + (flat.take(base.take(at) + row) > self.cut.take(at))
        return self.place.take(at) if placed else at

    def leaf(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The leaf of each row from the values themselves, feature by
        feature; missing ones go right."""
        if not self.steps:
            return np.zeros(len(row), np.intp)
        at = self._top(lambda a: ~(x[self.feat[a]] <= self.cut[a])).astype(np.intp)
        base, flat = self.feat * x.shape[1], x.ravel()
        for _ in range(self.steps - TOP):
            # A leaf's own cut is infinite, and a missing value stays too.
            at = self.left.take(at) + (~(flat.take(base.take(at) + row) <= self.cut.take(at)) & (self.left.take(at) != at))
        return at


def _whole(rows: DataFrame, out: Trees, centre: list[float], bound: list[float]) -> tuple[np.ndarray, ...]:
    """Per model: rows, sum of the target, and least and largest value of each
    feature (feature, model)."""
    width, models = max(len(m.feats) for m in out.models), len(out.models)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full((width, models), np.inf), np.full((width, models), -np.inf)
        n, s = np.zeros((2, models), np.int64)
        for blk in opened(batches, out.width, out.targets):
            for i in range(models):
                x, values, g = _own(out, i, blk, centre, bound)
                if not len(g):
                    continue
                n[i] += len(g)
                s[i] += int(g.sum())
                for f, v in enumerate(x):
                    (least,), (most,) = _ends(v, np.zeros(1, np.intp))
                    if least != ABSENT:
                        lo[f, i], hi[f, i] = min(lo[f, i], values[f][least]), max(hi[f, i], values[f][most])
        yield _table([np.arange(models), n, s], lo, hi)

    got = _summed(rows.mapInArrow(task, _shape(["m"], width)), ["m"], width)
    n, g = np.zeros((2, models), np.int64)
    lo, hi = np.full((width, models), np.inf), np.full((width, models), -np.inf)
    at = got["m"].to_numpy()
    n[at], g[at] = got["n"].to_numpy(), got["g"].to_numpy()
    for f in range(width):
        lo[f, at], hi[f, at] = got[f"lo{f}"].to_numpy(), got[f"hi{f}"].to_numpy()
    return n, g, lo, hi


def _shape(keys: list[str], width: int) -> str:
    return ", ".join([*[f"{c} long" for c in [*keys, "n", "g"]], *[f"{e}{f} double" for e in ("lo", "hi") for f in range(width)]])


def _table(whole: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in [*whole, *lo, *hi]], names=[str(i) for i in range(len(whole) + 2 * len(lo))])


def _summed(parts: DataFrame, keys: list[str], width: int):
    ends = [f"{e}{f}" for e in ("lo", "hi") for f in range(width)]
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("g").alias("g"), *[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in ends]).toArrow().to_pandas()


def _parts(rows: DataFrame, out: Trees, roots, owner, tree, frontier, chosen, cut, centre, bound, spread: bool):
    """The frontier's nodes divided by ``PAIR`` drawn cuts at a time: rows and
    target sums (node, pair, part) and, with ``spread``, least and largest
    value of each feature (feature, node, pair, part). A part's bits say on
    whose left it is."""
    k, parts = chosen.shape[1], 1 << PAIR
    pairs = -(-k // PAIR)
    width = max(len(m.feats) for m in out.models) if spread else 0
    shape = (len(frontier), pairs, parts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown: dict[int, list[_Grown]] = {}
        for t in np.unique(tree).tolist():
            m = int(owner[t])
            grown.setdefault(m, []).append(_Grown(out.forest, roots[t], frontier, np.flatnonzero(tree == t), out.models[m].feats))
        n, s = np.zeros((2, *shape), np.int64)
        lo, hi = np.full((width, *shape), np.inf), np.full((width, *shape), -np.inf)
        flat_lo, flat_hi = (v.reshape(width, n.size) for v in (lo, hi))
        for blk in opened(batches, out.width, out.targets):
            for i, own in grown.items():
                x, values, g = _own(out, i, blk, centre, bound)
                if not len(g):
                    continue
                row, flat = np.arange(len(g)), x.ravel()
                for one in own:
                    at, places = one.walk(x, values, row), one.places
                    for q in range(pairs):
                        part = at * parts
                        for b, j in enumerate(range(q * PAIR, min(k, (q + 1) * PAIR))):
                            feat = np.minimum(chosen[places, j], len(x) - 1)
                            stop = np.zeros(len(places) + 1, np.int32)
                            for f in np.unique(feat):
                                mine = np.flatnonzero((feat == f) & ~np.isnan(cut[places, j]))
                                stop[mine] = np.searchsorted(values[f], cut[places[mine], j], "right")
                            left = flat.take(np.append(feat * len(g), 0).take(at) + row) < stop.take(at)
                            part += left.astype(np.intp) << b
                        count = np.bincount(part, minlength=parts * (len(places) + 1))[:parts * len(places)]
                        some = np.flatnonzero(count)
                        if not len(some):
                            continue
                        # Short numbers are sorted by their digits; rows that stand elsewhere come last.
                        order = np.argsort(part.astype(np.min_scalar_type(parts * (len(places) + 1))), kind="stable")[:count.sum()]
                        first = (np.cumsum(count) - count)[some]
                        cell = (places[some // parts] * pairs + q) * parts + some % parts
                        n.ravel()[cell] += count[some]
                        s.ravel()[cell] += np.add.reduceat(g.take(order), first).astype(np.int64)
                        for f in range(len(x) if spread else 0):
                            least, most = _ends(x[f].take(order), first)
                            here, c = values[f], cell
                            if least.max(initial=0) == ABSENT:  # a part without a value
                                c, least, most = cell[least != ABSENT], least[least != ABSENT], most[least != ABSENT]
                            flat_lo[f, c] = np.minimum(flat_lo[f, c], here[least])
                            flat_hi[f, c] = np.maximum(flat_hi[f, c], here[most])
        cell = np.flatnonzero(n)
        if len(cell):
            yield _table([cell, n.ravel()[cell], s.ravel()[cell]], flat_lo[:, cell], flat_hi[:, cell])

    got = _summed(rows.mapInArrow(task, _shape(["cell"], width)), ["cell"], width)
    cell = got["cell"].to_numpy()
    n, g = np.zeros((2, *shape), np.int64)
    lo, hi = np.full((width, *shape), np.inf), np.full((width, *shape), -np.inf)
    n.ravel()[cell], g.ravel()[cell] = got["n"].to_numpy(), got["g"].to_numpy()
    for f in range(width):
        lo[f].ravel()[cell], hi[f].ravel()[cell] = got[f"lo{f}"].to_numpy(), got[f"hi{f}"].to_numpy()
    return n, g, lo, hi


def predict_trees(table: DataFrame, grown: Trees, keep: list[str], outs: dict[str, list[int]]) -> DataFrame:
    """``keep`` and, per name of ``outs``, the mean over the trees of the one
    of its models that does not see the row's fold (a model that sees all
    rows predicts all); NULL where there is none."""
    cols = table.select("_x", "_y", "_fold", *keep)
    shape = StructType([*cols.schema.fields[3:], *[StructField(c, DoubleType()) for c in outs]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Grown] = {}
        for b in batches:
            got = {c: np.full(len(b), np.nan) for c in outs}
            at = 0
            for x, _, fold, _ in chunks(iter([b]), grown.width, grown.targets):
                for c, own in outs.items():
                    for i in own:
                        m = grown.models[i]
                        r = np.flatnonzero((fold == m.held) | (m.held is None))
                        if len(r):
                            got[c][at + r] = grown.predict(x[r], i, known)
                at += len(x)
            yield pa.RecordBatch.from_arrays([*b.columns[3:], *[pa.array(v, mask=np.isnan(v)) for v in got.values()]], names=shape.names)

    return cols.mapInArrow(task, shape)


# --------------------------------------------------------------------------
# Out-of-fold predictions
# --------------------------------------------------------------------------

def boosted_oof(df: DataFrame, feats: list[str], label: str, fold: str, folds: list[int], key: list[str], out: str = "pred",
                loss: str = "squared", **how) -> DataFrame:
    """key, fold, label, ``out``: each fold predicted by the model of the
    others; all folds' models grow in the same passes."""
    edges = bin_edges(df, feats)
    table = prepare(df, feats, [label], fold, [*key, fold, label], edges)
    models = [Model(0, f, tuple(range(len(feats)))) for f in folds]
    grown, scored = boost(table, models, edges, 1, loss, **how)
    return own_prediction(scored, grown, out, [*key, fold, label])


def extra_trees_oof(df: DataFrame, feats: list[str], label: str, fold: str, folds: list[int], key: list[str], out: str = "pred", **how) -> DataFrame:
    """As :func:`boosted_oof`, by extremely randomised trees."""
    table = prepare(df, feats, [label], fold, [*key, fold, label])
    grown = extra_trees(table, [Model(0, f, tuple(range(len(feats)))) for f in folds], len(feats), 1, **how)
    return predict_trees(table, grown, [*key, fold, label], {out: list(range(len(folds)))})


def two_stage_oof(df: DataFrame, feats: list[str], label: str, fold: str, folds: list[int], key: list[str], quantile: dict[str, float],
                  winsor: tuple[float, float] = (0.01, 0.99), boosting: dict | None = None, forest: dict | None = None) -> DataFrame:
    """Key, fold, label and, per name and quantile of ``quantile``, the
    out-of-fold two-stage prediction. A label at or above the training folds'
    quantile is high; a boosted classifier gives P(high), which is a further
    feature of extremely randomised trees on the label clipped to the training
    folds' ``winsor`` quantiles; with r = max(regression, 0) the result is
    max(0.6 r + 0.4 P r, 0). The classifiers of all folds and quantiles grow
    in the same passes, and so do the regressors."""
    seen_by = F.explode(F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col(fold))).alias("_held")
    names = list(quantile)
    marks = quantiles(df.select(seen_by, F.col(label).cast("double").alias("_l")), "_l", [*quantile.values(), *winsor],
                      [*[f"q{j}" for j in range(len(names))], "lo", "hi"], by=["_held"])
    mark = {r["_held"]: r for r in marks.collect()}  # a row per fold
    y = F.col(label).cast("double")
    none = {f"q{j}": None for j in range(len(names))} | {"lo": None, "hi": None}
    at = lambda f, c: F.lit((mark[f] if f in mark else none)[c])
    highs = {f"_hi{j}_{f}": (y >= at(f, f"q{j}")).cast("double") for j in range(len(names)) for f in folds}
    clipped = {f"_w{f}": F.least(F.greatest(y, at(f, "lo")), at(f, "hi")) for f in folds}
    edges = bin_edges(df, feats)
    table = prepare(df.withColumns({**highs, **clipped}), feats, list(highs), fold, [*key, fold, label, *feats, *clipped], edges)
    own = tuple(range(len(feats)))
    first = [Model(j * len(folds) + i, f, own) for j in range(len(names)) for i, f in enumerate(folds)]
    _, scored = boost(table, first, edges, len(highs), "logistic", **(boosting or {}))
    p = {f"_p{i}": predicted(F.col("_s")[i], "logistic") for i in range(len(first))}
    second = prepare(scored.withColumns(p), [*feats, *p], list(clipped), fold, [*key, fold, label, *p])
    models = [Model(i % len(folds), m.held, (*own, len(feats) + i)) for i, m in enumerate(first)]
    grown = extra_trees(second, models, len(feats) + len(p), len(clipped), **(forest or {}))
    per = {c: [j * len(folds) + i for i in range(len(folds))] for j, c in enumerate(names)}
    pred = predict_trees(second, grown, [*key, fold, label, *p], per)
    outs = []
    for c, own in per.items():
        high = F.lit(None).cast("double")
        for i in own:
            high = F.when(F.col(fold) == first[i].held, F.col(f"_p{i}")).otherwise(high)
        r = F.greatest(F.col(c), F.lit(0.0))
        outs.append(F.greatest(0.6 * r + 0.4 * high * r, F.lit(0.0)).alias(c))
    return pred.select(*key, fold, label, *outs)
