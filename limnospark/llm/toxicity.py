"""Toxicity score: a linear classifier over character n-grams whose features
are scaled by naive Bayes log-count ratios (op 7; Wang & Manning 2012).

1. Labelled rows, at most ``MAX_ROWS`` of either label, the smallest hashes
   of the key first (the stated bound), are taken out of the table by a
   broadcast of their keys: no text of other rows is shuffled.
2. Counts. A document's features are the hashed character n-grams it holds,
   once each. Each task sums two vectors (documents of either label holding a
   feature) and the vectors are added by slices, so what is gathered has the
   fixed size ``2 * 2**bits`` whatever the input.
3. Ratios. ``r = log((p + s*P/N)/P) - log((q + s*Q/N)/Q)``; the smoothing is
   shared in proportion to the classes, so an unseen feature has r = 0.
   Features whose ratio is not significant (``|r|`` below ``MIN_Z`` standard
   errors) carry nothing and are dropped; of the others the ``MAX_FEATURES``
   most significant are used, which bounds the model.
4. Weights. Logistic regression over ``r`` of the features present, on the
   first ``FIT_ROWS`` of these rows of either label, each class weighted back
   to its share.
5. Scoring of every whole text is one pass over the table without a shuffle.

Defined cases: null or empty texts hold no feature and get the score of the
intercept; rows without a key are scored, never learnt from; label rows with a
null or with contradictory values for one key are left out; repeated keys are
scored row by row; without labelled rows of both classes every score is the
share of label 1 (0.0 without any). An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, free_name, ship, text_of, written

ship(__name__)

BITS = 20
ORDERS = (4, 5, 6)
SMOOTH = 1.0
MIN_Z = 4.0
MAX_FEATURES = 1 << 14
MAX_ROWS = 20_000
FIT_ROWS = 5_000
PARTS = 16
SLICES = 64
#: Non-zeros handled at once in a fit, which bounds the driver's memory.
CHUNK = 1 << 19
_SPACE = re.compile(r"\s+")


class Grams:
    """Distinct hashed n-grams of a text; keeps its scratch table."""

    def __init__(self, bits: int, orders: tuple[int, ...]):
        self.bits, self.orders = bits, orders
        self.place = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        plain = " " + _SPACE.sub(" ", text.lower()).strip() + " "
        codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        found, h = [], codes
        for n in range(2, max(self.orders) + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1:]
            if n in self.orders:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append((mixed >> np.uint64(64 - self.bits)).astype(np.int64))
        if not found:
            return np.empty(0, np.int64)
        every = np.concatenate(found)
        number = np.arange(len(every), dtype=np.int32)
        self.place[every] = number  # the last writer of a cell stands for all equal ones
        return every[self.place[every] == number]


def _texts(column: pa.Array) -> Iterator[str]:
    for t in column:
        yield t.as_py()


def class_counts(rows: DataFrame, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """rows (text, y) -> documents per feature of either class, class sizes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums, sizes = Grams(bits, orders), np.zeros((2, 1 << bits), np.int32), [0, 0]
        for b in batches:
            for t, y in zip(_texts(b.column(0)), b.column(1).to_pylist()):
                sums[y][grams(t)] += 1
                sizes[y] += 1
        if any(sizes):
            step = (1 << bits) // SLICES
            parts = [sums[:, k * step:(k + 1) * step] for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()),
                 pa.array([sizes[0]] * SLICES, pa.int64()), pa.array([sizes[1]] * SLICES, pa.int64())],
                names=["slice", "sums", "n0", "n1"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for b in batches:
            for k, v, n0, n1 in zip(*(c.to_pylist() for c in b.columns)):
                have = totals.setdefault(k, [np.zeros(len(v) // 4, np.int64), 0, 0])
                have[0] += np.frombuffer(v, np.int32)
                have[1] += n0
                have[2] += n1
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(totals, pa.int32()), pa.array([v[0].tobytes() for v in totals.values()], pa.binary()),
                 pa.array([v[1] for v in totals.values()], pa.int64()), pa.array([v[2] for v in totals.values()], pa.int64())],
                names=["slice", "sums", "n0", "n1"],
            )

    shape = "slice int, sums binary, n0 long, n1 long"
    parts = rows.mapInArrow(count, shape).repartition(SLICES, "slice").mapInArrow(add, shape).collect()
    sums = np.zeros((2, 1 << bits), np.int64)
    step = (1 << bits) // SLICES
    for r in parts:
        sums[:, r["slice"] * step:(r["slice"] + 1) * step] = np.frombuffer(r["sums"], np.int64).reshape(2, step)
    n0, n1 = (parts[0]["n0"], parts[0]["n1"]) if parts else (0, 0)
    return sums[1], sums[0], n1, n0


def log_ratio(p, q, n_p, n_q, smooth: float = SMOOTH):
    n_p, n_q = np.maximum(n_p, 1), np.maximum(n_q, 1)
    share = n_p / (n_p + n_q)
    return np.log((p + smooth * share) / n_p) - np.log((q + smooth * (1 - share)) / n_q)


def fit_weights(rows: np.ndarray, feats: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray,
                dims: int, steps: int = 120, rate: float = 0.02, ridge: float = 2e-5, start: float = 0.1) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the weighted logistic loss; row, feature and value
    of every non-zero. The penalty draws weights to ``start`` (plain naive
    Bayes scaled), as rare features say little by themselves."""
    v, b = np.full(dims, start), float(np.log(weight[y == 1].sum() / weight[y == 0].sum()))
    parts = [slice(at, at + CHUNK) for at in range(0, len(rows), CHUNK)]
    m, s, mb, sb, total = np.zeros(dims), np.zeros(dims), 0.0, 0.0, weight.sum()
    for t in range(1, steps + 1):
        z = np.full(len(y), b)
        for c in parts:
            z += np.bincount(rows[c], v[feats[c]] * x[c], minlength=len(y))
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        g = ridge * (v - start)
        for c in parts:
            g += np.bincount(feats[c], gap[rows[c]] * x[c], minlength=dims)
        gb = gap.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        v -= rate * (m / fix) / (np.sqrt(s / fix2) + 1e-8)
        b -= 5 * rate * (mb / fix) / (np.sqrt(sb / fix2) + 1e-8)
    return v, b


class Model:
    """Weights per hashed feature and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float, bits: int, orders: tuple[int, ...]):
        self.weights, self.intercept, self.bits, self.orders = weights.astype(np.float32), float(intercept), bits, orders


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          bits: int = BITS, orders: tuple[int, ...] = ORDERS, max_rows: int = MAX_ROWS, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` that ``labels`` names."""
    told = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k"))
    told = told.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_y")).where("y = _y").drop("_y")
    ids = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    told = written(told.join(ids, "k").withColumn("h", F.xxhash64("k")), "labelled")
    sizes = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = (sizes.get(1, 0), sizes.get(0, 0))
    dims = 1 << bits
    if not all(total):
        share = total[0] / max(1, sum(total))
        return Model(np.zeros(dims), np.log(max(share, 1e-9) / max(1 - share, 1e-9)), bits, orders)
    first = told.where("y = 1").orderBy("h", "k").limit(max_rows).unionByName(told.where("y = 0").orderBy("h", "k").limit(max_rows))
    body = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), text_of(text).alias("t"))
    drawn = written(body.join(F.broadcast(first), "k").repartition(PARTS, F.xxhash64("k", "t")), "drawn")  # 2 * max_rows keys
    p, q, n_p, n_q = class_counts(drawn.select("t", "y"), bits, orders)
    ratio = log_ratio(p, q, n_p, n_q)
    z = np.abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (q + 1))
    use = np.zeros(dims, bool)
    best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    use[best[z[best] >= MIN_Z]] = True

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(bits, orders)
        for b in batches:
            feats = [f[use[f]].astype(np.int32) for f in map(grams, _texts(b.column(0)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.tobytes() for f in feats], pa.binary()), b.column(1)], names=["f", "y"])

    few = drawn.where("y = 1").orderBy("h", "k").limit(fit_rows).unionByName(drawn.where("y = 0").orderBy("h", "k").limit(fit_rows))
    got = few.select("t", "y").mapInArrow(sparse, "f binary, y int").toArrow()
    feats = [np.frombuffer(f, np.int32) for f in got.column("f").to_pylist()]
    y = np.array(got.column("y").to_pylist(), np.int64)
    rows = np.repeat(np.arange(len(y), dtype=np.int32), [len(f) for f in feats])
    flat = np.concatenate(feats)
    del got, feats, p, q, z
    x = ratio.astype(np.float32)[flat]
    weight = np.where(y == 1, total[0] / (y == 1).sum(), total[1] / (y == 0).sum())
    kept = np.flatnonzero(use)
    place = np.zeros(dims, np.int32)
    place[kept] = np.arange(len(kept))
    flat = place[flat]
    v, b = fit_weights(rows, flat, x, y, weight, len(kept))
    weights = np.zeros(dims)
    weights[kept] = v * ratio[kept]
    return Model(weights, b, bits, orders)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1."""
    weights, intercept, bits, orders = model.weights, model.intercept, model.bits, model.orders

    @F.arrow_udf("double")
    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams(bits, orders)
        for part in texts:
            z = np.array([weights[grams(t)].sum(dtype=np.float64) for t in _texts(part)], np.float64) + intercept
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return docs.withColumn(name, rate(text_of(text)))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 4, hold: int = 2,
             threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt from rows whose
    fold is not ``hold``."""
    model = train(docs.where(fold_of(F.col(key), folds) != hold), labels, key, text)
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"))
    return score(slim, model, "_t").select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == hold, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 4, hold: int = 2,
          threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged."""
    model = train(docs.where(fold_of(F.col(key), folds) != hold), labels, key, text)
    name = free_name(docs, "_toxicity")
    return score(docs, model, text, name).where(F.col(name) < threshold).drop(name)
