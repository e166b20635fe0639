"""Quality score by Bradley-Terry pairwise ranking (op 8).

Each document gets a fixed vector of shape features (byte classes, word and
line statistics); a preference pair is one document of label 1 and one of
label 0, the first preferred. ``P(a over b) = sigmoid(w . (f(a) - f(b)))`` is
fitted by logistic loss over the feature differences. The score ``w . f`` is
cut at the quantile that leaves the training share of label 0 below it, and
mapped to 0..1 so that the cut falls on the threshold.

Texts are read once; the vectors are a slim table in the shared folder.
Every labelled training row is learnt from: equal vectors of one label are one
row with their count as its weight, rows are dealt to small groups by a hash of
the vector, and each row meets rows of the other label in its group (their mean
over all groups where a group has none). Newton's method sums the loss over all
pairs in one Spark job a step; scale, shares and cut come from all rows.

Defined cases: null or empty texts have the zero vector; rows without a key
are scored, never learnt from; label rows that are null or contradict each
other for one key are left out; repeated keys are scored row by row; without
labelled rows of both classes every score is the share of label 1 (0.0 without
any); an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import quantiles
from .common import discard, fold_of, ship, text_of, written

ship(__name__)

#: A group has about so many rows of the rarer label, and so many rows at most
#: on average; a row of the commoner label meets up to ``MEETS`` others.
RARER, GROUP, MEETS = 8, 4096, 8
STEPS = 25

_BYTES = np.arange(256)
#: Byte classes whose shares are features.
CLASSES = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 97) & (_BYTES <= 122),
    (_BYTES >= 48) & (_BYTES <= 57),
    _BYTES >= 128,
    _BYTES == 32,
    (_BYTES == 10) | (_BYTES == 13) | (_BYTES == 9),
    np.isin(_BYTES, list(b".,;:?'\"-()")),
    _BYTES == 33,
    np.isin(_BYTES, list(b"#$%&*@^~+=<>\\/_")),
    np.isin(_BYTES, list(b"|[]{}`")),
]).astype(np.float64).T
N_FEATURES = CLASSES.shape[1] + 9


def features(text: bytes) -> np.ndarray:
    """Shape of a text, every value 0 to about 1 apart from log lengths."""
    out = np.zeros(N_FEATURES)
    n = len(text)
    if not n:
        return out
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    k = CLASSES.shape[1]
    out[:k] = hist @ CLASSES / n
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    share = hist[hist > 0] / n
    out[k] = -(share * np.log2(share)).sum() / 8
    out[k + 1] = np.log1p(n) / 16
    out[k + 2] = sum(map(eq, words, words[1:])) / m
    out[k + 3] = len(set(words)) / m ** 0.8
    out[k + 4] = min(4.0, (n - len(words)) / m / 16)
    out[k + 5] = 1 - len(set(lines)) / len(lines)
    out[k + 6] = sum(w.isupper() for w in words) / m
    out[k + 7] = sum(not w.isalnum() for w in words) / m
    out[k + 8] = sum(map(eq, words, words[2:])) / m
    return out


def feature_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f array<float>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(t.as_buffer().to_pybytes()) for t in b.column(1)], np.float32).reshape(-1, N_FEATURES)
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * N_FEATURES), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), f], names=["doc_id", "f"])

    slim = docs.select(F.col(key).alias("doc_id"), text_of(text).cast("binary").alias("t"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, f array<float>")


def pairs(good: np.ndarray, bad: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of the pairs of a group and their weights; every row of
    either side (weights ``u``, ``v``) takes part in some pair."""
    n, m = len(good), len(bad)
    i = np.tile(np.arange(max(n, m)), min(n, m, MEETS))
    j = i + np.repeat(np.arange(min(n, m, MEETS)), max(n, m))
    a, b = (i, j % m) if n >= m else (j % n, i)
    return good[a] - bad[b], u[a] * v[b]


def bradley_terry(groups: DataFrame, model: Model, means: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights of least logistic loss over the pairs of all groups (y, f, n:
    arrays of a group's rows) by Newton's method with halved steps; ``means``:
    the scaled mean vector of labels 0 and 1."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(w)
            out = np.zeros(2 + k + k * k)
            for b in batches:
                for r in b.to_pylist():
                    y, f, n = np.array(r["y"]), model.scaled(np.array(r["f"], np.float64)), np.array(r["n"], np.float64)
                    side = [(f[y == c], n[y == c]) if (y == c).any() else (means[c][None], np.ones(1)) for c in (0, 1)]
                    d, c = pairs(side[1][0], side[0][0], side[1][1], side[0][1])
                    z = d @ w
                    p = 1 / (1 + np.exp(np.clip(z, -700, 700)))
                    out[0] += c.sum()
                    out[1] += c @ np.logaddexp(0, -z)
                    out[2:2 + k] -= (c * p) @ d
                    out[2 + k:] += ((d * (c * p * (1 - p))[:, None]).T @ d).ravel()
            yield pa.RecordBatch.from_pylist([{"s": out.tolist()}])

        k = len(w)
        sums = np.array([r["s"] for r in groups.mapInArrow(task, "s array<double>").collect()])  # a row per task
        out = np.array([math.fsum(c) for c in sums.T])
        out[1:] /= out[0]
        return out[1] + ridge * w @ w / 2, out[2:2 + k] + ridge * w, out[2 + k:].reshape(k, k) + ridge * np.eye(k)

    w = np.zeros(means.shape[1])
    loss, g, h = at(w)
    for _ in range(STEPS):
        step = np.linalg.solve(h, g)
        if g @ step < 1e-10:
            break
        share = 1.0
        while (new := at(w - share * step))[0] > loss and share > 1e-3:
            share /= 2
        if new[0] > loss:
            break
        w, (loss, g, h) = w - share * step, new
    return w


class Model:
    def __init__(self, mean, scale, w, cut, steep, base):
        self.mean, self.scale, self.w, self.cut, self.steep, self.base = mean, scale, w, cut, steep, base

    def scaled(self, f: np.ndarray) -> np.ndarray:
        return np.clip((f - self.mean) / self.scale, -6, 6)

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.scaled(f) @ self.w

    def score(self, f: np.ndarray, threshold: float) -> np.ndarray:
        if self.w is None:
            return np.full(len(f), self.base)
        at = np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(self.steep * (self.raw(f) - self.cut) + at, -700, 700)))


def vectors(f: pa.Array) -> np.ndarray:
    return f.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(f), -1)


def train(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """table: rows to learn from, (doc_id, f)."""
    told = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("doc_id"))
    told = told.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_y")).where("y = _y").drop("_y")
    learnt = table.join(told, "doc_id").select("f", "y")
    rows = written(learnt.groupBy("f", "y").agg(F.count("*").alias("n")), "quality-rows")
    x = [F.col("f")[i].cast("double") for i in range(N_FEATURES)]
    sums = rows.groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), *[F.sum(c * F.col("n")).alias(f"s{i}") for i, c in enumerate(x)])
    sums = {r["y"]: r for r in sums.collect()}
    n = {y: r["n"] for y, r in sums.items()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        discard(rows)
        return Model(None, None, None, 0.0, 1.0, share)
    total = sum(n.values())
    mean = np.array([(sums[0][f"s{i}"] + sums[1][f"s{i}"]) / total for i in range(N_FEATURES)])
    spread = rows.agg(*[F.sum(F.pow(c - float(mean[i]), 2) * F.col("n")).alias(f"v{i}") for i, c in enumerate(x)]).first()
    m = Model(mean, np.maximum(np.sqrt(np.array([spread[f"v{i}"] for i in range(N_FEATURES)]) / total), 1e-3), None, 0.0, 1.0, share)
    means = np.array([m.scaled(np.array([sums[y][f"s{i}"] / n[y] for i in range(N_FEATURES)])) for y in (0, 1)])
    size = [sums[y]["rows"] for y in (0, 1)]
    parts = max(1, min(size) // RARER, sum(size) // GROUP)
    dealt = F.array_sort(F.collect_list(F.struct(F.xxhash64("f").alias("h"), "f", "y", "n")))
    groups = rows.groupBy(F.pmod(F.xxhash64("f", F.lit(8)), F.lit(parts)).alias("g")).agg(dealt.alias("r"))
    groups = written(groups.select("r.y", "r.f", "r.n"), "quality-groups")
    m.w = bradley_terry(groups, m, means)
    discard(groups)

    @F.arrow_udf("double")
    def raw(f: pa.Array) -> pa.Array:
        return pa.array(m.raw(vectors(f)))

    # The quantile of all rows' scores at the share of label 0: halfway between the last row below it and the next.
    scores = written(learnt.select(raw("f").alias("s")), "quality-scores")
    m.cut = float(quantiles(scores, "s", [(n[0] - 0.5) / (total - 1)], ["q"]).first()["q"])
    m.steep = float(4 / max(1e-6, quantiles(scores.select(F.abs(F.col("s") - m.cut).alias("a")), "a", [0.5], ["q"]).first()["q"]))
    discard(rows)
    discard(scores)
    return m


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, hold: int = 0,
             threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt from rows whose
    fold is not ``hold``."""
    table = written(feature_table(docs, key, text), "quality")
    model = train(table.where(fold_of(F.col("doc_id"), folds) != hold), labels, key)

    @F.arrow_udf("double")
    def rate(f: pa.Array) -> pa.Array:
        return pa.array(model.score(vectors(f), threshold))

    return table.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == hold, F.lit(False)).alias("held_out"), rate("f").alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
