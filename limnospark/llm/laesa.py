"""Product codes of integer vectors, assigned with LAESA pivots (op 13; Mico,
Oncina & Vidal 1994).

Each component becomes ``floor(scale * x)``; a vector is cut into ``parts``
equal parts, each position with a codebook of its own. A codebook starts as
the parts of the first ``entries`` vectors by id; a round assigns each part to
its nearest entry (squared distance in integers, ties to the lower index) and
replaces an entry by the componentwise floor of its parts' mean; at the end
the parts are assigned once more.

Pivots. Each position has up to ``PIVOTS`` fixed points (starting entries far
from one another). The distance of every part to its pivots is computed once
and written with it. In a round only the pivots are compared with the entries:
``|d(part, pivot) - d(pivot, entry)|`` bounds d(part, entry) from below, the
largest over the pivots being the bound. A part meets its entries in the order
of the bound, each by its exact integer distance, until the next bound is
above the best distance; the rest is pruned. Bounds are lowered by ``SLACK``
(rounding of the stored single-precision distances), so a pruned entry is
farther for certain.

Scale. Vectors stay where they are: a round is a map with the codebooks (a few
thousand numbers) whose tasks give at most parts x entries partial sums, added
up by a grouped aggregate. The driver holds the codebooks only.

Defined cases. Rows whose vector is null or holds null or non-finite
components take no part, nor do those whose length differs from the most
frequent one (of equals the shorter) among multiples of ``parts``, nor those
with a component whose integer passes ``TOP`` (the error would pass a long).
Repeated rows count as often as they come; a null id comes after all others
and stays null; ids that occur twice start the codebook in the order of their
vectors. Fewer vectors than entries give a shorter codebook. An empty table
gives an empty table. Only id, vector and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

ship(__name__)

PIVOTS = 4
SLACK = 1e-5
TOP = 1 << 27
#: Vectors that a task handles at once.
CHUNK = 2048
#: Labels up to which their errors are sent to every task.
FEW = 50_000


def integers(df: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, v array<int>) of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"),
                     F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.col(vector).alias("x"))
    finite = ~F.exists("x", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * scale >= TOP))
    rows = rows.where(F.col("x").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", "label", "v")
    length = F.size("v")
    usual = rows.where((length > 0) & (length % parts == 0)).groupBy(length.alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(length == (usual["d"] if usual else -1)).withColumn("v", F.col("v").cast("array<int>"))


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows: the farthest from the mean, then always the
    farthest from those taken (the lowest index of equals)."""
    gap = ((entries - entries.mean(0)) ** 2).sum(1)
    taken: list[int] = []
    near = np.full(len(entries), np.inf)
    for _ in range(min(n, len(entries))):
        at = int(gap.argmax())
        if taken and gap[at] == 0:
            break
        taken.append(at)
        near = np.minimum(near, ((entries - entries[at]) ** 2).sum(1))
        gap = near
    return entries[taken]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(2).astype(np.float64))


def assign(x: np.ndarray, to_pivot: np.ndarray, pivots: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row of ``x`` (integers), its squared distance,
    and how many exact distances were computed."""
    between = to_pivots(entries, pivots)  # (entries, pivots)
    bound = np.zeros((len(x), len(entries)), np.float32)
    for p in range(len(pivots)):
        a, b = to_pivot[:, p, None], between[None, :, p].astype(np.float32)
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    in_order = np.take_along_axis(bound, order, 1).astype(np.float64) ** 2 * (1 - SLACK)
    best = np.full(len(x), np.iinfo(np.int64).max)
    own = np.zeros(len(x), np.int64)
    live, done = np.arange(len(x)), 0
    for j in range(len(entries)):
        live = live[in_order[live, j] <= best[live]]
        if not len(live):
            break
        e = order[live, j]
        d = ((x[live] - entries[e]) ** 2).sum(1)
        done += len(live)
        better = (d < best[live]) | ((d == best[live]) & (e < own[live]))
        best[live[better]], own[live[better]] = d[better], e[better]
    return own, best, done


def blocks(b: pa.RecordBatch, column: int, dtype) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(b), -1)


def each_part(b: pa.RecordBatch, pivots: list[np.ndarray], books: list[np.ndarray]) -> Iterator[tuple]:
    """(part, its columns of the vectors, nearest entries, distances)."""
    v, dist = blocks(b, 2, np.int64), blocks(b, 3, np.float32)
    d, at = v.shape[1] // len(books), 0
    for p, (pivot, book) in enumerate(zip(pivots, books)):
        x = v[:, p * d:(p + 1) * d]
        own, best, _ = assign(x, dist[:, at:at + len(pivot)], pivot, book)
        at += len(pivot)
        yield p, x, own, best


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), CHUNK):
            yield b.slice(at, CHUNK)


def summing(pivots: list[np.ndarray], books: list[np.ndarray]) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = books[0].shape[1]
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), d), object) for b in books]  # whole numbers of any size
        for b in chunks(batches):
            for p, x, own, _ in each_part(b, pivots, books):
                n[p] += np.bincount(own, minlength=len(n[p]))
                part = np.zeros((len(n[p]), d), np.int64)
                np.add.at(part, own, x)
                sums[p] += part
        rows = [(p, e, int(n[p][e]), [str(s) for s in sums[p][e]]) for p in range(len(books)) for e in np.flatnonzero(n[p])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "entry", "n", "sums"])

    return task


def improved(rows: DataFrame, pivots: list[np.ndarray], books: list[np.ndarray]) -> list[np.ndarray]:
    """A round: every entry with parts becomes the floor of their mean."""
    d = books[0].shape[1]
    partial = rows.mapInArrow(summing(pivots, books), "part long, entry long, n long, sums array<string>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]
    out = [b.copy() for b in books]
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows
        out[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(d)]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
           key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 per vector, with the
    label itself as a further column."""
    if entries > 256:
        raise ValueError("an index has two hex digits: 256 entries at most")
    spark = df.sparkSession
    whole = integers(df, key, vector, label, parts, scale)
    kind = whole.schema["label"].dataType.simpleString()
    first = whole.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    start = np.array([r["v"] for r in first], np.int64)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    pivots = [far_apart(b, PIVOTS) for b in books]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            v = blocks(b, 2, np.int64)
            dist = np.hstack([to_pivots(x, p) for x, p in zip(np.split(v, len(pivots), axis=1), pivots)]).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * dist.shape[1]), pa.array(dist.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], names=["vec_id", "label", "v", "to_pivots"])

    rows = written(whole.mapInArrow(measure, f"vec_id long, label {kind}, v array<int>, to_pivots array<float>"), "laesa-parts")
    for _ in range(rounds):
        books = improved(rows, pivots, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            found = list(each_part(b, pivots, books))
            text = np.stack([own for _, _, own, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = sum(best for *_, best in found)
            w = 2 * len(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([text[i * w:(i + 1) * w] for i in range(len(b))], pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"])

    coded = written(rows.mapInArrow(code, f"vec_id long, label {kind}, code string, error long"), "laesa-codes")
    return _with_label_error(coded).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _with_label_error(coded: DataFrame) -> DataFrame:
    """The error summed over rows of an equal label (nulls together): a
    grouped sum joined back. The sums are sent to every task where the labels
    are few; otherwise only those of frequent labels are (a thousandth of the
    rows each, so a thousand at most), the others are joined by label."""
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "laesa-labels")
    labels, n = sums.agg(F.count("*"), F.sum("_n")).first()
    few = sums if labels <= FEW else sums.where(F.col("_n") * 1000 >= n)
    few = few.select(F.col("label").alias("_label"), "label_error")
    out = coded.join(F.broadcast(few), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    if labels <= FEW:
        return out
    rest = sums.where(F.col("_n") * 1000 < n).select(F.col("label").alias("_label"), "label_error")
    rare = out.where("label_error is null").drop("label_error")
    return out.where("label_error is not null").unionByName(
        rare.join(rest, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"))
