"""SimHash near-duplicates by bit-sliced comparison (op 9).

A document's fingerprint takes the majority of every bit over the XXH64
(seed 42) of its word shingles, repeats included. Fingerprints at most
``radius`` bits apart are linked, and a document's class is its connected
component.

Candidates: the 64 bits are cut into ``radius + 2`` blocks, so two linked
fingerprints agree on at least two whole blocks; every pair of blocks is one
bucket table. Within a bucket the fingerprints stand as 64 bit planes. Row i
is compared with row i + s for all i at once: planes are shifted by s, xored,
and summed by carry-save counters of one bit each; words of 64 pairs in which
every pair has left the radius are abandoned early. Only links that join two
classes of a batch leave the task, never all pairs of a group.

Equal fingerprints are one row before the search. A bucket of more than
``CHUNK`` different fingerprints is dealt into chunks, and each pair of its
chunks is a task's work of its own, so no bucket has to fit one task and no
link is lost.

Defined cases: null text counts as empty; no words gives fingerprint zero,
linked like any other; fewer words than a shingle hash as one sequence; rows
with a null key belong to no component (null) and link nothing; repeated keys
keep one row each; an empty table gives an empty table. Only key and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, tasks, text_of, written
from .graph import components

ship(__name__)

SEED = 42
CHUNK = 4096
BATCH = 1 << 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of a text's UTF-8 bytes. ``bytes.lower`` changes A-Z
    alone and ``bytes.split`` cuts at space and \\x09-\\x0d alone."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    spans = zip(starts, ends[shingle - 1:]) if len(words) >= shingle else [(0, len(joined) + 1)]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    hashes = [digest(joined[s:e - 1], SEED) for s, e in spans]
    for at in range(0, len(hashes), BATCH):
        part = np.array(hashes[at:at + BATCH], dtype="<u8")
        n += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp, th): the fingerprint's bits as a signed long, and a hash
    of the text that tells rows of one key apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], names=["doc_id", "fp", "th"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("t"), F.xxhash64(text_of(text)).alias("th"))
    return slim.mapInArrow(run, "doc_id long, fp long, th long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed words: bit i of row b is bit b of fingerprint i."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    words = (n + 63) // 64 + 2
    out = np.zeros((64, words * 8), np.uint8)
    out[:, :packed.shape[1]] = packed
    return out.view("<u8")


def _pack(mask: np.ndarray) -> np.ndarray:
    packed = np.packbits(mask, bitorder="little")
    out = np.zeros(((len(mask) + 63) // 64) * 8, np.uint8)
    out[:len(packed)] = packed
    return out.view("<u8")


def within(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Indices i whose fingerprint is at most ``radius`` bits from that of
    i + shift, among the pairs set in the packed mask ``valid``."""
    far, near = np.uint64(shift % 64), np.uint64((64 - shift % 64) % 64)
    step = shift // 64
    at = np.flatnonzero(valid)
    alive = valid[at]
    depth = max(1, (radius + 1).bit_length())
    counters = [np.zeros(len(at), np.uint64) for _ in range(depth)]
    over = np.zeros(len(at), np.uint64)
    limit = radius + 1  # counted exactly up to 2**depth - 1 >= limit

    def beyond():
        """Pairs whose counter has reached ``limit`` or has overflowed."""
        more, same = np.zeros(len(at), np.uint64), np.full(len(at), ~np.uint64(0))
        for k in reversed(range(depth)):
            if limit >> k & 1:
                same = same & counters[k]
            else:
                more, same = more | (same & counters[k]), same & ~counters[k]
        return over | more | same

    for b in range(64):
        row = planes[b]
        other = row[at + step]
        if shift % 64:
            other = (other >> far) | (row[at + step + 1] << near)
        carry = row[at] ^ other
        for k in range(depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 6 == 5 or b == 63:
            alive = alive & ~beyond()
            keep = np.flatnonzero(alive)
            if len(keep) == 0:
                return keep
            if len(keep) < len(at):
                at, alive, over = at[keep], alive[keep], over[keep]
                counters = [c[keep] for c in counters]
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return at[word] * 64 + bit


def links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key (rows sorted by key): a spanning
    forest, so n - 1 links at most."""
    n = len(fps)
    planes, label = _planes(fps), np.arange(n)
    first, second = [], []
    # Rows still having a partner at distance s; runs of equal keys make this exact.
    last = np.searchsorted(keys, keys, side="right") - 1
    room = last - np.arange(n)
    for s in range(1, int(room.max(initial=0)) + 1):
        for i in within(planes, s, _pack(room >= s), radius):
            a, b = label[i], label[i + s]
            if a != b:
                lo, hi = int(np.searchsorted(keys, keys[i])), int(last[i]) + 1
                part = label[lo:hi]
                part[part == max(a, b)] = min(a, b)
                first.append(i)
                second.append(i + s)
    return np.array(first, int), np.array(second, int)


def bucket_links(fps: DataFrame, radius: int) -> DataFrame:
    """fps: distinct column ``fp`` -> edges (u, v) between fingerprints."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    cut = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    pairs = list(combinations(range(blocks), 2))
    table = [F.struct(F.lit(k).alias("tab"), (F.shiftleft(cut[i], 32) + cut[j]).alias("bits")) for k, (i, j) in enumerate(pairs)]
    rows = fps.select("fp", F.explode(F.array(*table)).alias("e")).select("fp", "e.tab", "e.bits")
    sizes = rows.groupBy("tab", "bits").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["tab", "bits"])  # a bucket of one row has no pair
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    rows = rows.withColumn("c", chunks).withColumn("own", own)
    # Chunk pairs: every row goes to the pairs its own chunk is part of.
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select(
        F.xxhash64("tab", "bits", F.least("own", "o"), F.greatest("own", "o")).alias("key"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(k, f):
            if len(k):
                a, b = links(k, f.view(np.uint64), radius)
                return pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], names=["u", "v"])

        keys, vals = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            vals = np.concatenate([vals, b.column(1).to_numpy()])
            if len(keys) >= BATCH:
                end = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if out := found(keys[:end], vals[:end]):
                    yield out
                keys, vals = keys[end:], vals[end:]
        if out := found(keys, vals):
            yield out

    n = tasks(fps.sparkSession)
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _classes(docs: DataFrame, key: str, text: str, shingle: int, radius: int) -> DataFrame:
    prints = written(fingerprints(docs, key, text, shingle), "simhash")
    keyed = prints.where("doc_id is not null")
    distinct = written(keyed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(bucket_links(distinct.select("fp"), radius))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    found = prints.join(named, "fp", "left")
    return found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    return _classes(docs, key, text, shingle, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the least key (of
    several, that of the least text hash). Rows without a key stay."""
    found = _classes(docs, key, text, shingle, radius)
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("th").alias("th"))
    keep = written(keep.join(found.groupBy("doc_id", "th").agg(F.count("*").alias("n")), ["doc_id", "th"]), "simhash-keep")
    k, h = free_name(docs, "_key"), free_name(docs, "_hash")
    named = docs.withColumn(k, F.col(key).cast("long")).withColumn(h, F.xxhash64(text_of(text)))
    ids = keep.select(F.col("doc_id").alias(k), F.col("th").alias(h))
    kept = named.join(ids, [k, h], "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([k, h])
    return kept.drop(k, h).unionByName(docs.where(F.col(key).isNull()))
