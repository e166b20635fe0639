"""Removal of repeated 200-byte strings by merging shard Burrows-Wheeler
transforms (op 2).

Every byte covered by a 200-byte string that also starts anywhere else, in
the same document or another, is found and removed; matches never cross
documents, and strings are judged on the input.

1. Documents are cut into units (:mod:`repeats`): runs of up to 45 windows
   around a common minimiser. Equal windows lie in units of equal core, so
   only cores that occur more than once go on. This drops no repeat and
   leaves what is to be merged in proportion to the repeated passages.
2. Units alike in every byte need no comparison: all their windows repeat.
   They are put together in each task before the shuffle, and go on as one
   string with its count.
3. Where a core's units differ, their strings form a collection. The core,
   common to all, is one symbol. Collections of whole cores are put together
   up to ``BATCH`` symbols a task, cut into shards, each shard's transform is
   built, and the shards are merged by interleave refinement (:mod:`bwt`):
   runs of the merged order with a whole window in common, counted more than
   once, are repeated.
4. The windows found go back to all units alike, and each document loses the
   union of the windows' bytes.

A core with more than ``MOST`` different units (a passage between ever
different neighbours) is not put into one task: its windows are counted by
their 128-bit hash in a plain aggregation instead, which is exact and has no
group to hold.

Texts are shuffled once, by key; the removal reuses that exchange.

Defined cases: a null text counts as empty; texts under 200 bytes lose
nothing; null and repeated keys are kept apart by a hash of the text, equal
rows (key and text) are each other's repeats; very long texts are cut in
overlapping pieces; an empty table gives an empty table. Helper columns are
prefixed ``_``; the input's other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bwt import repeated
from .common import free_name, ship, tasks, text_of, written
from .repeats import CLASS, LENGTH, Powers, core_of, unplace, units

ship(__name__)

BATCH = 1 << 19
MOST = 30_000


def keyed(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(doc_id, uid, t, more): ``uid`` is the key where keys are whole and
    unique, else a hash of key and text."""
    k, t = F.col(key).cast("long"), text_of(text).cast("binary")
    ids = docs.select(k.alias("k"))
    whole = ids.where("k is null").isEmpty() and ids.groupBy("k").count().where("count > 1").isEmpty()
    uid = F.coalesce(k, F.lit(0).cast("long")) if whole else F.xxhash64(k, t)
    return docs.select(k.alias("doc_id"), uid.alias("uid"), t.alias("t"), *more)


#: Units gathered in a task before alike ones are put together.
GATHER = 1 << 20


def gathered(core: np.ndarray, alike: np.ndarray, uid: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for units alike in every byte: their number, the first one's
    uid and place, and the others' packed in ``more``. A group of copies is
    so put together before it is shuffled."""
    order = np.lexsort((alike, core))
    core, alike, uid, place = core[order], alike[order], uid[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (core[1:] != core[:-1]) | (alike[1:] != alike[:-1])]))
    n = np.diff(np.append(first, len(core)))
    pairs = np.stack([uid, place], 1)
    more: list[bytes | None] = [None] * len(first)
    for g in np.flatnonzero(n > 1).tolist():
        more[g] = pairs[first[g] + 1:first[g] + n[g]].tobytes()
    packed = pa.array(more, pa.binary())
    for at in range(0, len(first), 50_000):
        f = first[at:at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(core[f].view(np.int64)), pa.array(alike[f].view(np.int64)), pa.array(n[at:at + 50_000]),
             pa.array(uid[f]), pa.array(place[f]), packed.slice(at, 50_000)],
            names=["core", "alike", "n", "uid", "place", "more"])


def unit_rows(base: DataFrame) -> DataFrame:
    """(core, alike, n, uid, place, more) of every unit of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, parts, size, found, uids = Powers(), [], 0, [], []

        def keep():
            nonlocal size, found, uids
            if found:
                core, alike, place = zip(*found)
                parts.append((np.array(core, np.uint64), np.array(alike, np.uint64), np.array(uids, np.int64), np.array(place, np.int64)))
                size += len(found)
                found, uids = [], []

        for b in batches:
            for u, t in zip(b.column(0).to_pylist(), b.column(1)):
                got = units(t.as_buffer().to_pybytes(), powers)
                found += got
                uids += [u] * len(got)
                if len(found) > 50_000:
                    keep()
                if size >= GATHER:
                    yield from gathered(*(np.concatenate(c) for c in zip(*parts)))
                    parts, size = [], 0
        keep()
        if parts:
            yield from gathered(*(np.concatenate(c) for c in zip(*parts)))

    return base.select("uid", "t").mapInArrow(run, "core long, alike long, n long, uid long, place long, more binary")


def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, place, more, spans) -> (uid, a, b): the byte ranges of the
    repeated windows of every unit; null spans stand for all windows."""
    for batch in rows:
        uids, places, lows, highs = [], [], [], []
        for u, p, more, spans in zip(*(c.to_pylist() for c in batch.columns)):
            members = [(u, p)]
            if more:
                members += map(tuple, np.frombuffer(more, np.int64).reshape(-1, 2).tolist())
            inner = [(0, unplace(p)[2])] if spans is None else [(s["a"], s["b"]) for s in spans]
            for m, q in members:
                first = q >> 16
                for a, b in inner:
                    uids.append(m)
                    lows.append(first + a)
                    highs.append(first + b + LENGTH - 1)
            if len(uids) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["uid", "a", "b"])
                uids, lows, highs = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["uid", "a", "b"])


def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, wants) -> the bytes of every wanted unit."""
    names = ["core", "alike", "weight", "place", "b"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in rows:
        out: list[list] = [[] for _ in names]
        for t, wants in zip(batch.column(0), batch.column(1)):
            t = t.as_buffer().to_pybytes()
            for w in wants.as_py():
                first, _, n = unplace(w["place"])
                for column, v in zip(out, (w["core"], w["alike"], w["weight"], w["place"], t[first:first + n + LENGTH - 1])):
                    column.append(v)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def merged_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core -> (core, alike, spans) of units with repeated
    windows; ``spans`` are window ranges counted from the unit's start."""

    def solve(part: list[tuple]) -> pa.RecordBatch:
        strings, windows, weights, group = [], [], [], {}
        for core, _, weight, place, b in part:
            _, distance, n = unplace(place)
            lo, hi = core_of(distance)
            s = np.frombuffer(b, np.uint8).astype(np.uint16) + 1
            mark = np.array([257 + group.setdefault(core, len(group))], np.uint16)
            strings.append(np.concatenate([s[:lo], mark, s[hi:]]))
            windows.append(n)
            weights.append(weight)
        found = []
        for (core, alike, _, _, _), hit in zip(part, repeated(strings, windows, weights, CLASS)):
            if hit.any():
                found.append((core, alike, [{"a": a, "b": b} for a, b in runs(hit)]))
        core, alike, spans = zip(*found) if found else ((), (), ())
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(core, pa.int64()), pa.array(alike, pa.int64()), pa.array(spans, span)], names=["core", "alike", "spans"])

    held: list[tuple] = []
    size = groups = 0
    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if not held or held[-1][0] != row[0]:
                if size >= BATCH or groups >= 60_000:
                    yield solve(held)
                    held, size, groups = [], 0, 0
                groups += 1
            held.append(row)
            size += len(row[4]) - LENGTH + CLASS + 1
    if held:
        yield solve(held)


def counted_windows(units_: DataFrame) -> DataFrame:
    """The same for units of overfull cores, window by window."""

    def explode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, digest = ["h", "core", "alike", "weight", "j"], xxhash.xxh3_128_digest
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in rows:
            for at in range(0, len(batch), 1000):
                out = [(digest(b[j:j + LENGTH]), core, alike, weight, j)
                       for core, alike, weight, place, b in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns))
                       for j in range(unplace(place)[2])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    windows = units_.mapInArrow(explode, "h binary, core long, alike long, weight long, j int")
    often = windows.groupBy("h").agg(F.sum("weight").alias("n")).where("n > 1").select("h")
    hits = windows.join(often, "h").groupBy("core", "alike").agg(F.collect_list(F.struct(F.col("j").alias("a"), (F.col("j") + 1).alias("b"))).alias("spans"))
    return hits


def repeated_spans(base: DataFrame, by_uid: DataFrame) -> DataFrame:
    """(uid, spans): byte ranges of every document with a repeated window,
    unordered, overlapping. ``by_uid`` is ``base`` dealt by uid."""
    n = tasks(base.sparkSession)
    core = W.partitionBy("core")
    counted = unit_rows(base).select(
        "*", F.sum("n").over(core).alias("total"), (F.min("alike").over(core) != F.max("alike").over(core)).alias("mixed"))
    found = written(counted.where("total > 1").drop("total"), "units")
    mixed = found.where("mixed")
    strings = mixed.groupBy("core", "alike").agg(
        F.sum("n").alias("weight"), F.min(F.struct("uid", "place")).alias("at"))
    wants = strings.groupBy("at.uid").agg(
        F.collect_list(F.struct("core", "alike", "weight", F.col("at.place").alias("place"))).alias("wants"))
    cuts = by_uid.select("uid", "t").join(wants, "uid").select("t", "wants").mapInArrow(
        cut, "core long, alike long, weight long, place long, b binary")
    over = strings.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("core")
    overfull = [r["core"] for r in over.limit(1).collect()]
    usual = cuts if not overfull else cuts.join(over, "core", "left_anti")
    span = "core long, alike long, spans array<struct<a:int,b:int>>"
    spans = usual.repartition(n, "core").sortWithinPartitions("core").mapInArrow(merged_windows, span)
    if overfull:
        spans = spans.unionByName(counted_windows(cuts.join(over, "core", "left_semi")))
    none = F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans")
    whole = found.where("not mixed").select("uid", "place", "more", none)
    partly = mixed.join(spans, ["core", "alike"]).select("uid", "place", "more", "spans")
    ranges = whole.unionByName(partly).mapInArrow(spread, "uid long, a long, b long")
    return ranges.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def unite(spans) -> list[tuple[int, int]]:
    """Ordered, disjoint, maximal ranges; ranges that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _left(t: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    at, kept = 0, []
    for a, b in spans:
        kept.append(t[at:a])
        at = b
    kept.append(t[at:])
    return kept


def _with_spans(base: DataFrame) -> DataFrame:
    by_uid = base.repartition(tasks(base.sparkSession), "uid")
    return by_uid.join(repeated_spans(base.select("uid", "t"), by_uid), "uid", "left")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, s in zip(batch.column(1), batch.column(2)):
                t, spans = t.as_buffer().to_pybytes(), unite(s.as_py())
                kept = b"".join(_left(t, spans))
                rows.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            n, gone, parts, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(keyed(docs, key, text)).select("doc_id", "t", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` without the repeated bytes in ``text`` (characters cut in two
    go whole); a column ``length`` is set to the characters left. Rows that
    lose all their text go; others without a repeat stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, gone = [], []
            for t, s in zip(batch.column(1), batch.column(2)):
                t, spans = t.as_buffer().to_pybytes(), unite(s.as_py())
                left.append("".join(x.decode("utf-8", "ignore") for x in _left(t, spans)))
                gone.append(bool(spans) and not left[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(left, pa.string()), pa.array(gone, pa.bool_())], names=["row", "left", "gone"])

    rest = F.struct(*[F.col(c) for c in docs.columns if c != text], F.col(text).isNull().alias(free_name(docs, "_none")))
    base = keyed(docs, key, text, rest.alias("row"))
    found = _with_spans(base).select("row", "t", "spans")
    kind = found.schema["row"].dataType.simpleString()
    found = found.mapInArrow(run, f"row {kind}, left string, gone boolean").where("not gone")
    out = []
    for f in docs.schema.fields:
        if f.name == text:
            c = F.when(~F.col("row")[free_name(docs, "_none")], F.col("left"))
        elif f.name == length:
            c = F.when(F.col("row")[free_name(docs, "_none")], F.col("row")[length]).otherwise(F.char_length("left")).cast(f.dataType)
        else:
            c = F.col("row")[f.name]
        out.append(c.alias(f.name))
    return found.select(*out)
