"""Patched frame-of-reference blocks of token ids, in numpy.

A block holds ``BLOCK`` ids (the last of a file fewer). Its least id is
subtracted; the rest is packed at the width that ``SHARE`` of the block's ids
need, and the bits above that width of the others stand in an exception list
(place in the block, high bits). All numbers are little-endian.

    block   u32 least, u8 width, u8 ids - 1, u16 exceptions,
            4 x width words of 32 bits (packed; lane j holds ids j, 32 + j, ...
            in groups of 32), u8 place per exception, u32 high per exception
    file    magic, blocks, index (u64 start of each block, and of the end),
            documents (u64 first id of each, and the end; i64 key; u8 key
            known), footer (u64 documents, ids, blocks, start of the index,
            magic)

:class:`Writer` takes documents one after another and holds ``FLUSH`` ids and
the tables; :class:`Reader` reads any document by the index, or all in order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from .common import ship

ship(__name__)

MAGIC = b"PFOR-T01"
BLOCK = 128
SHARE = 0.9
FLUSH = 1 << 18
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("last", "u1"), ("exceptions", "<u2")])
FOOT = "<QQQQ8s"


def pack(v: np.ndarray, width: int) -> np.ndarray:
    """(m, 32) values below 2**width -> (m, width) words."""
    out = np.zeros((len(v), width + 1), np.uint64)
    for j in range(32):
        at, off = divmod(j * width, 32)
        out[:, at] |= v[:, j] << np.uint64(off)
        if off + width > 32:
            out[:, at + 1] |= v[:, j] >> np.uint64(32 - off)
    return out[:, :width].astype("<u4")


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """(m, width) words -> (m, 32) values."""
    w = words.astype(np.uint64)
    out = np.zeros((len(w), 32), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(32 if width else 0):
        at, off = divmod(j * width, 32)
        x = w[:, at] >> np.uint64(off)
        if off + width > 32:
            x = x | (w[:, at + 1] << np.uint64(32 - off))
        out[:, j] = x & mask
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of ``counts[i]`` numbers each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Ids below 2**32 -> (the blocks, bytes of each)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    sizes = np.full(n, BLOCK)
    sizes[-1] = len(ids) - (n - 1) * BLOCK
    v = np.full(n * BLOCK, ids[(n - 1) * BLOCK:].min(), np.uint64)  # a short block is filled with its least id
    v[:len(ids)] = ids
    v = v.reshape(n, BLOCK)
    least = v.min(1)
    v = v - least[:, None]
    at = BLOCK - sizes + np.ceil(SHARE * sizes).astype(int) - 1
    need = np.sort(v, axis=1)[np.arange(n), at]
    width = np.ceil(np.log2(need.astype(np.float64) + 1)).astype(np.uint64)
    high = v >> width[:, None]
    row, place = np.nonzero(high)
    exceptions = np.bincount(row, minlength=n)
    total = HEAD.itemsize + 16 * width.astype(np.int64) + 5 * exceptions
    starts = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint8)
    head = np.zeros(n, HEAD)
    head["least"], head["width"], head["last"], head["exceptions"] = least, width, sizes - 1, exceptions
    out[starts[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(n, -1)
    low = v & ((np.uint64(1) << width) - np.uint64(1))[:, None]
    for w in np.unique(width).astype(int):
        if w:
            own = np.flatnonzero(width == w)
            words = pack(low[own].reshape(-1, 32), w).reshape(len(own), -1)
            out[starts[own][:, None] + HEAD.itemsize + np.arange(16 * w)] = words.view(np.uint8)
    tail = starts + HEAD.itemsize + 16 * width.astype(np.int64)
    out[spread(tail, exceptions)] = place
    values = high[row, place].astype("<u4").view(np.uint8)
    out[spread(tail + exceptions, 4 * exceptions)] = values
    return out.tobytes(), total


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks at ``starts`` in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    n = len(starts)
    head = raw[starts[:, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
    width, exceptions = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            words = raw[starts[own][:, None] + HEAD.itemsize + np.arange(16 * w)].reshape(-1).view("<u4")
            out[own] = unpack(words.reshape(-1, w), int(w)).reshape(len(own), BLOCK)
    tail = starts + HEAD.itemsize + 16 * width
    row = np.repeat(np.arange(n), exceptions)
    high = raw[spread(tail + exceptions, 4 * exceptions)].view("<u4").astype(np.uint64)
    out[row, raw[spread(tail, exceptions)]] |= high << width[row].astype(np.uint64)
    out += head["least"].astype(np.uint64)[:, None]
    return out[np.arange(BLOCK) <= head["last"][:, None]].astype("<u4")


class Writer:
    """Writes a file to an open binary stream."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.sizes: list[np.ndarray] = []
        self.firsts: list[int] = []
        self.keys: list[int | None] = []
        stream.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.firsts.append(self.ids)
        self.keys.append(key)
        self.waiting.append(ids)
        self.ids += len(ids)
        self.held += len(ids)
        if self.held >= FLUSH:
            self.flush(self.held // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.waiting])
        data, sizes = encode_blocks(ids[:n])
        self.stream.write(data)
        self.at += len(data)
        self.sizes.append(sizes)
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def close(self) -> int:
        """Writes what is left; bytes of the file."""
        self.flush(self.held)
        sizes = np.concatenate(self.sizes).astype(np.int64)
        index = len(MAGIC) + np.concatenate([[0], np.cumsum(sizes)])
        parts = [index.astype("<u8").tobytes(), np.array([*self.firsts, self.ids], "<u8").tobytes(),
                 np.array([k or 0 for k in self.keys], "<i8").tobytes(), np.array([k is not None for k in self.keys], np.uint8).tobytes(),
                 struct.pack(FOOT, len(self.keys), self.ids, len(sizes), self.at, MAGIC)]
        for p in parts:
            self.stream.write(p)
        return self.at + sum(map(len, parts))


class Reader:
    """Reads a file from an open, seekable binary stream of known size."""

    def __init__(self, stream, size: int):
        self.stream = stream
        n_docs, self.ids, n, at, magic = struct.unpack(FOOT, self._bytes(size - struct.calcsize(FOOT), struct.calcsize(FOOT)))
        if magic != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of this format")
        tables = self._bytes(at, size - struct.calcsize(FOOT) - at)
        self.index = np.frombuffer(tables, "<u8", n + 1).astype(np.int64)
        self.firsts = np.frombuffer(tables, "<u8", n_docs + 1, 8 * (n + 1)).astype(np.int64)
        known = np.frombuffer(tables, np.uint8, n_docs, len(tables) - n_docs)
        keys = np.frombuffer(tables, "<i8", n_docs, len(tables) - 9 * n_docs)
        self.keys = [int(k) if ok else None for k, ok in zip(keys, known)]

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids start..end of the file: only their blocks are read."""
        if start >= end:
            return np.zeros(0, "<u4")
        a, b = start // BLOCK, -(-end // BLOCK)
        at = int(self.index[a])
        got = decode_blocks(self._bytes(at, int(self.index[b]) - at), self.index[a:b] - at)
        return got[start - a * BLOCK:end - a * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.firsts[i]), int(self.firsts[i + 1]))

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document number, ids) over the whole file in order, ``FLUSH`` ids
        at a time: a long document comes in several pieces, an empty one in
        none."""
        for at in range(0, self.ids, FLUSH):
            end = min(self.ids, at + FLUSH)
            ids = self.span(at, end)
            i = int(np.searchsorted(self.firsts, at, "right")) - 1
            while i < len(self.keys) and self.firsts[i] < end:
                a, b = max(int(self.firsts[i]), at), min(int(self.firsts[i + 1]), end)
                if a < b:
                    yield i, ids[a - at:b - at]
                i += 1
