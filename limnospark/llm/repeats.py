"""Units of a text for the search of repeated 200-byte strings.

Every window of ``LENGTH`` bytes has a minimiser: the least hashed k-mer in
it, the leftmost of equals. Windows next to each other with the same
minimiser, and the same class of distance to it, form a unit. Equal windows
have the same minimiser at the same distance, so they lie in units whose
``core``, the bytes that every window of the class shares, is equal. Hence
units whose core occurs once hold no repeated window, whatever the text."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import ship

ship(__name__)

LENGTH = 200
KMER = 21
#: Distances (window start to minimiser) of one class; it divides LENGTH - KMER + 1.
CLASS = 45
#: Bytes taken at once from a very long text.
PIECE = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Powers of the rolling hash's base and of its inverse, as long as needed."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BACK)]), dtype=np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by block-wise running minima."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def units(text: bytes, powers: Powers) -> list[tuple[int, int, int]]:
    """(core hash, whole hash, place) of every unit of a text; ``place``
    packs first window, distance to the minimiser, and windows."""
    if len(text) <= PIECE:
        return _units(text, 0, powers)
    out = []
    for at in range(0, len(text) - LENGTH + 1, PIECE):
        out += _units(text[at:at + PIECE + LENGTH - 1], at, powers)
    return out


def place(first: int, distance: int, windows: int) -> int:
    return first << 16 | distance << 8 | windows


def unplace(p: int) -> tuple[int, int, int]:
    return p >> 16, p >> 8 & 255, p & 255


def core_of(distance: int) -> tuple[int, int]:
    """The core's bytes, from the unit's first byte on."""
    near = distance // CLASS * CLASS
    return distance - near, distance - near - CLASS + 1 + LENGTH


def _units(text: bytes, offset: int, powers: Powers) -> list[tuple[int, int, int]]:
    n = len(text)
    if n < LENGTH:
        return []
    powers.upto(n)
    b = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(b * powers.up[:n], out=sums[1:])
    h = (sums[KMER:] - sums[:n - KMER + 1]) * powers.down[:n - KMER + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    m = (sliding_min(keys, LENGTH - KMER + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    group = m * 8 + (m - np.arange(len(m))) // CLASS
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(first, len(m)))
    distance = m[first] - first
    left = distance // CLASS * CLASS
    core = first + distance - left
    digest = xxhash.xxh3_64_intdigest
    size = LENGTH - CLASS + 1
    places = ((first + offset) << 16 | distance << 8 | count).tolist()
    return [
        (digest(text[c:c + size], o + 1), digest(text[s:s + k + LENGTH - 1], d), p)
        for s, k, d, o, c, p in zip(first.tolist(), count.tolist(), distance.tolist(), left.tolist(), core.tolist(), places)
    ]
