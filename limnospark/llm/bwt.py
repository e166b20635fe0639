"""Burrows-Wheeler transforms of string shards and their merge by iterative
interleave refinement (Holt & McMillan 2014; common prefixes as in Egidi &
Manzini 2017).

A string is followed by the terminator 0 and read as a circle, so the
transform's last-to-first steps are exact for collections. The merge keeps
one thing: the interleave, which says for each place of the merged order from
which shard its suffix comes. One round deals the places by the symbol before
each suffix (the shards' transforms give it), a stable counting sort; after
round t the interleave is right for the first t symbols. Places that first
part in round t + 1 have t symbols in common, which gives the common
prefixes, and the runs with ``depth`` symbols in common are the repeated
intervals. Suffixes are never compared or sorted again."""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)


class Shard:
    """Suffix order and transform of strings laid end to end."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        n = len(text)
        at = np.arange(n, dtype=np.int32)
        after = at + 1
        after[starts + lengths - 1] = starts  # the circle closes
        before = np.empty(n, np.int32)
        before[after] = at
        two = after[after]
        t = text.astype(np.uint64)
        key = t << np.uint64(48) | t[after] << np.uint64(32) | t[two] << np.uint64(16) | t[after[two]]
        order = np.argsort(key, kind="stable").astype(np.int32)
        s = key[order]
        fresh = np.concatenate([[True], s[1:] != s[:-1]])
        # A suffix's rank is the first place of its block; only blocks of several are refined.
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        ahead, depth, longest = two[two], 4, int(lengths.max(initial=0))
        while depth < longest:
            block = rank[order]
            several = np.concatenate([block[1:] == block[:-1], [False]])
            several[1:] |= several[:-1]
            places = np.flatnonzero(several)
            if not len(places):
                break
            part = order[places]
            first, second = rank[part], rank[ahead[part]]
            by = np.lexsort((second, first))
            part, first, second = part[by], first[by], second[by]
            order[places] = part
            fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            rank[part] = np.maximum.accumulate(np.where(fresh, places, 0))
            ahead, depth = ahead[ahead], 2 * depth
        self.order = order
        self.transform = text[before[order]]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order, as places in the shards' joined texts, and the
    common prefix of each place with the one before, ``depth`` at most."""
    sizes = [len(s.order) for s in shards]
    n = sum(sizes)
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    symbols = np.empty(n, np.uint16)
    common = np.zeros(n, np.int16)
    block = np.zeros(n, np.int32)
    for _ in range(depth):
        for k, s in enumerate(shards):
            symbols[source == k] = s.transform
        order = np.argsort(symbols, kind="stable")
        source, dealt, parts = source[order], symbols[order], block[order]
        part = (dealt[1:] != dealt[:-1]) | (parts[1:] != parts[:-1])
        common[1:] += ~part
        np.cumsum(part, out=block[1:])
        block[0] = 0
    merged, base = np.empty(n, np.int64), 0
    for k, s in enumerate(shards):
        merged[source == k] = s.order + base
        base += sizes[k]
    return merged, common


def repeated(strings: list[np.ndarray], windows: list[int], weights: list[int], depth: int, shards: int = 4) -> list[np.ndarray]:
    """For each string, which of its first ``windows`` suffixes share
    ``depth`` symbols with a suffix counted elsewhere; a string counts
    ``weights`` times."""
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = np.zeros(int(lengths.sum()), np.uint16)
    for s, at in zip(strings, starts):
        text[at:at + len(s)] = s
    share = -(-len(strings) // max(1, min(shards, len(strings))))
    made = []
    for k in range(0, len(strings), share):
        lo, hi = int(starts[k]), int(starts[min(k + share, len(strings)) - 1] + lengths[min(k + share, len(strings)) - 1])
        made.append(Shard(text[lo:hi], (starts[k:k + share] - lo).astype(np.int32), lengths[k:k + share].astype(np.int32)))
    merged, common = merge(made, depth)
    weight = np.zeros(len(text), np.int64)
    for at, w, c in zip(starts, windows, weights):
        weight[at:at + w] = c
    ranked = weight[merged]
    heads = np.flatnonzero(common < depth)
    total = np.add.reduceat(ranked, heads)
    hit = np.zeros(len(text), bool)
    hit[merged] = np.repeat(total > 1, np.diff(np.append(heads, len(text))))
    return [hit[at:at + w] for at, w in zip(starts.tolist(), windows)]
