"""Periodic runs of words, found on a grammar (op 12).

The word ids of each document are compressed by Re-Pair (Larsson & Moffat
2000): again and again a repeated pair of neighbouring symbols becomes a new
nonterminal. Pairs are replaced in rounds, all documents of a portion at once:
in a round a pair's place is taken if no overlapping pair is more frequent
(equals by their ids), so that the most frequent pair is always replaced
whole. What is left of a document, its start rule, is paired up as a balanced
tree. A nonterminal stands for a stretch of the text, so it is held as its
first place (start, boundary between its two halves, end) and the places of
all its occurrences: the places where it was put in.

A run (a stretch of smallest period q, at least ``exponent * q`` and ``least``
words long, that no neighbour extends) crosses the boundary of the lowest
derivation node that holds it. So each nonterminal's boundary is looked at
once, in its first place: as one of its sides has at least half of the run, a
period is the distance of the pair of words next to the boundary from an
earlier (left side) or later (right side) occurrence of that pair. Fingerprints
of word stretches check two periods and give how far the period goes to either
side; of several periods of one stretch the least is the run's; what is found
is then compared word by word. Runs are translated to all places of their
nonterminal; of a document's stretches with one period those inside another
are dropped, which leaves the maximal ones.

Scale. A map over the documents, without a shuffle; a task holds a portion of
about ``PORTION`` bytes of text, or one longer document. Time is about
n log n in a document's words, whatever they are.

Defined cases: a null or empty text has no word and no run; a null key is kept
and its text is taken as it is; repeated rows are independent of one another;
an empty table gives an empty table. Only key and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import portions
from .common import ship, text_of
from .pfor import spread

ship(__name__)

PORTION = 1 << 21
LEAST = 6
EXPONENT = 4
#: Candidate periods that are checked at once.
MANY = 1 << 20
# Primes below 2**31 and bases of the fingerprints.
FIELDS = ((2147483647, 911382323), (2147483629, 972663749))


@dataclass
class Rules:
    """Nonterminals: start, boundary and end of the first place, and the
    starts of all places (``where``, grouped by ``rule``)."""

    start: np.ndarray
    mid: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    where: np.ndarray


def re_pair(words: np.ndarray, doc: np.ndarray) -> Rules:
    """Grammar of a portion. ``words``: ids from 0; ``doc``: document of each
    word, ascending. Pairs never cross documents."""
    n = len(words)
    sym = words.astype(np.int64)
    fresh = int(sym.max(initial=-1)) + 1
    # A symbol's place is its first word; n stands for none.
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if n else np.zeros(0, np.int64)
    last_of = np.repeat(last, np.diff(np.concatenate([[-1], last])))
    made: list[tuple[np.ndarray, ...]] = []  # (start, mid, end) of first places, and all places with their rule
    rules = 0

    def put(at: np.ndarray, group: np.ndarray) -> None:
        """The pairs at ``at`` become nonterminals, one per ``group``."""
        nonlocal fresh, rules
        mid = nxt[at]
        end = nxt[mid]
        groups, first, rule = np.unique(group, return_index=True, return_inverse=True)
        made.append((at[first], mid[first], end[first], rule + rules, at))
        rules += len(groups)
        sym[at] = fresh + rule
        fresh += len(groups)
        nxt[at] = end
        inside = end < n
        prv[end[inside]] = at[inside]

    def has_next(at: np.ndarray) -> np.ndarray:
        return nxt[at] <= last_of[at]

    live = np.flatnonzero(np.arange(n) < last_of)
    weight = np.zeros(n + 1, np.int64)
    while len(live):
        # Rules are a document's own: its number is part of the pair.
        left, right = sym[live], sym[nxt[live]]
        if (int(doc[-1]) + 1) * fresh * fresh >= 1 << 62:
            _, left = np.unique(left * (int(doc[-1]) + 1) + doc[live], return_inverse=True)
            key = left * fresh + right
        else:
            key = (doc[live] * fresh + left) * fresh + right
        _, kind, times = np.unique(key, return_inverse=True, return_counts=True)
        often = times[kind] > 1
        live, kind = live[often], kind[often]
        if not len(live):
            break
        w = times[kind] * len(times) + kind + 1
        weight[live] = w
        before, after = prv[live], nxt[live]
        own_before = (before >= 0) & (doc[np.maximum(before, 0)] == doc[live])
        wb = np.where(own_before, weight[np.maximum(before, 0)], 0)
        wa = weight[after]
        # Places of one pair that overlap (a a a): every second from the first.
        chained = np.concatenate([[False], (live[1:] == after[:-1]) & (kind[1:] == kind[:-1])])
        head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(live))))
        even = (np.arange(len(live)) - head) % 2 == 0
        taken = even & (wb <= w) & (wa <= w)
        weight[live] = 0
        at, group = live[taken], kind[taken]
        gone = nxt[at]
        put(at, group)
        alive = np.ones(len(live), bool)
        alive[taken] = False
        alive[np.isin(live, gone, assume_unique=True)] = False
        pb = prv[at]
        pb = pb[(pb >= 0) & (doc[np.maximum(pb, 0)] == doc[at])]
        live = np.unique(np.concatenate([live[alive], at[has_next(at)], pb]))
    # Start rules: neighbours are paired up until a document is one symbol.
    top = _tops(nxt, n)
    while len(top):
        place = np.arange(len(top)) - np.searchsorted(doc[top], doc[top])
        pairs = top[(place % 2 == 0) & has_next(top)]
        if not len(pairs):
            break
        put(pairs, np.arange(len(pairs)))
        top = top[place % 2 == 0]
    parts = [np.concatenate(c) for c in zip(*made)] if made else [np.zeros(0, np.int64)] * 5
    return Rules(*parts)


def _tops(nxt: np.ndarray, n: int) -> np.ndarray:
    """Places of the symbols that are left, in order: a symbol that was put in
    covers the places up to the next one."""
    if not n:
        return np.zeros(0, np.int64)
    # The symbol at i is left iff no earlier one that is left covers it; the
    # places covered by any symbol's later halves are those inside [i+1, nxt).
    inside = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(nxt > np.arange(1, n + 1))
    np.add.at(inside, long + 1, 1)
    np.add.at(inside, nxt[long], -1)
    return np.flatnonzero(np.cumsum(inside[:n]) == 0)


class Fingerprints:
    """Equality of stretches by two polynomial sums, each modulo a prime."""

    def __init__(self, words: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in FIELDS:
            power = np.ones(1, np.uint64)
            step = np.uint64(base)
            while len(power) <= len(words):
                power = np.concatenate([power, power * step % np.uint64(prime)])
                step = step * step % np.uint64(prime)
            power = power[:len(words) + 1]
            term = (words.astype(np.uint64) + np.uint64(1)) * power[:-1] % np.uint64(prime)
            # Terms below 2**31: no overflow up to 2**33 words.
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)]) % np.uint64(prime))
            self.powers.append(power)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """words[a:a+length] == words[b:b+length], for a <= b."""
        out = np.ones(len(a), bool)
        for (prime, _), s, power in zip(FIELDS, self.sums, self.powers):
            p = np.uint64(prime)
            x = (s[a + length] + p - s[a]) % p * power[b - a] % p
            out &= x == (s[b + length] + p - s[b]) % p
        return out

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a and b on are equal, ``most`` at most (a < b)."""
        return self._longest(a, b, most, lambda n: (a, b, n))

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before a and b are equal, ``most`` at most (a < b)."""
        return self._longest(a, b, most, lambda n: (a - n, b - n, n))

    def _longest(self, a, b, most, stretch) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(*stretch(mid))
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def candidates(rules: Rules, pair: np.ndarray, side: int, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rule, period) to be checked, ``MANY`` at a time: distances between the
    pair of words next to a rule's boundary (``side`` -1: before it, 1: after)
    and other places of that pair inside the rule. ``pair``: id of the pair of
    words at each place, -1 at a document's end."""
    n = len(pair)
    order = np.argsort(pair, kind="stable")
    place = pair[order] * (n + 1) + order  # ascending
    long = np.flatnonzero(rules.end - rules.start >= least)
    s, m, e = rules.start[long], rules.mid[long], rules.end[long]
    room = (e - s) // exponent
    if side < 0:
        own = m - 2
        ok = own >= s
        most = np.minimum(room, (m - s) // 2)
        low, high = own - most, own - 1
    else:
        own = m
        ok = own + 1 < e
        most = np.minimum(room, (e - m) // 2)
        low, high = own + 1, own + most
    ok &= most > 0
    long, own, low, high = long[ok], own[ok], low[ok], high[ok]
    group = pair[own] * (n + 1)
    a, z = np.searchsorted(place, group + low), np.searchsorted(place, group + high, "right")
    counts = z - a
    some = counts > 0
    long, own, a, counts = long[some], own[some], a[some], counts[some]
    cut = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(long):
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + MANY, "right")) - 1)
        c = counts[at:to]
        other = order[spread(a[at:to], c)]
        yield np.repeat(long[at:to], c), np.abs(other - np.repeat(own[at:to], c))
        at = to


def crossing(rules: Rules, words: np.ndarray, pair: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, ...]:
    """Runs that cross a nonterminal's boundary, in its first place: rule,
    start, end, period."""
    marks = Fingerprints(words)
    found = []
    for side in (-1, 1):
        for rule, q in candidates(rules, pair, side, least, exponent):
            s, m, e = rules.start[rule], rules.mid[rule], rules.end[rule]
            twice = marks.equal(m - 2 * q, m - q, q) if side < 0 else marks.equal(m, m + q, q)
            rule, q, s, m, e = rule[twice], q[twice], s[twice], m[twice], e[twice]
            if side < 0:
                left = m - q - marks.backward(m - q, m, m - q - s)
                right = m + marks.forward(m - q, m, e - m)
                over = right > m
            else:
                left = m - marks.backward(m, m + q, m - s)
                right = m + q + marks.forward(m, m + q, e - m - q)
                over = left < m
            ok = over & (right - left >= np.maximum(least, exponent * q))
            found.append((rule[ok], left[ok], right[ok], q[ok]))
    rule, left, right, q = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    # A stretch that has several periods has the least one.
    order = np.lexsort((q, right, left, rule))
    rule, left, right, q = rule[order], left[order], right[order], q[order]
    again = np.concatenate([[False], (rule[1:] == rule[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])]) if len(rule) else np.zeros(0, bool)
    rule, left, right, q = rule[~again], left[~again], right[~again], q[~again]
    verify(words, left, right, q)
    return rule, left, right, q


def verify(words: np.ndarray, left: np.ndarray, right: np.ndarray, q: np.ndarray) -> None:
    """Word by word: fingerprints must not have been alike by chance."""
    for at in range(0, len(left), 1 << 14):
        part = slice(at, at + (1 << 14))
        x = spread(left[part], right[part] - left[part] - q[part])
        if (words[x] != words[x + np.repeat(q[part], right[part] - left[part] - q[part])]).any():
            raise ArithmeticError("two stretches with one fingerprint: choose other bases")


def runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs of a portion, by (start, period)."""
    if exponent < 4 or least < 6:
        raise ValueError("the search by the longer side needs 4 periods and 6 words at least")
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    rules = re_pair(words, doc)
    pair = words[:-1].astype(np.int64) * (int(words.max()) + 1) + words[1:]
    _, pair = np.unique(pair, return_inverse=True)
    # Places inside a rule are in one document, so pairs across documents and the last place are never met.
    rule, left, right, q = crossing(rules, words, np.append(pair, pair.max() + 1), least, exponent)
    # To all places of the nonterminal.
    order = np.argsort(rules.rule, kind="stable")
    per = np.bincount(rules.rule, minlength=len(rules.start))
    begin = np.cumsum(per) - per
    times = per[rule]
    where = rules.where[order[spread(begin[rule], times)]]
    shift = where - np.repeat(rules.start[rule], times)
    left, right, q = np.repeat(left, times) + shift, np.repeat(right, times) + shift, np.repeat(q, times)
    # Of one period, what lies inside another goes.
    order = np.lexsort((-right, left, q))
    left, right, q = left[order], right[order], q[order]
    _, rank = np.unique(q, return_inverse=True)
    reach = np.maximum.accumulate(right + rank * (n + 1)) if len(q) else none
    keep = np.concatenate([[True], right[1:] + rank[1:] * (n + 1) > reach[:-1]]) if len(q) else np.zeros(0, bool)
    left, right, q = left[keep], right[keep], q[keep]
    order = np.lexsort((q, left))
    return left[order], right[order], q[order]


def stretched(n: int, key: int | None, share: int) -> np.ndarray | None:
    """Places of the words of a document that is made periodic, or None: those
    whose hash is a multiple of ``share`` repeat a stretch from some word on."""
    if key is None or not n or not share:
        return None
    h = zlib.crc32(str(key).encode())
    if h % share:
        return None
    g = h // share
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def describe(keys: list, texts: list[str], share: int) -> list[dict]:
    ids: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next number
    split, flat, sizes = [], [], []
    for key, text in zip(keys, texts):
        w = text.encode().split()  # bytes are split at the blanks of ASCII
        own = np.fromiter(map(ids.__getitem__, w), np.int64, len(w))
        order = stretched(len(w), key, share)
        if order is not None:
            own, w = own[order], [w[i] for i in order.tolist()]
        split.append(w)
        flat.append(own)
        sizes.append(len(w))
    words = np.concatenate([np.zeros(0, np.int64), *flat])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left, right, q = runs(words, doc)
    base = np.cumsum([0, *sizes])
    at = np.searchsorted(left, base)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, left + q, 1)
    np.add.at(drop, right, -1)
    kept = np.cumsum(drop[:-1]) == 0
    out = []
    for i, key in enumerate(keys):
        a, z = at[i], at[i + 1]
        s, length, p = left[a:z] - base[i], right[a:z] - left[a:z], q[a:z]
        row = dict(doc_id=key, n_runs=int(z - a), start=None, length=None, period=None, exponent_milli=None)
        w = split[i]
        if z > a:
            best = int(np.argmax(length))  # the first of equals: by start, then period
            row |= dict(start=int(s[best]), length=int(length[best]), period=int(p[best]), exponent_milli=1000 * int(length[best]) // int(p[best]))
            w = [w[k] for k in np.flatnonzero(kept[base[i]:base[i + 1]]).tolist()]
        listed = "".join(f"{x},{y},{v}\n" for x, y, v in zip(s.tolist(), length.tolist(), p.tolist()))
        row["runs_sha256"] = hashlib.sha256(listed.encode()).hexdigest()
        row["collapsed_sha256"] = hashlib.sha256(b" ".join(w)).hexdigest()
        out.append(row)
    return out


def report(df: DataFrame, key: str = "doc_id", text: str = "text", share: int = 10, portion: int = PORTION) -> DataFrame:
    """A document's runs: their number, the longest, digests of all and of the
    text without what runs repeat. ``share``: one document in so many (by the
    hash of its key) is made periodic first; 0: none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 1, portion):
                rows = describe(part.column(0).to_pylist(), part.column(1).to_pylist(), share)
                yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array([r[c.split()[0]] for r in rows], pa.string() if c.endswith("string") else pa.int64())
                                                  for c in COLUMNS.split(", ")})

    return df.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t")).mapInArrow(task, COLUMNS)
