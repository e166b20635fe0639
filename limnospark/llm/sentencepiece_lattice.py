"""SentencePiece encoding and decoding on a relational lattice (op 4).

A text is read as SentencePiece reads it with the identity normaliser: a
space is put in front, spaces become U+2581. It falls into *words* wherever
no piece of the model holds the two neighbouring characters together; no
piece and no merge can cross such a place, so words are encoded by themselves
and each different word once.

1. Documents are packed into compressed blocks of bounded size; the different
   words of each block are listed.
2. Lattice: the different words of all blocks are exploded into their
   substrings of bounded length and equi-joined to the piece table (its size
   is the vocabulary's, checked before it is broadcast); the edges found are
   grouped by word.
3. Fold: a higher-order ``aggregate`` over a word's edges gives its pieces.
   ``unigram`` models take the best-scoring path (Viterbi). The models at hand
   are ``bpe`` models, whose encoding is *not* the best-scoring path but the
   outcome of merging the best-ranked neighbours first. All that merging can
   touch are edges of the same lattice, so for them the fold holds the set of
   boundaries as bits and takes the edges best first; one that covers exactly
   two symbols merges them. Where an edge covers more at its turn, it may have
   to merge later: such words are folded again, each step taking the best edge
   that covers two symbols. The outcome equals the library's.
4. The words and their boundaries go back to the blocks that hold them, and
   each block is encoded by lookup. Characters that are no piece become byte
   pieces.

Words over ``LONGEST`` characters are parted by the same rules in a task, since
the bit set ends there. Decoding joins pieces and byte pieces and takes the
first space away; a text's own U+2581 comes back as a space, as it does in the
library.

Defined cases: a null or empty text has no tokens; repeated rows are encoded
row by row; null keys stay null; an empty table gives an empty table. The
input's other columns are not read."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, tasks, text_of

ship(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 14 << 20
LONGEST = 60
MOST_PIECES = 2_000_000
SPACE = "▁"
_WORD = re.compile(r" +[^ ]*|[^ ]+")


class Model:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int, kind: str):
        self.kind, self.unknown, self.byte_ids = kind, unknown, byte_ids
        special = set(byte_ids.values())
        self.pieces = {p: (i, s) for i, (p, s) in enumerate(zip(pieces, scores)) if p is not None and i not in special}
        self.longest = max(map(len, self.pieces), default=1)
        # Cost of a character that is no piece, for unigram models.
        self.worst = 10.0 - min([s for p, (_, s) in self.pieces.items() if len(p) == 1], default=0.0)
        multi = [p for p in self.pieces if len(p) > 1]
        self.chars = "".join(sorted(set("".join(multi))))
        self.pairs = sorted({a + b for p in multi for a, b in zip(p, p[1:])})
        self.bytes_of = [b"" if p is None else p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in byte_ids.items():
            self.bytes_of[i] = bytes([b])

    @staticmethod
    def load(path: str = MODEL, kind: str = "bpe") -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > MOST_PIECES:
            raise ValueError(f"{n} pieces; the table is broadcast up to {MOST_PIECES}")
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        pieces = [None if odd(i) else sp.id_to_piece(i) for i in range(n)]
        return Model(pieces, [sp.get_score(i) for i in range(n)], byte_ids, sp.unk_id(), kind)

    def edges(self, spark: SparkSession) -> DataFrame:
        """The pieces of two characters or more: (piece, cost, rank); equal
        costs have equal ranks."""
        costs = {p: -float(s) for p, (_, s) in self.pieces.items() if len(p) > 1}
        rank = {c: i for i, c in enumerate(sorted(set(costs.values())))}
        return spark.createDataFrame([(p, c, rank[c]) for p, c in costs.items()], "piece string, cost double, rank long")


class Cutter:
    """Cuts space-led words into words of the lattice."""

    def __init__(self, model: Model):
        self.klass = np.zeros(0x110000, np.uint16)
        self.klass[[ord(c) for c in model.chars]] = np.arange(1, len(model.chars) + 1)
        self.joined = np.zeros((len(model.chars) + 1,) * 2, bool)
        for p in model.pairs:
            self.joined[self.klass[ord(p[0])], self.klass[ord(p[1])]] = True
        # A mark between words: a character that no piece joins to another.
        self.mark = next(c for c in map(chr, range(1, 0x110000)) if c not in model.chars)

    def __call__(self, keys: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """For some keys at a time: their lattice words end to end, and where
        each key's words end. A key is a space-led word without its first
        space."""
        for at in range(0, len(keys), 1 << 14):
            part = keys[at:at + (1 << 14)]
            line = (" " + f"{self.mark} ".join(part)).replace(" ", SPACE) + self.mark
            k = self.klass[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)]
            bounds = np.concatenate([[0], np.flatnonzero(~self.joined[k[:-1], k[1:]]) + 1, [len(line)]])
            # Each key's mark is a word of its own, at the place that its length gives.
            marks = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 2) - 1
            ends = np.searchsorted(bounds, marks)
            bounds = bounds.tolist()
            yield [line[a:b] for a, b in zip(bounds, bounds[1:])], ends.tolist()


def pack(docs: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
    """(block, blob): documents dealt over ``blocks``, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 7919
        zip_ = zstandard.ZstdCompressor(3)
        for b in batches:
            # Whole batches are dealt over the blocks row by row.
            own = (at + np.arange(len(b))) % blocks
            at += len(b)
            for k in np.unique(own):
                part = b.take(pa.array(np.flatnonzero(own == k)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([zip_.compress(sink.getvalue())], pa.binary())], names=["block", "blob"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("t"))
    return slim.mapInArrow(run, "block int, blob binary").repartition(blocks, "block")


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def keys_of(text: str) -> list[str]:
    """A text's space-led words (the put-in space first), each without its
    first space; further spaces stay with the word after them."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " ":
        return [w[1:] for w in _WORD.findall(" " + text)]
    return text.split(" ")


def block_words(packed: DataFrame, model: Model) -> DataFrame:
    """(block, word): different lattice words of two characters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(model)

        def listed(k: int, have: set[str]) -> Iterator[pa.RecordBatch]:
            words: set[str] = set()
            for subs, _ in cutter(list(have)):
                words.update(subs)
            have.clear()
            out = [w for w in words if 1 < len(w) <= LONGEST]
            for at in range(0, len(out), 50_000):
                part = out[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.int32()), pa.array(part, pa.string())], names=["block", "word"])

        now, have = None, set()  # blobs come block by block: one block's words are held
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if k != now and have:
                    yield from listed(now, have)
                now = k
                for t in unpack(blob.as_buffer().to_pybytes()).column("t"):
                    have.update(keys_of(t.as_py()))
        if have:
            yield from listed(now, have)

    return packed.sortWithinPartitions("block").mapInArrow(run, "block int, word string")


#: An edge as it is held for merging: rank, place and length in one number, so
#: that edges sort best first, the leftmost of equals; and for least cost.
BY_RANK = "shiftleft(rank, 12) | shiftleft(cast(at as long), 6) | cast(k as long)"
BY_COST = "struct(cost, at, k)"


def lattice(words: DataFrame, pieces: DataFrame, longest: int, edge: str) -> DataFrame:
    """words (word, distinct) -> (word, edges): an ``edge`` is a piece of two
    characters or more that lies in the word; they are sorted. Words without
    edges are left out."""
    n = F.char_length("word")
    at = words.select("word", F.explode(F.sequence(F.lit(1), n - 1)).alias("at"), n.alias("n"))
    subs = at.select("word", "at", F.explode(F.sequence(F.lit(2), F.least(F.lit(max(2, longest)), F.col("n") - F.col("at") + 1))).alias("k"))
    subs = subs.withColumn("piece", F.expr("substring(word, at, k)"))
    found = subs.join(F.broadcast(pieces), "piece")
    return found.groupBy("word").agg(F.sort_array(F.collect_list(F.expr(edge))).alias("edges"))


def fold_merges(edges: str = "edges", word: str = "word") -> Column:
    """Boundaries of a bpe word's pieces, by merging the edges ``BY_RANK``.
    The accumulator is the set of boundaries; bit i stands before character i.

    An edge whose ends are no boundaries cannot merge any more, since
    boundaries only go. So edges are taken once, best first, unless one finds
    more than two symbols within its ends at its turn (bit 62): then every
    step looks for the best edge anew."""
    at, k = "cast(shiftright(e, 6) & 63L as int)", "cast(e & 63L as int)"
    ends = f"shiftleft(shiftleft(1L, {k}) | 1L, {at} - 1)"
    inner = f"shiftleft(shiftleft(1L, {k} - 1) - 1L, {at})"
    every = f"shiftleft(1L, char_length({word}) + 1) - 1L"
    return F.expr(f"""
        aggregate({edges}, {every},
          (cuts, e) -> if((cuts & {ends}) = {ends},
            if(bit_count(cuts & {inner}) = 1, cuts & ~{inner}, cuts | shiftleft(1L, 62)), cuts),
          once -> if((once & shiftleft(1L, 62)) = 0, once, aggregate(
            sequence(1, least(char_length({word}) - 1, size({edges}))), {every},
            (cuts, _) -> cuts & ~coalesce(get(transform(
              filter({edges}, e -> (cuts & {ends}) = {ends} AND bit_count(cuts & {inner}) = 1), e -> {inner}), 0), 0L))))""")


def fold_viterbi(singles: Column, edges: str = "edges", word: str = "word") -> Column:
    """Boundaries (bits) of a unigram word's pieces along its path of least
    cost. ``singles``: cost of each character by itself, as an array. The
    accumulator holds for every
    place the cost so far and the edge (at, k) that ends there."""
    step = F.col(edges)

    def places(best: Column, i: Column) -> Column:
        own = F.struct((F.element_at(best, i)["cost"] + F.element_at(singles, i)).alias("cost"), i.alias("at"), F.lit(1).alias("k"))
        ending = F.transform(F.filter(step, lambda e: e["at"] + e["k"] == i + 1), lambda e: F.struct(
            (F.element_at(best, e["at"])["cost"] + e["cost"]).alias("cost"), e["at"].alias("at"), e["k"].alias("k")))
        return F.concat(best, F.array(F.array_min(F.concat(F.array(own), ending))))

    zero = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("at"), F.lit(0).alias("k")))
    best = F.aggregate(F.sequence(F.lit(1), F.char_length(word)), zero, places)
    none = F.array().cast("array<struct<cost:double,at:int,k:int>>")
    back = F.aggregate(
        F.sequence(F.lit(1), F.char_length(word)),
        F.struct((F.char_length(word) + 1).alias("to"), none.alias("path"), best.alias("best")),
        lambda acc, _: F.when(acc["to"] <= 1, acc).otherwise(F.struct(
            F.element_at(acc["best"], acc["to"])["at"].alias("to"),
            F.concat(F.array(F.element_at(acc["best"], acc["to"])), acc["path"]).alias("path"), acc["best"].alias("best"))),
        lambda acc: acc["path"])
    every = F.expr(f"shiftleft(1L, char_length({word}) + 1) - 1L")
    one = F.lit(1).cast("long")
    inner = lambda e: F.call_function("shiftleft", F.call_function("shiftleft", one, e["k"] - 1) - one, e["at"])
    return F.aggregate(back, every, lambda cuts, e: cuts.bitwiseAND(F.bitwise_not(inner(e))))


def parted(word: str, cuts: int) -> list[str]:
    """The word's pieces, from the boundaries of :func:`fold_merges`."""
    cuts = cuts >> 1 & (1 << len(word) - 1) - 1  # those inside the word
    if not cuts:
        return [word]
    out, at = [], 0
    while cuts:
        end = (cuts & -cuts).bit_length()
        out.append(word[at:end])
        at, cuts = end, cuts & cuts - 1
    out.append(word[at:])
    return out


def merge_word(word: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    """The merge rule for a word of any length: its pieces."""
    n = len(word)
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (p := pieces.get(word[a:b + size[b]])):
            heapq.heappush(heap, (-p[1], a, size[a], size[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, left, right = heapq.heappop(heap)
        b = a + left
        if size[a] != left or b >= n or size[b] != right or after[a] != b:
            continue
        size[a], size[b], after[a] = left + right, 0, after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(word[a:a + size[a]])
        a = after[a]
    return out


def viterbi_word(word: str, pieces: dict[str, tuple[int, float]], longest: int, worst: float) -> list[str]:
    """The least-cost path for a word of any length: its pieces."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[end - 1][0] + worst, end - 1)] if word[end - 1] not in pieces else []
        for at in range(max(0, end - longest), end):
            if p := pieces.get(word[at:end]):
                ways.append((best[at][0] - p[1], at))
        best.append(min(ways))
    out, end = [], len(word)
    while end:
        out.append(word[best[end][1]:end])
        end = best[end][1]
    return out[::-1]


class Numbered(dict):
    """Numbers keys in the order of their first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Spelt(dict):
    """Word -> ids as bytes; ``spell`` gives those of a word not seen yet."""

    def __init__(self, spell):
        self.spell = spell

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.spell(word)
        return ids


def encoded_blocks(packed: DataFrame, table: DataFrame, model: Model) -> DataFrame:
    """packed (block, blob), table (block, word, cuts) -> the documents.

    A text is read once, into the numbers of its keys; a key is spelt once,
    into a stretch of one array of ids; a text's ids are its keys' stretches."""

    kept: list[Cutter] = []  # one per task, for all its blocks

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not kept:
            kept.append(Cutter(model))
        cutter, pieces = kept[0], model.pieces
        code = {p: i.to_bytes(4, "little") for p, (i, _) in pieces.items()}
        spell = model.bytes_of
        # Ids in pieces that do not decode to themselves.
        strange = {i for p, (i, _) in pieces.items() if spell[i] != p.replace(SPACE, " ").encode("utf-8", "surrogatepass")}

        def other(c: str) -> bytes:
            """A character that is no piece."""
            raw = c.encode("utf-8", "surrogatepass")
            ids = [model.byte_ids[b] for b in raw] if model.byte_ids else [model.unknown]
            if b"".join([spell[i] for i in ids]) != c.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                strange.update(ids)
            return code.setdefault(c, b"".join(i.to_bytes(4, "little") for i in ids))

        def spell_out(parts) -> bytes:
            return b"".join([code.get(p) or other(p) for p in parts])

        def sub(w: str) -> bytes:
            if len(w) > LONGEST:
                parts = merge_word(w, pieces) if model.kind == "bpe" else viterbi_word(w, pieces, model.longest, model.worst)
            else:  # no piece of two characters lies in it
                parts = w
            return spell_out(parts)

        numbers, seen, out = Numbered(), [], [[], [], []]
        sight = numbers.__getitem__
        for blob in left.column("blob"):
            part = unpack(blob.as_buffer().to_pybytes())
            out[0] += part.column("doc_id").to_pylist()
            for t in part.column("t"):
                t = t.as_py()
                words = keys_of(t)
                out[1].append(len(t))
                out[2].append(len(words))
                seen.append(np.fromiter(map(sight, words), np.int32, len(words)))
        keys = list(numbers)
        numbers.clear()
        seen = np.concatenate([*seen, np.zeros(0, np.int32)])
        known = Spelt(sub)
        for words in right.select(["word", "cuts"]).to_batches(1 << 16):
            for w, cuts in zip(words.column(0).to_pylist(), words.column(1).to_pylist()):
                known[w] = spell_out(parted(w, cuts))
        del right
        flat, sizes = [], []
        for subs, ends in cutter(keys):
            codes = list(map(known.__getitem__, subs))
            for end in ends:
                codes[end] = b""  # a key's mark
            upto = np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))
            sizes.append((np.diff(upto[ends], prepend=0) // 4).astype(np.int32))
            flat.append(np.frombuffer(b"".join(codes), np.int32))
        known.clear()
        flat, sizes = np.concatenate([*flat, np.zeros(0, np.int32)]), np.concatenate([*sizes, np.zeros(0, np.int32)])
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        # Decoding is word by word, so a text comes back whole if its words do,
        # and a word does if each of its pieces does.
        broken = np.zeros(len(keys), bool)
        for k in np.unique(np.searchsorted(first, np.flatnonzero(np.isin(flat, list(strange))), "right") - 1) if strange else ():
            ids = flat[first[k]:first[k] + sizes[k]].tolist()
            broken[k] = b"".join([spell[i] for i in ids]) != (" " + keys[k]).encode("utf-8", "surrogatepass")
        del keys
        stop = np.cumsum([0, *out[2]])  # keys before each document's end

        def sums(of_key: np.ndarray) -> np.ndarray:
            """Sums over the keys before each document's end."""
            return np.concatenate([[0], np.cumsum(of_key[seen], dtype=np.int32)])[stop]

        total = sums(sizes)
        values, at = np.empty(total[-1], np.int32), 0
        for i in range(0, len(seen), 1 << 16):
            own = seen[i:i + (1 << 16)]
            n = sizes[own]
            ends = np.cumsum(n)
            values[at:at + ends[-1]] = flat[np.repeat(first[own] - ends + n, n) + np.arange(ends[-1])]
            at += ends[-1]
        whole = np.diff(sums(broken)) == 0
        lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(values))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(np.diff(total), pa.int64()), lists, pa.array(whole)],
                        names=["doc_id", "n_chars", "n_tokens", "token_ids", "round_trip"])

    return packed.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(
        run, "doc_id long, n_chars long, n_tokens long, token_ids array<int>, round_trip boolean")


def encode(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_chars, n_tokens, token_ids, and whether decoding the ids
    gives the text again."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    packed = pack(docs, key, text, max(1, -(-size // block)))
    # Dealt by word once: the different words and the join below share that.
    listed = block_words(packed, model).repartition(tasks(spark), "word")
    each = listed.groupBy("word").agg(F.min("block").alias("in"))  # both columns, so that the exchange is the same
    words = lattice(each.where("in >= 0"), model.edges(spark), model.longest, BY_RANK if model.kind == "bpe" else BY_COST)
    if model.kind == "bpe":
        cuts = fold_merges()
    else:
        costs = {c: -s for c, (_, s) in model.pieces.items() if len(c) == 1}
        prices = F.create_map(*[F.lit(x) for kv in costs.items() for x in kv]) if costs else F.create_map().cast("map<string,double>")
        single = F.transform(F.split("word", ""), lambda c: F.coalesce(F.element_at(prices, c), F.lit(model.worst)))
        words, cuts = words.withColumn("_costs", single), fold_viterbi(F.col("_costs"))
    table = words.select("word", cuts.alias("cuts"))
    return encoded_blocks(packed, listed.join(table, "word").select("block", "word", "cuts"), model)


def decode(df: DataFrame, model: Model, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids; null ids give a null text."""
    spell = model.bytes_of

    @F.arrow_udf("string")
    def text_of_ids(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b"".join(spell[i] for i in x)[1:].decode("utf-8", "replace")
                         for x in column.to_pylist()], pa.string())

    return df.withColumn(name, text_of_ids(ids))
