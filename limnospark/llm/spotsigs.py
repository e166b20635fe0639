"""Document fingerprints by SpotSigs (op 6; Theobald et al. 2008).

A spot signature is a common word (the anchor) with the chain of the content
words that follow it in its line; anchors inside the chain are passed over. The
set of signatures, hashed to 32 bits, sorted and written as hexadecimal digits, is
the fingerprint; the likeness of two fingerprints is the Jaccard coefficient
of their sets. Lines without any common word (tables, lists) take every word
as an anchor, so they are told apart as well.

:func:`near_duplicates` compares fingerprints: equal ones are one row, sets
are partitioned by their size so that only sizes within the threshold meet,
and within a partition a pair is looked at only if the sets share one of the
rare signatures that any pair above the threshold must share.

Defined cases: a null text counts as empty; the empty set's fingerprint is
"", and two empty sets have likeness 1; equal texts have equal fingerprints;
repeated keys follow each other in the order of their text's hash; null keys
come last; an empty table gives an empty table. Only key and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tasks, text_of, written
from .graph import components

ship(__name__)

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or that the their they "
    "this to was we were which will with you "
    "als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für ich im ist mit nach "
    "nicht oder sich sie sind um und von vor war werden wie wird zu zum zur über "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas "
    "plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos en es esta este fue ha la las lo los más mi muy no nos o para pero por que se sin "
    "sobre son su sus un una y ya".split()
)
CHAIN = 2
_WORD = re.compile(r"\w+")


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's spot signatures."""
    digest, anchors, out = xxhash.xxh32_intdigest, ANCHORS, set()
    for line in text.lower().split("\n"):
        words = _WORD.findall(line)
        if anchors.isdisjoint(words):
            out.update(digest(" ".join(words[k:k + chain + 1])) for k in range(len(words)))
            continue
        content, spots = [], []
        for w in words:
            if w in anchors:
                spots.append((w, len(content)))
            else:
                content.append(w)
        out.update(digest(" ".join([w, *content[at:at + chain]])) for w, at in spots)
    return np.unique(np.fromiter(out, np.uint32, len(out)))


def printed(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def read(print_: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(print_), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to the following text's
    first as many."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def edit_check(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, the following
    document being the next by descending key (the first after the last).

    Keys are cut into ranges; each range is one stream in order, closed by a
    copy of the first row of the range after it. Only range ends, one key per
    range, pass the driver; texts are shuffled once."""
    spark = docs.sparkSession
    n = tasks(spark)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("t"))
    ids = base.select("doc_id").where("doc_id is not null")
    bounds = np.unique(np.array(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [], np.int64))

    @F.arrow_udf("int")
    def part_of(k: pa.Array) -> pa.Array:
        at = len(bounds) - np.searchsorted(bounds, k.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        return pa.array(np.where(k.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, at).astype(np.int32))

    tie = F.xxhash64("t")
    first = F.min(F.struct((-F.col("doc_id")).alias("k"), tie.alias("h")))
    heads = sorted((r["p"], r["f"]["k"], r["f"]["h"]) for r in
                   base.select(part_of("doc_id").alias("p"), "doc_id", "t").groupBy("p").agg(first.alias("f")).collect())
    rows = base.select("doc_id", "t", part_of("doc_id").alias("p"), F.lit(0).alias("last"), tie.alias("h"))
    if heads:
        # One row per range: the key of the first row, to be read by the range before it.
        ends = [(heads[i - 1][0], None if k is None else -k, h) for i, (_, k, h) in enumerate(heads)]
        wanted = F.broadcast(spark.createDataFrame(ends, "p int, k long, h long"))
        found = base.join(wanted, base.doc_id.eqNullSafe(wanted.k) & (F.xxhash64(base.t) == wanted.h))
        found = found.groupBy("p").agg(F.first("doc_id").alias("doc_id"), F.first("t").alias("t"))
        rows = rows.unionByName(found.select("doc_id", "t", "p", F.lit(1).alias("last"), F.lit(0).cast("long").alias("h")))
    out = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in out.split(", ")]
        held = None  # (range, id, text, signatures) waiting for its follower
        for b in batches:
            done: list[list] = [[] for _ in names]
            size = 0
            for i, t, p, last in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                t = t.as_py()
                own = signatures(t)
                if held and held[0] == p:
                    new = edited(held[2], t)
                    sigs = signatures(new)
                    row = (held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), printed(held[3]), printed(sigs),
                           likeness(held[3], sigs), likeness(held[3], own))
                    for column, v in zip(done, row):
                        column.append(v)
                    size += 8 * (len(held[3]) + len(sigs))
                held = None if last else (p, i, t, own)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names=names)
                    done, size = [[] for _ in names], 0
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    dealt = rows.repartition(n, "p").sortWithinPartitions("p", "last", F.desc_nulls_last("doc_id"), "h")
    return dealt.mapInArrow(run, out)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the least key reachable), n_links (other sets at
    least ``threshold`` alike) for every row with a key.

    Equal sets are one row. A set offers its first ``size - ceil(threshold *
    size) + 1`` signatures, the rarest in the table first: any pair that
    reaches the threshold shares one of them. Pairs meet by signature and size
    class; sizes apart and shared places too late in both orders are pruned,
    and the Jaccard coefficient decides; signatures of one set alone are never offered."""

    @F.arrow_udf("array<long>")
    def sigs_of(column: pa.Array) -> pa.Array:
        return pa.array([signatures(t.as_py()).astype(np.int64) for t in column], pa.list_(pa.int64()))

    rows = written(docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), sigs_of(text_of(text)).alias("s")), "spots")
    named = rows.withColumn("h", F.xxhash64("s"))
    sets = written(named.groupBy("h", "s").agg(F.min("doc_id").alias("id")).select("id", "s"), "spot-sets")
    each = sets.select("id", F.explode("s").alias("sig"), F.size("s").alias("n"))
    often = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(often, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("r"))
    width = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
    offered = ranked.select("id", "n", F.posexplode(F.slice(F.col("r"), F.lit(1), width)).alias("pos", "e")).where("e.df > 1")
    step = F.lit(-float(np.log(threshold)))
    offered = offered.select("id", "n", "pos", F.col("e.sig").alias("sig"), F.floor(F.log("n") / step + 1e-9).alias("cls"))
    offered = written(offered, "spot-offers")
    # A set meets its own size class and the next larger one.
    a = offered.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), "sig", F.explode(F.array("cls", F.col("cls") + 1)).alias("cls"))
    b = offered.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "sig", "cls")
    both = a.join(b, ["sig", "cls"]).where("(na < nb) or (na = nb and a < b)").where(F.col("na") >= threshold * F.col("nb") - 1e-9)
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    need = F.lit(threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = both.where(room >= need).select("a", "b").distinct()
    x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(x, "a").join(y, "b").where(shared / (F.size("sa") + F.size("sb") - shared) >= threshold - 1e-12).select("a", "b")
    links = written(links, "spot-links")
    roots = components(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_links"))
    classes = sets.join(roots.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    classes = classes.select("s", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(classes, "s").select("doc_id", "class_id", "n_links")
