"""Reproducible shuffle into shards (op 10).

Every row gets a global row number in the order of its key, a keyed Feistel
network permutes the numbers ``0 .. N-1`` (walking the cycle while a value
falls outside), and shard and slot follow from the permuted number ``p``:
``shard = p mod shards``, ``slot = p div shards``. Row counts of shards differ
by one at most. Since the permutation can be inverted, the row in a given
shard and slot can be computed as well (:func:`row_at`).

Defined cases: an empty table gives an empty table; null texts have no bytes;
null keys come first; rows with equal key and equal text are
interchangeable, each gets a number of its own. The input's other columns are
not read, so clashing names cannot occur.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf

from .common import ship, tasks, text_of, written

ship(__name__)

ROUNDS = 6
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def half_bits(n: int) -> int:
    """Bits of each Feistel half: the smallest even-width domain holding n."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    return [((seed * 2 + 1) * _GOLD * (i + 1) + (i + 1) * 0xD1B54A32D192ED03) & _MASK for i in range(ROUNDS)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64's public constants) over ``x + key``."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pass(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << b) | right


def permute(numbers: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Bijection of ``0 .. n-1``; ``back`` gives its inverse."""
    bits, keys = half_bits(n), round_keys(seed)
    out = _pass(numbers.astype(np.uint64), bits, keys, back)
    while (outside := out >= np.uint64(n)).any():  # a cycle that starts inside comes back inside
        out[outside] = _pass(out[outside], bits, keys, back)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global row number that sits in (shard, slot)."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def global_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``row_number`` 0 .. N-1 in the order of ``order`` (nulls first).

    Ranges of the order are numbered each in its own task; only one count per
    range goes to the driver. ``order`` must tell most rows apart."""
    spark = df.sparkSession
    n = tasks(spark)
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    local = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    # The ranges are written once: the counts and the numbers must come from one and the same split.
    kept = written(ranged.withColumn("_local", local), "ranges")
    counts = sorted((r["_range"], r["n"]) for r in kept.groupBy("_range").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for k, c in counts:
        starts.append((k, at))
        at += c
    offsets = spark.createDataFrame(starts, "_range int, _start long")
    out = kept.join(F.broadcast(offsets), "_range").withColumn("row_number", F.col("_start") + F.col("_local") - 1)
    out = out.drop("_range", "_local", "_start")
    out._limno_rows = at
    return out


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row."""
    body = text_of(text)
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        # Rows alike in all three are interchangeable; this only lets a large group of them be split.
        F.monotonically_increasing_id().alias("_tie"),
    )
    numbered = global_numbers(slim, ["doc_id", "text_crc32", "size", "_tie"])
    n = numbered._limno_rows

    @pandas_udf(T.LongType())
    def permuted(s):
        return type(s)(permute(s.to_numpy(), n, seed))

    return numbered.withColumn("_p", permuted("row_number")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.expr(f"cast(_p % {shards} as int)").alias("shard"),
        F.expr(f"_p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
