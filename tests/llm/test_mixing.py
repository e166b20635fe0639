"""Op 5: budgets against plain water-filling, prefixes against sorting."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from limnospark.llm import mixing, queries
from limnospark.llm.common import load


def fill(budget, caps, weights):
    """Shares by weight, none above its cap, by repeated passes."""
    got, open_, left = [0.0] * len(caps), [i for i, w in enumerate(weights) if w > 0], budget
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if got[i] + left * weights[i] / total >= caps[i] - 1e-12]
        if not full:
            for i in open_:
                got[i] += left * weights[i] / total
            return got
        for i in full:
            left -= caps[i] - got[i]
            got[i] = caps[i]
        open_ = [i for i in open_ if i not in full]
    return got


def slow_budgets(leaves, weights, total, epochs):
    def split(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        kids = sorted({k[:len(prefix) + 1] for k in leaves if k[:len(prefix)] == prefix})
        caps = [sum(v * epochs for k, v in leaves.items() if k[:len(kid)] == kid) for kid in kids]
        out = {}
        for kid, b in zip(kids, fill(budget, caps, [weights.get("/".join(kid), 1.0) for kid in kids])):
            out.update(split(kid, b))
        return out

    return split((), min(total, sum(leaves.values()) * epochs))


@pytest.mark.parametrize("share, epochs", [(0.1, 1), (0.5, 1), (0.9, 3), (2.5, 3), (9.0, 2)])
def test_budgets(spark, share, epochs):
    leaves = {("a", "en", "s1"): 1000, ("a", "en", "s2"): 10, ("a", "de", "s1"): 300, ("b", "en", "s3"): 50, ("b", "fr", "s3"): 0,
              ("c", "en", "s4"): 700, ("c", "en", "s5"): 700}
    weights = {"a": 1.0, "b": 5.0, "c": 2.0, "a/de": 3.0, "c/en/s5": 0.0}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], [*mixing.LEVELS, "tokens"])
    total = sum(leaves.values())
    # A leaf of weight 0 still counts in its parents' capacity, as any shortage would.
    got = {tuple(r[c] for c in mixing.LEVELS): r["budget"] for r in mixing.budgets(df, F.col("all_tokens") * share, weights, epochs).collect()}
    want = slow_budgets(leaves, weights, total * share, epochs)
    assert got == pytest.approx(want, abs=1e-6)


def slow_mix(spark, rows, weights, share, epochs, seed):
    """rows: (key, text, leaf)."""
    words = [len((t or "").split()) for _, t, _ in rows]
    leaves = defaultdict(int)
    for (_, _, leaf), n in zip(rows, words):
        leaves[leaf] += n
    budgets = slow_budgets(leaves, weights, sum(words) * share, epochs)
    keys = [(seed, e, k, zlib.crc32((t or "").encode())) for k, t, _ in rows for e in range(1, epochs + 2)]
    table = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i long, s int, e long, k long, c long")
    hashes = {r["i"]: r["h"] for r in table.select("i", F.xxhash64("s", "e", "k", "c").alias("h")).collect()}
    out = []
    for leaf, tokens in leaves.items():
        budget = int(budgets[leaf] + 1e-9)
        whole = min(budget // tokens, epochs) if tokens else 0
        rest = budget - whole * tokens
        mine = [i for i, r in enumerate(rows) if r[2] == leaf]
        out += [(rows[i][0], e) for i in mine for e in range(1, whole + 1)]
        if rest <= 0:
            continue
        order, at = defaultdict(list), 0
        for i in mine:
            order[hashes[i * (epochs + 1) + whole]].append(i)
        for h in sorted(order):
            at += sum(words[i] for i in order[h])
            if at > rest:
                break
            out += [(rows[i][0], whole + 1) for i in order[h]]
    return sorted(out)


@pytest.mark.parametrize("share, epochs", [(0.3, 1), (0.8, 3), (2.0, 3), (50.0, 2)])
def test_selection_against_sorting(spark, crowded, share, epochs):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"], (r["d"], r["lang"], r["source"]))
            for r in docs.withColumn("d", queries.domain_of()).collect()]
    got = mixing.mix(crowded(docs), queries.domain_of(), share, queries.MIX_WEIGHTS, epochs, 5)
    assert sorted((r["doc_id"], r["_mix_epoch"]) for r in got.collect()) == slow_mix(spark, rows, queries.MIX_WEIGHTS, share, epochs, 5)


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs, queries.domain_of(), 1.0, {}, 1, 5).collect()
    with_tokens = {r["doc_id"] for r in odd_docs.collect() if (r["text"] or "").split()}
    assert with_tokens <= {r["doc_id"] for r in got}  # a share of 1 takes every token
    assert mixing.mix(no_docs, queries.domain_of(), 1.0, {}, 1, 5).count() == 0
    assert all(len(r) == len(odd_docs.columns) + 5 for r in got)


def test_reproducible(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    pick = lambda d, seed: sorted(r["doc_id"] for r in mixing.mix(d, queries.domain_of(), 0.4, {}, 1, seed).collect())
    assert pick(docs, 5) == pick(docs.repartition(7), 5) != pick(docs, 6)
