"""The pipeline: stages keep what they should, on a small fixture and the
given tables."""

import random

import corpus_pipeline as C
from limnospark.llm import queries
from limnospark.llm.common import load


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = load(spark, sf, "documents")
    columns = docs.columns
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before and ids
        before = set(ids)
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
    assert docs.where("not round_trip").count() == 0
    assert sorted(r["doc_id"] for r in C.run(spark, sf).collect()) == sorted(before)


def test_a_run_leaves_other_results_alone(spark):
    """A query's tables outlive a pipeline run between its building and its
    reading."""
    sf = "/root/testdata/sf0.001"
    waiting = [queries.op10_sharding(spark, sf), queries.op13_laesa(spark, sf)]
    C.run(spark, sf).count()
    assert [df.count() for df in waiting] == [200, 500]


def test_stages_on_odd_rows(spark, odd_docs, no_docs, crowded):
    sf = "/root/testdata/sf0.001"
    for table in (crowded(odd_docs), no_docs):
        for name, stage in C.STAGES[:-1]:
            got = stage(spark, table, sf)
            assert got.columns == table.columns, name
            assert got.count() <= table.count()
        assert C.STAGES[-1][1](spark, table, sf).count() == table.count()


def test_planted_cases(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(200), text(60)
    near = base.split()
    near[100] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, text(150) + " " + passage), (5, passage + " " + text(150)), *[(10 + i, text(120)) for i in range(20)]]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in C.near_copies(spark, docs, "").collect()}
    assert kept >= {1, 4, 5, *range(10, 30)} and 2 not in kept
    out = {x["doc_id"]: x["text"] for x in C.repeats(spark, docs.where("doc_id >= 4"), "").collect()}
    assert passage[100:200] not in out[4] and passage[100:200] not in out[5]
    assert all(out[i] == t for i, t in rows if i >= 10)
