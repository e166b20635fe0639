"""Op 11: the block codec, files read by document and whole, ids against the
library, odd rows."""

import glob
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from limnospark.llm import pfor, queries, token_files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))


def slow(rows, library):
    """(doc_id, text) -> result rows."""
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [1]
    out, start = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # rows of one key have one text here
        x = ids(t)
        out.append((k, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.full(n, 2**32 - 1), np.where(rng.random(n) < 0.05, 2**32 - 1, rng.integers(7, 9, n)), rng.integers(0, 2**32, n)):
        data, sizes = pfor.encode_blocks(ids.astype(np.uint32))
        assert len(data) == sizes.sum()
        starts = (np.cumsum(sizes) - sizes).astype(np.int64)
        assert (pfor.decode_blocks(data, starts) == ids).all()
    if n == 5000:  # few large ids in a block of small ones stand apart: 2 bits each and 5 bytes an exception
        few = np.arange(n) % 4
        few[::64] = 2**31
        data, sizes = pfor.encode_blocks(few.astype(np.uint32))
        assert sizes[0] == 8 + 16 * 2 + 5 * 2


@pytest.mark.parametrize("width", [0, 1, 5, 16, 31, 32])
def test_pack(width):
    v = np.random.default_rng(width).integers(0, 1 << width, (9, 32)).astype(np.uint64)
    assert (pfor.unpack(pfor.pack(v, width), width) == v).all()


def test_file_by_document_and_whole(monkeypatch):
    monkeypatch.setattr(pfor, "FLUSH", 300)
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 60000, n).astype(np.uint32) for n in (5, 0, 1, 2000, 128, 0, 256, 300, 1)]
    keys = [7, None, -3, 2**62, 0, 1, 2, 3, 4]
    out = io.BytesIO()
    w = pfor.Writer(out)
    for k, d in zip(keys, docs):
        w.add(k, d)
    assert w.close() == len(out.getvalue())
    r = pfor.Reader(out, len(out.getvalue()))
    assert r.keys == keys and r.ids == sum(map(len, docs))
    for i in random.Random(0).sample(range(len(docs)), len(docs)):
        assert (r.document(i) == docs[i]).all() and len(r.document(i)) == len(docs[i])
    again = [[] for _ in docs]
    for i, ids in r.pieces():
        again[i] += ids.tolist()
    assert again == [d.tolist() for d in docs]
    with pytest.raises(ValueError):
        pfor.Reader(io.BytesIO(b"x" * 200), 200)


def test_pieces_equal_the_library(library):
    rng = random.Random(1)
    signs = list("aAbzZéÉßüÿ019 '.,-_\n\t\x0b\x1c\x1f\x7f") + ["'s", "'T", "'re", "'LL", "it's", "  ", "\x85", "\xa0", "µ", "ª", "×", "÷", "İ", "Σ", "ς", "é", "é", "日本", "　", "\U0001f600", "<|endoftext|>", "<|", "٣", "ﬁ"]
    texts = ["".join(rng.choices(signs[:rng.randrange(5, len(signs) + 1)], k=rng.randrange(40))) for _ in range(3000)]
    e = token_files.Encoder(public_tokenizers.path(token_files.VOCABULARY))
    for at in range(0, len(texts), 100):
        got = e.encode(texts[at:at + 100])
        assert [x.tolist() for x in got] == [x.ids for x in library.encode_batch(texts[at:at + 100], add_special_tokens=False)]
    plain = [t for t in texts if token_files.PLAIN.fullmatch(t)]
    assert 500 < len(plain) < 2900


def test_query_equals_the_library(spark, small_dir, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op11_token_files(spark, small_dir).collect()) == slow(rows, library)


def test_odd_rows(spark, crowded, odd_docs, library, monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 50)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect() if r["doc_id"] is not None] + [(None, "")] * 2
    rows += [(9, "   ")] * 200
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [tuple(r) for r in token_files.report(df).collect()]
    assert sorted(got, key=lambda r: r[1]) == slow(rows, library)
    assert token_files.report(df.where("false")).count() == 0


def test_ties_come_in_one_order(spark):
    rows = [(i % 2, f"text {i % 7} " + "x " * (i % 7)) for i in range(300)]
    results = []
    for n in (2, 11):
        df = spark.createDataFrame(random.Random(n).sample(rows, len(rows)), "doc_id long, text string").repartition(n)
        results.append(sorted(tuple(r) for r in token_files.report(df).collect()))
    assert results[0] == results[1] and len(results[0]) == 300


def test_files_alone_hold_everything(spark, library):
    rows = [(i, f"document {i} has its words") for i in range(100)]
    made = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"))
    place = fs.FileSystem.from_uri(made.folder)[1]
    assert sorted(glob.glob(f"{place}/*.pfor")) == sorted(f[1] for f in made.files)
    seen = {}
    for _, name, before, size in made.files:
        with open(name, "rb") as f:
            r = pfor.Reader(f, size)
            seen |= {k: r.document(i).tolist() for i, k in enumerate(r.keys)}
    assert seen == {k: library.encode(t, add_special_tokens=False).ids + [1] for k, t in rows}
