"""Op 4: ids equal to the library's, exact round trip, Viterbi by brute force."""

import random
from itertools import combinations

import pytest
import sentencepiece

from limnospark.llm import sentencepiece_lattice as S
from limnospark.llm.common import load


@pytest.fixture(scope="module")
def model():
    return S.Model.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def test_cutter(model):
    cut = S.Cutter(model)
    keys = ["hello", "a.b\nc", " x", "", "é日本\n\n", "thnt\n", "tail"]
    (subs, ends), = cut(keys)
    first = 0
    for key, end in zip(keys, ends):
        assert "".join(subs[first:end]) == (" " + key).replace(" ", S.SPACE)
        first = end + 1


def test_keys(model):
    for t in ("a b", "a  b", " a", "a ", "  ", " ", "a", "a   b c ", "\n x"):
        assert "".join(" " + k for k in S.keys_of(t)) == " " + t
    assert S.keys_of("") == []


def test_words_of_any_length(model, library):
    r = random.Random(4)
    for _ in range(200):
        word = "".join(r.choice("theonrigask") for _ in range(r.randint(1, 90)))
        assert [model.pieces[p][0] for p in S.merge_word(S.SPACE + word, model.pieces)] == library.encode(word)


def odd_texts():
    return ["  two  spaces\n\nnew\tline ", None, "", "a▁b ﬁ ① 日本語 ", "x" * 300 + "the" * 50 + " " + "ab" * 100, "   ", " ", "\n",
            "        deep    indent\n    code(x)[0] = \"it's\"; // ok\r\n\u0000 end", "\U0001f600 ok", "é́ ß"]


def test_ids_equal_the_library(spark, model, library, crowded, odd_docs):
    docs = load(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    table = docs.unionByName(extra).unionByName(odd_docs.where("doc_id = 4").select((-F_id()).alias("doc_id"), "text"))
    text = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    got = S.encode(crowded(table), model, block=200_000).collect()
    assert len(got) == table.count()
    for r in got:
        t = text[r["doc_id"]]
        assert r["token_ids"] == library.encode(t), t[:80]
        assert r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) and r["n_chars"] == len(t)


def F_id():
    from pyspark.sql import functions as F

    return F.col("doc_id") + 1000


def test_decode(spark, model, odd_docs):
    coded = S.encode(odd_docs, model)
    back = S.decode(coded, model).collect()
    assert sorted(r["decoded"] for r in back) == sorted((r["text"] or "") for r in odd_docs.collect())


def test_empty(no_docs, model):
    assert S.encode(no_docs, model).count() == 0


def best_path(word, pieces, worst):
    """Least cost of any segmentation, by trying all."""
    n, best = len(word), None
    for k in range(n):
        for cuts in combinations(range(1, n), k):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, n))]
            cost = 0.0
            for p in parts:
                if p in pieces:
                    cost -= pieces[p][1]
                elif len(p) == 1:
                    cost += worst
                else:
                    break
            else:
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, parts)
    return best


def test_unigram_viterbi(spark):
    r = random.Random(9)
    names = ["a", "b", "c", S.SPACE, "ab", "bc", "abc", "ca", S.SPACE + "a", S.SPACE + "ab", "cab", "bb"]
    scores = [-3.0, -3.5, -4.0, -2.0] + [-r.uniform(3, 7) for _ in names[4:]]
    model = S.Model(["<unk>"[:0] or None, *names], [0.0, *scores], {}, 0, "unigram")
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 9))) for _ in range(40)] + ["abx"]
    for t in texts:
        parts = S.viterbi_word(t, model.pieces, model.longest, model.worst)
        assert sum(-model.pieces[p][1] if p in model.pieces else model.worst for p in parts) == pytest.approx(best_path(t, model.pieces, model.worst)[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    worst = 14.0
    cost = lambda i: worst if i == 0 else -scores[i - 1]
    for row in S.encode(docs, model).collect():
        t = S.SPACE + texts[row["doc_id"]].replace(" ", S.SPACE)
        assert sum(map(cost, row["token_ids"])) == pytest.approx(best_path(t, model.pieces, worst)[0])


def test_parted_by_boundaries():
    every = (1 << 5) - 1
    assert S.parted("abcd", every & ~0b00110) == ["abc", "d"]
    assert S.parted("abcd", every & ~0b01110) == ["abcd"]
    assert S.parted("abcd", (1 << 6) - 1) == list("abcd")


def test_edges_that_have_to_wait(spark):
    """Longer pieces of better rank than their parts: at its turn an edge
    covers more than two symbols and merges later."""
    r = random.Random(5)
    names = ["a", "b", "c", "d", S.SPACE, "abcd", "abc", "bcd", "cd", "ab", "bc", "da", S.SPACE + "ab", "dd"]
    for _ in range(3):
        scores = [0.0] * 5 + [-float(r.randint(1, 6)) for _ in names[5:]]
        scores[names.index("abc")] = -0.5  # before ab and bc
        model = S.Model([None, *names], [0.0, *scores], {}, 0, "bpe")
        texts = ["".join(r.choice("abcd ") for _ in range(r.randint(1, 30))) for _ in range(40)] + ["abc", "abcd abcdabc"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for row in S.encode(docs, model).collect():
            whole = S.SPACE + texts[row["doc_id"]].replace(" ", S.SPACE)
            assert row["token_ids"] == [model.pieces[p][0] for p in S.merge_word(whole, model.pieces)]
            assert row["round_trip"]


def test_text_with_the_mark(spark, model, library):
    mark = S.Cutter(model).mark
    texts = [mark, f"the{mark}end {mark}", f"{mark} {mark}{mark} on"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in S.encode(docs, model).collect():
        assert row["token_ids"] == library.encode(texts[row["doc_id"]]) and row["round_trip"]


def test_a_text_is_read_once_for_its_ids(model, library, monkeypatch):
    import pyarrow as pa
    import zstandard

    class Grouped:
        def groupBy(self, _):
            return self

        def cogroup(self, _):
            return self

        def applyInArrow(self, run, _):
            self.run = run
            return self

    texts = ["the end of the end", "", "one  more\n"]
    rows = pa.table([pa.array([3, 4, 5], pa.int64()), pa.array(texts)], names=["doc_id", "t"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_table(rows)
    left = pa.table([pa.array([0], pa.int32()), pa.array([zstandard.compress(sink.getvalue())], pa.binary())], names=["block", "blob"])
    words = sorted({w for t in texts if t for subs, _ in S.Cutter(model)(S.keys_of(t)) for w in subs if len(w) > 1})

    def cuts(word):
        at = [0]
        for p in S.merge_word(word, model.pieces):
            at.append(at[-1] + len(p))
        return sum(1 << i for i in at)

    right = pa.table([pa.array([0] * len(words), pa.int32()), pa.array(words), pa.array(list(map(cuts, words)), pa.int64())],
                     names=["block", "word", "cuts"])
    read, keys_of = [], S.keys_of
    monkeypatch.setattr(S, "keys_of", lambda t: read.append(t) or keys_of(t))
    got = S.encoded_blocks(Grouped(), Grouped(), model).run(left, right)
    assert got.column("token_ids").to_pylist() == [library.encode(t) for t in texts]
    assert sorted(read) == sorted(texts)
