"""Op 1: held-out layouts, the given pages, decoding, parsing."""

import html
import re

import numpy as np
import pytest

from limnospark.llm import gbt, html_extract as H, html_layouts
from limnospark.llm.common import load


@pytest.fixture(scope="module")
def model():
    return H.train(700)


def test_held_out_layouts(model):
    same = total = exact = 0
    pages = html_layouts.pages(150, seed=77)
    for page in pages:
        nodes, blocks = H.parse(page, labels=True)
        kept, label = H.decode(nodes, model.raw(H.features([nodes]))), [bool(x.label) for x in nodes]
        same += sum(a == b for a, b in zip(kept, label))
        total += len(nodes)
        exact += [t for n, t in blocks if kept[n]] == [t for n, t in blocks if label[n]]
    assert same / total > 0.99 and exact / len(pages) > 0.9


def test_given_pages(spark, model):
    pages = load(spark, "/root/testdata/sf0.001", "pages")
    for r in H.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_parse():
    blocks = lambda page: [t for _, t in H.parse(page)[1]]
    assert blocks("<p>a\n  b<p>c &amp;&nbsp;d<b>e</b><br>f") == ["a b", "c & de f"]
    assert blocks("<div>x<script>var a='</div>';</script>y<style>p{}</style></div>z") == ["xy", "z"]
    assert blocks("<!-- <p>no --><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>") == ["one", "two", "a", "b"]
    assert blocks("<head><title>t</title><p>in head</head><body>b") == ["b"]
    assert blocks("5 < 6 & 7 > 4 </nope> <unknown>ok</unknown>") == ["5 < 6 & 7 > 4 ok"]
    assert blocks("") == [] and blocks("<script>never closed") == [] and blocks("<p") == ["<p"]


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(0)
    nodes, _ = H.parse("<div><ul><li>a<li>b</ul><p>c</div><section><p>d</section>")
    for _ in range(50):
        raw = rng.normal(scale=2, size=len(nodes))
        kept = H.decode(nodes, raw)
        assert all(kept[x.up.n] for x in nodes[1:] if kept[x.n])

        def score(choice):
            return sum(-np.logaddexp(0, -r if k else r) for k, r in zip(choice[1:], raw[1:]))

        best = -np.inf
        for bits in range(1 << (len(nodes) - 1)):
            choice = [True] + [bool(bits >> i & 1) for i in range(len(nodes) - 1)]
            if all(choice[x.up.n] for x in nodes[1:] if choice[x.n]):
                best = max(best, score(choice))
        assert score(kept) == pytest.approx(best)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = gbt.fit(x[:1500], y[:1500], trees=30, depth=4)
    assert ((m.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "plain text only"), (3, "u", "plain text only"),
            (4, "u", "<article><p>" + "word " * 40_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = H.extract(pages, model).collect()
    assert len(got) == 6 and got[0]["text"] == "" and got[1]["text"] == "" and got[0]["n_chars"] == 0
    assert got[3]["text"] == got[4]["text"] == "plain text only" and got[5]["n_chars"] == 40_000 * 5 - 1
    assert H.extract(pages.where("false"), model).count() == 0
