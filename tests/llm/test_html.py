"""HTML extraction: broken pages, time on hostile ones, the gradient of the fit, and held-out pages whose names are hidden."""

import re
import time
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import op08_html_extraction as op

SF = "/root/testdata/sf0.01"


def blocks(source):
    return [t for t in op.parse(source).text if t is not None]


@pytest.mark.parametrize(
    "source",
    [
        "<html><head><title>T</title><body><article><p>Hello world</p></article>",
        "<head><title>T</title><p>Hello world",
        "<head><meta charset=utf-8><style>p{}</style>Hello world",
        "<title>T<body><p>Hello world",
        "<head><script>x</script><div>Hello <b>world</div>",
        "<body><svg><path d='m0'/><p>Hello world",
        '<p title="a > b">Hello world</p>',
        "<p don't>Hello world</p>",
        '<p><a href="x>Hello</a> <a href=y>world</a>',
        "<!-- a > b --><p>Hello world<!--",
        "<p>Hello world<a href=",
        "<?xml version='1.0'?><!DOCTYPE html><p>Hello world</",
    ],
)
def test_broken_pages_keep_their_text(source):
    assert " ".join(blocks(source)).rstrip("</").strip() in ("Hello world", "world")


def test_structure_of_unclosed_elements():
    page = op.parse("<ul><li>a<li>b<p>c<p>d<li>e</ul><table><tr><td>f<td>g<tr><th>h</table>x < y & z <3")
    parent = {page.text[i]: page.tag[page.parent[i]] for i in range(len(page.tag)) if page.text[i]}
    assert parent == {"a": "li", "b": "li", "c": "p", "d": "p", "e": "li", "f": "td", "g": "td", "h": "th", "x < y & z <3": "#root"}
    lists = [i for i in range(len(page.tag)) if page.tag[i] == "li"]
    assert len({page.parent[i] for i in lists}) == 1


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<figure><p>", '<p x="', "<title>", "<p>x</q>", "<", "</", "<!--", "<svg>", "&amp;<b>", "<li>", "<td><p>", "<a b='\">"])
def test_time_grows_with_the_length(piece):
    took = time.process_time()
    page = op.parse(piece * (1_000_000 // len(piece)))
    assert max(page.depth) <= op.DEEPEST + 1
    assert time.process_time() - took < 20


def test_gradient_of_the_likelihood(monkeypatch):
    page = op.parse("<div><article><p>Some text.</p><p>More</p></article><nav><ul><li><a>x</a></li></ul></nav></div>")
    y = np.array(op.labels(page))
    made = op._features(page)
    forest = op.Forest([np.array(page.parent)], [np.array([t is not None for t in page.text])], [made])
    rng = np.random.default_rng(3)
    w, pairs = rng.normal(size=op.WIDTH), rng.normal(size=(2, 2, 2))

    def loss(w, pairs):
        """From the sum over all states."""
        n = len(y)
        own = np.array([w[np.array(made[1][a:b])].sum() for a, b in zip(made[0], made[0][1:], strict=False)])
        states = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        score = states @ own
        for i in range(1, n):
            score = score + pairs[int(page.text[i] is not None), states[:, page.parent[i]], states[:, i]]
        return np.logaddexp.reduce(score) - score[int((y << np.arange(n)).sum())]

    p, joint = forest.marginals(w, pairs)
    for k in np.unique(made[1])[:6]:
        step = np.zeros(op.WIDTH)
        step[k] = 1e-5
        want = (loss(w + step, pairs) - loss(w - step, pairs)) / 2e-5
        got = sum((p[i] - y[i]) * made[1][made[0][i] : made[0][i + 1]].count(k) for i in range(len(y)))
        assert abs(want - got) < 1e-5
    for kind in (0, 1):
        for a in (0, 1):
            for b in (0, 1):
                step = np.zeros((2, 2, 2))
                step[kind, a, b] = 1e-5
                want = (loss(w, pairs + step) - loss(w, pairs - step)) / 2e-5
                mine = forest.kind[forest.child] == kind
                c = forest.child[mine]
                got = joint[mine, a, b].sum() - ((y[forest.parent[c]] == a) & (y[c] == b)).sum()
                assert abs(want - got) < 1e-5


def precision_recall(want, got):
    a, b = (Counter({t: 0 for t in x}) + Counter({t: len(t) * n for t, n in Counter(x).items()}) for x in (want, got))
    common = sum((a & b).values())
    return common / max(1, sum(b.values())), common / max(1, sum(a.values()))


def test_held_out_pages(spark):
    """Labels are what the page's own mark holds; names of blocks are hidden from the model in the second round, all of them in the third."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = op.train(pages.where("page_id % 3 <> 0"))
    rows = [r.html for r in pages.where("page_id % 3 = 0").collect()]
    assert len(rows) > 50
    hide = lambda h: re.sub(r"<(/?)(article|nav|footer|header|main|aside)\b", r"<\1div", h).replace('class="ad"', 'class="x7"')
    for change in (lambda h: h, lambda h: re.sub(r"<(/?)article\b", r"<\1div", h), hide):
        want, got = [], []
        for h in rows:
            page = op.parse(h)
            want += [t for t, y in zip(page.text, op.labels(page), strict=True) if t is not None and y]
            page = op.parse(change(h))
            got += [t for t, p in zip(page.text, model.marginals([page])[0].tolist(), strict=True) if t is not None and p > 0.5]
        precision, recall = precision_recall(want, got)
        assert precision > 0.97 and recall > 0.97


def test_repeated_ids_very_long_pages_and_clashing_columns(spark):
    article = "<article>" + "<p>A sentence of the article, with some words in it.</p>" * 40000 + "</article><footer>&copy; us</footer>"
    rows = [(1, article, 5, "x"), *[(7, f"<nav><a>n</a></nav><article><p>Some text number {i}.</p></article>", 5, "x") for i in range(60)], (None, "<article>y z</article>", 5, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, n_chars int, text string")
    assert op.sample(pages, "page_id", "html", 100).count() == 1  # one row of id 7; the long page is above a row's bound
    out = op.extract(pages, op.train(pages)).orderBy("page_id").collect()
    assert out[0].text is not None and len(out) == len(rows)
    long = next(r for r in out if r.page_id == 1)
    assert long.n_chars == len(long.text) == 40000 * 50 - 1


def test_formulas_and_drawings_stay_in_their_sentence():
    from palimpsest.llm import op08_html_extraction as op

    def blocks(source):
        return [t for t in op.parse(source).text if t]

    assert blocks("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be.</p>") == ["Let x=1 be."]
    assert blocks("<p>A <svg><title>t</title><text>drawn</text></svg> word <object>kept</object>.</p>") == ["A drawn word kept."]
