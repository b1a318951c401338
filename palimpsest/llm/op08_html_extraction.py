"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Nodes are block elements and the text blocks between them; each is content or not. A node's own potential is a
weighted sum of its features, and parent-child potentials depend on the kind of the child. Sum-product messages go
up the trees and down again, all pages of a batch level by level, and give the marginal of every node and edge.

Weights and pair potentials are fitted together, by the gradient of the likelihood of labelled pages: what the
messages expect less what the labels show. Labelled are pages that mark their article themselves (`article`, `main`
or `itemprop=articleBody`) and hold nothing inside it that is named as something else: what lies in the mark is content.
In part of them the marks are hidden from the features, in part all names, so that text, links and places are
learned too. Hints that no labelled page may show, such as sidebars or reader comments, start from prior weights.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, chunks, sample, table

#: Pages that the model learns from, smallest hashes first; hashed features; gradient steps.
SAMPLE_PAGES, WIDTH, STEPS, RATE, RIDGE = 2000, 1 << 12, 60, 0.3, 1e-4
#: Elements nested deeper hang on the last one at this depth, as in browsers; their text stays.
DEEPEST = 512
#: A start or end tag. Quotes count after an equals sign only; an unclosed one is an ordinary character.
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: Fixed sets of HTML element names: text never shown, inline elements, elements without an end, what ends an open element.
SILENT = {"script", "style", "noscript", "template", "title", "head", "iframe", "select", "textarea", "button"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "annotation", "annotation-xml", "desc", "metadata"}
ASIDE = {"title", "annotation", "annotation-xml", "desc", "metadata"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas and drawings stand within their sentence, and so does the text in them.
INLINE |= set("math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom mtable mtr mtd svg g text tspan textpath path circle ellipse rect line polyline polygon use defs canvas object".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSABLE = {"p": 1, "li": 2, "dt": 4, "dd": 8, "tr": 16, "td": 32, "th": 64, "option": 128}
HOLDERS = {"ul", "ol", "dl", "table", "tbody", "thead", "div", "section", "article", "main", "aside", "nav", "footer", "header", "body", "html", "form", "blockquote", "#root"}
BOILER = set("nav navbar navigation menu footer header masthead sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent notice alert comment comments discussion reply replies respond form search share sharing social related recommended breadcrumb breadcrumbs subscribe newsletter signup popup modal overlay login widget pagination pager copyright disclaimer toolbar skip".split())
CONTENT = set("article main content post entry story articlebody text body prose".split())
MARKS = {"article", "main", "articlebody"}


@dataclass
class Page:
    """Nodes in page order: parent, depth, kind; text blocks have text."""

    parent: list[int]
    depth: list[int]
    tag: list[str]
    hints: list[set]
    text: list[str | None]
    linked: list[float]


def parse(source: str) -> Page:
    """The tree of a page, however its tags are broken, in time that grows with its length.

    A head ends at its end tag, at text, or at the first element that it cannot hold. A tag that never closes hides what follows it.
    """
    page = Page([-1], [0], ["#root"], [set()], [None], [0.0])
    stack, held, links = [0], [], 0
    # what is open: how often each tag, and of the tags that others close, those above the last holder (as bits)
    open_tags, closable = Counter(), [0]
    text_len = [0, 0]
    at, size = 0, len(source)
    silent = 0
    endless: set[str] = set()

    def flush() -> None:
        if held:
            block = SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if block and not silent:
                add("#text", set(), block)
                page.linked[-1] = min(1.0, text_len[1] / max(1, text_len[0]))
        text_len[:] = [0, 0]

    def add(tag: str, hints: set, text: str | None) -> int:
        page.parent.append(stack[-1])
        page.depth.append(page.depth[stack[-1]] + 1)
        page.tag.append(tag)
        page.hints.append(hints)
        page.text.append(text)
        page.linked.append(0.0)
        return len(page.tag) - 1

    def leave(tags: set[str]) -> None:
        """Close elements up to the innermost of these tags, which is open."""
        nonlocal silent
        flush()
        while True:
            tag = page.tag[stack.pop()]
            closable.pop()
            open_tags[tag] -= 1
            silent -= tag in SILENT
            if tag in tags:
                return

    def say(piece: str) -> None:
        if open_tags["head"] and page.tag[stack[-1]] == "head" and not piece.isspace():
            leave({"head"})
        held.append(piece)
        n = len(piece)
        text_len[0] += n
        text_len[1] += n if links else 0

    def element(tag: str, attributes: str) -> None:
        nonlocal silent, links
        flush()
        closes = CLOSES.get(tag, {"p"})
        while closable[-1] & sum(CLOSABLE[c] for c in closes):
            leave(closes)
        names = {w for a in ATTRIBUTE.finditer(attributes) for w in NAME.findall((a[2] or a[3] or a[4] or "").lower())} if attributes else set()
        made = add(tag, names, None)
        links = 0
        if len(stack) < DEEPEST:
            stack.append(made)
            open_tags[tag] += 1
            closable.append(0 if tag in HOLDERS else closable[-1] | CLOSABLE.get(tag, 0))
            silent += tag in SILENT

    while at < size:
        start = source.find("<", at)
        if start < 0:
            say(source[at:])
            break
        if start > at:
            say(source[at:start])
        follows = source[start + 1 : start + 2]
        if follows in ("!", "?"):
            comment = source.startswith("<!--", start)
            end = source.find("-->" if comment else ">", start + 2)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        m = TAG.match(source, start)
        if not m:
            if not re.match(r"</?[a-zA-Z]", source[start : start + 3]):  # no tag: the sign itself, or an empty or odd end tag
                end = source.find(">", start) if follows == "/" else -1
                say("<" if end < 0 else "")
                at = start + 1 if end < 0 else end + 1
                continue
            break
        at = m.end()
        tag = m[1].lower()
        if open_tags["head"] and follows != "/" and tag not in IN_HEAD and tag != "head":
            leave({"head"})
        if tag == "br":
            say(" ")
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if follows == "/" else 1))
        elif follows == "/":
            if open_tags[tag]:
                leave({tag})
            else:
                flush()
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in RAW:
            end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            if end:
                at = end.end()
            elif tag in ASIDE:  # without an end it is over at the next tag
                endless.add(tag)
                at = start if (start := source.find("<", at)) >= 0 else size
            else:
                at = size
        else:
            element(tag, m[2])
    flush()
    return page


def _code(name: str) -> int:
    return zlib.crc32(name.encode()) % (WIDTH - 64) + 64


BOILER_AT, CONTENT_AT, BIAS = 0, 1, 2
#: Weights before any page is seen: hints of the rest of a page, and of an article.
PRIOR = np.zeros(WIDTH)
PRIOR[BOILER_AT], PRIOR[CONTENT_AT] = -6.0, 3.0


def _features(page: Page, hide: int = 0) -> tuple[list[int], list[int]]:
    """(first, feature): the features of each node; all have value 1. ``hide`` 1 hides the marks of articles, 2 all names of blocks."""
    first, out = [0], []
    # a hint counts for what lies below it too, but not on an element that holds the marked article
    holds, boiler = [False] * len(page.tag), [False] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):
        holds[page.parent[i]] |= holds[i] or page.tag[i] in MARKS
    hidden = (set(), MARKS, MARKS | BOILER | CONTENT)[hide]
    for i, tag in enumerate(page.tag):
        names = {tag, *page.hints[i]} - hidden
        own = [BIAS, _code("tag:" + (tag if tag in names else "div"))]
        if tag not in ("body", "html", "#root"):
            boiler[i] = boiler[page.parent[i]] or bool(names & BOILER and not holds[i])
            if boiler[i]:
                own.append(BOILER_AT)
            elif names & CONTENT:
                own.append(CONTENT_AT)
        if (text := page.text[i]) is not None:
            parent = page.tag[page.parent[i]]
            n = len(text)
            own += [_code(f"in:{'div' if parent in hidden else parent}"), _code(f"length:{min(9, n.bit_length())}"), _code(f"links:{int(page.linked[i] * 4)}"), _code(f"end:{text[-1] in '.!?…»”'}"), _code(f"sign:{'©' in text}")]
        out += own
        first.append(len(out))
    return first, out


def labels(page: Page) -> list[int] | None:
    """Content or not of each node of a page that marks its article, by the mark alone; None of pages without, or with other hints inside it."""
    n = len(page.tag)
    marked = [page.tag[i] in MARKS or "articlebody" in page.hints[i] for i in range(n)]
    if not any(marked):
        return None
    inside, weight, good = [False] * n, [0] * n, [0] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or marked[i]
        if inside[i] and not marked[i] and (page.tag[i] in BOILER or page.hints[i] & BOILER):
            return None
        if page.text[i] is not None:
            weight[i], good[i] = len(page.text[i]), len(page.text[i]) * inside[i]
    for i in range(n - 1, 0, -1):
        weight[page.parent[i]] += weight[i]
        good[page.parent[i]] += good[i]
    return [int(g >= 0.9 * w > 0) for g, w in zip(good, weight, strict=True)]


class Forest:
    """The trees of many pages, side by side: nodes by depth, and the features of each."""

    def __init__(self, parents: list[np.ndarray], kinds: list[np.ndarray], made: list[tuple[np.ndarray, np.ndarray]]):
        self.base = np.concatenate([[0], np.cumsum([len(p) for p in parents])]).astype(np.int64)
        self.parent = np.concatenate([np.asarray(p, np.int64) + b for p, b in zip(parents, self.base, strict=False)])
        self.kind = np.concatenate(kinds).astype(np.int64)
        self.feature = np.concatenate([np.asarray(f, np.int64) for _, f in made])
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for f, _ in made]))])
        root = np.zeros(len(self.parent), bool)
        root[self.base[:-1]] = True
        self.parent[root] = self.base[:-1]
        depth = np.where(root, 0, -1)
        level = np.flatnonzero(root)
        self.levels, order = [], np.argsort(self.parent, kind="stable")
        start = np.searchsorted(self.parent[order], np.arange(len(depth) + 1))
        while len(level):
            self.levels.append(level)
            count = start[level + 1] - start[level]
            child = order[np.repeat(start[level] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
            level = child[~root[child]]
        self.child = np.flatnonzero(~root)

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and of each node but roots the joint marginal [parent state, own state]."""
        sums = np.concatenate([[0.0], np.cumsum(weights[self.feature])])
        up, sent = np.zeros((len(self.parent), 2)), np.zeros((len(self.parent), 2))
        up[:, 1] = sums[self.first[1:]] - sums[self.first[:-1]]
        for nodes in self.levels[:0:-1]:  # from leaves to roots
            mine, pair = up[nodes], pairs[self.kind[nodes]]
            sent[nodes] = np.logaddexp(mine[:, :1] + pair[:, :, 0], mine[:, 1:] + pair[:, :, 1])
            above = np.flatnonzero(np.diff(self.parent[nodes], prepend=-1))  # a level goes by parents
            up[self.parent[nodes[above]]] += np.add.reduceat(sent[nodes], above, axis=0)
        belief = up.copy()
        for nodes in self.levels[1:]:  # and back: what the parent believes without this child
            rest, pair = belief[self.parent[nodes]] - sent[nodes], pairs[self.kind[nodes]]
            belief[nodes] += np.logaddexp(rest[:, :1] + pair[:, 0, :], rest[:, 1:] + pair[:, 1, :])
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))
        c = self.child
        joint = (belief[self.parent[c]] - sent[c])[:, :, None] + pairs[self.kind[c]] + up[c][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return p, joint / joint.sum(axis=(1, 2), keepdims=True)


@dataclass
class Model:
    """Weights of features, and log potentials [child kind, parent state, child state]."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, pages: list[Page], hide: int = 0) -> list[np.ndarray]:
        """P(content) of every node of each page."""
        if not pages:
            return []
        forest = Forest([np.array(p.parent) for p in pages], [np.array([t is not None for t in p.text]) for p in pages], [_features(p, hide) for p in pages])
        p, _ = forest.marginals(self.weights, self.pairs)
        return np.split(p, forest.base[1:-1])


#: Potentials before any page is seen: a child is as its parent.
PAIRS = np.broadcast_to(np.array([[1.0, -1.0], [-1.0, 1.0]]), (2, 2, 2))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """Weights and potentials near their prior under which the labels of (first, feature, label, parent, kind) are likeliest, by Adam."""
    if not rows:
        return Model(PRIOR, PAIRS.copy())
    forest = Forest([r[3] for r in rows], [r[4] for r in rows], [(r[0], r[1]) for r in rows])
    label = np.concatenate([r[2] for r in rows]).astype(np.int64)
    node = np.repeat(np.arange(len(label)), np.diff(forest.first))
    c, n = forest.child, len(rows)
    edge = forest.kind[c] * 4 + label[forest.parent[c]] * 2 + label[c]
    shown = np.bincount(edge, minlength=8).reshape(2, 2, 2)
    at, prior = np.concatenate([PRIOR, PAIRS.ravel()]), np.concatenate([PRIOR, PAIRS.ravel()])
    mean, square = np.zeros(len(at)), np.zeros(len(at))
    for t in range(1, STEPS + 1):
        p, joint = forest.marginals(at[:WIDTH], at[WIDTH:].reshape(2, 2, 2))
        by_weight = np.bincount(forest.feature, weights=(p - label)[node], minlength=WIDTH) / n
        expected = np.stack([joint[forest.kind[c] == k].sum(axis=0) for k in (0, 1)])
        grad = np.concatenate([by_weight, (expected - shown).ravel() / n]) + RIDGE * (at - prior)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        at = at - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return Model(at[:WIDTH], at[WIDTH:].reshape(2, 2, 2))


def train(pages: DataFrame, key: str = "page_id", source: str = "html", n: int = SAMPLE_PAGES) -> Model:
    """The model of the n pages with the smallest hashes; pages that mark no article teach nothing.

    Null keys and pages teach nothing; a key that is given more than once counts once.
    """

    def compute(given: pa.Table) -> list:
        out = []
        for number, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
            page = parse(text)
            y = labels(page)
            first, feature = _features(page, hide=zlib.crc32(str(number).encode()) % 3)
            out.append(None if y is None else pickle.dumps((np.array(first), np.array(feature), np.array(y), np.array(page.parent), np.array([t is not None for t in page.text], int))))
        return [pa.array(out, pa.binary())]

    rows = append(sample(pages, key, source, n), [T.StructField("made", T.BinaryType())], compute, [key, source], keep=[key]).where("made IS NOT NULL").collect()
    rows.sort(key=lambda r: (str(r[0]), bytes(r.made)))
    return fit([pickle.loads(r.made) for r in rows])


def extract(pages: DataFrame, model: Model, source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Every row with ``text``, its content blocks joined by newlines, and n_chars; null, empty or broken pages never fail."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # fixed width

    def compute(given: pa.Table) -> list:
        sources, texts = [x or "" for x in given.column(0).to_pylist()], []
        for a, b in chunks([x.encode() for x in sources]):
            parsed = [parse(x) for x in sources[a:b]]
            for page, p in zip(parsed, sent.value.marginals(parsed), strict=True):
                texts.append("\n".join(t for t, x in zip(page.text, p.tolist(), strict=True) if t is not None and x > 0.5))
        return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

    return append(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], compute, [source], keep=keep)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages), keep=["page_id", "url"])
