"""Benchmark decontamination over suffix arrays of the training text.

Each task takes its documents in shards of some megabytes, sorts the suffixes of a shard's words into a suffix array,
and binary-searches every suffix of the benchmark items in it. The neighbours found give the longest verbatim match
of each item suffix and of each document, with their places; the ranges found give every occurrence of each window.
Documents are read once and never shuffled.

Words are compared by their bytes (120 bits of a digest from 16 bytes on) and numbered as the benchmark has them; a
document word outside the benchmark ends every match, so suffixes start at benchmark words and end before others.
The benchmark is read in blocks of bounded size, each broadcast in turn; what earlier blocks have found is
checkpointed before the next is sent, so neither the plan nor a task ever holds two. Matches are measured by names of runs of
1, 2, 4, ... words, so long verbatim items cost little more than short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, chunks, cut, small_batches, table, utf8
from .words import NOT_ALPHANUMERIC, Words, covered, words_of

WINDOW = 13
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 8 << 20
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: The longest verbatim match of a document: words, where it starts, the item and where it starts there.
LONGEST = T.StructType([T.StructField("words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_start", T.LongType())])
_LONGEST = pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Suffixes:
    """The suffix array of numbered words (0 ends a suffix), sorted by their first ``depth`` words at least."""

    def __init__(self, word: np.ndarray, depth: int, known: Suffixes | None = None):
        n = len(word)
        self.word = np.append(word, 0)
        stop = np.where(self.word == 0, np.arange(n + 1), n)
        self.run = (np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n + 1))[:n]
        self.runs = Runs(self.word, self.run, depth, None if known is None else known.runs)
        at = np.flatnonzero(self.run)
        # a rank is the first place of the group of suffixes that are still equal, and one; each round doubles the words compared
        rank = np.zeros(n + 1, np.int64)
        first = self.word[at]
        order = np.argsort(first, kind="stable")
        rank[at[order]] = _firsts(first[order]) + 1
        shared, length = at, 1
        while length < depth:
            count = np.bincount(rank[shared], minlength=len(at) + 2)
            shared = shared[(count[rank[shared]] > 1)]
            if not len(shared):
                break
            after = np.where(self.run[shared] > length, rank[np.minimum(shared + length, n)], 0)
            key = rank[shared] * (len(at) + 2) + after
            order = np.argsort(key, kind="stable")
            old, place = rank[shared][order], _firsts(key[order])
            rank[shared[order]] = old + place - _firsts(old)
            length *= 2
        self.order = at[np.argsort(rank[at], kind="stable")]


def _firsts(ascending: np.ndarray) -> np.ndarray:
    """For each place of an ascending array, the first place of the same value."""
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ascending)), 0))


class Runs:
    """Names of the runs of 1, 2, 4, ... words from each place of numbered words; equal runs have equal names, 0 is none.

    The names are those of the benchmark's runs, made from pairs of names of half the length; a shard looks its pairs up. So how
    many words two places have in common takes as many comparisons as that number has binary digits.
    """

    def __init__(self, word: np.ndarray, run: np.ndarray, longest: int, known: Runs | None = None):
        self.levels, self.pairs = [np.append(word[: len(run)], 0).astype(np.int32)], []
        at = np.flatnonzero(run)
        while 2 << len(self.pairs) <= longest:
            half = 1 << len(self.pairs)
            last = self.levels[-1]
            at = at[run[at] >= 2 * half]
            pair = last[at].astype(np.int64) << 32 | last[at + half]
            there = (last[at] > 0) & (last[at + half] > 0)
            at, pair = at[there], pair[there]
            if known is None:
                self.pairs.append(np.unique(pair))
                place, found = np.searchsorted(self.pairs[-1], pair), np.ones(len(pair), bool)
            else:
                named = known.pairs[len(self.pairs)]
                self.pairs.append(named)
                place = np.minimum(np.searchsorted(named, pair), max(len(named) - 1, 0))
                found = named[place] == pair if len(named) else np.zeros(len(pair), bool)
            at, place = at[found], place[found]
            level = np.zeros(len(last), np.int32)
            level[at] = place + 1
            self.levels.append(level)


def common(a: Runs, i: np.ndarray, b: Runs, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that the places i of a and j of b have in common, up to ``most``, which neither passes the end with."""
    length = np.zeros(len(i), np.int64)
    for k in range(len(a.levels) - 1, -1, -1):
        going = np.flatnonzero(length + (1 << k) <= most)
        name = a.levels[k][i[going] + length[going]]
        same = going[(name > 0) & (name == b.levels[k][j[going] + length[going]])]
        length[same] += 1 << k
    return length


def bound(shard: Suffixes, tests: Suffixes, wanted: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """Where the first ``size`` words of each wanted suffix would stand in the shard's order; ``after`` all that begin so, else before."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(shard.order))
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        test, place, limit = wanted[open_], shard.order[middle], size[open_]
        same = common(tests.runs, test, shard.runs, place, np.minimum(limit, shard.run[place]))
        whole = same == limit
        less = shard.word[place + same] < tests.word[np.minimum(test + same, len(tests.word) - 1)]
        right = np.where(whole, after, less)
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
    return low


def _joined(words: Words, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with a 0 after each text, and where each word stands."""
    out = np.zeros(len(number) + len(words.base), np.int64)
    place = np.arange(len(number)) + words.text
    out[place] = number
    return out, place


class Benchmark:
    """Words, suffixes and windows of a block of items."""

    def __init__(self, items: list[tuple[object, str]], size: int = WINDOW):
        self.size, self.ids = size, [None if i is None else str(i) for i, _ in items]
        words = words_of([(t or "").encode() for _, t in items], NOT_ALPHANUMERIC, fold=True)
        order = np.lexsort((words.high, words.low))
        low, high = words.low[order], words.high[order]
        new = np.ones(len(order), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        self.low, self.high = low[new], high[new]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new)
        joined, place = _joined(words, number)
        n = np.diff(words.first)
        self.depth = int(n.max()) if len(n) else 0
        self.suffixes = Suffixes(joined, max(self.depth, 1))
        self.item = np.zeros(len(joined), np.int64)
        self.item[place] = words.text
        self.offset = np.zeros(len(joined), np.int64)
        self.offset[place] = np.arange(len(place)) - words.first[words.text]
        # a window starts at each word that has enough words after it; an item of fewer is one window
        width = np.zeros(len(joined), np.int64)
        width[place] = np.minimum(n, size)[words.text]
        self.windows = np.flatnonzero((width > 0) & (self.suffixes.run >= width)) if len(place) else np.zeros(0, np.int64)
        self.width = width[self.windows]

    def number(self, words: Words) -> np.ndarray:
        """The benchmark's number of each word, 0 of others."""
        at = np.searchsorted(self.low, words.low)
        last = len(self.low) - 1
        while len(later := np.flatnonzero((at < last) & (self.low[np.minimum(at, last)] == words.low) & (self.high[np.minimum(at, last)] < words.high))):
            at[later] += 1
        at = np.minimum(at, last)
        return np.where((self.low[at] == words.low) & (self.high[at] == words.high), at + 1, 0)

    def search(self, texts: list[bytes]) -> Found:
        """What the items share with a shard of texts."""
        words = words_of(texts, NOT_ALPHANUMERIC, fold=True)
        found = Found(np.diff(words.first), [None] * len(texts), [set() for _ in texts], np.zeros((len(texts), 4), np.int64), np.zeros((len(self.ids), 4), np.int64))
        found.longest[:, 2] = found.of_item[:, 1] = -1
        if not len(self.low) or not len(words.low):
            return found
        joined, place = _joined(words, self.number(words))
        tests = self.suffixes
        shard = Suffixes(joined, max(self.depth, 1), tests)
        if not len(shard.order):
            return found
        text = np.zeros(len(joined), np.int64)
        text[place] = words.text
        start = np.arange(len(joined)) - (words.first[:-1] + np.arange(len(texts)))[text]
        every, all_words = tests.order, np.full(len(joined), self.depth)
        at = bound(shard, tests, every, tests.run[every], False)
        self._longest(found, shard, every, at, text, start, all_words)
        self._windows(found, shard, text, start, words)
        return found

    def _longest(self, found: Found, shard: Suffixes, every: np.ndarray, at: np.ndarray, text: np.ndarray, start: np.ndarray, most: np.ndarray) -> None:
        """The longest match of each item and of each text: that of a suffix is with a neighbour in the common order."""
        tests = self.suffixes
        for near in (at - 1, at):
            there = np.flatnonzero((near >= 0) & (near < len(shard.order)))
            i, j = every[there], shard.order[near[there]]
            length = common(tests.runs, i, shard.runs, j, np.minimum(tests.run[i], shard.run[j]))
            k = _best(length, self.item[i], found.of_item[:, 0], self.offset[i])
            found.of_item[self.item[i[k]]] = np.stack([length[k], text[j[k]], start[j[k]], self.offset[i[k]]], axis=1)
        before = np.searchsorted(at, np.arange(len(shard.order)), side="right")  # item suffixes up to each suffix of the shard
        for near in (before - 1, before):
            there = np.flatnonzero((near >= 0) & (near < len(every)))
            i, j = every[near[there]], shard.order[there]
            length = common(tests.runs, i, shard.runs, j, np.minimum(tests.run[i], np.minimum(shard.run[j], most[j])))
            k = _best(length, text[j], found.longest[:, 0], start[j])
            found.longest[text[j[k]]] = np.stack([length[k], start[j[k]], self.item[i[k]], self.offset[i[k]]], axis=1)

    def _windows(self, found: Found, shard: Suffixes, text: np.ndarray, start: np.ndarray, words: Words) -> None:
        """Words inside occurrences of windows, and the items of these."""
        tests = self.suffixes
        low, high = (bound(shard, tests, self.windows, self.width, after) for after in (False, True))
        seen = np.flatnonzero(high > low)
        if not len(seen):
            return
        # equal windows have one range, so each place of the shard is met once for each width of windows
        ranges, which = np.unique(np.stack([low[seen], high[seen], self.width[seen]], axis=1), axis=0, return_inverse=True)
        count = ranges[:, 1] - ranges[:, 0]
        owner = np.repeat(np.arange(len(ranges)), count)
        j = shard.order[np.repeat(ranges[:, 0] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
        begin = words.first[text[j]] + start[j]
        inside = covered(begin, ranges[owner, 2], len(words.text))
        pair = np.unique(np.stack([text[j], owner], axis=1), axis=0)
        items = np.split(self.item[self.windows[seen]][np.argsort(which, kind="stable")], np.cumsum(np.bincount(which, minlength=len(ranges)))[:-1])
        names = [sorted({self.ids[k] for k in np.unique(x).tolist()} - {None}) for x in items]
        for t, r in pair.tolist():
            found.items[t].update(names[r])
        for t in np.unique(pair[:, 0]).tolist():
            a, b = words.first[t], words.first[t + 1]
            cover = np.diff(inside[a:b].astype(np.int8), prepend=0, append=0)
            found.spans[t] = list(zip(np.flatnonzero(cover == 1).tolist(), np.flatnonzero(cover == -1).tolist(), strict=True))


def _best(length: np.ndarray, owner: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each owner whose longest is longer than what is known, where that longest is; the first by ``place``."""
    order = np.lexsort((place, -length, owner))
    new = np.ones(len(order), bool)
    new[1:] = owner[order][1:] != owner[order][:-1]
    top = order[new]
    return top[length[top] > known[owner[top]]]


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Found:
    """Of each text: words, spans of words hit (None: none), items, longest match (words, start, item, start there). Of each item: its longest (words, text, start, start in the item)."""

    n_words: np.ndarray
    spans: list
    items: list[set]
    longest: np.ndarray
    of_item: np.ndarray


_LAST: list = []


def built(items: list[tuple[object, str]]) -> Benchmark:
    """The benchmark of a broadcast list of items; a worker keeps the last that it has made."""
    if not _LAST or _LAST[0] is not items:
        _LAST[:] = [items, Benchmark(items)]
    return _LAST[1]


def blocks(benchmark: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[object, str]]]:
    """Items in lists of about ``limit`` bytes of text, each item whole; the driver holds one list at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(f"`{key}`"), F.col(f"`{text}`")).toLocalIterator():
        held.append((row[0], row[1]))
        size += len((row[1] or "").encode())
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row with n_words, n_hit, items (ids as sorted strings), spans of words hit, longest (match in words) and longest_match.

    ``longest_match`` has the words, the document's word and the item's word where it starts, and the item. Null and empty texts
    have no words; the windows of an item without an id count for n_hit, only its name is missing. Clashing columns of the
    input are replaced.
    """
    made_columns = ("n_words", "n_hit", "items", "spans", "longest", "longest_match")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPAN), T.StructField("longest_match", LONGEST)]
    spark = docs.sparkSession
    out = docs.drop(*made_columns) if keep is None else docs.select(text, *[c for c in keep if c != text])
    wanted = [c for c in out.columns if keep is None or c in keep]

    def with_block(given_docs: DataFrame, sent, first: bool) -> DataFrame:
        def compute(given: pa.Table) -> list:
            bench = built(sent.value)
            texts = utf8(given.column(0))
            n_all, items_all, spans_all, longest_all = [], [], [], []
            for a, b in chunks(texts):
                found = bench.search(texts[a:b])
                n_all += found.n_words.tolist()
                spans_all += [s or [] for s in found.spans]
                items_all += [sorted(x) for x in found.items]
                longest_all += [(n, x, bench.ids[i] if n else None, y) for n, x, i, y in found.longest.tolist()]
            if not first:
                for i, (old_items, old_spans, old) in enumerate(zip(*(given.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    items_all[i] = sorted({*items_all[i], *old_items})
                    spans_all[i] = merged(np.array([*spans_all[i], *[(s["start"], s["end"]) for s in old_spans]], np.int64).reshape(-1, 2))
                    if old["words"] >= longest_all[i][0]:
                        longest_all[i] = (old["words"], old["start"], old["item"], old["item_start"])
            spans_out = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans_all], _SPAN)
            longest_out = pa.array([dict(zip(("words", "start", "item", "item_start"), x, strict=True)) for x in longest_all], _LONGEST)
            return [pa.array(n_all, pa.int64()), pa.array(items_all, pa.list_(pa.string())), spans_out, longest_out]

        return append(given_docs, fields, compute, [text] if first else [text, "items", "spans", "longest_match"])

    sent = None
    for part in blocks(benchmark, item, item_text, block_bytes):
        if sent is not None:
            out = cut(out)
            sent.destroy()
        first, sent = sent is None, spark.sparkContext.broadcast(part)
        out = with_block(out, sent, first)
    if sent is None:
        out = with_block(out, spark.sparkContext.broadcast([]), True)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(*[F.col(f"`{c}`") for c in wanted], "n_words", n_hit.alias("n_hit"), "items", "spans", F.col("longest_match.words").alias("longest"), "longest_match")


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, words, item_start, doc, start): the longest verbatim match of each item in the documents, and where.

    Among equal ones that of the smallest document counts. Items of one id count as one; an item that shares no word with any
    document has no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("words", T.LongType()), T.StructField("item_start", T.LongType()), given.schema["doc"], T.StructField("start", T.LongType())])
    out = None

    def of_block(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = built(sent.value)
            for batch in batches:
                texts = utf8(batch.column(1))
                for a, b in chunks(texts):
                    best = bench.search(texts[a:b]).of_item
                    some = np.flatnonzero(best[:, 0] > 0)
                    doc = batch.column(0).take(pa.array(best[some, 1] + a))
                    columns = [pa.array([bench.ids[i] for i in some.tolist()], pa.string()), pa.array(best[some, 0]), pa.array(best[some, 3]), doc, pa.array(best[some, 2])]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return run

    for part in blocks(benchmark, item, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(part)
        one = cut(given.mapInArrow(of_block(sent), schema))  # before the next block is sent
        sent.destroy()
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], schema)
    order = F.struct((-F.col("words")).alias("n"), F.col("doc").isNull().alias("none"), "doc", "start", "item_start")
    best = out.groupBy("item_id").agg(F.min(order).alias("b"))
    return best.select("item_id", (-F.col("b.n")).alias("words"), "b.item_start", "b.doc", "b.start")


def contaminated() -> Column:
    """The rule: some words hit, and a twentieth of all words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """The documents without those that the rule calls contaminated; columns stay as they are."""
    marked = matches(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_row", F.col(f"`{more.pop('text', 'text')}`").alias("text")), benchmark, **more)
    return marked.where(~contaminated()).select("_row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit, items found and verdict of every document."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), contaminated().alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id::VARCHAR AS item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k),
hit AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (k, s)),
n AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, k)) AS u(j) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""
