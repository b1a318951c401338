"""Substring dedup of word windows with a count-min prefilter.

Documents are dealt into blocks. A block sends a sketch of its windows: the cells that it touches in each row of one
wide count-min sketch. Merging the sketches of all blocks gives every cell's count, which is never below a
window's true count, and each block gets back one bit for each cell it touched. The second pass sends only windows
whose cells all say "repeated", with the block's smallest document, grouped by two digests of the word
sequence, and gets back one bit each: does a smaller document hold it? A window sends at most one entry from each
block, so a passage that a third of the documents share stays small. The sketch is never broadcast: its width follows
the data, and so does the number of ranges; blocks and ranges meet through the levels of ``exchange``.

Words are told apart by their bytes, or 120 bits of their digest from 16 bytes on; windows by 96 bits of two digests
and the bits that number the ranges. Among n different windows of r ranges, any two are taken for one with a chance
of n * n / r / 2**97: less than 1 in 10**12 for 30 GB, and 1 in 10**9 for 100 TB.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, table, utf8
from .exchange import FRAGMENT, Exchange, Kind, answers, decode, encode, flags, fragments  # noqa: F401
from .words import SPACES, covered, mix, windows_of, words_of

WINDOW = 13
#: Bytes of text in a block, sketch rows, cells a window in each row, cells in a range, exact keys in a range.
BLOCK_BYTES, DEPTH, CELLS, RANGE_BITS, RANGE_KEYS = 5 << 20, 2, 4, 22, 1 << 20
LEAST_BLOCKS = 12
#: A bound below the mean length of words with the space after them: it only sizes the sketch.
WORD_BYTES = 6
NO_KEY = np.iinfo(np.int64).max


class Block:
    """Windows of a block of documents, and its different windows in order, whatever the order of its rows."""

    def __init__(self, keys: np.ndarray, texts: list[bytes], size: int):
        heads, tails, docs, places = [], [], [], []
        self.n_words = np.zeros(len(texts), np.int64)
        for a, b in chunks(texts):
            words = words_of(texts[a:b], SPACES)
            self.n_words[a:b] = np.diff(words.first)
            at, head, tail = windows_of(words, size)
            heads.append(head)
            tails.append(tail)
            docs.append((words.text[at] + a).astype(np.int32))
            places.append((at - words.first[words.text[at]]).astype(np.int32))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        head, tail, self.doc, self.place = join(heads, np.uint64), join(tails, np.uint64), join(docs, np.int32), join(places, np.int32)
        order = np.argsort(head, kind="stable")
        same = head[order][1:] == head[order][:-1]
        if (same & (tail[order][1:] != tail[order][:-1])).any():
            order = np.lexsort((tail, head))
        h, t = head[order], tail[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        start = np.flatnonzero(new)
        self.head, self.tail = h[start], t[start]
        self.which = np.empty(len(order), np.int32)
        self.which[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(keys[self.doc[order]], start) if len(start) else np.zeros(0, np.int64)
        self.twice = np.diff(start, append=len(order)) > 1


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """Document numbers; null counts as larger than any."""
    return column.cast(pa.int64()).fill_null(NO_KEY).to_numpy()


def _cells(block: Block, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a sketch row that the block touches, the cell of each window, and the windows in each cell."""
    cell = mix(block.head, 11 + row) >> np.uint64(64 - bits)
    touched, which = np.unique(cell, return_inverse=True)
    return touched, which, np.bincount(which, weights=1 + block.twice, minlength=len(touched))


def without_repeats(docs: DataFrame, key: str, text: str, fields: list[T.StructField], result, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``result(table, texts, n_words, removed)`` of each block, removed the flags of each document's words (None: no word).

    Rows are dealt by key and text, so rows without a key, or of one key, spread like others.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-total // block_bytes))
    bits = max(RANGE_BITS - 6, math.ceil(math.log2(max(1, total / WORD_BYTES * CELLS))))
    key_bits = max(1, math.ceil(math.log2(max(2, total / WORD_BYTES / RANGE_KEYS / 2))))
    (dealing,) = fresh(docs, "_block")
    dealt = docs.withColumn(dealing, F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(blocks)))
    sketches = Exchange({row: Kind(bits, max(0, bits - RANGE_BITS), ("count",), lambda n: n > 1) for row in range(DEPTH)}, blocks)
    smaller = lambda told, first, own, total: told | (own[0] > total[0])
    exact = Exchange({DEPTH: Kind(key_bits + 32, key_bits, ("min",), np.zeros_like, smaller, second=True)}, blocks)

    def block_of(given: pa.Table) -> tuple[int, list[bytes], Block]:
        texts = utf8(given.column(text))
        return given.column(dealing)[0].as_py(), texts, Block(_keys(given.column(key)), texts, size)

    def short(head: np.ndarray) -> np.ndarray:
        return head >> np.uint64(32 - key_bits) if key_bits < 32 else head

    def sketch(given: pa.Table) -> pa.Table:
        number, _, block = block_of(given)
        rows = []
        for row in range(DEPTH):
            touched, _, count = _cells(block, row, bits)
            rows += sketches.send(row, number, touched, count)
        return fragments(rows)

    def candidates(given: pa.Table, said: pa.Table) -> pa.Table:
        if not given.num_rows:
            return fragments([])
        number, _, block = block_of(given)
        said = answers(said)
        likely = np.ones(len(block.head), bool)
        for row in range(DEPTH):
            touched, which, _ = _cells(block, row, bits)
            likely &= sketches.told(said, row, number, touched)[which] > 0
        own = [(-1 - number, number, np.packbits(likely).tobytes())]
        return fragments(own + exact.send(DEPTH, number, short(block.head[likely]), block.least[likely], second=block.tail[likely]))

    def finish(given: pa.Table, said: pa.Table) -> pa.Table:
        if not given.num_rows:
            return pa.table({f.name: [] for f in fields})
        number, texts, block = block_of(given)
        said = answers(said)
        likely = flags(said[-1 - number], len(block.head))
        earlier = np.zeros(len(block.head), bool)
        earlier[likely] = exact.told(said, DEPTH, number, short(block.head[likely])) > 0
        gone = earlier[block.which] | (_keys(given.column(key))[block.doc] > block.least[block.which])
        first = np.concatenate([[0], np.cumsum(block.n_words)])
        inside = covered((first[block.doc] + block.place)[gone], size, int(first[-1]))
        removed: list = [None] * len(texts)
        for i in np.unique(block.doc[gone]).tolist():
            removed[i] = inside[first[i] : first[i + 1]]
        return result(given, texts, block.n_words, removed)

    by_block = dealt.groupBy(f"`{dealing}`")
    counts = sketches.settle(by_block.applyInArrow(sketch, FRAGMENT))
    told = exact.settle(by_block.cogroup(counts.groupBy("block")).applyInArrow(candidates, FRAGMENT))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(finish, T.StructType(fields))


def cut_words(text: bytes, removed: np.ndarray) -> bytes:
    """The text without the removed words and the white space after them."""
    words = words_of([text], SPACES)
    start = np.append(words.start, len(text))
    keep = np.ones(len(text), bool)
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, start[:-1][removed], 1)
    np.add.at(change, start[1:][removed], -1)
    keep &= np.cumsum(change[:-1]) == 0
    return np.frombuffer(text, np.uint8)[keep].tobytes()


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row.

    A word goes if a window of 13 words over it also starts in a document with a smaller key, judged on the input.
    Null text has no words; rows of one key never remove each other; a null key counts as the largest.
    """
    fields = [docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def result(given: pa.Table, texts: list[bytes], n_words: np.ndarray, removed: list) -> pa.Table:
        kept = [b" ".join(t.split() if r is None else compress(t.split(), (~r).tolist())) for t, r in zip(texts, removed, strict=True)]
        return pa.table([given.column(key), pa.array(n_words), pa.array([0 if r is None else int(r.sum()) for r in removed], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=[f.name for f in fields])

    return without_repeats(docs.select(key, text), key, text, fields, result, **more)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """All rows and columns of the documents, texts without their repeated words; other texts stay byte for byte."""
    names = docs.columns

    def result(given: pa.Table, texts: list[bytes], n_words: np.ndarray, removed: list) -> pa.Table:
        old = given.column(text).to_pylist()
        new = pa.array([o if r is None else cut_words(t, r).decode() for o, t, r in zip(old, texts, removed, strict=True)], pa.string())
        return pa.table([new if c == text else given.column(c) for c in names], names=names)

    return without_repeats(docs, key, text, list(docs.schema.fields), result, **more)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept and removed of every document."""
    return digests(table(spark, sf_dir, "documents"))


_WINDOW = " || ' ' || ".join(["w[i]", *[f"w[i+{k}]" for k in range(1, WINDOW)]])
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, {_WINDOW} AS s FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i) WHERE len(w) >= {WINDOW}),
gone AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
word AS (SELECT r, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
hit AS (SELECT DISTINCT r, i + k AS i FROM gone, unnest(range(0, {WINDOW})) AS u(k)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN hit USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
