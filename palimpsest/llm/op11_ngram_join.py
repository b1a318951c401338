"""N-gram Jaccard self-join by universe partition and pigeonhole.

A document is the set of its different word shingles. Equal sets are one from the start. Sets are dealt into bands of
size, each no wider than the similarity allows, so a set has partners in its own band and the one below. In a band
shingles are hashed into segments, one more than two similar sets can differ in, so some segment of the two is equal;
or, where one segment is left out and another allows one difference, one of those agrees up to one shingle. Each band
indexes all segments of its sets and, of some segments, what is left when one shingle is deleted. A set then asks
only as many segments as it must, those of least cost: a count-min sketch over all documents tells how common a segment
is, so empty ones and those of passages that many documents share are left out wherever others can stand in.

Sets that meet are first compared with the most popular set that they meet often, and joined where similar, a few times over;
then every meeting of sets that are still apart is compared, unless parities of hashed shingles already show too many differences. Sets are always
compared by all their shingles. So copies of copies never make all pairs, and no link between groups is lost.

A shingle is told by 64 bits of a digest, a set by 96 bits and its size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, small_batches, stored, table, utf8
from .components import components
from .words import SPACES, mix, windows_of, words_of

SHINGLE, PERCENT = 5, 80
#: Cells in a row of the sketch of segment counts, and rows; the sketch has this size whatever the corpus.
CELLS, DEPTH, PARTS = 1 << 18, 2, 16
#: Bits whose parity is kept of each set, as a lower bound of differences.
PARITY = 1024
#: 64-bit words of the parities, folded, that meet at places.
FOLDED = 8
#: Candidate sets whose texts are picked by a broadcast list of so many digests at most (16 bytes each); beyond it by a shuffle.
LISTED = 1 << 20
#: Rounds in which sets are compared with one popular set each, before all that are still apart are.
ROUNDS = 1
#: What asking for an empty segment costs.
EMPTY = 1e12
INDEX, INDEX_LESS, ASK, ASK_MORE, ASK_LESS = 1, 2, 4, 8, 16


class Bands:
    """Bands of set sizes lo..hi and their numbers of segments, for a least similarity in per cent."""

    def __init__(self, percent: int = PERCENT, most: int = 1 << 40):
        self.percent, lo = percent, [1]
        while lo[-1] <= most:
            lo.append(lo[-1] * 100 // percent + 1)
        self.lo = np.array(lo[:-1])
        self.hi = np.array(lo[1:]) - 1
        self.segments = self.differences(self.hi, self.hi * 100 // percent) + 1
        # of so many segments the one-deletion neighbourhoods are indexed too
        self.spare = np.minimum(self.segments, np.maximum(4, self.segments // 16 + 1))

    def differences(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Most shingles that are in one only of two similar sets of these sizes."""
        return (r + s) * (100 - self.percent) // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, n, "right") - 1


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the different shingles of each text in ascending order, and where each text's begin.

    A to Z in lower case; a text of fewer words is one shingle, one without words none.
    """
    words = words_of(texts, SPACES, fold=True)
    at, token, _ = windows_of(words, size)
    text = words.text[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = [hashlib.blake2b(b" ".join(texts[i].lower().split()), digest_size=8).digest() for i in short.tolist()]
        token, text = np.concatenate([token, np.frombuffer(b"".join(whole), "<u8")]), np.concatenate([text, short])
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    token, text = token[new], text[new]
    return token, np.searchsorted(text, np.arange(len(texts) + 1))


def identities(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that tell a set: a digest; the size and 32 more bits."""
    n = np.diff(first)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(token, s), dtype=np.uint64)]) for s in (3, 4)]
    a, tag = (mix(x[first[1:]] - x[first[:-1]], 5) for x in sums)
    return a.view(np.int64), n.astype(np.int64) << 32 | (tag >> np.uint64(32)).astype(np.int64)


def parities(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set, whether an odd number of its shingles falls on each of PARITY bits, as rows of 64-bit numbers."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    odd = np.bincount(text * PARITY + (mix(token, 6) & np.uint64(PARITY - 1)).astype(np.int64), minlength=(len(first) - 1) * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, PARITY), axis=1).view(np.int64)


class Segments:
    """Segments of some sets, each in a band of its own or the one below."""

    def __init__(self, token: np.ndarray, first: np.ndarray, sets: np.ndarray, band: np.ndarray, bands: Bands):
        n = np.diff(first)[sets]
        self.m = bands.segments[band]
        begin = np.concatenate([[0], np.cumsum(self.m)])
        self.view = np.repeat(np.arange(len(sets)), self.m)
        self.number = np.arange(begin[-1]) - begin[self.view]
        self.salt = mix((band[self.view].astype(np.uint64) << np.uint64(40)) | self.number.astype(np.uint64), 7)
        at = np.repeat(first[sets] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        view = np.repeat(np.arange(len(sets)), n)
        self.at = begin[view] + (mix(token[at], 8) % self.m[view].astype(np.uint64)).astype(np.int64)
        self.token = mix(token[at], 9)
        self.sum = np.zeros(int(begin[-1]), np.uint64)
        np.add.at(self.sum, self.at, self.token)
        self.size = np.bincount(self.at, minlength=len(self.sum))
        self.spare = self.number < bands.spare[band][self.view]
        self.key = mix(self.sum + self.salt, 10)

    def less(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment, and key of what is left of it without one shingle, for each shingle of the wanted segments."""
        pick = wanted[self.at]
        at = self.at[pick]
        return at, mix(self.sum[at] - self.token[pick] + self.salt[at], 10)

    def asked(self, need: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        """What each segment is asked for: 0 nothing, 1 equality, 2 one difference as well; ``need`` in sum for each set, at least cost.

        Asking for more of a segment never costs less than asking for it at all, so taking the cheapest steps is best.
        """
        cost = np.where(self.size == 0, EMPTY, 1.0 + estimate(sketch, self.key))
        at, key = self.less(self.spare)
        more = np.zeros(len(cost))
        np.add.at(more, at, 1.0 + estimate(sketch, key))
        spare = np.flatnonzero(self.spare)
        more = np.where(self.size[spare] == 1, EMPTY, more[spare])
        cost2 = np.maximum(cost[spare], more) + 0.5
        view = np.concatenate([self.view, self.view[spare]])
        order = np.lexsort((np.concatenate([cost, cost2]), view))
        begin = np.searchsorted(view[order], np.arange(len(need)))
        taken = np.zeros(len(order), bool)
        taken[order] = np.arange(len(order)) - begin[view[order]] < need[view[order]]
        out = taken[: len(cost)].astype(np.int64)
        out[spare] += taken[len(cost) :]
        return out


def _places(key: np.ndarray) -> Iterator[np.ndarray]:
    for row in range(DEPTH):
        yield (mix(key, 20 + row) & np.uint64(CELLS - 1)).astype(np.int64)


def estimate(sketch: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many sets have a segment: never too few."""
    return np.minimum.reduce([sketch[row][x] for row, x in enumerate(_places(key))]).astype(float)


def entries(token: np.ndarray, first: np.ndarray, bands: Bands, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, role) of all that the sets index and ask."""
    n = np.diff(first)
    band = bands.of(np.maximum(n, 1))
    out = []
    # sets that are too small to differ even from the largest that may be similar have equal ones only
    own = np.flatnonzero((n > 0) & (bands.differences(n * 100 // bands.percent, n) > 0))
    seg = Segments(token, first, own, band[own], bands)
    # the larger of two sets asks; one that can differ from larger ones only is asked for
    most = bands.differences(n[own], n[own])
    v = seg.asked(np.where(most > 0, most + 1, 0), sketch)
    out.append((own[seg.view], seg.key, INDEX | ASK * (v > 0) | ASK_MORE * (v > 1)))
    at, key = seg.less(seg.spare)
    out.append((own[seg.view[at]], key, INDEX_LESS | ASK_LESS * (v[at] > 1)))
    below = own[(band[own] > 0) & (100 * bands.hi[np.maximum(band[own] - 1, 0)] >= bands.percent * n[own])]
    seg = Segments(token, first, below, band[below] - 1, bands)
    v = seg.asked(bands.differences(bands.hi[band[below] - 1], n[below]) + 1, sketch)
    out.append((below[seg.view[v > 0]], seg.key[v > 0], ASK | ASK_MORE * (v[v > 0] > 1)))
    at, key = seg.less(v > 1)
    out.append((below[seg.view[at]], key, np.full(len(at), ASK_LESS)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _facts(docs: DataFrame, size: int, bands: Bands) -> tuple[DataFrame, np.ndarray]:
    """(key, a, b, parity, t1, t2) of every row, and the count-min sketch of the segments of all sets, of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros((DEPTH, CELLS), np.int64), set()
        for batch in batches:
            a, b, parity = [], [], []
            texts = utf8(batch.column(1))
            for i, j in chunks(texts):
                token, first = shingle_sets(texts[i:j], size)
                x, y = identities(token, first)
                a.append(x)
                b.append(y)
                parity.append(parities(token, first))
                n = np.diff(first)
                new = np.array([k for k, s in enumerate(zip(x.tolist(), y.tolist(), strict=True)) if n[k] and s not in seen and not seen.add(s)], np.int64)
                key = Segments(token, first, new, bands.of(n[new]), bands).key
                for row, at in enumerate(_places(key)):
                    cells[row] += np.bincount(at, minlength=CELLS)
            if texts:
                columns = [batch.column(0), pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), _lists(np.concatenate(parity)), batch.column(2), batch.column(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())], names=names)
        if seen:
            parts = [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in np.split(cells, PARTS, axis=1)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(PARTS, f.type) for f in given], pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in parts.column("cells").to_pylist())
        return pa.table({"part": parts.column("part")[:1], "cells": pa.array([total.tobytes()], pa.binary())})

    kind = docs.dtypes[0][1]
    arrow = docs.limit(0).select(docs.columns[0]).toArrow().schema.field(0).type
    names = ["key", "a", "b", "parity", "t1", "t2", "part", "cells"]
    given = [pa.field("key", arrow), pa.field("a", pa.int64()), pa.field("b", pa.int64()), pa.field("parity", pa.list_(pa.int64())), pa.field("t1", pa.int64()), pa.field("t2", pa.int64())]
    made = stored(docs.mapInArrow(run, f"key {kind}, a long, b long, parity array<long>, t1 long, t2 long, part int, cells binary"))
    sums = made.where("part IS NOT NULL").select("part", "cells").groupBy("part").applyInArrow(add, "part int, cells binary").collect()  # PARTS rows, whatever the corpus
    sketch = np.zeros((DEPTH, CELLS), np.int64)
    for r in sums:
        sketch[:, r.part * CELLS // PARTS : (r.part + 1) * CELLS // PARTS] = np.frombuffer(r.cells, np.int64).reshape(DEPTH, -1)
    return made.where("part IS NULL").drop("part", "cells"), sketch


def _meetings(docs: DataFrame, size: int, bands: Bands, sketch: np.ndarray) -> DataFrame:
    """(place, a, n, role, here): sets at places where different sets meet, and how many meet there."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # copies that a task reads are one
        for batch in batches:
            texts = utf8(batch.column(0))
            for i, j in chunks(texts):
                token, first = shingle_sets(texts[i:j], size)
                a, b = identities(token, first)
                new = [k for k, s in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if s not in seen and not seen.add(s)]
                inside = np.zeros(len(a), bool)
                inside[new] = True
                token = token[np.repeat(inside, np.diff(first))]
                first = np.concatenate([[0], np.cumsum(np.diff(first)[inside])])
                which, key, role = entries(token, first, bands, sent.value)
                a, b = a[inside], b[inside]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(a[which]), pa.array((b[which] >> 32).astype(np.int32)), pa.array(role.astype(np.int8))], names=["place", "a", "n", "role"])

    rows = docs.mapInArrow(run, "place long, a long, n int, role byte")
    here = Window.partitionBy("place")
    met = rows.withColumns({"low": F.min("a").over(here), "high": F.max("a").over(here), "here": F.count("*").over(here)}).where("low <> high")
    return stored(met.drop("low", "high"))


def similar(r: Column, s: Column, percent: int) -> Column:
    """Whether the sizes alone allow two sets to be similar."""
    return 100 * F.least(r, s) >= percent * F.greatest(r, s)


def within(p: Column, q: Column, r: Column, s: Column, percent: int, words: int = PARITY // 64) -> Column:
    """Whether two sets of sizes r and s can be similar by their parities: each odd difference is a shingle that one of them lacks."""
    odd = sum((F.bit_count(p[i].bitwiseXOR(q[i])) for i in range(words)), F.lit(0))
    return odd * (100 + percent) <= (r + s) * (100 - percent)


def _compare(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (i, j) of set numbers whose sets are similar, by all their shingles."""
    facts = sets.select("id", "n", "parity", "t1", "t2")
    x, y = (facts.withColumnsRenamed({c: f"{c}_{k}" for c in facts.columns}) for k in "ij")
    n, parity = ([F.col(f"{c}_{k}") for k in "ij"] for c in ("n", "parity"))
    both = pairs.join(x.hint("merge"), F.col("i") == F.col("id_i")).join(y.hint("merge"), (F.col("j") == F.col("id_j")) & similar(*n, percent) & within(*parity, *n, percent))
    near = stored(both.select("i", "j", "t1_i", "t2_i", "t1_j", "t2_j"))
    ids = stored(near.select(F.explode(F.array(F.struct(F.col("t1_i").alias("t1"), F.col("t2_i").alias("t2")), F.struct(F.col("t1_j").alias("t1"), F.col("t2_j").alias("t2")))).alias("t")).select("t.*").distinct())
    wanted = F.broadcast(ids) if ids.count() <= LISTED else ids.hint("merge")
    texts = docs.select("text", "t1", "t2").join(wanted, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    texts = stored(texts)
    for k in "ij":
        own = texts.withColumnsRenamed({"t1": f"t1_{k}", "t2": f"t2_{k}", "text": f"text_{k}"})
        near = near.join(own.hint("merge"), [f"t1_{k}", f"t2_{k}"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [utf8(batch.column(c)) for c in (2, 3)]
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p, q in chunks([x + y for x, y in zip(*sides, strict=True)]):
                (t, first), (u, begin) = (shingle_sets(x[p:q], size) for x in sides)
                one, two = (np.repeat(np.arange(q - p), np.diff(f)) for f in (first, begin))
                token, row = np.concatenate([t, u]), np.concatenate([one, two])
                order = np.lexsort((token, row))
                twice = (token[order][1:] == token[order][:-1]) & (row[order][1:] == row[order][:-1])
                common = np.bincount(row[order][1:][twice], minlength=q - p)
                whole = np.diff(first) + np.diff(begin) - common
                good = (100 * common >= percent * whole) & (common > 0)
                yield pa.RecordBatch.from_arrays([pa.array(i[p:q][good]), pa.array(j[p:q][good])], names=["u", "v"])

    return stored(near.select("i", "j", "text_i", "text_j").mapInArrow(verify, "u long, v long"))


def _apart(met: DataFrame, told: DataFrame | None) -> DataFrame:
    """The meetings at places where sets of different components meet, with each set's component (top) and the place's most popular set."""
    named = met.withColumn("top", F.col("id")) if told is None else met.join(told.withColumnRenamed("vertex", "id").hint("merge"), "id", "left").withColumn("top", F.coalesce("component", "id")).drop("component")
    heads = named.groupBy("place").agg(F.min("top").alias("low"), F.max("top").alias("high"), F.max(F.struct("popular", "id", "top")).alias("h")).where("low <> high")
    heads = heads.select("place", F.col("h.id").alias("head"), F.col("h.top").alias("head_top"), F.col("h.popular").alias("head_popular"))
    return named.join(heads.hint("merge"), "place")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row; the component is the smallest key reachable over links.

    Rows link when 100 * common >= percent * all of their different shingles. Null texts and texts without words have
    no shingle, link with nothing and are their own component. Null keys name a component only where no other key is
    in it. Repeated rows each get a row; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    bands = Bands(percent)
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    docs = docs.select("key", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    facts, sketch = _facts(docs, size, bands)
    met = _meetings(docs.select("text"), size, bands, sketch)
    # one row for each different set, numbered; popular ones meet many others
    sets = facts.where("b >> 32 > 0").groupBy("a", "b").agg(F.min("key").alias("least"), F.min(F.struct("t1", "t2")).alias("t"), F.first("parity").alias("parity"))
    popular = met.groupBy("a", "n").agg(F.sum("here").alias("popular"))
    sets = stored(sets.withColumn("n", F.shiftright("b", 32).cast("int")).join(popular.hint("merge"), ["a", "n"], "left"))
    sets = stored(sets.select("a", "b", "n", "least", "t.t1", "t.t2", "parity", "popular", F.monotonically_increasing_id().alias("id")))
    met = stored(met.drop("here").join(sets.select("a", "n", "id", "popular").hint("merge"), ["a", "n"]).select("place", "id", "n", "popular", "role"))
    links, told, tried = None, None, None
    for _ in range(ROUNDS):
        # every set with the most popular one of some of its places, where it meets that most often and is not joined with it
        apart = _apart(met, told).where("top <> head_top")
        asked = apart.groupBy("id", "head").agg(F.count("*").alias("n"), F.first("head_popular").alias("p"))
        asked = asked if tried is None else asked.join(tried.hint("merge"), ["id", "head"], "left_anti")
        best = stored(asked.groupBy("id").agg(F.max(F.struct("n", "p", "head")).alias("m")).select("id", "m.head"))
        found = _compare(best.select(F.col("id").alias("i"), F.col("head").alias("j")), sets, docs, size, percent)
        tried = best if tried is None else tried.union(best)
        links = found if links is None else links.union(found)
        told = components(links)
        if found.isEmpty():
            break
    # then all that meet and are not joined yet: one of the two is not joined with the most popular one at their place
    named = stored(_apart(met, told).select("place", "id", "n", "role", "top", (F.col("top") == F.col("head_top")).alias("at_head")))
    folded = F.array(*[reduce(Column.bitwiseXOR, [F.col("parity")[i] for i in range(k, PARITY // 64, FOLDED)]) for k in range(FOLDED)])
    named = stored(named.join(sets.select("id", folded.alias("parity")).hint("merge"), "id"))
    x, y = (d.withColumnsRenamed({c: f"{c}_{k}" for c in ("id", "n", "role", "top", "at_head", "parity")}) for d, k in ((named.where("NOT at_head"), "x"), (named, "y")))
    asks = lambda s, r: ((F.col(f"role_{r}").bitwiseAND(INDEX) > 0) & (F.col(f"role_{s}").bitwiseAND(ASK | ASK_LESS) > 0)) | ((F.col(f"role_{r}").bitwiseAND(INDEX_LESS) > 0) & (F.col(f"role_{s}").bitwiseAND(ASK_MORE) > 0))
    meet = ((F.col("n_x") >= F.col("n_y")) & asks("x", "y")) | ((F.col("n_x") <= F.col("n_y")) & asks("y", "x"))
    may = (F.col("top_x") != F.col("top_y")) & similar(F.col("n_x"), F.col("n_y"), percent) & meet & within(F.col("parity_x"), F.col("parity_y"), F.col("n_x"), F.col("n_y"), percent, FOLDED)
    pairs = x.withColumnRenamed("place", "place_x").join(y.withColumnRenamed("place", "place_y").hint("merge"), (F.col("place_x") == F.col("place_y")) & may)
    pairs = stored(pairs.select(F.least("id_x", "id_y").alias("i"), F.greatest("id_x", "id_y").alias("j")).distinct())
    told = components(links.union(_compare(pairs, sets, docs, size, percent)))
    named = sets.join(told.hint("merge"), F.col("id") == F.col("vertex"), "left").select("a", "b", "least", F.coalesce("component", "id").alias("top"))
    least = named.groupBy("top").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least.hint("merge"), "top").select("a", "b", "component_id"))
    found = facts.join(named.hint("merge"), ["a", "b"], "left")
    alone = F.shiftright("b", 32) == 0
    return found.select(F.col("key").alias(key), F.shiftright("b", 32).alias("n_shingles"), F.when(alone, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard similarity of 5-word shingles of 0.8 or more."""
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
