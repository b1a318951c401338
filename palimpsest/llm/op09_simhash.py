"""Near duplicates by SimHash fingerprints and BK-trees.

Equal texts share a fingerprint, so trees hold different fingerprints only. Two fingerprints within the radius
agree on at least ``parts - radius`` of ``parts`` pieces; every choice of so many pieces makes a shard key, and each
shard is one BK-tree, whose children hang on an edge labelled with their integer distance to the parent. Trees
and their queries meet by a shuffle on the shard key, since neither has a proven size for a broadcast. All
trees of a task are built and searched together, level by level, and a search follows only edges whose
label differs from the distance to the parent by the radius at most. A shard sends a spanning forest of
the links it finds, which is enough for components and never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, cut, fresh, table, utf8
from .components import components

RADIUS = 3
SHINGLE = 3
#: Searches that a task follows at once, as (query, tree node) pairs.
FRONTIER = 1 << 20


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, A to Z in lower case, joined by single spaces."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[size:], strict=False)), np.uint64, len(words) - size + 1)


_HALVES = np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit as in more than half of the hashes; zero of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(kept columns, fp) of every row, fp a signed 64-bit number; null and empty texts have 0."""

    def compute(given: pa.Table) -> list:
        made = np.array([fingerprint(shingle_hashes(x)) for x in utf8(given.column(0))], np.uint64)
        return [pa.array(made.view(np.int64))]

    return append(docs, [T.StructField("fp", T.LongType())], compute, need=[text], keep=keep)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... count[i] numbers for each i."""
    total = int(count.sum())
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)


class Trees:
    """The BK-trees of consecutive shards; node i holds values[item[i]]."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        item, parent, label = [], [], []
        order = np.argsort(shard, kind="stable")
        group = np.unique(shard[order], return_inverse=True)[1]
        above, made = np.full(len(order), -1), 0
        edge = np.zeros(len(order), np.int64)
        while len(order):
            first = np.flatnonzero(np.diff(group, prepend=-1))
            item.append(order[first])
            parent.append(above[first])
            label.append(edge[first])
            nth = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
            rest = np.ones(len(order), bool)
            rest[first] = False
            order, root, nth = order[rest], order[first][nth][rest], nth[rest]
            edge = distance(values[order], values[root]).astype(np.int64)
            above = made + nth
            made += len(first)
            sort = np.lexsort((edge, above))
            order, edge, above = order[sort], edge[sort], above[sort]
            group = above * 65 + edge
        self.values = values
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        self.parent = np.concatenate(parent) if item else np.zeros(0, np.int64)
        self.label = np.concatenate(label) if item else np.zeros(0, np.int64)
        self.roots = np.flatnonzero(self.parent < 0)
        child = np.flatnonzero(self.parent >= 0)
        sort = np.lexsort((self.label[child], self.parent[child]))
        self.child = child[sort]
        self.child_key = self.parent[self.child] * 65 + self.label[self.child]

    def within(self, query: np.ndarray, node: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query item, found item) from searches that start at the given nodes."""
        waiting = [(query, node)]
        while waiting:
            query, node = waiting.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                waiting += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            d = distance(self.values[query], self.values[self.item[node]]).astype(np.int64)
            near = d <= radius
            yield query[near], self.item[node[near]]
            low = np.searchsorted(self.child_key, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.child_key, node * 65 + np.minimum(d + radius, 64), side="right")
            count = high - low
            if count.any():
                waiting.append((np.repeat(query, count), self.child[_ranges(low, count)]))


def forest(values: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger item, smaller item by place) that join the values within the radius in each shard, one less than values joined."""
    trees = Trees(values, shard)
    root_of = np.zeros(int(shard.max()) + 1 if len(shard) else 0, np.int64)
    root_of[shard[trees.item[trees.roots]]] = trees.roots
    label = np.arange(len(values))

    def top(x: np.ndarray) -> np.ndarray:
        while True:
            up = label[x]
            if (up == x).all():
                return x
            x = up

    for a, b in trees.within(np.arange(len(values)), root_of[shard], radius):
        apart = a != b
        a, b = a[apart], b[apart]
        while len(a):  # hook the larger top of each pair on the smaller until all pairs share theirs
            a, b = top(a), top(b)
            high, low = np.maximum(a, b), np.minimum(a, b)
            differ = high != low
            a, b = high[differ], low[differ]
            np.minimum.at(label, a, b)
    tops = top(np.arange(len(values)))
    moved = np.flatnonzero(tops != np.arange(len(values)))
    return moved, tops[moved]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal keys; a run never ends inside what is worked on."""
    held: list[pa.RecordBatch] = []

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        shard = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        a, b = forest(fp.view(np.uint64), shard)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        ends = batch.column(0)
        if sum(x.num_rows for x in held) < FRONTIER // 8 or (len(held) > 1 and batch.num_rows and ends[0] == ends[batch.num_rows - 1]):
            continue
        key, fp = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        done = int(np.searchsorted(key, key[-1]))
        held = [pa.RecordBatch.from_arrays([pa.array(key[done:]), pa.array(fp[done:])], names=["key", "fp"])]
        if done:
            yield solve(key[:done], fp[:done])
    if held:
        yield solve(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))


def shard_keys(parts: int, radius: int = RADIUS) -> list:
    """For each choice of ``parts - radius`` of the parts of ``fp``, a 64-bit key of their bits."""
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(parts)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in chosen))))) for n, chosen in enumerate(combinations(range(parts), parts - radius))]


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that join all different fingerprints (column fp) within the radius."""
    values = cut(values.select("fp").distinct())
    n = values.count()
    # shards of some dozens of random fingerprints at most; every number of parts finds the same links
    parts = next((m for m in range(radius + 1, 2 * radius + 1) if n >> (64 * (m - radius) // m) < 64), 2 * radius)
    keyed = values.select(F.explode(F.array(*shard_keys(parts, radius))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_search, "u long, v long")


def classes(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``values``, one for each fingerprint fp, with the smallest fingerprint reachable over links (top)."""
    found = components(links(values, radius)).withColumnsRenamed({"vertex": "fp", "component": "top"})
    return cut(values.join(found.hint("merge"), "fp", "left").withColumn("top", F.coalesce("top", "fp")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) of every row; the component is the smallest key reachable over links.

    A null key never names a component unless all its members are null. Repeated rows each get a row.
    """
    docs = cut(fingerprints(docs, [key], text))
    told = classes(docs.groupBy("fp").agg(F.min(key).alias("least")), radius)
    names = told.groupBy("top").agg(F.min("least").alias("component_id"))
    named = told.join(names.hint("merge"), "top").select("fp", "component_id")
    return docs.join(named.hint("merge"), "fp").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each group of near duplicates, the least by key, fingerprint and digests of the whole row.

    Documents are chosen by row: two texts under one key both stay if they lead different groups. Groups without any key go.
    """
    cells = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]  # Spark hashes no maps
    digests = {c: F.xxhash64(F.lit(n), *[x.isNull() for x in cells], *cells) for n, c in enumerate(fresh(docs, "_row_1", "_row_2"), 1)}
    rows = cut(fingerprints(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), *[d.alias(n) for n, d in digests.items()]), ["_key", *digests], "_text"))
    # a digest decides the fingerprint; a null key comes last
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "fp", *digests)).alias("r"))
    first = cut(classes(best, radius).groupBy("top").agg(F.min("r").alias("r")).where("NOT r.none").select(*[F.col(f"r.{n}") for n in digests]))
    same = list(digests)
    left = docs.withColumns(digests).join(first.hint("merge"), same, "left_semi")
    # only if a whole row is given twice must one of its copies be chosen
    repeated = rows.join(first.hint("merge"), same, "left_semi").count() > first.count()
    return (left.dropDuplicates(same) if repeated else left).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
