"""Trie of the shared beginnings of conversations, built as a burst trie.

A conversation is its turns in order, each told by 128 bits of a SHA-256 digest of role and text. Equal conversations are
one sequence. At first all sequences lie in one container under the root. A container of too many turns bursts: what all its
sequences begin with becomes a chain of trie heads, and they part by their next turn id into containers below it.
When no container is too large any more, Spark sorts each by its suffixes, in shards of whole containers, and one sweep makes
its nodes with all that is summed below them. Then the heads of each round of bursts, last round first, add up
their containers. A burst always parts sequences, so a common first turn or a large group of long, nearly equal
conversations takes a few rounds, not one for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored, table

#: Turns in a container that is not burst, and turns that a sweep takes at once.
CONTAINER, SWEEP = 1 << 12, 1 << 16
BASE, HEADS = 5, 9
NODE = "least long, depth long, parent_least long, n_convs long, n_children long, n_leaves long, saved_tokens long, end binary, above binary"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): turn ids (16 bytes each) and text bytes (8 each) of every rebuilt conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"), role, F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256), 1, 32).alias("id"), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0").alias("size"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = cut(turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns")))
    base = own.where(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE).join(base.hint("merge"), "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    whole = F.concat(F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h)), F.slice("turns", h + 1, F.size("turns")))
    joined = lambda field: F.unhex(F.array_join(F.transform("whole", lambda t: t[field]), ""))
    return both.select("conv_id", whole.alias("whole")).select("conv_id", joined("id").alias("ids"), joined("size").alias("sizes"))


def end_digests(members: DataFrame) -> DataFrame:
    """(sid, ends_sha256): the digest of the conversations of each sequence, in one pass over sorted numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for sid, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sid != now:
                    if digest:
                        done.append((now, digest.hexdigest()))
                    now, digest = sid, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["sid", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["sid", "ends_sha256"])

    return members.repartition("sid").sortWithinPartitions("sid", "conv_id").mapInArrow(run, "sid binary, ends_sha256 string")


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences of turn ids begin with alike."""
    n = min(len(a), len(b)) // 16
    differ = np.flatnonzero((np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n)))
    return int(differ[0]) // 2 if len(differ) else n


class Sweep:
    """Nodes of containers that come one after another, each sorted by its suffixes; parents stand before their children."""

    def __init__(self):
        self.depth, self.parent, self.bytes, self.least, self.n, self.end, self.above, self.above_least = ([] for _ in range(8))

    def node(self, depth: int, parent: int, size: int, above: bytes | None = None, above_least: int | None = None) -> int:
        for column, x in ((self.depth, depth), (self.parent, parent), (self.bytes, size), (self.least, None), (self.n, 0), (self.end, None), (self.above, above), (self.above_least, above_least)):
            column.append(x)
        return len(self.depth) - 1

    def add(self, members: list[tuple]) -> None:
        """Members (head, depth, above, above_least, suffix, sizes, least, n, sid) of whole containers."""
        path, last, head = [], b"", None
        for own, depth, above, above_least, suffix, sizes, least, n, sid in members:
            size = np.frombuffer(sizes, ">i8").tolist()
            if own != head:
                path, last, head = [self.node(depth, -1, size[depth - 1] if depth else 0, above, above_least)], b"", own
            del path[common_turns(last, suffix) + 1 :]
            for k in range(len(path) - 1, len(suffix) // 16):
                path.append(self.node(depth + k + 1, path[-1], size[depth + k]))
            self.least[path[-1]], self.n[path[-1]], self.end[path[-1]] = least, n, sid
            last = suffix

    def rows(self) -> pa.RecordBatch:
        """All nodes with their sums."""
        count = len(self.depth)
        least, n, children, leaves, saved = self.least, self.n, [0] * count, [0] * count, [0] * count
        for i in range(count - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * self.bytes[i]
            if (p := self.parent[i]) >= 0:
                least[p] = least[i] if least[p] is None else min(least[p], least[i])
                n[p] += n[i]
                children[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        up = [self.above_least[i] if p < 0 else least[p] for i, p in enumerate(self.parent)]
        longs = [pa.array(x, pa.int64()) for x in (least, self.depth, up, n, children, leaves, saved)]
        return pa.RecordBatch.from_arrays([*longs, pa.array(self.end, pa.binary()), pa.array(self.above, pa.binary())], names=[f.split()[0] for f in NODE.split(", ")])


def swept(members: DataFrame) -> DataFrame:
    """Nodes of all containers (their tops carry the head above), from shards of whole containers."""
    columns = ["head", "depth", "above", "above_least", "suffix", "sizes", "least", "n", "sid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns, start = 0, 0  # of what is held, and where its last container starts
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(len(columns))], strict=True):
                if held and row[0] != held[-1][0]:
                    if turns > SWEEP:
                        sweep = Sweep()
                        sweep.add(held)
                        yield sweep.rows()
                        held, turns = [], 0
                held.append(row)
                turns += len(row[4]) // 16 + 1
        if held:
            sweep = Sweep()
            sweep.add(held)
            yield sweep.rows()

    return members.select(*columns).repartition("head").sortWithinPartitions("head", "suffix").mapInArrow(run, NODE)


def burst(sequences: DataFrame, limit: int = CONTAINER) -> tuple[DataFrame, list[DataFrame]]:
    """Members of the containers that remain, and the heads of each round of bursts.

    A head has: head, depth, above (the head above it), above_least, last (depth where its sequences part), least, n, end
    (the sequence that ends at ``last``, if any), sizes (of one of its sequences).
    """
    digest = lambda depth: F.unhex(F.md5(F.expr(f"substring(ids, 1, CAST(16 * ({depth}) AS INT))")))
    suffix = F.expr("substring(ids, CAST(16 * depth + 1 AS INT))")
    start = [F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("above"), F.lit(None).cast("long").alias("above_least")]
    active = sequences.select("*", *start).withColumn("head", digest("0"))
    done, heads = [], []

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            same = [d + common_turns(a, b) for d, a, b in zip(batch.column("depth").to_pylist(), first, last, strict=True)]
            columns = [batch.column("head"), batch.column("depth"), batch.column("above"), batch.column("above_least"), pa.array(same, pa.int64()), batch.column("least"), batch.column("n"), batch.column("sizes")]
            yield pa.RecordBatch.from_arrays(columns, names=["head", "depth", "above", "above_least", "last", "least", "n", "sizes"])

    while True:
        active = stored(active.withColumn("suffix", suffix))
        turns = F.sum(F.octet_length("suffix") / 16)
        # the least and the greatest suffix begin alike in just what all of them share
        stats = active.groupBy("head", "depth", "above", "above_least").agg(
            F.min("suffix").alias("low"), F.max(F.struct("suffix", "sizes")).alias("m"), F.min("least").alias("least"), F.sum("n").alias("n"), F.count("*").alias("members"), turns.alias("turns"),
        )
        large = stats.where((F.col("turns") > limit) & (F.col("members") > 1)).selectExpr("head", "depth", "above", "above_least", "least", "n", "low", "m.suffix AS high", "m.sizes AS sizes")
        large = stored(large.mapInArrow(parted, "head binary, depth long, above binary, above_least long, last long, least long, n long, sizes binary"))
        if not large.count():
            return (active if not done else _union([*done, active])), heads
        told = active.join(large.select("head", F.col("last").alias("_last"), F.col("least").alias("_least")).hint("merge"), "head", "left")
        told = stored(told)
        done.append(told.where("_last IS NULL").drop("_last", "_least"))
        inside = told.where("_last IS NOT NULL")
        ended = inside.where("octet_length(ids) = 16 * _last").select("head", F.col("sid").alias("end"))
        heads.append(large.join(ended.hint("merge"), "head", "left"))
        active = inside.where("octet_length(ids) > 16 * _last").select(
            "sid", "ids", "sizes", F.col("least"), "n", (F.col("_last") + 1).alias("depth"), F.col("head").alias("above"), F.col("_least").alias("above_least"), digest("_last + 1").alias("head"),
        )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chains(heads: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of burst heads, from the tops of what lies below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                saved, top, last = r["saved"], r["depth"], r["last"]
                size, made = np.frombuffer(r["sizes"], ">i8").tolist(), []
                for d in range(last, top - 1, -1):
                    saved += (r["n"] - 1) * (size[d - 1] if d else 0)
                    made.append((r["least"], d, r["above_least"] if d == top else r["least"], r["n"], r["children"] if d == last else 1, r["leaves"], saved, r["end"] if d == last else None, r["above"] if d == top else None))
                out += made
            columns = list(zip(*out, strict=True)) or [()] * 9
            types = [pa.int64()] * 7 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in NODE.split(", ")])

    sums = below.where("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("above", "head")
    return heads.join(sums.hint("merge"), "head").mapInArrow(run, NODE)


def prefix_trie(conversations: DataFrame, limit: int = CONTAINER) -> DataFrame:
    """One row for each different beginning of the rebuilt conversations.

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Rows without conv_id belong to no conversation. Null roles and texts are empty. Turns of equal number, null ones
    too, come in the order of role and digest; repeated rows are repeated turns. Other columns are not read. An
    empty table has no members, so not even a root. One conversation's turn ids (24 bytes a turn) lie in one row.
    """
    members = cut(rebuilt(conversations).withColumn("sid", F.unhex(F.md5("ids"))))
    sequences = members.groupBy("sid").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("ids", "sizes")).alias("s"))
    ends = end_digests(members.select("sid", "conv_id"))
    remaining, heads = burst(sequences.select("sid", "least", "n", "s.ids", "s.sizes"), limit)
    below = cut(swept(remaining))
    parts = [below]
    for level in reversed(heads):
        below = stored(chains(level, _union(parts)))
        parts.append(below)
    nodes = _union(parts).join(ends.withColumnRenamed("sid", "end").hint("merge"), "end", "left")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select(F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
