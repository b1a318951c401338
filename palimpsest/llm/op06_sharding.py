"""Sharding by a minimax contiguous partition of ordered groups of equal texts.

Groups are put in the order of a digest of their text. The smallest capacity at which cutting
greedily needs no more than the wanted shards is found by binary search; the shards are cut within
that capacity. Group sizes never go to the driver: it sees the first and last group end in each of
some thousand stretches of the running size, and asks again, more finely, only about the stretches
where the search could still go either way.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 24
#: Rows of one group are numbered in separate runs, so that no task gets a whole large group: one for so many rows of the table, within these bounds.
RUN_ROWS, LEAST_RUNS, MOST_RUNS = 1 << 20, 16, 4096
#: Stretches of the running size that the driver sees first, and pieces that one stretch is split in.
STRETCHES, PIECES = 2048, 64


class Ends:
    """What is known of the group ends: for each stretch (start, end], its first and last group end."""

    def __init__(self, stretches: list[tuple[int, int, int, int]]):
        self.stretches = sorted(stretches)
        self.starts = [s[0] for s in self.stretches]

    def before(self, x: int) -> tuple[int, int]:
        """Lower and upper bound of the last group end at or before x."""
        i = bisect_left(self.starts, x) - 1
        if i < 0:
            return 0, 0
        _, _, first, last = self.stretches[i]
        if last <= x:
            return last, last
        if first <= x:
            return first, x
        return (self.stretches[i - 1][3],) * 2 if i else (0, 0)

    def path(self, capacity: int, bound: int, start: int = 0, steps: int = SHARDS) -> list[int]:
        """Ends of shards cut greedily, each as late as the bound (0 lower, 1 upper) says."""
        out = []
        for _ in range(steps):
            start = max(start, self.before(start + capacity)[bound])
            out.append(start)
        return out

    def smallest(self, low: int, high: int, bound: int, shards: int) -> int:
        """The smallest capacity in low..high at which the shards hold everything."""
        total = self.stretches[-1][3]
        while low < high:
            middle = (low + high) // 2
            if self.path(middle, bound, 0, shards)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low


def _stretches(ends: DataFrame, width: int) -> list[tuple[int, int, int, int]]:
    """First and last end in each stretch of so many bytes that has any."""
    found = ends.groupBy(F.expr(f"(end - 1) div {width}").alias("k")).agg(F.min("end").alias("a"), F.max("end").alias("b"))
    return [(r["k"] * width, (r["k"] + 1) * width, r["a"], r["b"]) for r in found.collect()]


def capacity_and_ends(ends: DataFrame, total: int, largest: int, shards: int = SHARDS) -> tuple[int, Ends]:
    """The smallest feasible shard capacity over the group ends (column ``end``), and what is known of the ends."""
    width = max(1, -(-total // STRETCHES))
    known = Ends(_stretches(ends, width))
    least, most = max(largest, -(-total // shards)), total
    while True:
        least = known.smallest(least, most, 1, shards)
        most = known.smallest(least, most, 0, shards)
        if least == most:
            return most, known
        early, late = known.path(least, 0, 0, shards), known.path(most, 1, 0, shards)
        asked = [(a + least, b + most) for a, b in zip([0, *early], [0, *late], strict=False)][:shards]
        open_, closed = [], []
        for s in known.stretches:
            (open_ if s[2] < s[3] and any(s[0] < hi and s[1] > lo for lo, hi in asked) else closed).append(s)
        width = min(s[1] - s[0] for s in open_)
        finer = max(1, width // PIECES)
        # stretches of one width at a time, so that the pieces of all have one width
        now, later = [s for s in open_ if s[1] - s[0] == width], [s for s in open_ if s[1] - s[0] != width]
        inside = ends.where(F.expr(f"(end - 1) div {width}").isin([s[0] // width for s in now]))
        known = Ends(closed + later + _stretches(inside, finer))


def even_cuts(known: Ends, capacity: int, shards: int = SHARDS) -> list[int]:
    """Shard ends within the capacity, each at the known group end nearest to an even share of what is left."""
    total = known.stretches[-1][3]
    points = sorted({p for s in known.stretches for p in s[2:]})
    at, out = 0, []
    for left in range(shards, 0, -1):
        furthest = max(at, known.before(at + capacity)[0])
        aim = at + (total - at) // left
        i = bisect_left(points, aim)
        near = [p for p in points[max(0, i - 1) : i + 1] if at <= p <= at + capacity]
        best = min([*near, furthest], key=lambda p: (abs(p - aim), p))
        if best != furthest and (left == 1 or known.path(capacity, 0, best, left - 1)[-1] < total):
            best = furthest
        at = total if left == 1 else best
        out.append(at)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row; rows of equal text share a shard, so a shard may exceed an even share by its largest group.

    Columns: key, size, text_crc32, shard, slot. Null text counts as empty; repeated rows each get a slot; an empty
    table gives an empty result. Slots of a shard run from 0 without gaps.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # rows are numbered where they are read, so that even equal rows spread; the checkpoint keeps what was dealt
    rows = cut(docs.select(
        F.col(f"`{key}`").alias(key), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.md5(whole.cast("binary")).alias("g"), F.monotonically_increasing_id().alias("nth"),
    ))
    runs = max(LEAST_RUNS, min(MOST_RUNS, rows.count() // RUN_ROWS))
    rows = rows.withColumn("salt", F.pmod("nth", F.lit(runs)).cast("int")).drop("nth")
    cells = rows.groupBy("g", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    order = Window.partitionBy("part").orderBy("g", "salt")
    cells = cells.withColumn("part", F.substring("g", 1, 3))
    cells = cells.select("*", (F.sum("n").over(order) - F.col("n")).alias("n_in"), (F.sum("bytes").over(order) - F.col("bytes")).alias("b_in"))
    cells = cut(cells)
    # 4096 parts at most, whatever the data
    parts = cells.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("bytes").alias("pb"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n_off"), F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("b_off"))
    cells = cells.join(F.broadcast(parts), "part").select("g", "salt", (F.col("n_in") + F.col("n_off")).alias("n_before"), (F.col("b_in") + F.col("b_off")).alias("b_before"), "bytes")
    cells = cut(cells)
    groups = cells.groupBy("g").agg(F.max(F.col("b_before") + F.col("bytes")).alias("end"), F.sum("bytes").alias("bytes"))
    ends = cut(groups)
    facts = ends.agg(F.max("end").alias("total"), F.max("bytes").alias("largest")).first()
    if facts["total"] is None:
        cuts = [0] * shards
    else:
        capacity, known = capacity_and_ends(ends.select("end"), facts["total"], facts["largest"], shards)
        cuts = even_cuts(known, capacity, shards)
    number = sum([(F.col("b_before") >= F.lit(c)).cast("int") for c in cuts[:-1]], F.lit(0))
    cells = cells.select("g", "salt", "n_before", number.alias("shard"))
    first = cells.groupBy("shard").agg(F.min("n_before").alias("shard_start"))
    cells = cells.join(F.broadcast(first), "shard")  # a row for each shard
    placed = rows.join(cells.hint("merge"), ["g", "salt"])
    nth = F.row_number().over(Window.partitionBy("g", "salt").orderBy(F.col(key)))
    return placed.select(key, "size", "text_crc32", "shard", (F.col("n_before") + nth - 1 - F.col("shard_start")).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
