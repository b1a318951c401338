"""Nearest vectors by products of blocks.

Queries and items of a universe are dealt into blocks, and every query block meets every item block under a key of its own, where one
matrix product gives all their distances. A cell sends only the few best of each query, so work spreads over the grid of blocks
whatever the number of universes, and neither texts nor vectors travel any further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries and items in a block.
QUERIES, ITEMS = 1024, 8192
#: Distances that may be equal once they are rounded; a cell sends all that could tie with its last.
SLACK = 2e-9


def rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors can be compared (not null, finite, not zero), and for each length their numbers in order as rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not len(lists):
        return np.zeros(0, np.int64), []
    flat = np.nan_to_num(lists.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), nan=np.nan, posinf=np.nan, neginf=np.nan)
    start, size = lists.offsets.to_numpy()[:-1], np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
    groups, places = [], []
    for n in np.unique(size[size > 0]).tolist():
        which = np.flatnonzero(size == n)
        rows = flat[start[which][:, None] + np.arange(n)]
        good = np.isfinite(rows).all(axis=1) & (np.square(rows).sum(axis=1) > 0)
        places.append(which[good])
        groups.append(rows[good])
    return places, groups


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True))


def best_of_cell(queries: np.ndarray, items: np.ndarray, same: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, distance) of the k nearest items of each query and of all that tie with the last; ``same`` marks pairs that do not count."""
    distance = 1 - queries @ items.T
    if same is not None:
        distance[same] = np.inf
    last = np.partition(distance, k - 1, axis=1)[:, k - 1] if distance.shape[1] > k else np.full(len(distance), np.inf)
    row, column = np.nonzero((distance <= last[:, None] + SLACK) & np.isfinite(distance))
    return row, column, distance[row, column]


def blocks_of(df: DataFrame, size: int) -> int:
    """Blocks for the largest universe."""
    most = df.groupBy("universe").count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-most // size))


def grid(queries: DataFrame, items: DataFrame, item: str, query_block: int = QUERIES, item_block: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """Queries and items, each with every cell of the grid that it is in, grouped by universe and cell."""
    n, m = blocks_of(queries, query_block), blocks_of(items, item_block)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # columns of their own, since both sides may come from one table
    own = lambda df: df.select(*[F.col(x).alias("_u" if x == "universe" else x) for x in df.columns])
    q = own(queries).withColumn("_i", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")).withColumn("_j", every(m))
    p = own(items).withColumn("_j", F.pmod(F.xxhash64(item), F.lit(m)).cast("int")).withColumn("_i", every(n))
    return q.groupBy("_u", "_i", "_j"), p.groupBy("_u", "_i", "_j")


def nearest(queries: DataFrame, items: DataFrame, k: int, item: str, own: bool = True, query_block: int = QUERIES, item_block: int = ITEMS) -> DataFrame:
    """(query_id, item, distance): candidates that hold the k nearest items of each query by cosine distance, k of each cell and ties.

    Null vectors, those with null or infinite numbers and zero vectors have no distance; vectors of different length never meet. If
    not ``own``, the item with the query's id is left out.
    """
    q = queries.select("query_id", "universe", F.col("embedding").alias("_q"))
    p = items.select(item, "universe", F.col("embedding").alias("_p"))
    schema = T.StructType([q.schema["query_id"], p.schema[item], T.StructField("distance", T.DoubleType())])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            left = {x.shape[1]: (w, x) for w, x in zip(*rows_of(a.column("_q")), strict=True)}
            right = {x.shape[1]: (w, x) for w, x in zip(*rows_of(b.column("_p")), strict=True)}
            for n in left.keys() & right.keys():
                (i, x), (j, y) = left[n], right[n]
                same = None if own else a.column("query_id").to_numpy()[i][:, None] == b.column(item).to_numpy()[j][None, :]
                row, column, distance = best_of_cell(unit(x), unit(y), same, k)
                out.append((i[row], j[column], distance))
        i, j, distance = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([a.column("query_id").take(pa.array(i, pa.int64())), b.column(item).take(pa.array(j, pa.int64())), pa.array(distance)], names=schema.names)

    left, right = grid(q, p, item, query_block, item_block)
    return left.cogroup(right).applyInArrow(cell, schema)


def encoded(items: DataFrame, item: str) -> DataFrame:
    """(item, universe, code): each unit vector in one signed byte a number, behind its scale of 8 bytes."""
    given = items.select(item, "universe", F.col("embedding").alias("_p"))
    schema = T.StructType([given.schema[item], given.schema["universe"], T.StructField("code", T.BinaryType())])

    def run(batches):
        for batch in batches:
            places, groups = rows_of(batch.column(2))
            where = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
            codes = []
            for x in groups:
                x = unit(x)
                scale = np.abs(x).max(axis=1, keepdims=True) / 127
                codes += [s.tobytes() + c.tobytes() for s, c in zip(scale, np.rint(x / scale).astype(np.int8), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), batch.column(1).take(pa.array(where)), pa.array(codes, pa.binary())], names=schema.names)

    return given.mapInArrow(run, schema)


def shortlist(queries: DataFrame, coded: DataFrame, item: str, most: int, keys: list[str], own: bool = True) -> DataFrame:
    """(query_id, item, near): for each query and cell the items whose codes are nearest, by tables of whole cells.

    Queries (query_id, keys, _q) meet items (item, keys, code) by the keys. No full vector of an item is read.
    """
    schema = T.StructType([queries.schema["query_id"], coded.schema[item], T.StructField("near", T.DoubleType())])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            codes = b.column("code").to_pylist()
            sizes = np.array([len(c) - 8 for c in codes])
            for i, x in zip(*rows_of(a.column("_q")), strict=True):
                j = np.flatnonzero(sizes == x.shape[1])
                if not len(j):
                    continue
                raw = np.frombuffer(b"".join(codes[n] for n in j.tolist()), np.uint8).reshape(len(j), -1)
                rows = np.ascontiguousarray(raw[:, 8:]).view(np.int8).astype(float) * np.ascontiguousarray(raw[:, :8]).view(np.float64)
                same = None if own else a.column("query_id").to_numpy()[i][:, None] == b.column(item).to_numpy()[j][None, :]
                row, column, distance = best_of_cell(unit(x), rows, same, most)
                out.append((i[row], j[column], distance))
        i, j, near = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([a.column("query_id").take(pa.array(i, pa.int64())), b.column(item).take(pa.array(j, pa.int64())), pa.array(near)], names=schema.names)

    left, right = (df.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in df.columns]).groupBy(*[f"_{k}" for k in keys]) for df in (queries, coded))
    return left.cogroup(right).applyInArrow(cell, schema)
