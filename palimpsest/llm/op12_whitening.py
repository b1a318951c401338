"""Whitening of embeddings by blockwise QR, a bidiagonal matrix, dqds and twisted factorisations.

Vectors become whole numbers, and each different one is fitted once. Tasks reduce their centred rows block by block to
the triangle R of a QR factorisation, and triangles meet in a tree until one is left, of dimension by dimension. On it
Householder reflections make a bidiagonal matrix, the differential quotient-difference algorithm with shifts (dqds)
finds its singular values to high relative accuracy, and twisted factorisations of the shifted matrix give the right
singular vectors. Nothing is squared before it is centred, and no product of rows is ever summed for the fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

COMPONENTS, SCALE, OFFSET = 16, 64, 1000000
#: Rows in a block of the QR, and parts that one task of the tree joins.
BLOCK_ROWS, FAN = 4096, 32
EPS = float(np.finfo(float).eps)
#: Singular values closer than this, relatively, get orthogonal vectors by projection.
CLUSTER = 1e-3


def pack(x: np.ndarray) -> bytes:
    """A vector of whole numbers in 2, 4 or 8 bytes each, as few as hold them all; equal vectors give equal bytes."""
    low = x - OFFSET
    most = int(np.abs(low).max(initial=0))
    return low.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def unpack(data: list[bytes], dim: int) -> np.ndarray:
    """The vectors as rows of 64-bit numbers."""
    out = np.empty((len(data), dim), np.int64)
    for i, b in enumerate(data):
        out[i] = np.frombuffer(b, f"<i{len(b) // dim}")
    return out + OFFSET


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, x) of the rows whose vector is there, not empty, and holds finite numbers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, start = lists.values.cast(pa.float64()), lists.offsets.to_numpy()
            good = np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            bad = np.concatenate([[0], np.cumsum(~good)])
            there = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(start) > 0) & (bad[start[1:]] == bad[start[:-1]])
            x = np.floor(np.where(good, SCALE * flat.fill_null(0.0).to_numpy(zero_copy_only=False), 0)).astype(np.int64) + OFFSET
            rows = np.flatnonzero(there)
            packed = [pack(x[start[i] : start[i + 1]]) for i in rows.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.diff(start)[rows].astype(np.int32)), pa.array(packed, pa.binary())], names=["key", "dim", "x"])

    given = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"))
    return given.mapInArrow(run, T.StructType([T.StructField("key", given.schema["key"].dataType), T.StructField("dim", T.IntegerType()), T.StructField("x", T.BinaryType())]))


def _tree(rows: DataFrame, each: Callable[[Iterator[np.ndarray]], bytes | None], join: Callable[[list[bytes]], bytes], dim: int) -> bytes | None:
    """``each`` makes one part of a task's blocks of vectors; parts are joined by FAN, until the last few meet on the driver."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (unpack(batch.column(0).to_pylist()[i : i + BLOCK_ROWS], dim) for batch in batches for i in range(0, batch.num_rows, BLOCK_ROWS))
        part = each(blocks)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([part], pa.binary())], names=["id", "part"])

    def merge(given: pa.Table) -> pa.Table:
        parts = [p for _, p in sorted(zip(given.column("id").to_pylist(), given.column("part").to_pylist(), strict=True))]
        return pa.table({"id": pa.array([given.column("id")[0].as_py() // FAN], pa.int64()), "part": pa.array([join(parts)], pa.binary())})

    parts, n = rows.select("x").mapInArrow(start, "id long, part binary"), rows.rdd.getNumPartitions()
    while n > FAN:
        parts, n = parts.groupBy(F.expr(f"id div {FAN}")).applyInArrow(merge, "id long, part binary"), -(-n // FAN)
    last = parts.collect()  # FAN parts of fixed size at most
    return join([r.part for r in sorted(last, key=lambda r: r.id)]) if last else None


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors, and their exact sum in each dimension."""

    def each(blocks: Iterator[np.ndarray]) -> bytes | None:
        n, total = 0, [0] * dim
        for x in blocks:
            n += len(x)
            total = [a + b for a, b in zip(total, (x - OFFSET).sum(axis=0).tolist(), strict=True)]
        return repr([n, *total]).encode() if n else None

    def join(parts: list[bytes]) -> bytes:
        return repr([sum(c) for c in zip(*[map(int, p[1:-1].split(b",")) for p in parts], strict=True)]).encode()

    found = _tree(rows, each, join, dim)
    n, *total = [int(v) for v in found[1:-1].split(b",")] if found else [0] * (dim + 1)
    return n, [t + n * OFFSET for t in total]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S of each entry, exactly; beyond 64 bits as Python's numbers."""
    base = np.array([t - n * OFFSET for t in total], object)
    most = n * int(np.abs(x - OFFSET).max(initial=0)) + max((abs(int(b)) for b in base), default=0)
    return n * (x - OFFSET) - base.astype(np.int64) if most < 1 << 62 else n * (x - OFFSET).astype(object) - base


def triangle(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of the QR factorisation of all rows less their mean."""
    dim = len(total)
    square = lambda r: np.pad(r, ((0, dim - len(r)), (0, 0)))

    def each(blocks: Iterator[np.ndarray]) -> bytes | None:
        r = None
        for x in blocks:
            z = (centred(x, n, total) / n).astype(float)
            r = np.linalg.qr(z if r is None else np.vstack([r, z]), mode="r")
        return None if r is None else square(r).tobytes()

    def join(parts: list[bytes]) -> bytes:
        return square(np.linalg.qr(np.vstack([np.frombuffer(p).reshape(dim, dim) for p in parts]), mode="r")).tobytes()

    return np.frombuffer(_tree(rows, each, join, dim)).reshape(dim, dim)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and superdiagonal b of an upper bidiagonal U'RV, and V, by Householder reflections from both sides."""
    m, dim = r.copy(), len(r)
    right = np.eye(dim)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        v = x.copy()
        size = np.linalg.norm(x)
        if not size:
            return None
        v[0] += math.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(dim):
        if (v := mirror(m[k:, k])) is not None:
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k < dim - 2 and (v := mirror(m[k, k + 1 :])) is not None:
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential step; None if the shift is above the smallest value."""
    d, least, out_q, out_e = q[0] - shift, math.inf, [], []
    for i in range(len(e)):
        if d < 0:
            return None
        least = min(least, d)
        top = d + e[i]
        out_q.append(top)
        if not top:
            out_e.append(0.0)
            d = q[i + 1] - shift
            continue
        ratio = q[i + 1] / top
        out_e.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    out_q.append(d)
    return out_q, out_e, min(least, d)


def dqds(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Squares of the singular values of an upper bidiagonal matrix, largest first."""
    found, blocks = [], [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        least = 0.0
        while q:
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            small = [i for i, x in enumerate(e) if x <= EPS**2 * (moved + q[i] + q[i + 1])]
            if small and small[-1] < len(e) - 1:  # the two parts have nothing to do with each other any more
                i = small[-1]
                blocks.append((q[: i + 1], e[:i], moved))
                q, e = q[i + 1 :], e[i + 1 :]
                continue
            if small:
                found.append(q.pop() + moved)
                e.pop()
                continue
            step = None
            # the last diagonal entry bounds the smallest value from above; how far off it can be shows in what stands beside it
            near = 1 - 2 * math.sqrt(e[-1] / (e[-1] + q[-1]))
            for part in (near, 0.75, 0.25):
                if part > 0 and (step := _dqds_step(q, e, part * least)):
                    break
            shift = part * least if step else 0.0
            q, e, least = step or _dqds_step(q, e, 0.0)
            moved += shift
            if q[0] < q[-1] / 4:  # from the other end it converges faster
                q, e, least = *_flipped(q, e), 0.0
    return sorted(found, reverse=True)


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same matrix of products read from its other end."""
    return q[::-1], e[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """Unit vector z with B'B z = value z, by the twisted factorisation of the shifted matrix; with ``start`` one step of inverse iteration instead."""
    k, tiny = len(a), EPS**3 * (float(np.abs(a).max()) ** 2 + value)
    a = np.where(np.abs(a) < math.sqrt(tiny), math.sqrt(tiny), a)
    d, low = a * a, b / a[:-1]
    upper, plus, s = np.empty(k), np.empty(k - 1), np.empty(k)
    s[0] = -value
    for i in range(k - 1):
        upper[i] = (s[i] + d[i]) or tiny
        plus[i] = d[i] * low[i] / upper[i]
        s[i + 1] = plus[i] * low[i] * s[i] - value
    upper[-1] = (s[-1] + d[-1]) or tiny
    p, lower, minus = np.empty(k), np.empty(k), np.empty(k - 1)
    p[-1] = d[-1] - value
    for i in range(k - 2, -1, -1):
        lower[i + 1] = (d[i] * low[i] ** 2 + p[i + 1]) or tiny
        ratio = d[i] / lower[i + 1]
        minus[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + p + value
    at = int(np.abs(gamma).argmin())
    z = np.zeros(k)
    z[at] = 1.0
    if start is not None:  # N D N' z = start
        y = start.copy()
        for i in range(at):
            y[i + 1] -= plus[i] * y[i]
        for i in range(k - 2, at - 1, -1):
            y[i] -= minus[i] * y[i + 1]
        y = y / np.concatenate([upper[:at], [gamma[at] or tiny], lower[at + 1 :]])
        z = y
    for i in range(at - 1, -1, -1):
        z[i] = (z[i] if start is not None else 0.0) - plus[i] * z[i + 1]
    for i in range(at, k - 1):
        z[i + 1] = (z[i + 1] if start is not None else 0.0) - minus[i] * z[i]
    return z / np.linalg.norm(z)


def singular_vectors(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a bidiagonal matrix and its right singular vectors, as columns."""
    dim = len(a)
    scale = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if not scale:
        return np.zeros(min(most, dim)), np.eye(dim)[:, :most]
    a, b = a / scale, b / scale
    ends = [*(np.flatnonzero(np.abs(b) <= EPS * np.minimum(np.abs(a[:-1]) + np.abs(a[1:]), 1) / 8) + 1).tolist(), dim]
    pairs, begin = [], 0
    for end in ends:
        values = dqds(a[begin:end], b[begin : end - 1])
        pairs += [(v, begin, end) for v in values]
        begin = end
    pairs = sorted(pairs, key=lambda p: -p[0])[:most]
    out, rng = [], np.random.default_rng(1)
    for i, (value, begin, end) in enumerate(pairs):
        if end - begin == 1:
            z = np.ones(1)
        else:
            near = [z[begin:end] for z, (v, s, _) in zip(out, pairs[:i], strict=True) if s == begin and v - value <= CLUSTER * v]
            z = _twisted(a[begin:end], b[begin : end - 1], value)
            for _ in range(20):
                rest = z - sum((u * (u @ z) for u in near), np.zeros(len(z)))
                size = float(np.linalg.norm(rest))
                rest = rest - sum((u * (u @ rest) for u in near), np.zeros(len(z)))
                if not near or size > 0.5:
                    break
                z = _twisted(a[begin:end], b[begin : end - 1], value * (1 + 4 * EPS * len(near)), rest / size if size > 1e-8 else rng.normal(size=len(z)))
            z = rest / np.linalg.norm(rest)
        whole = np.zeros(dim)
        whole[begin:end] = z
        out.append(whole)
    return np.array([p[0] for p in pairs]) * scale**2, np.array(out).T


@dataclass
class Whitening:
    """Mean (as a sum over n), directions as columns, their variances, and the share of all variance that each explains."""

    n: int
    total: list[int]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened coordinates of whole vectors, and their exact squared distance from the mean, times n squared."""
        z = centred(x, self.n, self.total)
        most = int(np.abs(z).max(initial=0))
        away = (z * z).sum(axis=1) if most * most * max(1, len(self.total)) < 1 << 63 else np.array([sum(int(v) ** 2 for v in row) for row in z], object)
        if any(int(v) >= 1 << 63 for v in away):
            raise OverflowError("a deviation does not fit 64 bits")
        there = self.variances > 0
        scale = np.divide(1.0, np.sqrt(self.variances), where=there, out=np.zeros(len(there)))
        return ((z / self.n).astype(float) @ self.directions) * scale, away.astype(np.int64)


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of different vectors (column x, packed); directions without variance get variance 0."""
    n, total = sums(rows, dim)
    if not n:
        return Whitening(0, total, np.zeros((dim, 0)), np.zeros(0), np.zeros(0))
    r = triangle(rows, n, total)
    a, b, right = bidiagonal(r)
    values, z = singular_vectors(a, b, components)
    trace = float((r * r).sum())
    values = np.where(values <= (dim * EPS) ** 2 * trace, 0.0, values)
    return Whitening(n, total, right @ z, values / n, values / trace if trace else values)


def identity_error(rows: DataFrame, dim: int, found: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fitted vectors less the identity, over directions with variance."""
    k = len(found.variances)

    def each(blocks: Iterator[np.ndarray]) -> bytes | None:
        total = None
        for x in blocks:
            w = found(x)[0]
            total = w.T @ w + (0 if total is None else total)
        return None if total is None else total.tobytes()

    got = _tree(rows, each, lambda parts: sum(np.frombuffer(p).reshape(k, k) for p in parts).tobytes(), dim) if k else None
    there = found.variances > 0
    return 0.0 if got is None or not there.any() else float(np.abs(np.frombuffer(got).reshape(k, k) / found.n - np.eye(k))[np.ix_(there, there)].max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a vector of finite numbers.

    Rows whose vector is null, empty or holds a null or a number that is not finite are left out, and so are vectors of another
    length than the commonest (of equally common ones the longest): no covariance joins them. Repeated rows, null and equal
    keys each keep their rows; equal vectors count once in the fit. A direction without variance has whitened 0 and
    explained 0. An empty table gives no rows.
    """
    given = whole_vectors(rows, key, vector)
    sizes = given.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    schema = T.StructType([
        T.StructField(key, rows.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    if not sizes:
        return rows.sparkSession.createDataFrame([], schema)
    dim = sizes[0]["dim"]
    given = given.where(F.col("dim") == dim)
    different = cut(given.select("x").distinct())
    found = fit(different, dim, components)
    error = identity_error(different, dim, found)
    k = len(found.variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                w, away = found(unpack(part.column(1).to_pylist(), dim))
                m = len(w)
                every = lambda x: pa.array(np.full(m * k, x))
                columns = [part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), every(found.n), pa.array(np.repeat(away, k)), pa.array(w.ravel()), pa.array(np.tile(found.explained, m)), every(error)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.select("key", "x").mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))
