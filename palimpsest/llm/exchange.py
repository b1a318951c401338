"""Totals over all blocks of a corpus, told back to every block.

A block sends ascending numbers, with columns beside them, in one fragment for each range of numbers. Equal numbers
of all blocks meet, and each block is told of each of its numbers what the totals say. Where there
are many blocks, a fragment for each block and range would be ever smaller and their count would grow with the square
of the data. So fragments go through levels: a node of a level takes one range from a group of blocks, merges
equal numbers, and sends finer ranges on to a larger group. At every level a sender has FAN ranges at most, so
fragments grow as the data does, times the number of levels. Answers come back the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FRAGMENT = "range long, block long, data binary"
#: Fragments that one sender makes at a level, at most; ranges of so many bits are counted in a table.
FAN, TABLE_BITS = 256, 22


def fragments(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table({"range": pa.array(cols[0], pa.int64()), "block": pa.array(cols[1], pa.int64()), "data": pa.array(cols[2], pa.binary())})


def rows_of(given: pa.Table) -> list[tuple]:
    """Fragments in the order of their senders."""
    return sorted(zip(*(given.column(c).to_pylist() for c in ("range", "block", "data")), strict=True), key=lambda r: r[1])


def answers(said: pa.Table) -> dict[int, bytes]:
    return dict(zip(said.column("range").to_pylist(), said.column("data").to_pylist(), strict=True))


def pieces(numbers: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """(number >> shift, where) of ascending numbers."""
    high = numbers >> np.uint64(shift) if shift < 64 else np.zeros(len(numbers), np.uint64)
    edge = np.flatnonzero(np.diff(high, prepend=high[:1] + np.uint64(1)))
    for a, b in zip(edge, [*edge[1:], len(high)], strict=False):
        yield int(high[a]), slice(int(a), int(b))


def encode(numbers: np.ndarray, width: int = TABLE_BITS) -> bytes:
    """Ascending numbers of ``width`` bits: their low bytes, and a bit string that counts up to their high parts."""
    numbers = np.asarray(numbers).astype(np.uint64)
    n = len(numbers)
    k = min(range(9), key=lambda k: 8 * k * n + n + ((1 << width) >> 8 * k))
    high = (numbers >> np.uint64(8 * k)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, bool)
    bits[high] = True
    low = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k]
    return np.array([n, k, len(bits)], "<u4").tobytes() + low.tobytes() + np.packbits(bits).tobytes()


def decode(data: bytes) -> np.ndarray:
    return _decode(data)[0]


def _decode(data: bytes) -> tuple[np.ndarray, int]:
    """The numbers, and where what follows them begins."""
    n, k, size = np.frombuffer(data, "<u4", 3).tolist()
    end = 12 + n * k + -(-size // 8)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, end - 12 - n * k, 12 + n * k), count=size)) - np.arange(n)
    low = np.zeros((n, 8), np.uint8)
    low[:, :k] = np.frombuffer(data, np.uint8, n * k, 12).reshape(n, k)
    return (high.astype(np.uint64) << np.uint64(8 * k)) | low.view("<u8").ravel(), end


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _pack(column: np.ndarray, kind: str) -> bytes:
    if kind == "count":  # one, or more than one
        return np.packbits(column > 1).tobytes()
    if kind == "second":
        return column.tobytes()
    base, most = (int(column.min()), int(column.max())) if len(column) else (0, 0)
    wide = next(w for w in (1, 2, 4, 8) if w == 8 or most - base < 1 << 8 * w)
    return np.array([base, wide], "<i8").tobytes() + (column.astype(np.int64) - base).astype(f"<u{wide}").tobytes()


def _unpack(data: bytes, n: int, at: int, kind: str) -> tuple[np.ndarray, int]:
    if kind == "count":
        end = at + -(-n // 8)
        return np.unpackbits(np.frombuffer(data, np.uint8, end - at, at), count=n).astype(np.int64) + 1, end
    if kind == "second":
        return np.frombuffer(data, "<u8", n, at), at + 8 * n
    base, wide = np.frombuffer(data, "<i8", 2, at).tolist()
    return np.frombuffer(data, f"<u{wide}", n, at + 16).astype(np.int64) + base, at + 16 + wide * n


@dataclass
class Kind:
    """Numbers of ``width`` bits that meet in 2 ** ``bits`` ranges.

    ``columns`` are named "count" (one or more, as a bit), "sum", "max" or "min". ``tell`` makes a small number from the totals of
    each; ``share`` what a sender is told, from that, whether it is the first that holds the number, its own columns and the totals.
    With ``second`` numbers are equal only if another 64 bits beside them are.
    """

    width: int
    bits: int
    columns: tuple[str, ...]
    tell: Callable
    share: Callable | None = None
    second: bool = False
    binary: bool = True

    def merge(self, numbers: np.ndarray, second: np.ndarray | None, columns: list[np.ndarray], free: int):
        """(group of each row, number and second of each group, totals); ``free`` bits of the numbers differ at most."""
        if second is None and free <= TABLE_BITS:
            base = numbers[0] >> np.uint64(free) << np.uint64(free)
            group, n = (numbers - base).astype(np.int64), 1 << free
            used = np.flatnonzero(np.bincount(group, minlength=n))
            place = np.zeros(n, np.int64)
            place[used] = np.arange(len(used))
            group, key, other = place[group], base + used.astype(np.uint64), None
        else:
            order = np.argsort(numbers, kind="stable") if second is None else np.lexsort((second, numbers))
            new = np.zeros(len(order), bool)
            new[:1] = True
            new[1:] = numbers[order][1:] != numbers[order][:-1]
            if second is not None:
                new[1:] |= second[order][1:] != second[order][:-1]
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            key, other = numbers[order][new], None if second is None else second[order][new]
        totals = []
        for kind, column in zip(self.columns, columns, strict=True):
            if kind in ("count", "sum"):
                total = np.bincount(group, weights=column, minlength=len(key)).astype(np.int64)
            else:
                total = np.full(len(key), np.iinfo(np.int64).max if kind == "min" else np.iinfo(np.int64).min)
                (np.minimum if kind == "min" else np.maximum).at(total, group, column)
            totals.append(total)
        return group, key, other, totals


class Exchange:
    """The levels between blocks and ranges; ``aside`` answers fragments of other kinds, all of a range at once."""

    def __init__(self, kinds: dict[int, Kind], blocks: int, aside: dict[int, Callable[[list[bytes]], list[bytes]]] | None = None):
        self.kinds, self.aside = kinds, aside or {}
        self.levels = next(n for n in range(1, 64) if FAN**n >= blocks)
        self.group = next(n for n in range(1, FAN + 1) if n**self.levels >= blocks)

    def _free(self, kind: int, level: int) -> int:
        """Bits of a number that its range at a level leaves open."""
        return self.kinds[kind].width - math.ceil(self.kinds[kind].bits * level / self.levels)

    def _send(self, kind: int, sender: int, level: int, group: int, numbers: np.ndarray, second: np.ndarray | None, columns: list[np.ndarray]) -> list[tuple]:
        spec, free, rows = self.kinds[kind], self._free(kind, level), []
        for piece, at in pieces(numbers, free):
            low = numbers[at] & np.uint64((1 << free) - 1)
            data = encode(low, free) + (_pack(second[at], "second") if spec.second else b"")
            data += b"".join(_pack(c[at], k) for c, k in zip(columns, spec.columns, strict=True))
            rows.append((kind << 58 | group << 32 | piece, sender, data))
        return rows

    def send(self, kind: int, block: int, numbers: np.ndarray, *columns: np.ndarray, second: np.ndarray | None = None) -> list[tuple]:
        """Fragments of a block's ascending numbers."""
        return self._send(kind, block, 1, block // self.group, numbers, second, list(columns))

    def told(self, said: dict[int, bytes], kind: int, block: int, numbers: np.ndarray) -> np.ndarray:
        """What a block has been told of each of the numbers that it sent."""
        out = np.zeros(len(numbers), np.uint8)
        for piece, at in pieces(numbers, self._free(kind, 1)):
            out[at] = self._read(kind, said[kind << 58 | block // self.group << 32 | piece], at.stop - at.start)
        return out

    def _read(self, kind: int, data: bytes, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n) if self.kinds[kind].binary else np.frombuffer(data, np.uint8)

    def _merged(self, rows: list[tuple], level: int):
        node = rows[0][0]
        kind, group, piece = node >> 58, node >> 32 & (1 << 26) - 1, node & (1 << 32) - 1
        spec, free = self.kinds[kind], self._free(kind, level)
        got, second, columns, sizes = [], [], [[] for _ in spec.columns], []
        for *_, data in rows:
            numbers, at = _decode(data)
            got.append(numbers)
            sizes.append(len(numbers))
            if spec.second:
                x, at = _unpack(data, len(numbers), at, "second")
                second.append(x)
            for kept, name in zip(columns, spec.columns, strict=True):
                x, at = _unpack(data, len(numbers), at, name)
                kept.append(x)
        numbers = np.concatenate(got) | np.uint64(piece << free)
        columns = [np.concatenate(x) for x in columns]
        return kind, group, sizes, columns, *spec.merge(numbers, np.concatenate(second) if spec.second else None, columns, free)

    def _answer(self, rows: list[tuple], level: int, said: dict[int, bytes] | None) -> list[tuple]:
        """What each sender of a node is told: by the totals at the last level, else by what the node is told of its own."""
        kind, own_group, sizes, own, group, key, _, totals = self._merged(rows, level)
        spec = self.kinds[kind]
        if said is None:
            told = spec.tell(*totals).astype(np.uint8)
        else:
            told = np.zeros(len(key), np.uint8)
            for piece, at in pieces(key, self._free(kind, level + 1)):
                told[at] = self._read(kind, said[kind << 58 | own_group // self.group << 32 | piece], at.stop - at.start)
        if spec.share is None:
            told = told[group]
        else:
            first = np.full(len(key), len(group))
            np.minimum.at(first, group, np.arange(len(group)))
            told = spec.share(told[group], first[group] == np.arange(len(group)), own, [t[group] for t in totals]).astype(np.uint8)
        split = np.split(told, np.cumsum(sizes)[:-1])
        return [(r, b, (np.packbits(x) if spec.binary else x).tobytes()) for (r, b, _), x in zip(rows, split, strict=True)]

    def tables(self, sent: DataFrame) -> list[DataFrame]:
        """Fragments that enter each level."""

        def combine(level: int):
            def run(given: pa.Table) -> pa.Table:
                rows = rows_of(given)
                if not rows or rows[0][0] < 0 or rows[0][0] >> 58 not in self.kinds:
                    return fragments([])
                kind, group, _, _, _, key, second, totals = self._merged(rows, level)
                return fragments(self._send(kind, rows[0][0], level + 1, group // self.group, key, second, totals))

            return run

        out = [sent]
        for level in range(1, self.levels):
            out.append(out[-1].groupBy("range").applyInArrow(combine(level), FRAGMENT))
        return out

    def settle(self, sent: DataFrame) -> DataFrame:
        """Each fragment with the answer in place of its data; a block's notes to itself (negative ranges) come back as they are."""

        def answer(level: int, given: pa.Table, said: dict[int, bytes] | None) -> pa.Table:
            rows = rows_of(given)
            if not rows or rows[0][0] < 0:
                return given.select(["range", "block", "data"])
            if other := self.aside.get(rows[0][0] >> 58):
                return fragments([(r, b, x) for (r, b, _), x in zip(rows, other([d for *_, d in rows]), strict=True)])
            return fragments(self._answer(rows, level, said))

        def back(level: int):
            return lambda given, said: answer(level, given, answers(said))

        tables = self.tables(sent)
        told = tables[-1].groupBy("range").applyInArrow(lambda given: answer(self.levels, given, None), FRAGMENT)
        for level in range(self.levels - 1, 0, -1):
            told = tables[level - 1].groupBy("range").cogroup(told.groupBy("block")).applyInArrow(back(level), FRAGMENT)
        return told
