"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are split by the vocabulary's pattern. Different pieces of a batch go by length into matrices of
token ids padded with -1. In each round every row merges its leftmost pair of least rank; pair ranks come
from a hashed table of all pairs that join to a token. Merged rows lose a column and finished rows leave the matrix.
Pieces already met in the task are looked up. Nothing is shuffled, and only the fixed vocabulary is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append, chunks, table, tokenizer_path, utf8

#: Longest pieces of each matrix; a longer piece merges along a heap, whose time grows as n log n instead of n squared.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256)
#: Rows of a matrix at once, and pieces that a task remembers.
ROWS, REMEMBERED = 1 << 14, 1 << 18
NO_RANK = np.int32(2**31 - 1)
_CODECS: dict[bytes, Codec] = {}


def public_pattern() -> str:
    """The pattern that splits texts for the installed rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """A vocabulary of ranks: its hashed pair table, and the pieces encoded so far."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.split = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        ids = sorted(self.ranks.items(), key=lambda x: x[1])
        self.size = ids[-1][1] + 1
        self.token_length = np.zeros(self.size, np.int64)
        self.token_length[[i for _, i in ids]] = [len(t) for t, _ in ids]
        self.token_start = np.concatenate([[0], np.cumsum(self.token_length)])
        self.token_data = np.frombuffer(b"".join(t for t, _ in ids), np.uint8)
        get = self.ranks.get
        pairs = [(a << 32 | b, r) for t, r in ids for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        key, rank = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int32)
        self.bits = int(len(pairs)).bit_length() + 2
        self.table_key = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.table_rank = np.full(1 << self.bits, NO_RANK)
        at = self._slot(key)
        while len(key):  # open addressing: what finds its place taken moves one on
            free = self.table_key[at] == np.uint64(2**64 - 1)
            self.table_key[at[free]], self.table_rank[at[free]] = key[free], rank[free]
            lost = self.table_key[at] != key
            key, rank, at = key[lost], rank[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self._forget()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair; NO_RANK if it isn't a token or one side is padding."""
        shape = left.shape
        key = (left.ravel().astype(np.uint64) << np.uint64(32)) | (right.ravel().astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(key)
        found, rank = self.table_key[at], self.table_rank[at]
        open_ = np.flatnonzero((found != key) & (found != np.uint64(2**64 - 1)))
        rank[found != key] = NO_RANK
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.table_key[at[open_]]
            hit = found == key[open_]
            rank[open_[hit]] = self.table_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return rank.reshape(shape)

    def merge(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of pieces of ``width`` bytes at most, all rows of a matrix together."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < length[:, None], self.of_byte[raw], np.int32(-1))
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(n), [None] * n
        while len(rows):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            every = np.arange(len(rows))
            least = rank[every, best] if rank.shape[1] else np.full(len(rows), NO_RANK)
            going = least != NO_RANK
            for r, row in zip(rows[~going].tolist(), ids[~going], strict=True):
                out[r] = row[row >= 0]
            rows, ids, rank, best, least = rows[going], ids[going], rank[going], best[going], least[going]
            if not len(rows):
                break
            every, columns = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids[every, best] = least  # a token's id is its rank
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), axis=1)
            before, after = np.flatnonzero(best > 0), np.flatnonzero(best < ids.shape[1] - 1)
            rank[before, best[before] - 1] = self.pair_ranks(ids[before, best[before] - 1], ids[before, best[before]])
            rank[after, best[after]] = self.pair_ranks(ids[after, best[after]], ids[after, best[after] + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges of one long piece, taken from a heap of (rank, place)."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the token that starts at each place
        before = list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= n or end[middle] != stop or middle == stop:
                continue
            alive[middle] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        return np.array([ranks[piece[i : end[i]]] for i in range(n) if alive[i]], np.int32)

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        self.ids, self.start, self.count = np.zeros(1 << 20, np.int32), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.used = 0

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that the task has not met."""
        data = [p.encode() for p in pieces]
        made: list = [None] * len(data)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(data):
            if (whole := self.ranks.get(piece)) is not None:
                made[i] = np.array([whole], np.int32)
            elif len(piece) > WIDTHS[-1]:
                made[i] = self.merge_long(piece)
            else:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(piece)), []).append(i)
        for width, all_rows in by_width.items():
            for a in range(0, len(all_rows), ROWS):
                some = all_rows[a : a + ROWS]
                for i, ids in zip(some, self.merge([data[i] for i in some], width), strict=True):
                    made[i] = ids
        first, counts = len(self.written), np.fromiter(map(len, made), np.int64, len(made))
        total, n = int(counts.sum()), first + len(made)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, len(self.ids)), np.int32)])
        if n > len(self.start):
            grow = np.zeros(max(n, len(self.start)), np.int64)
            self.start, self.count = np.concatenate([self.start[:first], grow]), np.concatenate([self.count[:first], grow])
        self.ids[self.used : self.used + total] = np.concatenate(made)
        self.start[first:n] = self.used + np.cumsum(counts) - counts
        self.count[first:n] = counts
        self.used += total
        self.number.update(zip(pieces, range(first, n), strict=True))
        self.written += [" ".join(map(str, x.tolist())) for x in made]

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """For each text its token ids, and the numbers of its pieces in ``written``."""
        for a, b in chunks(texts, 1 << 19):
            split = [self.split.findall(t.decode()) for t in texts[a:b]]
            if len(self.written) > REMEMBERED:
                self._forget()
            new = list(dict.fromkeys(p for pieces in split for p in pieces if p not in self.number))
            if new:
                self.learn(new)
            get = self.number.__getitem__
            for pieces in split:
                numbers = list(map(get, pieces))
                at = np.array(numbers, np.int64)
                yield self.ids[_spread(self.start[at], self.count[at])], numbers

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens; an id outside the vocabulary is an error."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.token_length[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.token_data[_spread(self.token_start[ids], self.token_length[ids])].tobytes()


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... count[i] numbers for each i."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    if ranks_file not in _CODECS:
        _CODECS[ranks_file] = Codec(ranks_file, pattern)
    return _CODECS[ranks_file]


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    with open(path or tokenizer_path(), "rb") as file:
        return spark.sparkContext.broadcast((file.read(), pattern or public_pattern()))


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every row with ``ids``, the tokens of its whole text; null and empty texts have none."""
    sent = _vocabulary(docs.sparkSession, path, pattern)

    def compute(given: pa.Table) -> list:
        return [pa.array([ids for ids, _ in codec(*sent.value).encode(utf8(given.column(0)))], pa.list_(pa.int32()))]

    return append(docs, [T.StructField("ids", T.ArrayType(T.IntegerType()))], compute, [text])


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every row with ``decoded``, the bytes of its tokens; null ids give empty bytes."""
    sent = _vocabulary(docs.sparkSession, path, pattern)

    def compute(given: pa.Table) -> list:
        return [pa.array([codec(*sent.value).decode(np.array(x or [], np.int64)) for x in given.column(0).to_pylist()], pa.binary())]

    return append(docs, [T.StructField("decoded", T.BinaryType())], compute, [ids])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): texts encoded and decoded again in one pass."""
    sent = _vocabulary(docs.sparkSession, path, pattern)

    def compute(given: pa.Table) -> list:
        own = codec(*sent.value)
        n, ids_sha, text_sha = [], [], []
        for ids, numbers in own.encode(utf8(given.column(0))):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(own.written.__getitem__, numbers)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return append(docs, fields, compute, [text], keep=[key])


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, and of what they decode to."""
    return digests(table(spark, sf_dir, "documents"))
