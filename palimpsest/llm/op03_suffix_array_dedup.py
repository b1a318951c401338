"""Suffix-array dedup by prefix-free parsing of the corpus, as exact removal of repeated byte strings.

A rolling hash triggers at the least value of each window of places, so every string of the wanted length holds a
trigger at a place that its bytes alone decide, and phrases between triggers never grow long. A string is then
a suffix of one phrase and a prefix of the parse that follows. Phrases whose whole surroundings repeat are
settled as entries of a dictionary, by digest. What is left lies at the ends of repeated passages: those
phrases and the parse after them meet in tasks by the bytes after the trigger. There the suffix array of
the phrases and that of the parse, with their common-prefix lengths, combine into the order of the
corpus: neighbours of equal phrase suffix whose parse agrees for the rest are repeats.

Documents are dealt into blocks once. Blocks exchange digests through the levels of ``exchange``, combined in each
block, and get answers back; phrases with their surroundings go to the task of their passage. A group of very many
different surroundings is settled window by window instead, by digest, so that no task gets a share that grows with
one passage. Where a digest decides, 96 bits of two digests and the bits that number the ranges have to agree.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, table, utf8
from .exchange import FRAGMENT, Exchange, Kind, answers, fragments, pieces
from .words import eights, pair

LENGTH = 200
#: Bytes of the rolling hash, and places of which the least hash is a trigger.
ROLL, PLACES = 16, 88
#: Bytes after a trigger that every string of the wanted length around it holds.
AFTER = LENGTH - PLACES + 1
#: Bytes of text in a block; digests in a task; different surroundings of one passage that a task takes.
BLOCK_BYTES, TASK_KEYS, HOT = 5 << 20, 1 << 19, 1 << 15
LEAST_BLOCKS = 12
SEEN, WHOLE, PASSAGE, CONTEXT, WINDOWS = range(5)
NOTHING, ALL, OPEN, SAMPLE = range(4)


#: Odd multipliers and shifts of the two digests of byte strings.
LANES = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(29)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)))


def digests_of(eight: np.ndarray, start: np.ndarray, size: np.ndarray, most: int, seed: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of byte strings of ``size`` bytes, 8 at least and ``most`` at most, taken 8 bytes at a time; the last 8 overlap."""
    seed = np.zeros(len(start), np.uint64) + np.asarray(seed, np.uint64)
    held = [pair(seed, size.astype(np.uint64), lane) for lane in (3, 4)]
    last = size - 8
    for k in range(0, most, 8):
        word = eight[start + np.minimum(k, last)]
        for i, (odd, shift) in enumerate(LANES):
            held[i] = (held[i] ^ word) * odd
            held[i] ^= held[i] >> shift
    return pair(held[0], seed, 5), pair(held[1], seed, 6)


class Phrases:
    """Runs of string starts that share a trigger, in a block of texts joined to one."""

    def __init__(self, texts: list[bytes]):
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(self.n)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.eight = eights(self.data)
        found = [self._of(int(self.base[a]), int(self.base[b]), self.base[a:b], self.n[a:b]) for a, b in chunks(texts)]
        self.low, self.high, self.trigger = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in range(3))
        self.passage = digests_of(self.eight, self.trigger, np.full(len(self.low), AFTER), AFTER)[0]
        # whole surroundings: where the trigger lies in them counts too
        shape = ((self.trigger - self.low) * 256 + (self.trigger - self.high)).astype(np.uint64)
        whole, other = digests_of(self.eight, self.low, self.high + LENGTH - self.low, LENGTH + PLACES, shape)
        order = np.lexsort((other, whole))
        new = np.ones(len(order), bool)
        new[1:] = (whole[order][1:] != whole[order][:-1]) | (other[order][1:] != other[order][:-1])
        self.first = order[new]
        self.of_entry = np.empty(len(order), np.int64)
        self.of_entry[order] = np.cumsum(new) - 1
        self.entry, self.other = whole[self.first], other[self.first]
        self.count = np.diff(np.flatnonzero(new), append=len(order))
        self.entry_passage = self.passage[self.first]

    def _of(self, start: int, end: int, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        eight = self.eight[start:end]
        room = np.maximum(n - LENGTH + 1, 0)
        ends = np.cumsum(room)
        x = np.repeat(base - start - (ends - room), room) + np.arange(int(ends[-1]) if len(ends) else 0)
        if not len(x):
            return (np.zeros(0, np.int64),) * 3
        rolled = pair(eight[:-8], eight[8:])[: end - start - ROLL + 1] >> np.uint64(32)  # of the 16 bytes from each place
        least = (rolled << np.uint64(32)) | np.arange(len(rolled), dtype=np.uint64)
        width = 1
        while 2 * width <= PLACES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :])
        trigger = (least[x] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(trigger, prepend=-1))
        low, trigger = x[new], trigger[new]
        high = x[np.append(new[1:], len(x)) - 1]
        return low + start, high + start, trigger + start

    def windows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String starts of some entries, and two digests of each."""
        run = self.first[entries]
        size = self.high[run] - self.low[run] + 1
        ends = np.cumsum(size)
        x = np.repeat(self.low[run] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return x, *digests_of(self.eight, x, np.full(len(x), LENGTH), LENGTH)


def common_lengths(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before; the first has none."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])])


def suffix_order(strings: list[bytes], width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each string among the different ones, and common prefix lengths in that order."""
    padded = b"".join((s[::-1] if backwards else s).ljust(width, b"\xff") for s in strings)  # no UTF-8 byte is 255
    rows = np.frombuffer(padded, np.uint8).reshape(len(strings), width)
    different, rank = np.unique(rows.view(f"V{width}").ravel(), return_inverse=True)
    lengths = common_lengths(different.view(np.uint8).reshape(-1, width))
    return rank, lengths


def repeats(phrases: list[bytes], parse: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which strings repeat: row i, column a, for the last a bytes of phrase i and LENGTH - a bytes of its parse, low <= a <= high."""
    rank_d, common_d = suffix_order(phrases, PLACES, backwards=True)
    rank_p, common_p = suffix_order(parse, LENGTH)
    out = np.zeros((len(phrases), PLACES), bool)
    for a in range(PLACES):
        rows = np.flatnonzero((low <= a) & (a <= high))
        if len(rows) < 2:
            continue
        suffix = np.cumsum(common_d < a)[rank_d[rows]]
        rest = np.cumsum(common_p < LENGTH - a)[rank_p[rows]]
        place = suffix * (len(common_p) + 1) + rest  # the order of the corpus: by phrase suffix, then by parse
        order = np.argsort(place, kind="stable")
        same = place[order][1:] == place[order][:-1]
        hit = np.zeros(len(rows), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        out[rows[hit], a] = True
    return out


def contexts(sent: list[bytes]) -> list[bytes]:
    """Which strings of phrases in their surroundings repeat, of all phrases of a range of passages."""
    phrases, parse, low, high, sizes = [], [], [], [], []
    for data in sent:
        n = int.from_bytes(data[:4], "little")
        a_low, a_high = np.frombuffer(data, np.uint8, n, 4), np.frombuffer(data, np.uint8, n, 4 + n)
        at = 4 + 2 * n
        for lo, hi in zip(a_low.tolist(), a_high.tolist(), strict=True):
            phrases.append(data[at : at + hi])
            parse.append(data[at + hi : at + hi + LENGTH - lo])
            at += hi + LENGTH - lo
        low.append(a_low)
        high.append(a_high)
        sizes.append(n)
    found = repeats(phrases, parse, np.concatenate(low), np.concatenate(high))
    return [np.packbits(x, axis=1).tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]


def without_repeats(docs: DataFrame, key: str, text: str, fields: list[T.StructField], result, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """``result(table, texts, removed)`` of each block, removed the flags of each text's bytes (None: no byte).

    Rows are dealt by key and text, so rows without a key, or of one key, spread like others.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-total // block_bytes))
    bits = max(1, math.ceil(math.log2(max(2, total / (PLACES / 2) / TASK_KEYS))))
    (dealing,) = fresh(docs, "_block")
    dealt = docs.withColumn(dealing, F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(blocks)))
    again = lambda n: n > 1
    lead = lambda told, first, own, total: np.where(first, told, np.minimum(told, 1))
    kinds = {
        SEEN: Kind(bits + 32, bits, ("count",), again),
        WHOLE: Kind(bits + 32, bits, ("count",), lambda n: np.where(n > 1, 2, 0), lead, second=True, binary=False),
        PASSAGE: Kind(bits + 32, bits, ("sum", "max"), lambda n, some: np.where(some > 0, np.where(n > hot, 2, 1), 0), binary=False),
        WINDOWS: Kind(bits + 32, bits, ("count",), again, second=True),
    }
    ex = Exchange(kinds, blocks, {CONTEXT: contexts})

    def block_of(given: pa.Table) -> tuple[int, list[bytes], Phrases]:
        texts = utf8(given.column(text))
        return given.column(dealing)[0].as_py(), texts, Phrases(texts)

    def short(x: np.ndarray) -> np.ndarray:
        return x >> np.uint64(32 - bits)

    def passages(block: Phrases, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different passages of some entries, the passage of each, entries of each."""
        return np.unique(short(block.entry_passage[entries]), return_inverse=True, return_counts=True)

    def sketch(given: pa.Table) -> pa.Table:
        number, _, block = block_of(given)
        seen, count = np.unique(short(block.passage), return_counts=True)
        return fragments(ex.send(SEEN, number, seen, count) + ex.send(WHOLE, number, short(block.entry), block.count, second=block.other))

    def states(number: int, block: Phrases, said: dict[int, bytes]) -> np.ndarray:
        """Of each entry after the first round: nothing repeats, all, perhaps some, or all and it stands for its like."""
        passage = short(block.entry_passage)
        seen = np.unique(short(block.passage))
        repeated = ex.told(said, SEEN, number, seen)[np.searchsorted(seen, passage)] > 0
        whole = ex.told(said, WHOLE, number, short(block.entry))
        return np.where(whole == 2, SAMPLE, np.where(whole == 1, ALL, np.where(repeated, OPEN, NOTHING))).astype(np.uint8)

    def ask(given: pa.Table, said: pa.Table) -> pa.Table:
        if not given.num_rows:
            return fragments([])
        number, _, block = block_of(given)
        state = states(number, block, answers(said))
        entries = np.flatnonzero(state >= OPEN)
        passage, which, count = passages(block, entries)
        some = np.bincount(which, weights=state[entries] == OPEN, minlength=len(passage)) > 0
        return fragments([(-1 - number, number, state.tobytes()), *ex.send(PASSAGE, number, passage, count, some.astype(np.int64))])

    def chosen(number: int, block: Phrases, state: np.ndarray, said: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Entries to compare with their surroundings, by passage; and those to compare window by window."""
        entries = np.flatnonzero(state >= OPEN)
        passage, which, _ = passages(block, entries)
        told = ex.told(said, PASSAGE, number, passage)[which]
        usual, many = entries[told == 1], entries[told == 2]
        return usual[np.lexsort((block.entry[usual], block.entry_passage[usual]))], many

    def compare(given: pa.Table, said: pa.Table) -> pa.Table:
        if not given.num_rows:
            return fragments([])
        number, _, block = block_of(given)
        said = answers(said)
        state = np.frombuffer(said[-1 - number], np.uint8)
        usual, many = chosen(number, block, state, said)
        pick = np.zeros(len(state), np.uint8)
        pick[usual], pick[many] = 1, 2
        rows = [(-1 - number, number, state.tobytes() + pick.tobytes())]  # the last round needs both
        data = block.data.tobytes()
        for piece, at in pieces(block.entry_passage[usual], 64 - bits):
            run = block.first[usual[at]]
            low, high = block.trigger[run] - block.high[run], block.trigger[run] - block.low[run]
            texts = b"".join(data[a : b + LENGTH] for a, b in zip(block.low[run].tolist(), block.high[run].tolist(), strict=True))
            rows.append((CONTEXT << 58 | piece, number, len(run).to_bytes(4, "little") + low.astype(np.uint8).tobytes() + high.astype(np.uint8).tobytes() + texts))
        _, different, other, _, count = _windows(block, many)
        return fragments(rows + ex.send(WINDOWS, number, short(different), count, second=other))

    def finish(given: pa.Table, said: pa.Table) -> pa.Table:
        if not given.num_rows:
            return pa.table({f.name: [] for f in fields})
        number, texts, block = block_of(given)
        said = answers(said)
        state, pick = np.frombuffer(said[-1 - number], np.uint8).reshape(2, -1)
        gone = np.zeros(len(block.data) + 1, np.int32)
        every = np.isin(state, (ALL, SAMPLE))[block.of_entry] if len(block.of_entry) else np.zeros(0, bool)
        np.add.at(gone, block.low[every], 1)
        np.add.at(gone, block.high[every] + LENGTH, -1)
        usual = np.flatnonzero(pick == 1)
        usual = usual[np.lexsort((block.entry[usual], block.entry_passage[usual]))]
        for piece, at in pieces(block.entry_passage[usual], 64 - bits):
            run = block.first[usual[at]]
            hit = np.unpackbits(np.frombuffer(said[CONTEXT << 58 | piece], np.uint8).reshape(len(run), -1), axis=1)
            row, a = np.nonzero(hit)
            x = block.trigger[run[row]] - a
            np.add.at(gone, x, 1)
            np.add.at(gone, x + LENGTH, -1)
        x, different, _, which, _ = _windows(block, np.flatnonzero(pick == 2))
        x = x[ex.told(said, WINDOWS, number, short(different))[which] > 0]
        np.add.at(gone, x, 1)
        np.add.at(gone, x + LENGTH, -1)
        inside = np.cumsum(gone[:-1]) > 0
        removed: list = [inside[a:b] if inside[a:b].any() else None for a, b in zip(block.base, block.base[1:], strict=False)]
        return result(given, texts, removed)

    by_block = dealt.groupBy(f"`{dealing}`")
    told = ex.settle(by_block.applyInArrow(sketch, FRAGMENT))
    for step in (ask, compare):
        told = ex.settle(by_block.cogroup(told.groupBy("block")).applyInArrow(step, FRAGMENT))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(finish, T.StructType(fields))


def _windows(block: Phrases, entries: np.ndarray) -> tuple[np.ndarray, ...]:
    """String starts of some entries; the two digests of the different strings, the string of each start, starts of each string."""
    x, digest, other = block.windows(entries)
    order = np.lexsort((other, digest))
    new = np.ones(len(order), bool)
    new[1:] = (digest[order][1:] != digest[order][:-1]) | (other[order][1:] != other[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return x, digest[first], other[first], which, np.diff(np.flatnonzero(new), append=len(order))


def _kept(text: bytes, removed: np.ndarray | None) -> bytes:
    return text if removed is None else np.frombuffer(text, np.uint8)[~removed].tobytes()


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes if a string of 200 bytes over it starts anywhere else too, in whichever text; all copies go. Null is empty.
    """
    names = ("n_bytes", "n_removed", "n_spans")
    fields = [docs.schema[key], *[T.StructField(c, T.LongType()) for c in names], T.StructField("kept_sha256", T.StringType())]

    def result(given: pa.Table, texts: list[bytes], removed: list) -> pa.Table:
        spans = [0 if r is None else int((np.diff(r.astype(np.int8), prepend=0) == 1).sum()) for r in removed]
        columns = [[len(t) for t in texts], [0 if r is None else int(r.sum()) for r in removed], spans]
        kept = [hashlib.sha256(_kept(t, r)).hexdigest() for t, r in zip(texts, removed, strict=True)]
        return pa.table([given.column(key), *[pa.array(c, pa.int64()) for c in columns], pa.array(kept, pa.string())], names=[f.name for f in fields])

    return without_repeats(docs.select(key, text), key, text, fields, result, **more)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """All rows and columns, texts without repeated bytes; what a cut leaves of a character becomes U+FFFD."""
    names = docs.columns

    def result(given: pa.Table, texts: list[bytes], removed: list) -> pa.Table:
        old = given.column(text).to_pylist()
        new = pa.array([o if r is None else _kept(t, r).decode(errors="replace") for o, t, r in zip(old, texts, removed, strict=True)], pa.string())
        return pa.table([new if c == text else given.column(c) for c in names], names=names)

    return without_repeats(docs, key, text, list(docs.schema.fields), result, **more)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document."""
    return digests(table(spark, sf_dir, "documents"))
