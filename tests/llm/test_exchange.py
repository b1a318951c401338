"""Word identity, the encodings of fragments, and the levels between blocks and ranges."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import exchange
from palimpsest.llm import op03_suffix_array_dedup as op3
from palimpsest.llm import op05_substring_dedup as op5
from palimpsest.llm.words import SPACES, pair, windows_of, words_of

from test_texts import brute_bytes, brute_windows, corpus


def test_words_are_told_apart_by_their_bytes():
    rng = random.Random(4)
    words = {"".join(rng.choice("ab\0é") for _ in range(rng.randrange(1, 40))) for _ in range(3000)} | {"a", "a\0", "a\0\0", "a" * 15, "a" * 16, "a" * 15 + "\0", "\xff" * 15}
    words = sorted(words)
    got = words_of([" ".join(words).encode()], SPACES)
    assert len(got.low) == len(words) == len(set(zip(got.low.tolist(), got.high.tolist(), strict=True)))
    again = words_of([w.encode() for w in words], SPACES)
    assert (again.low == got.low).all() and (again.high == got.high).all()


def thue_morse(n=1024):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_complementary_words_differ(spark):
    a, b = thue_morse()
    lead = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"{lead} {a}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in op5.digests(docs).collect()} == {1: 0, 2: 0, 3: 13}


@pytest.mark.parametrize("size", [1, 2, 3, 12, 13, 16])
def test_windows(size):
    rng = random.Random(size)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(50)]
    at, head, tail = windows_of(words_of([t.encode() for t in texts], SPACES), size)
    want = [tuple(w[i : i + size]) for w in map(str.split, texts) for i in range(len(w) - size + 1)]
    assert len(at) == len(want)
    for digest in (head, tail):
        assert len(set(zip(want, digest.tolist(), strict=True))) == len(set(want)) == len(set(digest.tolist()))


def test_encodings_round_trip():
    for n, width in ((0, 22), (1, 1), (5, 40), (3000, 22), (3000, 63), (2000, 12)):
        numbers = np.unique(np.random.default_rng(n).integers(0, 1 << width, n, dtype=np.uint64))
        got, end = exchange._decode(exchange.encode(numbers, width) + b"rest")
        assert (got == numbers).all() and exchange.encode(numbers, width)[end:] == b""
    for column in (np.array([], np.int64), np.array([3, 900]), np.array([-(2**63), 2**63 - 1, 0])):
        assert (exchange._unpack(exchange._pack(column, "min"), len(column), 0, "min")[0] == column).all()


def kinds():
    lead = lambda told, first, own, total: np.where(first, told, np.minimum(told, 1))
    return {1: exchange.Kind(40, 9, ("count",), lambda n: np.where(n > 1, 2, 0), lead, binary=False), 2: exchange.Kind(40, 9, ("sum", "min"), lambda n, least: n > 2, lambda told, first, own, total: told | (own[1] > total[1]), second=True)}


def test_levels_tell_what_one_meeting_would(spark, monkeypatch):
    monkeypatch.setattr(exchange, "FAN", 4)
    blocks = 40
    ex = exchange.Exchange(kinds(), blocks)
    assert (ex.levels, ex.group) == (3, 4)
    rng = np.random.default_rng(6)
    held = [np.unique(pair(rng.integers(0, 300, 60, dtype=np.uint64), np.uint64(0))) >> np.uint64(24) for _ in range(blocks)]
    rows = []
    for b, numbers in enumerate(held):
        rows += ex.send(1, b, numbers, np.ones(len(numbers), np.int64)) + ex.send(2, b, numbers, np.full(len(numbers), 2), np.full(len(numbers), 100 - b), second=numbers % np.uint64(3))
    rows.append((-1, 0, b"note"))
    said = ex.settle(spark.createDataFrame(pa.Table.to_pandas(exchange.fragments(rows)), exchange.FRAGMENT)).collect()
    of_block = {b: {r.range: bytes(r.data) for r in said if r.block == b} for b in range(blocks)}
    assert of_block[0][-1] == b"note"
    count = Counter(x for numbers in held for x in numbers.tolist())
    last = {x: max(b for b in range(blocks) if x in set(held[b].tolist())) for x in count}
    leads = Counter()
    for b, numbers in enumerate(held):
        told = ex.told(of_block[b], 1, b, numbers)
        assert [t > 0 for t in told] == [count[x] > 1 for x in numbers.tolist()]
        leads.update(x for x, t in zip(numbers.tolist(), told, strict=True) if t == 2)
        assert [t > 0 for t in ex.told(of_block[b], 2, b, numbers)] == [2 * count[x] > 2 or b < last[x] for x in numbers.tolist()]
    assert leads == Counter(x for x, n in count.items() if n > 1)


def test_fragments_grow_with_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(exchange, "FAN", 4)
    made = {}
    for blocks in (20, 40):
        bits = (blocks - 1).bit_length()
        ex = exchange.Exchange({1: exchange.Kind(40, bits, ("count",), lambda n: n > 1)}, blocks)
        rng = np.random.default_rng(7)
        rows = [r for b in range(blocks) for r in ex.send(1, b, np.unique(rng.integers(0, 1 << 40, 800, dtype=np.uint64)), np.ones(800, np.int64))]
        made[blocks] = sum(t.count() for t in ex.tables(spark.createDataFrame(pa.Table.to_pandas(exchange.fragments(rows)), exchange.FRAGMENT)))
    assert made[40] < 2.6 * made[20] and made[40] <= 40 * 3 * 8


@pytest.mark.parametrize("fan", [2, 3])
def test_dedup_over_several_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(exchange, "FAN", fan)
    rows = corpus(5, n=50)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op5.digests(docs, block_bytes=1500).collect()} == brute_windows(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3.digests(docs, block_bytes=1500).collect()} == brute_bytes(rows)


def test_rows_without_an_id_spread_over_blocks(spark):
    docs = spark.createDataFrame([(None, f"text number {i}") for i in range(2000)], "doc_id long, text string")
    seen = []
    for op in (op3, op5):
        field = [docs.schema["doc_id"], op.T.StructField("n", op.T.LongType())]
        result = lambda given, texts, *more: pa.table([given.column("doc_id"), pa.array([len(texts)] * len(texts), pa.int64())], names=["doc_id", "n"])
        seen.append(op.without_repeats(docs, "doc_id", "text", field, result).agg(op.F.max("n"), op.F.count("*")).first())
    assert all(n == 2000 and most < 400 for most, n in seen)
