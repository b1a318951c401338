"""The trie of conversations against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from palimpsest.llm import op13_prefix_trie as op

SF = "/root/testdata/sf0.001"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        m, below = members[node], children[node]
        leaves = sum(out[b][5] for b in below) or 1
        saved = sum(out[b][6] for b in below) + ((len(m) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(node))))
        out[node] = (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [op.CONTAINER, 20])
def test_whole_table(spark, limit):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in given.collect()]
    assert of(op.prefix_trie(given, limit)) == brute(rows)


@pytest.mark.parametrize("limit", [60, op.CONTAINER])
def test_shared_beginnings_copies_and_long_conversations(spark, limit):
    rng = random.Random(limit)
    rows = []
    hot = [("user", f"hot {k} é") for k in range(60)]
    for c in range(220):
        kind = c % 6
        if kind < 2:
            said = hot[: rng.randrange(40, 61)] + [("assistant", f"{rng.randrange(3)}")] * rng.randrange(3)
        elif kind == 2:
            said = [("user", "same"), ("assistant", "answer")]
        else:
            said = [(rng.choice(["user", "assistant"]), rng.choice("ab") * rng.randrange(3)) for _ in range(rng.randrange(9))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(said)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = of(op.prefix_trie(df, limit))
    assert got == brute(rows)
    _, heads = op.burst(sequences(df), limit)
    assert not heads if limit == op.CONTAINER and len(got) < limit else heads
    assert len(heads) < 30  # shared turns are passed in one round


def sequences(df):
    members = op.rebuilt(df).withColumn("sid", op.F.unhex(op.F.md5("ids")))
    return members.groupBy("sid").agg(op.F.min("conv_id").alias("least"), op.F.count("*").alias("n"), op.F.min(op.F.struct("ids", "sizes")).alias("s")).select("sid", "least", "n", "s.ids", "s.sizes")


def test_nulls_ties_and_no_rows(spark):
    rows = [(7, None, "user", "first"), (7, 0, None, None), (7, 0, "", ""), (7, 1, "user", None), (8, 5, "user", "x" * 3_000_000), (8, 5, "user", "x" * 3_000_000), (None, 0, "user", "lost"), (5, 3, "a", "b"), (10, 3, "a", "b"), (12, 0, "", "user"), (13, 0, "u", "ser")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, least int")
    for limit in (2, 100):
        assert of(op.prefix_trie(df, limit)) == brute(rows)
    assert op.prefix_trie(df.limit(0)).count() == 0
    assert of(op.prefix_trie(df.where("conv_id IS NULL"))) == []

