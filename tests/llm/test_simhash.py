import re

import numpy as np
import pytest
import xxhash

from palimpsest.llm import op09_simhash as op
from palimpsest.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    top = {k: k for k, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x in rows:
            for b, y in rows:
                if (x ^ y).bit_count() <= 3 and top[a] < top[b]:
                    top[b] = top[a]
                    changed = True
    return top


def test_whole_table_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op.op9_simhash(spark, SF).collect()}
    want = {k: brute_fingerprint(t) for k, t in texts.items()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in want.items()}
    assert {k: r.component_id for k, r in got.items()} == brute_components(sorted(want.items()))


def test_trees_find_every_pair_of_a_dense_ball():
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.integers(0, 2**63, 3, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (3, 60), dtype=np.uint64))]).ravel())
    shard = rng.integers(0, 2, len(values))
    trees = op.Trees(values, shard)
    roots = {int(shard[trees.item[r]]): r for r in trees.roots}
    found = set()
    for a, b in trees.within(np.arange(len(values)), np.array([roots[s] for s in shard]), 3):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if shard[i] == shard[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 3}
    assert found == want


@pytest.mark.parametrize("parts", [4, 5, 6])
def test_every_shard_choice_joins_the_same_values(spark, parts):
    keys = op.shard_keys(parts)
    assert len(keys) == {4: 4, 5: 10, 6: 20}[parts]
    base = 0x0123456789ABCDEF
    for flips in ((0,), (0, 20), (0, 20, 40), (3, 33, 63)):
        other = base ^ sum(1 << b for b in flips)
        other -= (1 << 64) if other >> 63 else 0
        row = spark.createDataFrame([(base, "a"), (other, "b")], "fp long, n string").select("n", op.F.array(*keys).alias("k")).collect()
        assert set(row[0].k) & set(row[1].k)


def test_nulls_empties_ties_and_clashing_columns(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "a b", 9), (4, "a b", 9), (4, "a b", 9), (None, "x y z w", 9), (6, "word " * 50000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in op.near_duplicates(docs).collect())
    assert got == [(-1, -1), (1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (6, 6)]
    assert sorted(r.doc_id for r in op.keep_first(docs).collect()) == [1, 3, 6]
    assert op.keep_first(docs).columns == docs.columns
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_documents_are_kept_by_row_where_a_key_is_shared(spark):
    one, two, three = ("".join(f"{w}{i} " for i in range(60)) for w in ("north", "river", "stone"))
    rows = [(1, one, "a"), (5, two, "a"), (5, three, "a"), (5, one, "a"), (7, three, "a"), (8, two, "a"), (5, two, "a"), (None, one, "a"), (5, two, "b"), (5, two, None)]
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.text, r.lang) for r in op.keep_first(spark.createDataFrame(order, "doc_id long, text string, lang string")).collect()]
        assert len(got) == 3 and {(k, t) for k, t, _ in got} == {(1, one), (5, two), (5, three)}
        assert order is rows or sorted(got, key=str) == before
        before = sorted(got, key=str)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 140)}}
