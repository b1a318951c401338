"""The n-gram join against all pairs by plain sets."""

import random
import re

import numpy as np
import pytest

from palimpsest.llm import op11_ngram_join as op

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=80):
    """{row place: (size, component)}, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            t = find(i)
            least[t] = min(least.get(t, k), k)
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + rng.randrange(2)] = [f"e{rng.randrange(999)}"] * rng.randrange(1, 3)
    return out


def test_whole_table_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert of(op.op11_ngram_join(spark, SF)) == brute(sorted(rows))


@pytest.mark.parametrize("percent", [80, 65, 95])
def test_edited_copies_shared_passages_and_short_texts(spark, percent):
    rng = random.Random(percent)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, rows = some(60), []
    for _ in range(12):
        base = some(rng.choice([3, 6, 8, 12, 25, 60, 150, 400]))
        rows += [" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 25 + 2))) for _ in range(rng.randrange(1, 7))]
    rows += [" ".join(passage + some(rng.randrange(4, 40))) for _ in range(40)]
    chain = some(120)
    for _ in range(10):  # the ends of the chain are not similar
        rows.append(" ".join(chain))
        chain = chain[4:] + some(4)
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    assert of(op.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)) == brute(rows, percent)


def test_every_similar_pair_meets_however_common_its_segments_seem():
    """Whatever the sketch says, an asked place of the larger set is one that the smaller indexes."""
    rng = np.random.default_rng(5)
    bands = op.Bands(80)
    for trial in range(60):
        n = int(rng.integers(5, 200))
        pool = rng.integers(0, 1 << 63, n + 60, dtype=np.uint64)
        cut = int(rng.integers(0, n // 9 + 1))
        one, two = pool[:n], np.concatenate([pool[cut:n], pool[n : n + int(rng.integers(0, n // 9 + 1))]])
        common, whole = len(np.intersect1d(one, two)), len(np.union1d(one, two))
        if 100 * common < 80 * whole:
            continue
        small, large = sorted([np.unique(one), np.unique(two)], key=len)
        sketch = rng.integers(0, 2, (op.DEPTH, op.CELLS)) * rng.integers(1, 10**6, (op.DEPTH, op.CELLS))
        which, key, role = op.entries(np.concatenate([small, large]), np.array([0, len(small), len(small) + len(large)]), bands, sketch)
        held = lambda s, bit: set(key[(which == s) & (role & bit > 0)].tolist())  # noqa: E731,B023
        if len(small) == len(large) and (small == large).all():
            continue
        assert held(0, op.INDEX) & (held(1, op.ASK) | held(1, op.ASK_LESS)) or held(0, op.INDEX_LESS) & held(1, op.ASK_MORE), trial


def test_nulls_empties_ties_and_repeated_rows(spark):
    long = "word " * 30000 + " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a B c"), (5, "A b  C"), (6, "a b c d"), (7, long), (9, long + " end"), (9, long + " end"), (None, long), (None, "nobody knows this text"), (None, "nobody knows THIS text"), (None, None), (4, "q r s t u v w x y z"), (8, "q r s t u v w x y z")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_shingles int, key int")
    got = of(op.near_classes(docs))
    assert got == brute(rows)
    assert (None, 1, None) in got and (9, 30002, 7) in got
    assert op.near_classes(docs.limit(0)).count() == 0


def test_four_and_five_shingles_link(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "q a b c d e f g h x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_classes(docs).collect()} == {1: (4, 1), 2: (5, 1), 3: (6, 3)}
