"""Decontamination, substring dedup, suffix-array dedup and quality rules, against brute force on small texts."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from palimpsest.llm import op02_decontamination as op2
from palimpsest.llm import op03_suffix_array_dedup as op3
from palimpsest.llm import op05_substring_dedup as op5
from palimpsest.llm import op10_quality_rules as op10
from palimpsest.llm import registry

SF = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def corpus(seed, n=60, words=("a", "bb", "ccc", "the", "é", "x1")):
    """Texts that share long passages, with copies, empty and null ones."""
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(k))
    shared = [some(30) for _ in range(4)]
    texts = [rng.choice(["", "\t"]).join([some(rng.randrange(25)) + " ", rng.choice(shared) + "\n", some(rng.randrange(25))]) for _ in range(n)]
    texts += [texts[0], texts[1], None, "", "   ", "one", "z " * 400, "ab" * 500]
    return [(i, t, "x") for i, t in enumerate(texts)]


def brute_windows(rows, size=13):
    seen = defaultdict(list)
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    for i, w in split.items():
        for k in range(len(w) - size + 1):
            seen[tuple(w[k : k + size])].append(i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if min(seen[tuple(w[k : k + size])]) < i:
                gone |= set(range(k, k + size))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode()))
    return out


def brute_bytes(rows, size=200):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(b[k : k + size] for _, b in data for k in range(len(b) - size + 1))
    out = {}
    for i, b in data:
        flag = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                flag[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(flag)) if flag[k] and (k == 0 or not flag[k - 1]))
        out[i] = (len(b), sum(flag), spans, sha(bytes(x for x, f in zip(b, flag, strict=True) if not f)))
    return out


@pytest.mark.parametrize("block_bytes", [500, 1 << 20])
def test_substring_dedup(spark, block_bytes):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op5.digests(docs, block_bytes=block_bytes).collect()}
    assert got == brute_windows(rows)
    kept = op5.drop_repeats(docs)
    assert kept.columns == docs.columns
    texts = {i: t for i, t, _ in rows}
    for r in kept.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert sha(" ".join(words).encode()) == got[r.doc_id][2]
        if not got[r.doc_id][1]:
            assert r.text == texts[r.doc_id]
    assert op5.digests(docs.limit(0)).count() == 0


def test_substring_dedup_null_key_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text), (5, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in op5.digests(docs).collect()) == [(-1, 20), (3, 0), (3, 0), (5, 20)]


def test_sketch_fragments_round_trip():
    import numpy as np

    for n in (0, 1, 5, 3000):
        cells = np.unique(np.random.default_rng(n).integers(0, 1 << 22, n))
        assert (op5.decode(op5.encode(cells)) == cells).all()


@pytest.mark.parametrize("hot", [0, op3.HOT])
def test_suffix_array_dedup(spark, hot):
    rows = corpus(2, n=40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3.digests(docs, block_bytes=2000, hot=hot).collect()}
    assert got == brute_bytes(rows)
    assert op3.drop_repeats(docs).columns == docs.columns
    assert op3.digests(docs.limit(0)).count() == 0


def test_phrase_suffixes_and_parse_find_all_repeats():
    rng = random.Random(3)
    base = "".join(rng.choice("abc") for _ in range(290)).encode()
    phrases, parse, low, high = [], [], [], []
    for _ in range(30):
        text = bytearray(base)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = ord("z")
        hi = rng.randrange(20, 80)
        lo = rng.randrange(0, hi + 1)
        phrases.append(bytes(text[80 - hi : 80]))
        parse.append(bytes(text[80 : 80 + 200 - lo]))
        low.append(lo)
        high.append(hi)
    got = op3.repeats(phrases, parse, op3.np.array(low), op3.np.array(high))
    windows = {(i, a): (phrases[i][-a:] if a else b"") + parse[i][: 200 - a] for i in range(30) for a in range(low[i], high[i] + 1)}
    count = Counter((a, w) for (i, a), w in windows.items())
    assert {(int(i), int(a)) for i, a in zip(*got.nonzero(), strict=True)} == {k for k, w in windows.items() if count[(k[1], w)] > 1}


@pytest.mark.parametrize("block_bytes", [1, 8 << 20])
def test_decontamination(spark, block_bytes):
    item = "The Quick brown-fox jumps over the lazy dog again and again, é says the 2nd dog of nine."
    bench = [(1, item), (2, "short item"), (3, ""), (4, None), (None, "not named"), (5, item.upper())]
    docs = [(1, "x " * 50 + item + " y" * 50, 0), (2, "a SHORT, Item!", 0), (3, None, 0), (4, "", 0), (5, " ".join(item.split()[:11]), 0), (6, "w " * 500 + "short item", 0), (6, "w " * 500 + "short item", 0), (None, "short item " * 3000, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, items int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = {r.doc_id: r for r in op2.matches(d, b, block_bytes=block_bytes).collect()}
    assert found[1]["items"] == ["1"]  # only A to Z are folded, and every window of item 5 holds É
    assert (found[1].n_words, found[1].n_hit, found[1].longest) == (119, 19, 19)
    assert (found[2]["items"], found[2].n_hit) == (["2"], 2)
    assert (found[3].n_words, found[4].n_words, found[3].n_hit) == (0, 0, 0)
    assert found[5].n_hit == 0
    assert found[6].n_hit == 2
    clean = op2.decontaminate(d, b, block_bytes=block_bytes)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 6]
    assert op2.matches(d.limit(0), b).count() == 0
    assert op2.matches(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_quality_rules_on_odd_texts(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "word " * 300000, 1), (4, "a b c d e\na b c d e\n\n", 1), (5, "# " * 20, 1), (5, "# " * 20, 1)]
    got = [tuple(r) for r in op10.judge(spark.createDataFrame(rows, "doc_id long, text string, kept int")).select(*op10.COLUMNS).orderBy("doc_id").collect()]
    assert got[0] == (1, 0, 0, 0, 0, 0, True, False) and got[1][1:] == got[0][1:]
    assert got[2] == (3, 300000, 1200000, 0, 0, 300000, True, False)
    assert got[3] == (4, 10, 10, 0, 1, 10, True, False)
    assert got[4] == got[5]


def test_sql_of_the_corpus_queries(spark):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want.fetchall())), name


def brute_longest(words, items):
    """Longest run of words that a text shares with any item."""
    return max((k for it in items for i in range(len(words)) for j in range(len(it)) for k in [next((n for n in range(min(len(words) - i, len(it) - j)) if words[i + n] != it[j + n]), min(len(words) - i, len(it) - j))]), default=0)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_suffix_search_against_brute_force(spark, seed, block_bytes):
    rng = random.Random(seed)
    some = lambda k, n=6: [rng.choice("abcdefghij"[:n]) for _ in range(k)]
    items = [(i, some(rng.randrange(30), 3 + i % 4)) for i in range(8)] + [(None, some(20)), (7, some(14)), (9, ["z"] * 40)]
    texts = [some(rng.randrange(60), 8) + (items[rng.randrange(len(items))][1][rng.randrange(5) :] if rng.random() < 0.6 else []) + some(5) for _ in range(25)] + [[], ["z"] * 300, ["a"]]
    docs = spark.createDataFrame([(i, " ".join(t) if t else None) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    if block_bytes == 1:
        bench = bench.coalesce(1)
        items, bench = items[::4], spark.createDataFrame([(i, " ".join(t)) for i, t in items[::4]], "item_id long, text string")
    got = {r.doc_id: r for r in op2.matches(docs, bench, block_bytes=block_bytes).collect()}
    best = defaultdict(int)
    for d, t in enumerate(texts):
        hit, names = set(), set()
        for i, it in items:
            size = min(13, len(it))
            wins = {tuple(it[k : k + size]) for k in range(len(it) - size + 1)} if size else set()
            at = [k for k in range(len(t) - size + 1) if tuple(t[k : k + size]) in wins] if size else []
            hit |= {k + n for k in at for n in range(size)}
            names |= {str(i)} if at and i is not None else set()
            best[i] = max(best[i], brute_longest(t, [it]))
        r = got[d]
        assert (r.n_words, r.n_hit, r["items"]) == (len(t), len(hit), sorted(names))
        assert {k for s in r.spans for k in range(s.start, s.end)} == hit
        assert r.longest == brute_longest(t, [it for _, it in items])
        if m := r.longest_match if r.longest else None:
            run = t[m.start : m.start + m.words]
            assert any(str(i) == (m["item"] or "None") and it[m.item_start : m.item_start + m.words] == run for i, it in items)
    found = {r.item_id: r for r in op2.longest_matches(docs, bench, block_bytes=block_bytes).collect()}
    assert {k: r.words for k, r in found.items()} == {None if i is None else str(i): n for i, n in best.items() if n}
    for k, r in found.items():
        run = texts[r.doc][r.start : r.start + r.words]
        assert any((None if i is None else str(i)) == k and it[r.item_start : r.item_start + r.words] == run for i, it in items)


def test_items_without_an_id_and_long_words_count(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, "short item"), (2, b), (3, a), (4, "x " * 2000000)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "short item"), (1, a)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in op2.matches(docs, bench).collect()}
    assert got == {1: (2, 2, []), 2: (1, 0, []), 3: (1, 1, ["1"]), 4: (2000000, 0, [])}


@pytest.mark.parametrize("n", [16_000, 100_000])
def test_long_verbatim_items(n):
    import time

    rng = random.Random(n)
    item = " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    text = ("before " * 30 + item + " after" * 20).encode()
    bench = op2.Benchmark([(1, item), (2, "another short item")])
    began = time.time()
    found = bench.search([text, b"nothing here"])
    took = time.time() - began
    assert found.spans[0] == [(30, 30 + n)] and found.spans[1] is None
    assert found.longest[0].tolist() == [n, 30, 0, 0] and found.of_item[0].tolist() == [n, 0, 30, 0]
    assert took < n / 4000  # in proportion, on whatever machine


def test_stop_words_of_other_languages_are_not_asked_for(spark):
    polish = "książka leży tutaj gdzieś między półkami obok starych gazet " + " ".join(f"słowo{i} żółć{i}" for i in range(40))
    chinese = " ".join(chr(0x4E00 + i) * 2 for i in range(80))
    junk = " ".join(f"qx{i} vz{i}" for i in range(40))
    good = "the house of the old man is in the street and it was built for him " + " ".join(f"word{i} and more{i}" for i in range(30))
    got = {r.doc_id: r.kept for r in op10.judge(spark.createDataFrame(list(enumerate([polish, chinese, junk, good])), "doc_id long, text string")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}
