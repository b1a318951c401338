"""Keyword search by blocks of texts, against plain Python, and what it sends."""

import random

import numpy as np
import pytest

from palimpsest.operators import postings as B
from palimpsest.operators import retrieval as V
from palimpsest.plans import retrieval_queries as RQ
from palimpsest.plans.fixtures import Views

WORDS = "zab zeb zib zob zub".split()


def plain(query, texts, k):
    """(id, score) of the best k of ``texts``; ``query`` has clauses of parts (banned, words)."""
    told = []
    for i, words in texts.items():
        weight, held = 0.0, True
        for parts in query:
            some = [p for _, p in parts if any(words[a : a + len(p)] == p for a in range(len(words)))]
            if parts[0][0]:
                held &= not some
            else:
                held &= bool(some)
                weight += sum(1 / n**2 for p in some for w in p for n in range(1, words.count(w) + 1))
        if held:
            told.append((i, weight / (np.pi**2 / 6 * sum(len(p) for parts in query for out, p in parts if not out))))
    return sorted(told, key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_blocks_of_texts_find_what_all_texts_hold(spark, monkeypatch, block):
    monkeypatch.setattr(B, "TEXT", block)
    monkeypatch.setattr(B, "ASKED", 2 if block == 300 else 1 << 16)
    rng = random.Random(11)
    texts = {i: [rng.choice([*WORDS, "dog"]) for _ in range(rng.randrange(1, 9))] for i in range(120)}
    must, out = (lambda *p: [(False, list(x)) for x in p]), (lambda *p: [(True, list(x)) for x in p])
    asked = {
        0: ("zab zeb", [must(["zab"]), must(["zeb"])]), 1: ("zab OR zib", [must(["zab"], ["zib"])]), 2: ('"zab zeb"', [must(["zab", "zeb"])]), 3: ("zab -zeb", [must(["zab"]), out(["zeb"])]),
        4: ('zub -"zob zab"', [must(["zub"]), out(["zob", "zab"])]), 5: ("-zab", None), 6: ("nowhere", None), 7: ('"zab zab" zob', [must(["zab", "zab"]), must(["zob"])]),
    }
    paras = spark.createDataFrame([(i, i % 2, " ".join(w)) for i, w in texts.items()] + [(999, 0, None), (998, None, "zab zeb")], "para_id long, universe long, text string")
    queries = spark.createDataFrame([(q, q % 2, t) for q, (t, _) in asked.items()], "query_id long, universe long, text string")
    for own in (True, False):
        got = {}
        for r in sorted(V.keyword_search(queries, paras, 4, own=own).collect(), key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append((r.para_id, pytest.approx(r.score, abs=1e-9)))
        want = {q: plain(query, {i: w for i, w in texts.items() if i % 2 == q % 2 and (own or i != q)}, 4) for q, (_, query) in asked.items() if query}
        assert want == got and len(want) == 6


def test_common_words_send_only_the_best_of_each_block(spark, monkeypatch):
    monkeypatch.setattr(B, "TEXT", 2000)
    paras = spark.range(400).selectExpr("id AS para_id", "0L AS universe", "'zab zeb zab' AS text")
    queries = spark.range(5).selectExpr("id AS query_id", "0L AS universe", "'zab zeb' AS text")
    sent = []
    search = V.search
    monkeypatch.setattr(V, "search", lambda *a: sent.append(search(*a)) or sent[-1])
    got = V.keyword_search(queries, paras, 3)
    blocks = -(-400 * 11 // 2000)
    assert blocks > 1 and sent[0].count() <= 5 * blocks * 3  # before, each query met all 400 texts
    assert sorted((r.query_id, r.rank, r.para_id) for r in got.collect()) == [(q, n, n - 1) for q in range(5) for n in (1, 2, 3)]


def test_scores_that_may_tie_once_they_are_rounded():
    rng = random.Random(2)
    for _ in range(300):
        score = np.array([rng.choice([1.0, 1.0 + 1e-16, 1.0 + 3e-16, 1.0 - 4e-10, 0.5, 2.0]) for _ in range(rng.randrange(1, 40))])
        k = rng.randrange(1, 6)
        some = B.best(score, k).tolist()
        want = sorted(range(len(score)), key=lambda i: (-round(score[i], 9), i))[:k]
        assert set(want) <= set(some) and len(some) <= 6 * k or len(score) <= k


def test_texts_that_no_vector_can_have_are_left_out_before_they_meet(spark):
    views = Views(spark, "/root/testdata/sf0.001")
    low, high = views("embeddings").selectExpr("min(vec_id)", "max(vec_id)").first()
    paras = views("rec_paras")
    plan = paras._jdf.queryExecution().optimizedPlan().toString()
    assert f">= {low})" in plan and f"<= {high})" in plan
    want = views("embeddings").join(views("documents"), views("embeddings").vec_id == views("documents").doc_id)
    assert paras.columns == ["para_id", "universe", "chapter_id", "text", "embedding"]
    assert sorted((r.para_id, r.universe, r.text) for r in paras.collect()) == sorted((r.vec_id, r.vec_id % 5, r.text) for r in want.collect())


def test_lists_carry_costs_and_only_what_is_returned_meets_its_text(spark):
    views = Views(spark, "/root/testdata/sf0.001")
    texts = {f"p:{r.para_id}": r.text for r in views("rec_paras").select("para_id", "text").collect()}
    cost = lambda x: len(x.encode()) // 4 + 1
    lists = RQ.lists(views, 3)
    said = lists.collect()
    found = [r for r in said if r.item in texts]
    assert found and all(r.fact is None and r.tokens == cost(texts[r.item]) for r in found)
    assert all(r.tokens == cost(r.fact) for r in said if r.item not in texts)
    told = V.with_texts(V.fuse(lists), views("rec_paras")).collect()
    assert len(told) == len({(r.query_id, r.item) for r in said}) and all(r.fact == texts[r.item] for r in told if r.item.startswith("p:")) and all(r.fact for r in told)


def test_lines_of_orders_that_hold_no_seed_are_left_out_before_they_meet(spark):
    views = Views(spark, "/root/testdata/sf0.001")
    lines = views("lineitem")
    low, high = lines.where("l_partkey = 1").selectExpr("min(l_orderkey)", "max(l_orderkey)").first()
    plan = views.edges_at(spark.createDataFrame([(1,)], "end long"))._jdf.queryExecution().optimizedPlan().toString()
    assert f">= {low})" in plan and f"<= {high})" in plan
    assert views.edges_at(spark.createDataFrame([(10**9,)], "end long")).count() == 0
