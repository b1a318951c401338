"""Automata, composable folds, greedy jumps, block products, codes, order statistics and stream state against plain loops."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import aggregates as A
from palimpsest.operators import automaton, folds
from palimpsest.operators import consistency as C
from palimpsest.operators import feedback as P
from palimpsest.operators import graph as G
from palimpsest.operators import nearest as N
from palimpsest.operators import resolve as R
from palimpsest.operators import retrieval as V
from palimpsest.operators import structure as S
from palimpsest.plans.fixtures import Views
from palimpsest.streaming import streams as Q


def brute_names(text, names):
    """Leftmost longest names by trying every place; names are (text, id) in lower case."""
    is_word = lambda c: unicodedata.category(c)[0] in "LN" or c == "_"
    cut, i = [], 0
    while i < len(text):
        j = i + 1
        while is_word(text[i]) and j < len(text) and is_word(text[j]):
            j += 1
        cut.append((i, j))
        i = j
    starts, ends = {a for a, _ in cut}, {b for _, b in cut}
    out, free = [], -1
    for a, _ in cut:
        if a <= free:
            continue
        best = None
        for name, entity in names:
            b = a + len(name)
            if name and text[a:b] == name and a in starts and b in ends and not (a and is_word(text[a - 1])) and not (b < len(text) and is_word(text[b])):
                if best is None or (b, -entity) > (best[1], -best[2]):
                    best = (a, b, entity)
        if best:
            out.append(best)
            free = best[1]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab -é", max_size=40), max_size=6), st.lists(st.text("ab -é", min_size=1, max_size=9), min_size=1, max_size=8), st.integers(1, 7))
def test_automaton_finds_the_leftmost_longest_names(texts, names, segment):
    known = {n.strip(): i for i, n in reversed(list(enumerate(names))) if n.strip()}
    if not known:
        return
    kept, automaton.SEGMENT = automaton.SEGMENT, segment
    try:
        row, start, end, entity, first, last = automaton.Automaton(list(known), list(known.values())).found(texts)
    finally:
        automaton.SEGMENT = kept
    stay = automaton.leftmost_longest(row, first, last)
    got = sorted(zip(*(x[stay].tolist() for x in (row, start, end, entity)), strict=True))
    assert got == sorted((i, *m) for i, t in enumerate(texts) for m in brute_names(t, list(known.items())))


def test_long_runs_and_names():
    name = "a b " * 300 + "a"
    text = "a b " * 2000
    a = automaton.Automaton([name, "b a"], [1, 2])
    row, start, end, entity, first, last = a.found([text, "x", name])
    stay = automaton.leftmost_longest(row, first, last)
    assert [(r, e, b - s) for r, s, b, e in zip(row[stay], start[stay], end[stay], entity[stay], strict=True)][:2] == [(0, 1, len(name)), (0, 2, 3)]
    assert (2, 0, len(name), 1) in list(zip(row[stay], start[stay], end[stay], entity[stay], strict=True))


@pytest.mark.parametrize("pass_bytes", [1, 1 << 30])
def test_lexicon_in_shards_and_passes(spark, pass_bytes):
    rng = random.Random(1)
    words = [f"{rng.choice('abcdef')}{rng.choice('xyz')}" for _ in range(30)]
    names = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))).title()) for i in range(60)] + [(99, None)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(30)] + [(50, None), (51, "")]
    df = S.match_gazetteer(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(names, "entity_id long, name string"), "k", shard_bytes=100, pass_bytes=pass_bytes)
    least = {}
    for i, n in names:
        if n:
            least[n.lower()] = min(i, least.get(n.lower(), i))
    want = sorted((k, e, a, b) for k, t in texts if t for a, b, e in brute_names(t, list(least.items())))
    assert sorted((r.k, r.entity_id, r.start, r.end) for r in df.collect()) == want
    none = spark.createDataFrame([], "entity_id long, name string")
    assert S.match_gazetteer(spark.createDataFrame(texts, "k int, text string"), none, "k").count() == 0


def test_the_matcher_shuffles_no_text(spark):
    df = S.match_gazetteer(spark.range(5).selectExpr("id AS k", "'an Apple' AS text"), spark.createDataFrame([(1, "apple")], "entity_id long, name string"), "k")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 2), st.floats(-1, 1), st.floats(-1, 0), st.floats(0, 1)), min_size=1, max_size=40), st.data())
def test_runs_of_steps(steps, data):
    cuts = sorted({0, *data.draw(st.lists(st.integers(0, len(steps) - 1), max_size=5))})
    whole = folds.runs_composed(np.array(steps).T, np.array(cuts))
    for run, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(steps)], strict=True)):
        for x in (-5.0, 0.3, 7.0):
            want = x
            for s in steps[a:b]:
                want = min(s[3], max(s[2], s[0] * want + s[1]))
            f = whole[:, run]
            assert abs(min(f[3], max(f[2], f[0] * x + f[1])) - want) < 1e-9


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=70), st.integers(0, 60))
def test_greedy_jumps(costs, budget):
    left, want = budget, []
    for i, c in enumerate(costs):
        if c <= left:
            want.append(i)
            left -= c
    assert folds.kept_places(np.array(costs, float), 0, len(costs), budget) == want


def test_jumps_grow_with_what_is_kept(monkeypatch):
    steps = 0
    real = folds.Minima.next

    def counted(self, *a):
        nonlocal steps
        steps += 1
        return real(self, *a)

    monkeypatch.setattr(folds.Minima, "next", counted)
    costs = np.full(100_000, 50.0)
    costs[[10, 70_000]] = 1
    assert folds.kept_places(costs, 0, len(costs), 3) == [10, 70_000] and steps == 3


def test_fit_over_batches_with_nulls(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(2)
        rows = [(k, i, rng.choice([None, 1, 3, 9, 40])) for k in (None, 1, 2) for i in range(50)]
        got = {(r.k, r.i): (r.fits, r.used) for r in folds.fit(spark.createDataFrame(rows, "k int, i int, c int"), ["k"], ["i"], "c", 30).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (None, 1, 2):
        used = 0
        for kk, i, c in rows:
            if kk == k:
                fits = c is not None and used + c <= 30
                used += c if fits else 0
                assert got[k, i] == (fits, used)


def test_feedback_brings_back_and_archives(spark):
    """Rows as the rules say: both accepts set relevance 1 and make active, a reject fades both, the threshold archives."""
    prefs = spark.createDataFrame([(1, 0.5, 0.1, "archived"), (2, 0.5, 0.4, "active"), (3, 0.5, 0.16, "active"), (4, 0.95, 0.9, "archived"), (5, 0.5, 0.9, "archived"), (6, None, None, "active")], "pref_id long, confidence double, relevance double, lifecycle string")
    events = [(1, 1, "accept"), (2, 1, "behavioural_accept"), (3, 1, "reject"), (4, 1, "accept"), (4, 2, "reject"), (5, 1, "reject"), (3, 2, "accept"), (3, 3, "reject"), (9, 1, "accept")]
    got = {r.pref_id: (round(r.confidence, 6) if r.confidence is not None else None, round(r.relevance, 6) if r.relevance is not None else None, r.lifecycle) for r in P.reinforce_preferences(prefs, spark.createDataFrame(events, "pref_id long, event_id long, signal string")).collect()}
    fade = 0.904837418
    assert got[1] == (0.6, 1.0, "active") and got[2] == (0.55, 1.0, "active")
    assert got[3] == (round((0.5 * fade + 0.1) * fade, 6), round(fade, 6), "active")
    assert got[4] == (round(fade, 6), round(fade, 6), "active") and got[5] == (round(0.5 * fade, 6), round(0.9 * fade, 6), "archived")
    assert got[6] == (None, None, "active")
    only = P.reinforce_preferences(prefs.where("pref_id = 3"), spark.createDataFrame([(3, 1, "reject")], "pref_id long, event_id long, signal string")).first()
    assert only.lifecycle == "archived"


def test_one_key_is_folded_by_many_tasks(spark):
    rows = spark.range(4000).selectExpr("0 AS k", "id AS n", "struct(0.999D AS a, 0.01D AS b, 0D AS low, 5D AS high) AS s")
    df = folds.composed(rows, ["k"], ["n"], ["s"]).select(folds.applied(F.col("s"), F.lit(3.0)).alias("x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(" in plan
    x = 3.0
    for _ in range(4000):
        x = min(5.0, max(0.0, 0.999 * x + 0.01))
    assert abs(df.first().x - x) < 1e-9


def test_order_statistics_of_skewed_keys(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1) * 10 ** rng.randrange(6)) for _ in range(3000)] + [("b", float(rng.randrange(3))) for _ in range(500)] + [("c", 7.0), ("d", None), (None, 1.0), ("e", 1e308), ("e", -1e308), ("e", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    want = {k: sorted(v)[min(len(v) * 95 // 100, len(v) - 1)] for k, v in held.items() if k is not None}
    for few, pieces in ((4, 3), (1, 16), (4096, 256)):
        got = {r.k: r.value for r in A.order_statistic(df, "k", "v", F.least(F.floor(F.col("n") * 95 / 100), F.col("n") - 1), pieces, few).collect()}
        assert {k: v for k, v in got.items() if k is not None} == want


def test_block_products_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))] + [(90, 0, [0.0] * 5), (91, 0, None), (92, 0, [1.0, 2.0]), (93, 0, [float("nan")] * 5), (94, 1, [1.0, None, 2.0, 3.0, 4.0])]
    rows += [(100 + i, 0, rows[0][2]) for i in range(4)]  # ties
    items = spark.createDataFrame(rows, "para_id long, universe int, embedding array<double>")
    queries = items.where("para_id < 20").withColumnRenamed("para_id", "query_id")
    ok = [r for r in rows if r[2] is not None and len(r[2]) == 5 and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    cos = lambda a, b: 1 - float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for own in (True, False):
        got = N.nearest(queries, items, 3, "para_id", own, query_block=3, item_block=7)
        got = got.withColumn("rank", A.nth(["query_id"], F.round("distance", 9), "para_id")).where("rank <= 3")
        have = sorted((r.query_id, r["rank"], r.para_id) for r in got.collect())
        want = []
        for q, u, v in ok:
            if q < 20:
                best = sorted((round(cos(v, w), 9), p) for p, t, w in ok if t == u and (own or p != q))[:3]
                want += [(q, n, p) for n, (_, p) in enumerate(best, 1)]
        assert have == sorted(want)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_codes_keep_recall_and_read_few_vectors(spark, sf):
    v = Views(spark, f"/root/testdata/sf{sf}")
    asked, items = v("query_vecs"), v("para_vecs")
    few = V.ann_shortlist(asked, items, own=False).cache()
    assert few.groupBy("query_id").count().agg(F.max("count")).first()[0] < 0.1 * items.count()
    exact = V.vector_topk(asked, items, 10, own=False).select("query_id", "para_id")
    assert exact.join(few, ["query_id", "para_id"]).count() >= 0.9 * exact.count()


def test_pairs_of_a_large_chunk_spread(spark):
    rows = [(1, i) for i in range(40)] + [(2, i) for i in (3, 5)] + [(3, 1)]
    for block in (3, 7, 512):
        got = sorted(tuple(r) for r in G.chunk_pairs(spark.createDataFrame(rows, "chunk long, entity_id long"), "chunk", block).select("chunk", "src", "dst").collect())
        assert got == sorted((c, a, b) for c, a in rows for d, b in rows if c == d and a < b)


def test_paragraphs_part_at_blank_lines(spark):
    text = "one\ntwo\n\n three 　\n\n \t\n\n\n four\x85"
    got = [(r.paragraph_index, r.offset, r.text) for r in S.paragraphs(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).orderBy("paragraph_index").collect()]
    assert got == [(0, 0, "one\ntwo"), (1, 11, "three"), (3, text.encode().index(b"four"), "four")]


def test_review_order_and_merge_status(spark):
    ents = spark.createDataFrame([(1, 0, "a", "candidate", 0.9, 1), (2, 0, "b", "candidate", 0.2, 5), (3, 0, "c", "candidate", 0.2, 4), (4, 0, "d", "active", 0.1, 1)], "entity_id long, universe int, name string, status string, confidence double, updated_at int")
    none = spark.createDataFrame([], "mention_id long, entity_id long, snippet string, chapter_no long, created_at timestamp")
    assert [r.entity_id for r in R.review_candidates(ents, none).orderBy("place").collect()] == [3, 2, 1]
    old = [(i, [], "é", {}, 0.1, s) for i, s in enumerate(["active", "dismissed", "merged", "candidate", "candidate"])]
    new = [(i, [], "abc", {}, c, s) for i, (c, s) in enumerate([(0.1, "deceased"), (0.9, "active"), (0.9, "active"), (0.9, ""), (0.1, "deceased")])]
    kind = "entity_id int, aliases array<string>, description string, props map<string,string>, confidence double, status string"
    got = {r.entity_id: (r.status, r.description) for r in R.merge_fields(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).collect()}
    assert got == {0: ("deceased", "abc"), 1: ("dismissed", "abc"), 2: ("merged", "abc"), 3: ("active", "abc"), 4: ("deceased", "abc")}


def test_names_before_aliases(spark):
    ents = spark.createDataFrame([(1, "Ann", ["Bo"], 0.2, "active"), (2, "Bo", [], 0.1, "active"), (3, "Cy", ["bo", "Dee"], 0.9, "active"), (4, "Eve", ["dee"], 0.95, "archived")], "entity_id long, name string, aliases array<string>, relevance double, status string")
    got = {r.name: r.seed for r in G.entities_by_name(spark.createDataFrame([("BO",), ("dee",), ("eve",)], "name string"), ents).collect()}
    assert got == {"BO": 2, "dee": 3}


def test_contradictions_of_two_chapters_are_two(spark):
    rows = [(1, "A", "deceased", "he ran", 1), (1, "A", "deceased", "he ran", 2), (1, "A", "deceased", None, 2), (2, "B", "active", "x", 1)]
    got = C.check_deceased(spark.createDataFrame(rows, "entity_id long, name string, previous_status string, mention_text string, chapter_no long")).collect()
    assert len({r.fingerprint for r in got}) == 3 and all(r.fingerprint for r in got)


def stream_of(spark, folder, rows, n):
    spark.createDataFrame(rows, "entity_id long, ts timestamp, text string, chapter long").coalesce(1).write.parquet(f"{folder}/{n}", mode="overwrite")
    return spark.readStream.schema("entity_id long, ts timestamp, text string, chapter long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_alerts_expire_and_a_restart_repeats_nothing(spark, tmp_path):
    from datetime import datetime

    known = spark.createDataFrame([(1, "A", "deceased")], "entity_id long, name string, status string")
    stored = spark.createDataFrame([], "fingerprint string")
    day = lambda d: datetime(2024, 1, d, 12)
    told = []
    days = [[(1, day(1), "he ran", 1), (1, day(1), "he ran", 2), (9, day(1), "new", 1)], [(1, day(2), "he ran", 1), (9, day(2), "new", 2)], [(1, day(20), "other", 3)], [(1, day(21), "he ran", 1)]]
    for n, rows in enumerate(days):
        stream = stream_of(spark, tmp_path / "in", rows, n)
        told.append(Q.drain(Q.alerts(stream, known, stored, remembered="5 days"), folder=str(tmp_path / "out")).count())
    assert told == [3, 3, 4, 5]  # told once, then nothing, another text, and after its time the first again


def test_a_batch_that_is_run_again_doubles_nothing(spark, tmp_path):
    write = Q.batch_writer(str(tmp_path))
    for n in (0, 1, 1, 0):
        write(spark.range(5), n)
    assert spark.read.parquet(str(tmp_path)).count() == 10


def test_a_batch_lost_between_write_and_commit(spark, tmp_path):
    """The query stops once its batch is written; the next start writes the same batch again."""
    spark.range(6).selectExpr("id AS entity_id", "timestamp'2024-01-01' AS ts", "'t' AS text", "1L AS chapter").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity_id long, ts timestamp, text string, chapter long").parquet(str(tmp_path / "in"))
    write = Q.batch_writer(str(tmp_path / "out"))

    def stop(df, n):
        write(df, n)
        raise RuntimeError("lost")

    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(stop).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_texts_cut_at_bytes(spark):
    from palimpsest.functions import text as X

    rows = [("é" * 20,), ("abc",), ("a" * 11,), ("a" * 12,), ("日本語テキスト",)]
    for r in spark.createDataFrame(rows, "t string").select("t", X.truncate(F.col("t"), 11).alias("c")).collect():
        head = r.t.encode()[:10].decode(errors="ignore")
        assert r.c == (r.t if len(r.t.encode()) <= 11 else head + "…")
