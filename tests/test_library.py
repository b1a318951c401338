"""Manuscript files, streams over several batches, and what must hold between operators."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import consistency as C
from palimpsest.operators import feedback as P
from palimpsest.operators import lifecycle as L
from palimpsest.operators import resolve as R
from palimpsest.operators import retrieval as V
from palimpsest.plans import resolve_queries as SQ
from palimpsest.plans import retrieval_queries as RQ
from palimpsest.plans import text_queries as TQ
from palimpsest.plans.fixtures import Views
from palimpsest.sources.tables import infer_title, read_manuscripts
from palimpsest.streaming import streams as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in four files, in order of time."""
    path = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    n = events.count()
    for k in range(4):
        events.where((F.col("event_id") * 4 / n).cast("int") == k).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return Q.event_stream(spark, folder, spark.read.parquet(folder).schema)


def test_manuscript_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿# Title\n\ntext".encode())
    (tmp_path / "b.TXT").write_text("plain")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.txt").write_text(" \n ")
    got = {r.path[-5:]: r for r in read_manuscripts(spark, str(tmp_path)).collect()}
    assert (got["/a.md"].text, got["/a.md"].error) == ("# Title\n\ntext", None)
    assert (got["b.TXT"].ext, got["b.TXT"].text) == ("txt", "plain")
    assert (got["c.pdf"].text, got["c.pdf"].error) == (None, "unsupported format")
    assert got["d.txt"].error == "empty document"


def test_titles(spark):
    rows = [
        (1, "---\nTitle: 'My Book'\n---\n# Other", "md", "My Book"), (2, "# Chapter 1\n\n# Real Title\n", "md", ""), (3, "A First Line\n\ntext", "txt", "A First Line"), (4, "two\nlines", "txt", ""), (5, "", "md", ""),
        (6, "# " + "long " * 40, "md", ""), (7, "# The Way Home\n\n## Holden\n\n## Miller", "md", "The Way Home"), (8, "Chapter One\n\nText", "txt", ""), (9, "The Book\n\nHolden\n\ntext of it\n\nMiller\n\nmore", "txt", ""), (10, "---\r\nauthor: x\r\n---\r\n# Home", "md", "Home"),
    ]
    got = [r.title for r in infer_title(spark.createDataFrame(rows, "id int, text string, ext string, want string"), ext="ext").orderBy("id").collect()]
    assert got == [r[3] for r in rows]


def test_short_title_whose_cut_ends_with_a_line_feed(spark):
    text = "word " * 15 + "last\n" + "more words after the cut"
    assert spark.createDataFrame([(text,)], "text string").select(X.short_title(F.col("text"))).first()[0] == ("word " * 15 + "last")


def test_style_of_one_sentence(spark):
    text = 'She quickly ran. “Go now,” he said! It rained?'
    row = spark.range(1).select(*[c.alias(n) for n, c in X.stylometry(F.lit(text)).items()]).first()
    assert (row.n_words, row.n_sentences, row.n_adverbs, row.n_quoted, row.n_distinct) == (9, 3, 1, 2, 9)


def test_streams_over_batches_equal_one_batch(spark, folder):
    events = spark.read.parquet(folder)
    seq = Q.drain(Q.per_work(stream(spark, folder).select("user_id", "event_id", "ts")))
    assert sorted(map(tuple, seq.collect())) == sorted((r.user_id, r.event_id, r.n) for r in events.selectExpr("user_id", "event_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n").collect())
    keys = Q.drain(Q.dedup_submissions(stream(spark, folder), "60 days").select("key", "ts")).select("key").collect()
    assert len(keys) == len(set(keys)) == events.select("event_type", "props").distinct().count()
    pairs = Q.drain(Q.behavioural_accepts(stream(spark, folder).where("event_type = 'view'"), stream(spark, folder).where("event_type = 'click'"), within="6 hours")).collect()
    a, b = events.where("event_type = 'view'").alias("a"), events.where("event_type = 'click'").alias("b")
    want = a.join(b, F.expr("a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOURS")).selectExpr("a.event_id AS x", "b.event_id AS y").collect()
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, want))


def test_rejected_and_valid_submissions_are_all(spark):
    rows = [(1, 5, "click", "{}"), (2, None, "click", "{}"), (3, 5, " ", "{}"), (4, 5, "click", None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    assert [r.event_id for r in Q.valid_submissions(df).collect()] == [1]
    assert [r.reason for r in Q.rejected_submissions(df).orderBy("event_id").collect()] == ["no user", "no kind", "no text"]


def test_ledger_adds_up_to_the_score(views):
    lists = RQ.lists(views)
    sums = V.ledger(lists).groupBy("query_id", "item").agg(F.sum("delta").alias("total"))
    off = V.fuse(lists).join(sums, ["query_id", "item"]).where(F.abs(F.col("total") - F.col("score")) > 1e-9)
    assert off.count() == 0


def test_recall_comes_from_the_lists(views):
    got = V.recall(RQ.rec_queries(views), RQ.context(views), 5, own=False)
    assert got.join(RQ.lists(views), ["query_id", "item"], "left_anti").count() == 0
    assert got.groupBy("query_id").agg(F.max("place").alias("n")).where("n > 5").count() == 0


def test_consolidation_leaves_no_duplicates_and_no_dangling_ids(views):
    parts = views("ent_parts")
    losers = R.winner_map(parts)
    left = parts.join(losers, "entity_id", "left_anti")
    assert R.duplicate_keys(left).count() == 0
    moved = R.repoint(views("lineitem"), losers, "l_partkey")
    assert moved.count() == views("lineitem").count()
    assert moved.join(left.withColumnRenamed("entity_id", "l_partkey"), "l_partkey", "left_anti").count() == 0


def test_decay_never_raises_and_mentions_never_lower(views):
    users = views("ent_users")
    down = L.decay(users, views("mentions").limit(0)).select("entity_id", F.col("relevance").alias("r"))
    assert users.join(down, "entity_id").where("r > relevance").count() == 0
    up = L.reinforce(users, views("mentions")).select("entity_id", F.col("relevance").alias("r"))
    assert users.join(up, "entity_id").where("r < relevance - 1e-9").count() == 0


def test_approximate_search_recall(views):
    exact = V.vector_topk(views("query_vecs"), views("para_vecs"), 10).select("query_id", "para_id")
    near = V.ann_topk(views("query_vecs"), views("para_vecs"), 10).select("query_id", "para_id")
    assert exact.join(near, ["query_id", "para_id"]).count() >= 0.9 * exact.count()


def test_every_twentieth_id_is_a_query(views):
    """Not a fixed set: searches take all rows with id % 20 = 0, against all rows."""
    every = {r.vec_id for r in views("embeddings").where("vec_id % 20 = 0").collect()}
    told = {r.doc_id for r in views("documents").select("doc_id").collect()}
    assert {r.query_id for r in views("query_vecs").collect()} == every
    assert {r.query_id for r in RQ.rec_queries(views).where("text <> ''").collect()} == every & told
    assert {r.entity_id % 2 for r in RQ.v2(views).collect()} == {0, 1}


def test_whole_tables_and_every_twentieth_part(views):
    """Operators over whole tables leave no id out, and graph seeds grow with the parts."""
    edges = views("edges")
    assert RQ.g9(views).count() == edges.count()
    assert SQ.r15(views).where("reason = 'unknown'").collect() == [("nobody", None, "unknown")]
    assert SQ.p7(views).select(F.sum(F.size(F.filter(F.split("events", " "), lambda e: e != "")))).first()[0] == views("feedback").join(views("prefs"), "pref_id").count()
    held = views("paragraphs").select("chapter_id").distinct()
    assert TQ.t6(views).count() == views("asked").join(held, "chapter_id").count() > held.count()
    linked = {x for r in edges.select("src", "dst").collect() for x in r if x % 20 == 0}
    assert {r.seed for r in RQ.g2(views).collect()} == {r.seed for r in RQ.g3(views).collect()} == {r.focal for r in RQ.g5(views).collect()} == linked
    assert {r.query_id for r in RQ.g4(views).collect()} == {x // 100 for x in linked}


def test_folds_keep_no_array_of_a_key(spark):
    """One key with very many rows: the state alone goes from batch to batch, and results are those of a plain loop."""
    n = 60_000
    items = spark.range(n).selectExpr("id % 2 AS k", "id AS place", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 11 END AS cost")
    got = C.fit_flags(items, ["k"], ["place"], "cost", 5000)
    used, fits = [0, 0], 0
    for i in range(n):
        if i % 7 and used[i % 2] + i % 11 <= 5000:
            used[i % 2], fits = used[i % 2] + i % 11, fits + 1
    assert {r.k: r.used for r in got.groupBy("k").agg(F.max("used").alias("used")).collect()} == dict(enumerate(used))
    assert got.where("fits").count() == fits
    events = spark.range(n).selectExpr("1L AS pref_id", "id AS event_id", "element_at(array('accept', 'reject', 'reject', 'other'), CAST(id % 4 AS INT) + 1) AS signal")
    prefs = spark.createDataFrame([(1, 0.2, 0.3, "active"), (2, 0.4, 0.1, "active")], "pref_id long, confidence double, relevance double, lifecycle string")
    told = P.reinforce_preferences(prefs, events)
    c, r = 0.2, 0.3
    for i in range(n):
        c, r = (min(1.0, c + 0.1), 1.0) if i % 4 == 0 else (c * math.exp(-0.1), r * math.exp(-0.1)) if i % 4 < 3 else (c, r)
    assert {x.pref_id: (round(x.confidence, 9), round(x.relevance, 9), x.lifecycle) for x in told.collect()} == {1: (round(c, 9), round(r, 9), "active"), 2: (0.4, 0.1, "archived")}
    fused = items.selectExpr("k AS query_id", "CAST(place AS STRING) AS item", "place AS position", "'a' AS fact")
    for df in (told, got, V.flag_fit(fused, 2000)):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
