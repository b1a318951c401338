"""Places and folds over keys that hold most rows, and recall from lists that only hold what settles it."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import aggregates as A
from palimpsest.operators import evaluation as E
from palimpsest.operators import retrieval as V
from palimpsest.plans import retrieval_queries as RQ
from palimpsest.plans.fixtures import Views
from palimpsest.sources import scratch
from palimpsest.streaming import streams as Q

SF = "/root/testdata/sf0.001"


def test_places_of_a_key_with_most_rows(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(1).alias("k"), F.when(F.col("id") % 11 != 0, F.xxhash64("id") % 50).alias("x"), "id")
    order = [F.desc("x"), "id"]
    told = A.number(rows, ["k"], order, "place")
    assert told.columns == ["k", "x", "id", "place"]
    want = rows.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    assert told.exceptAll(want).count() == 0 and told.count() == 20000
    assert A.number(rows.where("id < 0"), ["k"], order, "place").count() == 0


def test_places_of_a_key_come_from_several_ranges(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(A, "keep", lambda df: dealt.append(scratch.keep(df)) or dealt[-1])
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")  # these rows are few, and would be put into one task
    try:
        got = sorted((r.id, r.place) for r in A.number(spark.range(5000).withColumn("k", F.lit(1)), ["k"], ["id"], "place").collect())
    finally:
        spark.conf.set(name, was)
    assert got == [(n, n + 1) for n in range(5000)]
    sizes = [r["count"] for r in dealt[0].groupBy("_range").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2500


def test_places_of_equal_rows(spark):
    rows = spark.createDataFrame([(1, "a")] * 50 + [(None, "a")] * 20, "k int, x string")
    got = sorted((r.k or 0, r.place) for r in A.number(rows, ["k"], ["x"], "place").collect())
    assert got == [(0, n) for n in range(1, 21)] + [(1, n) for n in range(1, 51)]


@pytest.mark.parametrize("head", [20, 60, 200])
def test_recall_from_short_lists(spark, monkeypatch, head):
    views = Views(spark, SF)
    ctx = RQ.context(views)
    asked = scratch.keep(RQ.rec_queries(views))
    columns = ["query_id", "item", "position", "fits", "place"]
    want = sorted(map(tuple, V.recall(asked, ctx, 5, own=False).select(*columns).collect()))
    monkeypatch.setattr(V, "HEAD", head)
    found, lists = V.explained(asked, ctx, 5, own=False, keep=scratch.keep)
    assert sorted(map(tuple, found.select(*columns).collect())) == want and want
    whole = V.all_lists(asked, ctx, own=False)
    both = [df.join(found.select("query_id", "item"), ["query_id", "item"]).select("query_id", "item", "pipeline", "rank") for df in (lists, whole)]
    assert both[0].exceptAll(both[1]).count() == both[1].exceptAll(both[0]).count() == 0
    # the first places are those of the whole lists
    near, all_ = [V.fuse(x).where(F.col("position") <= head).select("query_id", "item", "position", "fact", "sources", F.round("score", 9)) for x in (V.all_lists(asked, ctx, own=False, most=head), whole)]
    assert near.exceptAll(all_).count() == all_.exceptAll(near).count() == 0


def test_progress_of_events_without_time(spark):
    rows = [(1, 1, 0), (1, 2, 10), (1, 3, None), (1, 4, 30), (2, 5, None), (None, 6, 5)]
    events = spark.createDataFrame(rows, "user_id int, event_id int, s int").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    got = {r.user_id: (r.done, r.seconds, r.eta) for r in Q.progress(events, 20).collect()}
    mean = Q.EWMA_NEW * 20 + (1 - Q.EWMA_NEW) * 10
    assert got[1] == (4, pytest.approx(mean), pytest.approx(16 * mean)) and got[2] == (1, None, None) and got[None] == (1, None, None)


def test_whole_fused_lists_share_the_recency_order(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "EARLY", 24)
    latest = spark.range(100).select((F.col("id") % 2).alias("universe"), F.col("id").alias("entity_id"), F.rpad(F.lit("n"), F.pmod(F.col("id") * 37, F.lit(60)).cast("int") + 1, "x").alias("name"), (F.floor(F.col("id") / 2) + 1).alias("rank"))
    queries = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 7)], "query_id long, universe long")
    rows = [(q, "graph", r, f"e:{2 * ((r * 7 + q) % 50) + q % 2}", "Related entity: x" * 2) for q in (0, 1) for r in range(1, 6)]
    rows += [(q, "vector", r, f"p:{r * q}", "text " * (r + 40)) for q in (0, 1, 3) for r in range(1, 4)] + [(0, "preference", 60, "f:1", "Preference 1")]
    short = spark.createDataFrame(rows, "query_id long, pipeline string, rank long, item string, fact string")
    whole = V.fuse_whole(short, queries, latest)
    plain = V.fuse(short.unionByName(V.recency_lists(queries, latest)))
    told = lambda df: sorted((r.query_id, r.position, r.item, r.fact, r.sources, round(r.score, 9)) for r in df.collect())
    assert told(whole.items()) == told(plain) and plain.count() == 3 * 50 + 8
    for budget in (0, 3, 150, 700):
        flags, fits = V.flag_fit(plain, budget), V.fit_whole(whole, budget)
        row = lambda df: sorted((r.query_id, r.position, r.item, r.fits) for r in df.collect())
        assert row(fits.flags()) == row(flags)
        sums = flags.groupBy("query_id").agg(F.count_if("fits").alias("fitted"), F.count_if(~F.col("fits")).alias("dropped"), F.max("used").alias("used"))
        assert sorted(map(tuple, fits.totals().select(*sums.columns).collect())) == sorted(map(tuple, sums.collect()))


def test_relevant_items_are_counted_without_meeting_them(spark):
    items = spark.range(40).select(F.col("id").alias("item"), (F.col("id") % 2).alias("u"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("c"))
    queries = spark.range(0, 60, 5).select(F.col("id").alias("query_id"))
    hits = queries.crossJoin(spark.range(1, 9).select(F.col("id").alias("rank"))).select("query_id", (F.pmod(F.col("query_id") * 3 + F.col("rank") * 2, F.lit(40))).alias("item"), "rank")
    own = items.select(F.col("item").alias("query_id"), "u", "c").join(queries, "query_id")
    gold = own.join(items, ["u", "c"]).where("item <> query_id").select("query_id", "item")
    some, n = E.alike(hits, queries, items, ["u", "c"])
    assert some.count() < gold.count()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(E.recall_precision(hits, some, queries, 5, n)) == rows(E.recall_precision(hits, gold, queries, 5))
    assert rows(E.ndcg(hits, some, queries, 5, n)) == rows(E.ndcg(hits, gold, queries, 5)) and rows(E.mrr(hits, some, queries)) == rows(E.mrr(hits, gold, queries))


def test_edges_are_paired_by_more_tasks_as_lines_grow(spark, monkeypatch):
    from palimpsest.plans import fixtures

    monkeypatch.setattr(fixtures, "LINES", 500)
    assert Views(spark, SF)("edges").rdd.getNumPartitions() == spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500
