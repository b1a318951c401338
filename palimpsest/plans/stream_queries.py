"""Streaming jobs over the events table, drained to a table, with the SQL of their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.consistency import deceased_fingerprint
from ..streaming import streams as Q
from .fixtures import Views, query


def events(v: Views):
    path = f"{v.sf_dir.rstrip('/')}/events.parquet"
    # a pattern, since a stream takes a single file only by one
    return Q.event_stream(v.spark, path[:-1] + "[t]", v.spark.read.parquet(path).schema)


@query("q1_valid_submissions", "", "SELECT event_id, user_id FROM events WHERE event_id % 10 <> 0 AND event_type <> 'error'")
def q1(v: Views):
    given = events(v).withColumn("props", F.when(F.col("event_id") % 10 != 0, F.col("props"))).withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" "))
    return Q.drain(Q.valid_submissions(given)).select("event_id", "user_id")


@query("q2_dedup_submissions", "", "SELECT DISTINCT sha256(event_type || '|' || props) AS key FROM events")
def q2(v: Views):
    return Q.drain(Q.dedup_submissions(events(v), "60 days").select("key", "ts")).select("key")


@query("q3_per_work", "", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def q3(v: Views):
    return Q.drain(Q.per_work(events(v).select("user_id", "event_id", "ts")))


@query("q4_relevance_stream", "", """
WITH RECURSIVE e AS (SELECT user_id AS entity_id, event_type <> 'purchase' AS tick, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('view', 'purchase')),
g AS (SELECT DISTINCT entity_id, 0::BIGINT AS n, 0.5::DOUBLE AS r, 'active' AS s, 0::BIGINT AS m FROM e UNION ALL
SELECT g.entity_id, e.n, CASE WHEN NOT tick THEN CASE WHEN s = 'archived' THEN 0.8::DOUBLE ELSE least(1, r + 0.15::DOUBLE) END WHEN s = 'active' THEN r * exp(-0.1::DOUBLE) ELSE r END,
CASE WHEN NOT tick THEN 'active' WHEN s = 'active' AND r * exp(-0.1::DOUBLE) <= 0.15::DOUBLE THEN 'archived' ELSE s END, m + (NOT tick)::INT FROM g JOIN e ON e.entity_id = g.entity_id AND e.n = g.n + 1)
SELECT entity_id, m AS mentions, round(r, 6) AS relevance, s AS status FROM g QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC) = 1""")
def q4(v: Views):
    given = events(v).where("event_type IN ('view', 'purchase')").select(F.col("user_id").alias("entity_id"), "ts", "event_id", (F.col("event_type") != "purchase").alias("tick"))
    told = Q.drain(Q.relevance_stream(given), "update")
    last = told.groupBy("entity_id").agg(F.max_by(F.struct("relevance", "status", "mentions"), "_batch").alias("s"))
    return last.select("entity_id", "s.mentions", F.round("s.relevance", 6).alias("relevance"), "s.status")


@query("q5_telemetry_stream", "", """
WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS total, count(*) FILTER (value > 50) AS slow, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY ALL)
SELECT CAST(start AS DATE) AS day, event_type, total, slow, mean, most FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q5(v: Views):
    return Q.drain(Q.telemetry_stream(events(v))).select(F.to_date("start").alias("day"), "event_type", "total", "slow", "mean", "most")


@query("q6_sessions", "", """
WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS head FROM events),
b AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, count(*) AS n, arg_max(props, ts) AS last FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q6(v: Views):
    return Q.drain(Q.sessions(events(v))).select("user_id", "n", "last")


_PAIRS = "SELECT a.event_id AS note_id, b.event_id AS edit_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL {} WHERE a.event_type = 'view' AND b.event_type = 'click'"


@query("q7_behavioural_accepts", "", _PAIRS.format("10 MINUTE") + " AND trim(a.props) <> '' AND a.props <> b.props")
def q7(v: Views):
    return Q.drain(Q.behavioural_accepts(events(v).where("event_type = 'view'"), events(v).where("event_type = 'click'"), text="props"))


@query("q7_behavioural_accepts_slow", "", _PAIRS.format("6 HOUR"))
def q7b(v: Views):
    return Q.drain(Q.behavioural_accepts(events(v).where("event_type = 'view'"), events(v).where("event_type = 'click'"), within="6 hours"))


@query("q8_progress", "", """
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER w AS n, epoch_us(ts) / 1e6::DOUBLE - epoch_us(lag(ts) OVER w) / 1e6::DOUBLE AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, n, NULL::DOUBLE AS a FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN a IS NULL THEN s ELSE 0.35::DOUBLE * s + 0.65::DOUBLE * a END FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1),
l AS (SELECT user_id, max(n) AS done, arg_max(a, n) AS a FROM g GROUP BY user_id)
SELECT user_id, done, round(a, 4) AS seconds, CASE WHEN done * 10 >= 200 THEN round(a * greatest(200 - done, 0), 2) END AS eta FROM l""")
def q8(v: Views):
    return Q.progress(v("events"), 200).select("user_id", "done", F.round("seconds", 4).alias("seconds"), F.round("eta", 2).alias("eta"))


_FOUND = """f AS (SELECT entity_id, name, CASE WHEN entity_id % 5 = 4 THEN NULL ELSE status END AS status, coalesce(snippet, '') AS snippet, chapter_no FROM mentions LEFT JOIN ent_users USING (entity_id)),
k AS (SELECT entity_id, CASE WHEN status IS NULL THEN 'entity_discovered' ELSE 'deceased_alive' END AS kind, sha256(entity_id || CASE WHEN status IS NULL THEN 'entity_discovered' ELSE 'deceased_alive' || 'Entity ' || name || ' is deceased in DB' || snippet || chapter_no || chapter_no END) AS fingerprint, chapter_no FROM f WHERE status IS NULL OR status = 'deceased')"""


@query("q9_alerts", "ent_users mentions", f"WITH {_FOUND} SELECT DISTINCT entity_id, kind, fingerprint FROM k WHERE NOT (kind = 'deceased_alive' AND chapter_no % 2 = 0)")
def q9(v: Views):
    told = F.dayofmonth("ts").cast("long")
    mentions = events(v).where("event_type = 'purchase'").select(F.col("user_id").alias("entity_id"), "ts", F.col("props").alias("text"), told.alias("chapter"))
    known = v("ent_users").where("entity_id % 5 <> 4").select("entity_id", "name", "status")
    before = v("mentions").where("chapter_no % 2 = 0").join(known.where("status = 'deceased'"), "entity_id")
    stored = before.select(deceased_fingerprint(F.col("entity_id"), F.col("name"), F.col("snippet"), F.col("chapter_no")).alias("fingerprint"))
    return Q.drain(Q.alerts(mentions, known, stored, "60 days"))
