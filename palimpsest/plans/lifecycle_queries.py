"""Queries over inventories, the relevance lifecycle and consistency, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import consistency as C
from ..operators import lifecycle as L
from .fixtures import Views, query


def r6(c: str):
    return F.round(c, 6).alias(c)


@query("a1_list_entities", "ent_parts", """
SELECT entity_id, name, round(relevance, 6) AS relevance FROM ent_parts
WHERE type = 'ECONOMY' AND relevance >= 0.6 AND (contains(lower(name), 'ring') OR len(list_filter(aliases, lambda x: contains(lower(x), 'ring'))) > 0) ORDER BY ent_parts.relevance DESC, entity_id LIMIT 20 OFFSET 20""")  # fmt: skip
def a1(v: Views):
    rows, _ = A.page(A.list_entities(v("ent_parts"), kind="ECONOMY", least=0.6, like="ring"), [F.desc("relevance"), F.asc("entity_id")], 2, 20)
    return rows.select("entity_id", "name", r6("relevance"))


@query("a1_page_metadata", "ent_parts", "SELECT count(*) AS total, 1 AS page, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM ent_parts WHERE type = 'ECONOMY'")
def a1b(v: Views):
    return A.page(A.list_entities(v("ent_parts"), kind="ECONOMY"), [F.asc("entity_id")], 1, 20)[1]


@query("a2_count_by_type", "ent_users", "SELECT universe, type, count(*) AS n FROM ent_users GROUP BY ALL")
def a2(v: Views):
    return A.count_by_type(v("ent_users"))


@query("a3_mentions_of", "mentions", """
SELECT entity_id, mention_id, place, total FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, mention_id DESC) AS place, count(*) OVER (PARTITION BY entity_id) AS total FROM mentions) AS x WHERE place <= 5""")
def a3(v: Views):
    return A.mentions_of(v("mentions"), 5).select("entity_id", "mention_id", "place", "total")


@query("a4_mentioned_in", "mentions", "SELECT DISTINCT universe, chapter_no, entity_id FROM mentions")
def a4(v: Views):
    return v("mentions").select("universe", "chapter_no", "entity_id").distinct()


@query("a5_max_mentions", "mentions ent_users", """
SELECT u.universe, coalesce(max(n), 0) AS most FROM (SELECT DISTINCT universe FROM ent_users) u LEFT JOIN (SELECT universe, entity_id, count(*) AS n FROM mentions GROUP BY ALL) m USING (universe) GROUP BY ALL""")
def a5(v: Views):
    return A.max_mentions(v("mentions"), v("ent_users"))


@query("a6_entities_for_paragraphs", "mentions", """
SELECT DISTINCT m.entity_id, m.chapter_no, m.paragraph_index FROM mentions m JOIN (SELECT DISTINCT chapter_no, paragraph_index FROM mentions WHERE mention_id % 20 = 0) k USING (chapter_no, paragraph_index)""")
def a6(v: Views):
    keys = v("mentions").where("mention_id % 20 = 0").select("chapter_no", "paragraph_index")
    return v("mentions").join(keys, ["chapter_no", "paragraph_index"], "left_semi").select("entity_id", "chapter_no", "paragraph_index").distinct()


@query("a7_active_entities", "ent_users", "SELECT universe, entity_id, name, row_number() OVER (PARTITION BY universe ORDER BY relevance DESC, name, entity_id) AS place FROM ent_users WHERE status = 'active'")
def a7(v: Views):
    return A.inventory(v("ent_users"), True).select("universe", "entity_id", "name", "place")


@query("a7_inventory", "ent_users", "SELECT universe, entity_id, name, status, row_number() OVER (PARTITION BY universe ORDER BY relevance DESC, name, entity_id) AS place FROM ent_users")
def a7b(v: Views):
    return A.inventory(v("ent_users")).select("universe", "entity_id", "name", "status", "place")


@query("a8_next_index", "chapters", "SELECT work, max(order_index) + 1 AS next_index FROM chapters GROUP BY work")
def a8(v: Views):
    return A.next_index(v("chapters"), "work")


def findings(v: Views):
    c = v("ent_users").select(F.col("entity_id").alias("id"), F.when(F.col("entity_id") % 4 == 0, "high").when(F.col("entity_id") % 4 == 1, "medium").when(F.col("entity_id") % 4 == 2, "low").otherwise("critical").alias("severity"), F.when(F.col("entity_id") % 3 == 0, "resolved").otherwise("open").alias("status"), (F.col("entity_id") % 17).alias("created"))
    h = v("ent_users").where("relevance > 0.7").select(F.col("entity_id").alias("id"), F.when(F.col("entity_id") % 2 == 0, "open").otherwise("resolved").alias("status"), (F.col("entity_id") % 13).alias("created"))
    return c, h


@query("a9_review_inbox", "ent_users", """
WITH b AS (SELECT 'contradiction' AS kind, entity_id AS id, CASE entity_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'critical' END AS severity, CASE WHEN entity_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, entity_id % 17 AS created FROM ent_users
UNION ALL SELECT 'plot_hole', entity_id, 'medium', CASE WHEN entity_id % 2 = 0 THEN 'open' ELSE 'resolved' END, entity_id % 13 FROM ent_users WHERE relevance > 0.7)
SELECT *, CASE WHEN status = 'open' THEN 0 ELSE 1 END AS open_first, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS rank FROM b""")
def a9(v: Views):
    return A.review_inbox(*findings(v))


_TELEMETRY = "count(*) AS total, count(*) FILTER (event_type = 'signup') AS client_errors, count(*) FILTER (event_type = 'error') AS server_errors, round(avg(value), 6) AS mean, max(value) AS most"


@query("a10_telemetry", "", f"SELECT event_type, {_TELEMETRY} FROM events GROUP BY event_type")
def a10(v: Views):
    return A.telemetry(v("events"), "event_type")


@query("a11_percentile_nearest", "", "SELECT event_type, quantile_disc(value, 0.95) AS value FROM events GROUP BY event_type")
def a11(v: Views):
    return A.percentile_nearest(v("events"), "event_type", "value", 0.95)


@query("a11_percentile_at", "", "SELECT event_type, list_sort(list(value))[least(count(*) * 95 // 100, count(*) - 1) + 1] AS value FROM events GROUP BY event_type")
def a11b(v: Views):
    return A.percentile_at(v("events"), "event_type", "value", 95)


@query("a12_distinct_on", "", "SELECT p_name, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY ALL UNION SELECT p_name, p_type, min(p_partkey) FROM part WHERE p_size < 10 GROUP BY ALL")
def a12(v: Views):
    one = lambda df: A.distinct_on(df, ["p_name", "p_type"], "p_partkey").select("p_name", "p_type", "p_partkey")
    return one(v("part")).union(one(v("part").where("p_size < 10"))).distinct()


def fading(v: Views):
    """Users of low relevance, so that a tick archives some."""
    return v("ent_users").withColumn("relevance", F.col("relevance") - F.lit(0.4)).withColumn("status", F.when(F.col("entity_id") % 11 == 0, "archived").otherwise(F.col("status")))


_FADING = "f AS (SELECT * REPLACE (relevance - 0.4::DOUBLE AS relevance, CASE WHEN entity_id % 11 = 0 THEN 'archived' ELSE status END AS status) FROM ent_users)"


@query("l1_decay", "ent_users mentions", """
SELECT entity_id, status, round(CASE WHEN status = 'active' AND entity_id NOT IN (SELECT entity_id FROM mentions WHERE chapter_no = 30) THEN relevance * exp(-0.1::DOUBLE) ELSE relevance END, 6) AS relevance FROM ent_users""")
def l1(v: Views):
    return L.decay(v("ent_users"), v("mentions").where("chapter_no = 30")).select("entity_id", "status", r6("relevance"))


@query("l2_decay_idle", "ent_users", "SELECT entity_id, round(relevance * exp(-0.1::DOUBLE * (30 - last_chapter)), 6) AS relevance FROM ent_users")
def l2(v: Views):
    return v("ent_users").select("entity_id", F.round(L.decay_idle(F.col("relevance"), 30 - F.col("last_chapter")), 6).alias("relevance"))


@query("l3_archive", "ent_users", f"WITH {_FADING} SELECT entity_id, status = 'active' AND relevance <= 0.15::DOUBLE AS newly_archived, CASE WHEN status = 'active' AND relevance <= 0.15::DOUBLE THEN 'archived' ELSE status END AS status FROM f")
def l3(v: Views):
    return L.archive(fading(v)).select("entity_id", "newly_archived", "status")


_REINFORCED = f"""{_FADING}, n AS (SELECT entity_id, count(*) AS n, max(chapter_no) AS c FROM mentions WHERE chapter_no <= 3 GROUP BY entity_id),
r AS (SELECT entity_id, CASE WHEN n > 0 AND status = 'archived' THEN least(1, 0.8::DOUBLE + 0.15::DOUBLE * (n - 1)) WHEN n > 0 AND status = 'active' THEN least(1, relevance + 0.15::DOUBLE * n) ELSE relevance END AS relevance,
CASE WHEN n > 0 AND status = 'archived' THEN 'active' ELSE status END AS status FROM f LEFT JOIN n USING (entity_id))"""


@query("l4_reinforce", "ent_users mentions", f"WITH {_REINFORCED} SELECT entity_id, round(relevance, 6) AS relevance, status FROM r")
def l4(v: Views):
    return L.reinforce(fading(v), v("mentions").where("chapter_no <= 3")).select("entity_id", r6("relevance"), "status")


@query("l5_reactivate", "ent_users", f"WITH {_FADING} SELECT entity_id, round(CASE WHEN entity_id % 22 = 0 THEN 0.8::DOUBLE ELSE relevance END, 6) AS relevance, CASE WHEN entity_id % 22 = 0 THEN 'active' ELSE status END AS status, status = 'archived' AND entity_id % 22 <> 0 AS has_memory FROM f")
def l5(v: Views):
    given = fading(v)
    out, left = L.reactivate(given, given.where("status = 'archived'").select("entity_id"), given.where("entity_id % 22 = 0"))
    return out.join(left.withColumn("m", F.lit(True)), "entity_id", "left").select("entity_id", r6("relevance"), "status", F.coalesce("m", F.lit(False)).alias("has_memory"))


@query("l6_snapshot", "ent_users", "SELECT universe, entity_id, round(relevance, 6) AS relevance, status, 7 AS recorded_at FROM ent_users")
def l6(v: Views):
    return L.snapshot(v("ent_users"), F.lit(7)).withColumn("relevance", F.round("relevance", 6))


@query("l7_recent_history", "", """
SELECT user_id AS entity_id, event_id AS recorded_at, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) AS x WHERE place <= 30""")
def l7(v: Views):
    return L.recent_history(v("events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("recorded_at")))


_REPLAY = """
hit AS (SELECT DISTINCT entity_id, chapter_no FROM mentions),
h AS (SELECT entity_id, universe, 0::BIGINT AS recorded_at, relevance, CASE status WHEN 'candidate' THEN 'active' ELSE status END AS status FROM ent_users
UNION ALL SELECT entity_id, universe, recorded_at, s AS relevance, CASE WHEN st = 'active' AND s <= 0.15::DOUBLE THEN 'archived' ELSE st END FROM (
 SELECT h.entity_id, universe, recorded_at + 1 AS recorded_at,
  CASE WHEN hit.entity_id IS NOT NULL AND status = 'archived' THEN 0.8::DOUBLE WHEN hit.entity_id IS NOT NULL AND status = 'active' THEN least(1::DOUBLE, relevance + 0.15::DOUBLE) WHEN status = 'active' THEN relevance * exp(-0.3::DOUBLE) ELSE relevance END AS s,
  CASE WHEN hit.entity_id IS NOT NULL AND status = 'archived' THEN 'active' ELSE status END AS st
 FROM h LEFT JOIN hit ON hit.entity_id = h.entity_id AND hit.chapter_no = recorded_at + 1 WHERE recorded_at < 30) AS x)"""


#: Fading a chapter at which some of the many mentioned entities are archived.
RATE = 0.3


def started(v: Views):
    return v("ent_users").withColumn("status", F.when(F.col("status") == "candidate", "active").otherwise(F.col("status")))


def history(v: Views):
    return L.replay(started(v), v("mentions"), 30, RATE)


def final(v: Views):
    return history(v).where("recorded_at = 30").select("entity_id", "universe", "relevance", "status")


@query("l12_replay", "ent_users mentions", f"WITH RECURSIVE {_REPLAY} SELECT entity_id, recorded_at, round(relevance, 6) AS relevance, status FROM h WHERE recorded_at > 0")
def l12(v: Views):
    return history(v).select("entity_id", "recorded_at", r6("relevance"), "status")


_LABELS = _REPLAY + """,
w AS (SELECT *, lag(status) OVER e AS was, lag(relevance) OVER e - relevance AS fell FROM h WHERE recorded_at > 0 WINDOW e AS (PARTITION BY entity_id ORDER BY recorded_at)),
c AS (SELECT entity_id, max_by(was || '>' || status, recorded_at) FILTER (was <> status) AS change, max_by(fell, recorded_at) AS fell FROM w GROUP BY entity_id),
lab AS (SELECT f.entity_id, f.universe, f.status, CASE WHEN f.status = 'archived' AND f.entity_id % 2 = 0 THEN 'consolidated' WHEN f.status = 'archived' THEN 'archived' WHEN change = 'archived>active' THEN 'reactivated' WHEN fell > 0.01 THEN 'decaying' ELSE 'active' END AS label
FROM h f JOIN c USING (entity_id) WHERE recorded_at = 30)"""


def labels(v: Views):
    now = final(v)
    return L.lifecycle(now, history(v), now.where("status = 'archived' AND entity_id % 2 = 0").select("entity_id"))


@query("l8_lifecycle", "ent_users mentions", f"WITH RECURSIVE {_LABELS} SELECT entity_id, status, label FROM lab")
def l8(v: Views):
    return labels(v).select("entity_id", "status", "label")


@query("l9_memory_report", "ent_users mentions", f"""WITH RECURSIVE {_LABELS},
n AS (SELECT universe, count(*) FILTER (label = 'consolidated') AS consolidated FROM lab GROUP BY universe)
SELECT entity_id, label, consolidated, string_agg(h.recorded_at || ':' || h.status, ' ' ORDER BY h.recorded_at) AS history FROM lab JOIN n USING (universe) JOIN (SELECT * FROM h WHERE recorded_at > 0) h USING (entity_id) GROUP BY ALL""")
def l9(v: Views):
    told = L.memory_report(labels(v), history(v))
    return told.select("entity_id", "label", "consolidated", F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["recorded_at"], x["status"])), " ").alias("history"))


@query("l10_crossings", "ent_users mentions", f"""WITH RECURSIVE {_REPLAY}, w AS (SELECT *, lag(relevance) OVER (PARTITION BY entity_id ORDER BY recorded_at) AS was FROM h WHERE recorded_at > 0)
SELECT entity_id, recorded_at, CASE WHEN relevance <= 0.15::DOUBLE THEN 'archive' ELSE 'reactivate' END AS kind FROM w WHERE (was > 0.15::DOUBLE) <> (relevance > 0.15::DOUBLE)""")
def l10(v: Views):
    return L.crossings(history(v))


@query("l11_stale_arcs", "ent_users", """
SELECT entity_id, universe, 'Stale arc: ' || name || ' (gap ' || (60 - last_chapter) || ' chapters)' AS title,
'Entity ' || chr(39) || name || chr(39) || ' has not been mentioned for ' || (60 - last_chapter) || ' chapters (last seen in chapter ' || last_chapter || ', currently at chapter 60)' AS description FROM ent_users WHERE status = 'active' AND relevance > 0.5 AND 60 - last_chapter >= 31""")
def l11(v: Views):
    return L.stale_arcs(v("ent_users"), 60, 31)


@query("l13_forgetting", "ent_users", """
WITH e AS (SELECT entity_id, relevance * exp(-0.1::DOUBLE * 17) <= 0.15::DOUBLE AS gone FROM ent_users WHERE status = 'active')
SELECT count(*) AS before, count(*) FILTER (NOT gone) AS after, count(*) FILTER (entity_id % 4 = 0 AND NOT gone) AS false_negatives, count(*) FILTER (entity_id % 4 = 1 AND gone) AS false_positives FROM e""")
def l13(v: Views):
    gold = v("ent_users").where("entity_id % 4 < 2").select("entity_id", F.when(F.col("entity_id") % 4 == 0, "archive").otherwise("stay").alias("should"))
    return L.forgetting(v("ent_users"), gold, 17)


def deceased(v: Views):
    known = v("ent_users").select("entity_id", "name", F.col("status").alias("previous_status"))
    return C.check_deceased(v("mentions").select("mention_id", "entity_id", "chapter_no", F.col("snippet").alias("mention_text")).join(known, "entity_id"))


_DECEASED = "d AS (SELECT entity_id, name, coalesce(snippet, '') AS snippet, chapter_no FROM ent_users e JOIN mentions m USING (entity_id) WHERE e.status = 'deceased')"
_MARK = "sha256(entity_id || 'deceased_alive' || 'Entity ' || name || ' is deceased in DB' || snippet || chapter_no || chapter_no)"


@query("c1_check_deceased", "ent_users mentions", f"""WITH {_DECEASED} SELECT entity_id, 'deceased_alive' AS kind, 'critical' AS severity, 'Entity ' || chr(39) || name || chr(39) || ' is marked as deceased but was mentioned as active: "' || snippet || '"' AS description,
'Entity ' || name || ' status: deceased' AS evidence_a, snippet AS evidence_b, chapter_no, {_MARK} AS fingerprint FROM d""")
def c1(v: Views):
    return deceased(v)


@query("c2_fingerprint", "ent_users mentions", f"WITH {_DECEASED} SELECT {_MARK} AS fingerprint, count(*) AS n FROM d GROUP BY ALL")
def c2(v: Views):
    return deceased(v).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query("c3_new_contradictions", "mentions", """
SELECT min(mention_id) AS id, sha256(entity_id || ':' || chapter_no) AS fingerprint FROM mentions GROUP BY entity_id, chapter_no
HAVING sha256(entity_id || ':' || chapter_no) NOT IN (SELECT sha256(entity_id || ':' || chapter_no) FROM mentions WHERE mention_id % 50 = 0)""")
def c3(v: Views):
    found = v("mentions").select(F.col("mention_id").alias("id"), C.fingerprint(F.col("entity_id"), F.lit(":"), F.col("chapter_no")).alias("fingerprint"))
    return C.new_contradictions(found, found.where("id % 50 = 0")).select("id", "fingerprint")


@query("c4_apply_status", "ent_users", """
SELECT entity_id AS id, CASE WHEN entity_id % 3 <> 0 AND entity_id % 2 = 0 AND entity_id % 10 <> 4 THEN 'dismissed' WHEN entity_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM ent_users""")
def c4(v: Views):
    rows = v("ent_users").select(F.col("entity_id").alias("id"), "universe", F.when(F.col("entity_id") % 3 == 0, "resolved").otherwise("open").alias("status"))
    changes = rows.where("id % 2 = 0").select("id", F.when(F.col("id") % 10 == 4, F.col("universe") + 1).otherwise(F.col("universe")).alias("universe"), F.lit("dismissed").alias("new_status"))
    return C.apply_status(rows, changes).select("id", "status")


@query("c5_open_arcs", "", """
SELECT l_partkey AS entity_id, o_custkey % 5 AS universe, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 5, l_partkey ORDER BY o_orderdate DESC, o_orderkey) AS place
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) AS l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_partkey % 5 = o_custkey % 5""")
def c5(v: Views):
    arcs = v("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("related"))
    orders = v("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("universe"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"))
    asked = v("part").select((F.col("p_partkey") % 5).alias("universe"), F.col("p_partkey").alias("entity_id"))
    return C.open_arcs(arcs.join(orders, "id"), asked).select("entity_id", "universe", "id", "place")


@query("c6_timeline", "", """
SELECT o_orderkey AS id, o_custkey % 5 AS universe, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END ASC NULLS LAST, o_orderkey) AS place FROM orders""")
def c6(v: Views):
    events = v("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("universe"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("position"))
    return C.timeline(events).select("id", "universe", "place")


@query("c7_validate_timeline", "chapters", """
WITH p AS (SELECT work, max(order_index) AS present FROM chapters GROUP BY work)
SELECT chapter_id, CASE WHEN chapter_id % 5 = 0 THEN 'valid' WHEN order_index + chapter_id % 3 > present THEN 'invalid' WHEN order_index + chapter_id % 3 = present THEN 'ambiguous' ELSE 'valid' END AS verdict FROM chapters JOIN p USING (work)""")
def c7(v: Views):
    events = v("chapters").select("chapter_id", "work", F.when(F.col("chapter_id") % 5 != 0, F.col("order_index") + F.col("chapter_id") % 3).alias("chapter_index"))
    return C.validate_timeline(events, v("chapters")).select("chapter_id", "verdict")


@query("c8_seed_timeline", "mentions ent_users", """
WITH t AS (SELECT DISTINCT m.universe, chapter_no, entity_id, type, name FROM mentions m JOIN ent_users e USING (entity_id))
SELECT a.universe, a.entity_id, a.name AS title, a.chapter_no AS position, coalesce(string_agg(b.entity_id, ',' ORDER BY b.entity_id), '') AS participants
FROM t a LEFT JOIN t b ON b.universe = a.universe AND b.chapter_no = a.chapter_no AND b.type = 'character' WHERE a.type = 'event' GROUP BY ALL""")
def c8(v: Views):
    return C.seed_timeline(v("mentions"), v("ent_users")).withColumn("participants", F.array_join(F.col("participants").cast("array<string>"), ","))


@query("c8_seeded_events", "mentions ent_users", """
WITH t AS (SELECT DISTINCT m.universe, chapter_no, entity_id, type, name FROM mentions m JOIN ent_users e USING (entity_id) WHERE type IN ('event', 'character'))
SELECT universe || ':' || chapter_no AS group_id, entity_id, type = 'event' AS is_event FROM t""")
def c8b(v: Views):
    events, members = C.seeded_events(v("mentions"), v("ent_users"))
    return events.select("group_id", "entity_id", F.lit(True).alias("is_event")).unionByName(members.withColumn("is_event", F.lit(False)))


@query("c9_last_k_chapters", "mentions", "SELECT universe, chapter_no FROM (SELECT DISTINCT universe, chapter_no FROM mentions) AS x QUALIFY row_number() OVER (PARTITION BY universe ORDER BY chapter_no DESC) <= 3")
def c9(v: Views):
    return C.last_k_chapters(v("mentions"), 3)


@query("c10_consolidation_inputs", "mentions", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, mention_id DESC) AS place FROM mentions WHERE entity_id % 4 = 0)
SELECT entity_id, string_agg('- ' || snippet, chr(10) ORDER BY place) AS lines FROM t WHERE place <= 100 GROUP BY entity_id""")
def c10(v: Views):
    return C.consolidation_inputs(v("ent_users").withColumn("status", F.when(F.col("entity_id") % 4 == 0, "archived").otherwise("active")), v("mentions"))


@query("c11_parse_memories", "", "SELECT p_partkey AS entity_id, p_name AS summary, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS n_facts FROM part WHERE p_partkey % 5 <> 0")
def c11(v: Views):
    facts = F.when(F.col("p_partkey") % 3 != 0, F.array("p_brand", "p_type"))
    raw = F.to_json(F.struct(F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).otherwise(" ").alias("summary"), facts.alias("key_facts")))
    return C.parse_memories(v("part").select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("```json\n"), raw, F.lit("\n```")).alias("raw"))).select("entity_id", "summary", F.size("key_facts").alias("n_facts"))


@query("c12_entity_lines", "ent_parts", """
WITH RECURSIVE i AS (SELECT universe, type, '- ' || name || ' (' || type || '): ' || description AS line, row_number() OVER (PARTITION BY universe, type ORDER BY relevance DESC, entity_id) AS n FROM ent_parts),
c AS (SELECT *, (strlen(line) + 1) // 4 + 1 AS cost FROM i),
g AS (SELECT universe, type, n, CASE WHEN cost <= 200 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 200 THEN line ELSE '' END AS text FROM c WHERE n = 1
UNION ALL SELECT c.universe, c.type, c.n, CASE WHEN used + cost <= 200 THEN used + cost ELSE used END, CASE WHEN used + cost <= 200 THEN text || chr(10) || line ELSE text END FROM g JOIN c ON c.universe = g.universe AND c.type = g.type AND c.n = g.n + 1)
SELECT universe, type, max_by(text, n) AS text, max_by(used, n) AS used FROM g GROUP BY ALL""")
def c12(v: Views):
    return C.entity_lines(v("ent_parts"), 200)
