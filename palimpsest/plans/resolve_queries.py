"""Queries over entity resolution and feedback, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as P
from ..operators import resolve as R
from ..operators import retrieval as V
from . import fixtures
from .fixtures import Views, query
from .retrieval_queries import top


def r6(c: str):
    return F.round(c, 6).alias(c)


def mentioned(v: Views):
    """Incoming names: full names, second words, brands and unknown ones, by part number."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.get(F.split("p_name", " "), 1)).when(k == 2, F.col("p_brand")).otherwise(F.concat(F.lit("Zz"), (F.col("p_partkey") % 50).cast("string")))
    return v("part").select(F.col("p_partkey").alias("mention_id"), F.lit(1).alias("universe"), F.col("p_type").alias("type"), name.alias("name"))


_MENTIONED = "m AS (SELECT p_partkey AS mention_id, p_type AS type, lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[2] WHEN 2 THEN p_brand ELSE 'Zz' || (p_partkey % 50) END) AS norm FROM part)"
_STORED = "s AS (SELECT * FROM ent_parts WHERE entity_id % 3 <> 0)"
_EXACT = "ex AS (SELECT mention_id, min(entity_id) AS entity_id FROM m JOIN s ON lower(s.name) = norm AND s.type = m.type GROUP BY mention_id)"
_FUZZY = "fz AS (SELECT mention_id, arg_max(entity_id, length(s.name) * 100000000 - entity_id) AS entity_id FROM m JOIN s ON s.type = m.type AND (contains(lower(s.name), norm) OR contains(norm, lower(s.name))) WHERE norm <> '' GROUP BY mention_id)"
_ALIAS = "al AS (SELECT mention_id, min(entity_id) AS entity_id FROM m JOIN (SELECT type, entity_id, lower(unnest(aliases)) AS a FROM s) x ON a = norm AND x.type = m.type GROUP BY mention_id)"


def stored(v: Views):
    return v("ent_parts").where("entity_id % 3 <> 0")


@query("r1_match_exact", "ent_parts", f"WITH {_MENTIONED}, {_STORED}, {_EXACT} SELECT * FROM ex")
def r1(v: Views):
    return R.match_exact(mentioned(v), stored(v))


@query("r2_match_fuzzy", "ent_parts", f"WITH {_MENTIONED}, {_STORED}, {_FUZZY} SELECT * FROM fz")
def r2(v: Views):
    return R.match_fuzzy(mentioned(v), stored(v))


@query("r3_match_alias", "ent_parts", f"WITH {_MENTIONED}, {_STORED}, {_ALIAS} SELECT * FROM al")
def r3(v: Views):
    return R.match_alias(mentioned(v), stored(v))


@query("r3_match_alias_untyped", "ent_parts", f"WITH {_MENTIONED}, {_STORED} SELECT mention_id, min(entity_id) AS entity_id FROM m JOIN (SELECT entity_id, lower(unnest(aliases)) AS a FROM s) x ON a = norm GROUP BY mention_id")
def r3b(v: Views):
    return R.match_alias(mentioned(v), stored(v), typed=False)


@query("r4_match_semantic", "para_vecs query_vecs", f"SELECT query_id, para_id FROM ({top('query_vecs', 'para_vecs', 'para_id', 1)}) AS t WHERE distance <= 0.60")
def r4(v: Views):
    return V.nearest_within(v("query_vecs"), v("para_vecs"), 0.60, own=False).select("query_id", "para_id")


@query("r5_resolve", "ent_parts query_vecs para_vecs", f"""WITH {_MENTIONED}, {_STORED}, {_EXACT}, {_FUZZY}, {_ALIAS},
se AS (SELECT query_id + 3 AS mention_id, para_id AS entity_id FROM ({top('query_vecs', 'para_vecs', 'para_id', 1)}) AS t WHERE distance <= 0.75),
r AS (SELECT m.*, coalesce(ex.entity_id, fz.entity_id, al.entity_id, se.entity_id) AS entity_id,
CASE WHEN ex.entity_id IS NOT NULL THEN 'exact' WHEN fz.entity_id IS NOT NULL THEN 'fuzzy' WHEN al.entity_id IS NOT NULL THEN 'alias' WHEN se.entity_id IS NOT NULL THEN 'semantic' ELSE 'new' END AS how
FROM m LEFT JOIN ex USING (mention_id) LEFT JOIN fz USING (mention_id) LEFT JOIN al USING (mention_id) LEFT JOIN se USING (mention_id))
SELECT mention_id, how, entity_id, CASE WHEN how = 'new' THEN min(mention_id) OVER (PARTITION BY how, norm, type) END AS new_of FROM r""")
def r5(v: Views):
    near = V.nearest_within(v("query_vecs"), v("para_vecs"), 0.75, own=False).select((F.col("query_id") + 3).alias("mention_id"), F.col("para_id").alias("entity_id"))
    return R.resolve(mentioned(v), stored(v), near).select("mention_id", "how", "entity_id", "new_of")


@query("r6_merge_fields", "ent_parts", """
SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN array_to_string(aliases, ',') || ',x' || entity_id ELSE array_to_string(aliases, ',') END AS aliases,
CASE WHEN entity_id % 2 = 0 AND strlen(name || ' of the old harbour town') > strlen(description) THEN name || ' of the old harbour town' ELSE description END AS description,
CASE WHEN entity_id % 2 = 0 THEN 'new' ELSE '' END AS color, 'old' AS size, round(CASE WHEN entity_id % 2 = 0 THEN greatest(0.5::DOUBLE, (entity_id % 10)::DOUBLE / 10) ELSE 0.5 END, 6) AS confidence,
CASE WHEN entity_id % 3 = 0 THEN 'dismissed' WHEN entity_id % 2 = 0 AND entity_id % 4 = 0 THEN 'deceased' WHEN entity_id % 2 = 0 AND entity_id % 10 >= 7 THEN 'active' ELSE 'candidate' END AS status FROM ent_parts""")
def r6_merge(v: Views):
    props = lambda a, b: F.create_map(F.lit("color"), F.lit(a), F.lit("size"), F.lit(b))
    old = v("ent_parts").select("entity_id", "aliases", "description", props("", "old").alias("props"), F.lit(0.5).alias("confidence"), F.when(F.col("entity_id") % 3 == 0, "dismissed").otherwise("candidate").alias("status"))
    new = v("ent_parts").where("entity_id % 2 = 0").select("entity_id", F.array(F.col("aliases")[0], F.concat(F.lit("x"), F.col("entity_id").cast("string"))).alias("aliases"), F.concat("name", F.lit(" of the old harbour town")).alias("description"), props("new", "new").alias("props"), (F.col("entity_id") % 10 / 10).alias("confidence"), F.when(F.col("entity_id") % 4 == 0, "deceased").otherwise("").alias("status"))
    return R.merge_fields(old, new).select("entity_id", F.array_join("aliases", ",").alias("aliases"), "description", F.col("props")["color"].alias("color"), F.col("props")["size"].alias("size"), r6("confidence"), "status")


@query("r7_duplicate_keys", "ent_parts", "SELECT universe, lower(name) AS norm, type, count(*) AS n FROM ent_parts GROUP BY ALL HAVING count(*) > 1")
def r7(v: Views):
    return R.duplicate_keys(v("ent_parts"))


_LOSERS = "w AS (SELECT entity_id, first_value(entity_id) OVER (PARTITION BY universe, lower(name), type ORDER BY length(description) DESC, created, entity_id) AS winner FROM ent_parts), lo AS (SELECT * FROM w WHERE entity_id <> winner)"


@query("r8_winner_map", "ent_parts", f"WITH {_LOSERS} SELECT * FROM lo")
def r8(v: Views):
    return R.winner_map(v("ent_parts"))


@query("r9_consolidate_attributes", "ent_parts", f"""WITH {_LOSERS},
a AS (SELECT winner, name AS alias FROM lo JOIN ent_parts USING (entity_id) UNION ALL SELECT w.winner, unnest(aliases) FROM ent_parts JOIN w USING (entity_id)),
f AS (SELECT a.winner, lower(alias) AS low, min(alias) AS alias FROM a JOIN ent_parts e ON e.entity_id = a.winner WHERE lower(alias) <> lower(e.name) GROUP BY ALL),
d AS (SELECT winner, arg_max(description, length(description)) AS n, max(length(description)) AS len FROM w JOIN ent_parts USING (entity_id) GROUP BY winner)
SELECT winner, string_agg(alias, ',' ORDER BY low) AS aliases, any_value(len) AS len FROM f JOIN d USING (winner) WHERE winner IN (SELECT winner FROM lo) GROUP BY winner""")
def r9(v: Views):
    out = R.consolidate_attributes(v("ent_parts"), R.winner_map(v("ent_parts")))
    return out.select("winner", F.array_join("aliases", ",").alias("aliases"), F.char_length("description").alias("len"))


@query("r10_repoint", "ent_parts", f"WITH {_LOSERS} SELECT coalesce(winner, l_partkey) AS l_partkey, count(*) AS n FROM lineitem LEFT JOIN lo ON entity_id = l_partkey GROUP BY 1")
def r10(v: Views):
    return R.repoint(v("lineitem"), R.winner_map(v("ent_parts")), "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("r11_repoint_array", "ent_parts", f"""WITH {_LOSERS}, x AS (SELECT l_orderkey, l_partkey, winner FROM lineitem LEFT JOIN lo ON entity_id = l_partkey)
SELECT l_orderkey, CASE WHEN count(winner) > 0 THEN array_to_string(list_sort(list_distinct(list(coalesce(winner, l_partkey)))), ',') ELSE string_agg(l_partkey, ',' ORDER BY l_partkey DESC) END AS parts FROM x GROUP BY l_orderkey""")
def r11(v: Views):
    arrays = v("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey"), asc=False).alias("parts"))
    return R.repoint_array(arrays, R.winner_map(v("ent_parts")), "l_orderkey", "parts").select("l_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query("r12_transfer_satellites", "ent_parts", f"""WITH {_LOSERS}, s AS (SELECT entity_id, created AS version FROM ent_parts WHERE entity_id % 3 = 0),
k AS (SELECT entity_id, version FROM s ANTI JOIN lo USING (entity_id)), m AS (SELECT winner AS entity_id, max(version) AS version FROM s JOIN lo USING (entity_id) GROUP BY winner)
SELECT * FROM k UNION ALL SELECT * FROM m ANTI JOIN k USING (entity_id)""")
def r12(v: Views):
    rows = v("ent_parts").where("entity_id % 3 = 0").select("entity_id", F.col("created").alias("version"))
    return R.transfer_satellites(rows, R.winner_map(v("ent_parts")), "version")


@query("r13_review_candidates", "ent_users mentions", """
SELECT universe, entity_id, name, round(confidence, 6) AS confidence, snippet, chapter_no, row_number() OVER (PARTITION BY universe ORDER BY confidence, last_chapter, entity_id) AS place
FROM (SELECT * FROM ent_users WHERE status = 'candidate') e LEFT JOIN (SELECT entity_id, snippet, chapter_no FROM mentions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, mention_id DESC) = 1) m USING (entity_id)""")
def r13(v: Views):
    return R.review_candidates(v("ent_users").withColumn("updated_at", F.col("last_chapter")), v("mentions")).withColumn("confidence", F.round("confidence", 6))


_DECIDED = """t AS (SELECT entity_id, universe, status, CASE entity_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'dismiss' ELSE 'merge' END AS decision, (entity_id // 10 + 1) * 10 + entity_id % 5 AS target FROM ent_users),
d AS (SELECT t.entity_id, decision, CASE WHEN decision = 'merge' THEN target END AS target FROM t LEFT JOIN ent_users a ON a.entity_id = target AND a.status = 'active' AND a.universe = t.universe AND target <> t.entity_id WHERE t.status = 'candidate' AND (decision <> 'merge' OR a.entity_id IS NOT NULL)),
x AS (SELECT *, [name, 'a' || entity_id % 3] AS aliases, repeat('x', (entity_id % 7)::INT) || entity_id AS description, CASE WHEN entity_id % 2 = 0 THEN 'c' || entity_id ELSE '' END AS color FROM ent_users),
g AS (SELECT entity_id AS to_id, -1 AS nth, entity_id FROM x UNION ALL SELECT target, entity_id, entity_id FROM d WHERE decision = 'merge')"""


def users(v: Views):
    """Users with fields to merge, and decisions of which the later ones must not count."""
    k = F.col("entity_id") % 3
    color = F.when(F.col("entity_id") % 2 == 0, F.concat(F.lit("c"), F.col("entity_id").cast("string"))).otherwise("")
    x = v("ent_users").withColumn("aliases", F.array("name", F.concat(F.lit("a"), k.cast("string")))).withColumn("description", F.concat(F.expr("repeat('x', CAST(entity_id % 7 AS INT))"), F.col("entity_id").cast("string"))).withColumn("props", F.create_map(F.lit("color"), color))
    d = v("ent_users").select(F.col("entity_id").alias("decision_id"), "entity_id", F.when(k == 0, "accept").when(k == 1, "dismiss").otherwise("merge").alias("decision"), F.expr("(entity_id div 10 + 1) * 10 + entity_id % 5").alias("target"))
    late = d.select((F.col("decision_id") + 10**9).alias("decision_id"), "entity_id", F.lit("dismiss").alias("decision"), "target")
    return x, d.unionByName(late)


@query("r14_apply_decisions", "ent_users", f"""
WITH {_DECIDED},
al AS (SELECT to_id, alias, min(nth * 10 + i) AS o FROM (SELECT to_id, nth, unnest(aliases) AS alias, unnest(range(0, 2)) AS i FROM g JOIN x USING (entity_id)) AS u GROUP BY ALL),
f AS (SELECT to_id, arg_min(description, -length(description) * 1000000 + nth) AS description, max(confidence) AS confidence, coalesce(arg_min(color, nth) FILTER (color <> ''), '') AS color FROM g JOIN x USING (entity_id) GROUP BY to_id)
SELECT x.entity_id, CASE d.decision WHEN 'accept' THEN 'active' WHEN 'dismiss' THEN 'dismissed' WHEN 'merge' THEN 'merged' ELSE x.status END AS status, d.target AS merged_into,
(SELECT string_agg(alias, ',' ORDER BY o) FROM al WHERE to_id = x.entity_id) AS aliases, f.description, f.color, round(f.confidence, 6) AS confidence FROM x JOIN f ON to_id = x.entity_id LEFT JOIN d USING (entity_id)""")
def r14(v: Views):
    return R.apply_decisions(*users(v)).select("entity_id", "status", "merged_into", F.array_join("aliases", ",").alias("aliases"), "description", F.col("props")["color"].alias("color"), r6("confidence"))


@query("r14_merge_references", "ent_users mentions", f"""
WITH {_DECIDED}, lo AS (SELECT entity_id, target AS winner FROM d WHERE decision = 'merge'),
c AS (SELECT chapter_no, coalesce(winner, entity_id) AS id, winner FROM mentions LEFT JOIN lo USING (entity_id)),
s AS (SELECT entity_id, last_chapter AS version FROM ent_users WHERE entity_id % 4 <> 2), k AS (SELECT * FROM s ANTI JOIN lo USING (entity_id)), m AS (SELECT winner AS entity_id, max(version) AS version FROM s JOIN lo USING (entity_id) GROUP BY winner)
SELECT 'mentions' AS kind, id, count(*) AS n FROM c GROUP BY id UNION ALL SELECT 'participants', id, count(DISTINCT chapter_no) FROM c GROUP BY id
UNION ALL SELECT 'memory', entity_id, version FROM (SELECT * FROM k UNION ALL SELECT * FROM m ANTI JOIN k USING (entity_id)) AS u""")
def r14b(v: Views):
    m = v("mentions")
    events = m.groupBy("chapter_no").agg(F.array_sort(F.collect_set("entity_id")).alias("participants"))
    memory = v("ent_users").where("entity_id % 4 <> 2").select("entity_id", F.col("last_chapter").alias("version"))
    out = R.merge_references(*users(v), {"mentions": (m, "entity_id")}, {"events": (events, "chapter_no", "participants")}, {"memory": (memory, "version")})
    rows = lambda kind, df, n: df.select(F.lit(kind).alias("kind"), F.col("id"), n.cast("long").alias("n"))
    counts = out["mentions"].groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    held = out["events"].select("chapter_no", F.explode("participants").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return rows("mentions", counts, F.col("n")).unionByName(rows("participants", held, F.col("n"))).unionByName(rows("memory", out["memory"].withColumnRenamed("entity_id", "id"), F.col("version")))


@query("r15_resolve_relation_names", "ent_parts", """
WITH n AS (SELECT DISTINCT name FROM (SELECT upper(p_name) AS name FROM part UNION ALL SELECT string_split(p_name, ' ')[1] FROM part UNION ALL SELECT 'the  bold ' || p_size FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'nobody')),
e AS (SELECT DISTINCT entity_id, lower(unnest(list_concat(aliases, [name, CASE WHEN entity_id % 2 = 0 THEN 'The Bold ' || created || ' of ' || entity_id ELSE name END]))) AS norm FROM ent_parts),
x AS (SELECT norm, count(DISTINCT entity_id) AS n, min(entity_id) AS id FROM e GROUP BY norm),
p AS (SELECT norm, count(DISTINCT entity_id) AS n, min(entity_id) AS id FROM (SELECT entity_id, unnest(list_transform(range(1, len(string_split(norm, ' '))), lambda i: array_to_string(string_split(norm, ' ')[1:i], ' '))) AS norm FROM e) GROUP BY norm)
SELECT name, CASE WHEN x.n = 1 THEN x.id WHEN x.n IS NULL AND p.n = 1 THEN p.id END AS entity_id, CASE WHEN x.n = 1 THEN 'exact' WHEN x.n > 1 THEN 'ambiguous' WHEN p.n = 1 THEN 'prefix' WHEN p.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS reason
FROM n LEFT JOIN x ON x.norm = lower(replace(name, '  ', ' ')) LEFT JOIN p ON p.norm = lower(replace(name, '  ', ' '))""")
def r15(v: Views):
    bold = F.concat(F.lit("The Bold "), F.col("created").cast("string"), F.lit(" of "), F.col("entity_id").cast("string"))
    entities = v("ent_parts").withColumn("aliases", F.when(F.col("entity_id") % 2 == 0, F.array_append("aliases", bold)).otherwise(F.col("aliases")))
    part = v("part")
    names = part.select(F.upper("p_name").alias("name")).unionByName(part.select(F.get(F.split("p_name", " "), 0).alias("name"))).unionByName(part.where("p_partkey % 2 = 0").select(F.concat(F.lit("the  bold "), F.col("p_size").cast("string")).alias("name"))).unionByName(v("region").limit(1).select(F.lit("nobody").alias("name")))
    return R.resolve_relation_names(names, entities)


def cloned(v: Views):
    """Every second part, with works, events that name parts, findings and edges."""
    some = v("ent_parts").where("entity_id % 2 = 0").select("entity_id", "universe", "name")
    chapters = v("chapters").select("chapter_id", "universe", "order_index")
    events = v("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("participants"), F.min("l_partkey").alias("owner"))
    findings = v("part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("entity_id"), (F.col("p_partkey") % 300).alias("chapter_id"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("f"), F.col("p_partkey").cast("string"))).alias("fingerprint"))
    tables = {
        "chapters": R.Cloned(chapters, "chapter_id"), "entities": R.Cloned(some, "entity_id"),
        "events": R.Cloned(events, "l_orderkey", {"owner": "entities"}, {"participants": "entities"}),
        "findings": R.Cloned(findings, "id", {"entity_id": "entities", "chapter_id": "chapters"}, fingerprint="fingerprint"),
        "edges": R.Cloned(v("edges"), None, {"src": "entities", "dst": "entities"}, linked=True, tasks=max(int(v.spark.conf.get("spark.sql.shuffle.partitions")), 2 * v("lineitem").count() // fixtures.LINES)),
    }
    return R.clone_universe(tables, "copy")


@query("r16_clone_universe", "edges ent_parts", """
WITH n AS (SELECT entity_id, sha256(entity_id || '/copy') AS id FROM ent_parts WHERE entity_id % 2 = 0)
SELECT a.id AS src, b.id AS dst, rel_type FROM edges JOIN n a ON a.entity_id = src JOIN n b ON b.entity_id = dst""")
def r16(v: Views):
    return cloned(v)[0]["edges"].select("src", "dst", "rel_type")


@query("r16_skipped_edges", "edges", "SELECT 'edges' AS table_name, count(*) AS skipped FROM edges WHERE src % 2 = 1 OR dst % 2 = 1")
def r16b(v: Views):
    return cloned(v)[1]


@query("r16_clone_rows", "chapters", """
WITH e AS (SELECT l_orderkey, string_agg(sha256(p || '/copy'), ',' ORDER BY p) FILTER (p % 2 = 0) AS participants, min(p) AS owner FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) AS x GROUP BY l_orderkey),
c AS (SELECT DISTINCT chapter_id FROM chapters)
SELECT 'event' AS kind, sha256(l_orderkey || '/copy') AS id, CASE WHEN owner % 2 = 0 THEN sha256(owner || '/copy') END AS entity_id, coalesce(participants, '') AS more FROM e
UNION ALL SELECT 'finding', sha256(p_partkey || '/copy'), CASE WHEN p_partkey % 2 = 0 THEN sha256(p_partkey || '/copy') END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'f' || p_partkey || ':copy' END || '|' || coalesce(CASE WHEN c.chapter_id IS NOT NULL THEN sha256(c.chapter_id || '/copy') END, '') FROM part LEFT JOIN c ON c.chapter_id = p_partkey % 300
UNION ALL SELECT 'chapter', sha256(chapter_id || '/copy'), NULL, 'copy' FROM chapters""")
def r16c(v: Views):
    out, _ = cloned(v)
    rows = lambda kind, df, key, entity, more: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), entity.alias("entity_id"), more.alias("more"))
    a = rows("event", out["events"], "l_orderkey", F.col("owner"), F.array_join("participants", ","))
    b = rows("finding", out["findings"], "id", F.col("entity_id"), F.concat("fingerprint", F.lit("|"), F.coalesce("chapter_id", F.lit(""))))
    return a.unionByName(b).unionByName(rows("chapter", out["chapters"], "chapter_id", F.lit(None).cast("string"), F.col("universe")))


_REASON = "CASE WHEN signal NOT IN ('accept', 'reject', 'behavioural_accept') THEN 'unknown signal' WHEN signal = 'behavioural_accept' AND before = after THEN 'unchanged' WHEN signal = 'behavioural_accept' AND age_seconds > 600 THEN 'too late' END"


@query("p1_validate_feedback", "feedback", f"SELECT event_id, {_REASON} AS reason FROM feedback")
def p1(v: Views):
    return P.validate_feedback(v("feedback")).select("event_id", "reason")


_EVIDENCE = f"""f AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN user_id * 4 + 1 END AS obs_ref, CASE WHEN event_id % 4 = 1 THEN NULL ELSE metric END AS m FROM feedback WHERE {_REASON} IS NULL),
ev AS (SELECT event_id, f.user_id, signal, obs_id FROM f JOIN observations o ON o.user_id = f.user_id AND CASE WHEN obs_ref IS NOT NULL THEN obs_ref = obs_id WHEN m IS NOT NULL THEN m = o.metric ELSE true END)"""


def evidence(v: Views):
    ok = P.validate_feedback(v("feedback")).where("reason IS NULL")
    given = ok.select("event_id", "user_id", "signal", F.when(F.col("event_id") % 4 != 1, F.col("metric")).alias("metric"), F.when(F.col("event_id") % 4 == 0, F.col("user_id") * 4 + 1).alias("obs_ref"))
    return P.match_evidence(given, v("observations"))


@query("p2_match_evidence", "feedback observations", f"WITH {_EVIDENCE} SELECT event_id, obs_id FROM ev")
def p2(v: Views):
    return evidence(v).select("event_id", "obs_id")


@query("p3_promote", "feedback observations", f"""WITH {_EVIDENCE}, c AS (SELECT user_id, obs_id, signal, count(*) AS n FROM ev GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY obs_id) AS events FROM c QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY n DESC, CASE signal WHEN 'accept' THEN 0 WHEN 'behavioural_accept' THEN 1 ELSE 2 END) = 1)
SELECT user_id, obs_id, signal, CAST(events AS BIGINT) AS events, 'The writer ' || CASE WHEN signal = 'reject' THEN 'deliberately keeps' ELSE 'values' END || ' ' || CASE metric WHEN 0 THEN 'long sentence lengths' WHEN 1 THEN 'adverb-rich phrasing' WHEN 2 THEN 'a dialogue-forward balance' ELSE 'this craft choice' END || '.' AS statement, 0.5::DOUBLE AS confidence, 1.0::DOUBLE AS relevance FROM b JOIN (SELECT obs_id, metric FROM observations) AS o USING (obs_id) WHERE events >= 3 AND n >= 3""")
def p3(v: Views):
    names = F.array(*[F.lit(m) for m in ("mean_sentence_length", "adverb_density", "dialogue_ratio", "vocabulary")])
    metrics = v("observations").select("obs_id", F.get(names, F.col("metric").cast("int")).alias("metric"))
    return P.promote(evidence(v).join(metrics, "obs_id"))


@query("p4_reinforce_preferences", "feedback prefs", """
WITH RECURSIVE e AS (SELECT pref_id, signal, row_number() OVER (PARTITION BY pref_id ORDER BY event_id) AS n FROM feedback),
g AS (SELECT pref_id, 0::BIGINT AS n, confidence AS c, relevance AS r, CASE WHEN relevance <= 0.15::DOUBLE THEN 'archived' ELSE lifecycle END AS l FROM prefs UNION ALL
SELECT pref_id, n, c, r, CASE WHEN r <= 0.15::DOUBLE THEN 'archived' WHEN signal IN ('accept', 'behavioural_accept') THEN 'active' ELSE l END FROM (
SELECT g.pref_id, e.n, e.signal, g.l, CASE signal WHEN 'accept' THEN least(1, c + 0.1::DOUBLE) WHEN 'behavioural_accept' THEN least(1, c + 0.05::DOUBLE) WHEN 'reject' THEN c * exp(-0.1::DOUBLE) ELSE c END AS c,
CASE WHEN signal IN ('accept', 'behavioural_accept') THEN 1 WHEN signal = 'reject' THEN r * exp(-0.1::DOUBLE) ELSE r END AS r FROM g JOIN e ON e.pref_id = g.pref_id AND e.n = g.n + 1) AS x)
SELECT pref_id, round(max_by(c, n), 6) AS confidence, round(max_by(r, n), 6) AS relevance, max_by(l, n) AS lifecycle FROM g GROUP BY pref_id""")
def p4(v: Views):
    return P.reinforce_preferences(v("prefs"), v("feedback")).select("pref_id", r6("confidence"), r6("relevance"), "lifecycle")


_FADED = "d AS (SELECT pref_id, confidence, lifecycle = 'active' AS f, CASE WHEN lifecycle = 'active' THEN relevance * exp(-0.1::DOUBLE) ELSE relevance END AS r, lifecycle FROM prefs)"


@query("p5_decay_preferences", "prefs", f"WITH {_FADED} SELECT pref_id, round(r, 6) AS relevance, CASE WHEN f AND r <= 0.15::DOUBLE THEN 'archived' ELSE lifecycle END AS lifecycle FROM d")
def p5(v: Views):
    return P.decay_preferences(v("prefs"), v("prefs").select("owner")).select("pref_id", r6("relevance"), "lifecycle")


@query("p5_decay_history", "prefs", f"WITH {_FADED} SELECT pref_id, 7 AS recorded_at, round(r, 6) AS relevance, round(confidence, 6) AS confidence, CASE WHEN r <= 0.15::DOUBLE THEN 'archived' ELSE 'active' END AS lifecycle FROM d WHERE f")
def p5b(v: Views):
    return P.decay_history(v("prefs"), v("prefs").select("owner"), F.lit(7)).select("pref_id", "recorded_at", r6("relevance"), r6("confidence"), "lifecycle")


@query("p6_list_preferences", "prefs", "SELECT owner, pref_id, row_number() OVER (PARTITION BY owner ORDER BY round(relevance * confidence, 9) DESC, created DESC, pref_id) AS place FROM prefs WHERE lifecycle = 'active' QUALIFY place <= 10")
def p6(v: Views):
    return P.list_preferences(v("prefs"), True, 10).select("owner", "pref_id", "place")


@query("p7_evidence_bundle", "prefs feedback observations", """
WITH e AS (SELECT pref_id, string_agg(event_id || ':' || signal, ' ' ORDER BY event_id) AS events FROM (SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY pref_id ORDER BY event_id DESC) <= 1000) AS x GROUP BY pref_id),
o AS (SELECT user_id % 20 AS pref_id, string_agg(obs_id || ':' || metric, ' ' ORDER BY obs_id) AS observations FROM observations GROUP BY 1),
h AS (SELECT pref_id, count(*) AS n, min(ts) AS first FROM (SELECT * FROM feedback WHERE signal = 'accept' QUALIFY row_number() OVER (PARTITION BY pref_id ORDER BY ts DESC) <= 1000) AS x GROUP BY pref_id)
SELECT p.pref_id, coalesce(events, '') AS events, coalesce(observations, '') AS observations, coalesce(n, 0) AS history, CAST(first AS DATE) AS first FROM prefs p LEFT JOIN e USING (pref_id) LEFT JOIN o USING (pref_id) LEFT JOIN h USING (pref_id)""")
def p7(v: Views):
    observations = v("observations").withColumn("pref_id", F.col("user_id") % 20)
    history = v("feedback").where("signal = 'accept'").select("pref_id", F.col("ts").alias("recorded_at"), F.lit(1.0).alias("relevance"), F.lit(0.5).alias("confidence"), F.lit("active").alias("lifecycle"))
    out = P.evidence_bundle(v("prefs").select("pref_id"), v("feedback"), observations, history)
    text = lambda c, a, b: F.coalesce(F.array_join(F.transform(c, lambda e: F.concat_ws(":", e[a].cast("string"), e[b].cast("string"))), " "), F.lit(""))
    return out.select("pref_id", text("events", "event_id", "signal").alias("events"), text("observations", "obs_id", "metric").alias("observations"), F.coalesce(F.size("history"), F.lit(0)).cast("long").alias("history"), F.to_date(F.get("history", 0)["recorded_at"]).alias("first"))


@query("p8_suppressed", "prefs feedback", """
WITH a AS (SELECT owner AS universe, pref_id FROM prefs WHERE lifecycle = 'active' AND (scope = 'universal' OR genre = owner OR genre = (owner + 1) % 5)),
n AS (SELECT pref_id, 'c' || category AS category FROM feedback WHERE signal = 'reject' GROUP BY ALL HAVING count(*) >= 3) SELECT DISTINCT universe, category FROM a JOIN n USING (pref_id)""")
def p8(v: Views):
    from .retrieval_queries import universes

    fits = V.preferences_for(v("prefs"), universes(v), 1 << 30)
    return P.suppressed(fits, v("feedback").withColumn("category", F.concat(F.when(F.col("event_id") % 2 == 0, "C").otherwise("c"), F.col("category").cast("string"))))


@query("p9_scope_rules", "prefs", "SELECT pref_id, CASE WHEN scope = 'universal' THEN '' WHEN pref_id % 4 = 0 THEN '' ELSE 'g' || genre END AS tags, CASE WHEN scope = 'genre_bound' AND pref_id % 4 = 0 THEN 'no tags' WHEN scope = 'genre_bound' AND genre = 4 THEN 'unknown tag' END AS reason FROM prefs")
def p9(v: Views):
    tag = F.concat(F.lit(" g"), F.col("genre").cast("string"), F.lit(" "))
    given = v("prefs").select("pref_id", "scope", F.when(F.col("pref_id") % 4 == 0, F.array(F.lit("  "))).otherwise(F.array(tag, tag)).alias("tags"))
    return P.validate_scope(P.normalize_scope(given), ["g0", "g1", "g2", "g3"]).select("pref_id", F.array_join("tags", ",").alias("tags"), "reason")


_W = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query("p10_filter_notes", "", rf"""
WITH n AS (SELECT doc_id AS note_id, CASE WHEN doc_id % 11 = 0 THEN 'Voice' WHEN doc_id % 3 = 0 THEN 'other' ELSE ' pacing' END AS skill, trim(substr(text, 3, 60)) AS quote, text,
  CASE doc_id % 5 WHEN 0 THEN 'Slow this scene down before the turn' WHEN 1 THEN 'Try: ' || substr(text, 3, 60) WHEN 2 THEN substr(text, 3, 30) || ' and something else that is new here' WHEN 3 THEN ' ' ELSE substr(text, 3, 12) END AS note, 'c' || doc_id % 7 AS category FROM documents),
w AS (SELECT *, {_W.format('note')} AS nw, {_W.format('quote')} AS qw FROM n WHERE trim(skill) IN ('pacing', 'voice', 'Voice') AND quote <> '' AND trim(note) <> '' AND contains(text, quote) AND category <> 'c2' AND lower(trim(skill)) <> 'voice')
SELECT note_id FROM w WHERE NOT (len(nw) >= 4 AND len(qw) >= 4 AND len(list_intersect(list_distinct(nw), list_distinct(qw)))::DOUBLE / least(len(nw), len(qw)) >= 0.8)""")
def p10(v: Views):
    k = F.col("doc_id") % 5
    part = lambda n: F.substring("text", 3, n)
    note = F.when(k == 0, "Slow this scene down before the turn").when(k == 1, F.concat(F.lit("Try: "), part(60))).when(k == 2, F.concat(part(30), F.lit(" and something else that is new here"))).when(k == 3, " ").otherwise(part(12))
    skill = F.when(F.col("doc_id") % 11 == 0, "Voice").when(F.col("doc_id") % 3 == 0, "other").otherwise(" pacing")
    notes = v("documents").select(F.col("doc_id").alias("note_id"), F.col("doc_id").alias("passage_id"), skill.alias("skill"), part(60).alias("quote"), note.alias("note"), F.concat(F.lit("c"), (F.col("doc_id") % 7).cast("string")).alias("category"))
    passages = v("documents").select(F.col("doc_id").alias("passage_id"), "text")
    off = v("region").limit(1).select(F.explode(F.array(F.lit("C2"), F.lit("voice"))).alias("category"))
    return P.filter_notes(notes, passages, ["pacing", "voice", "Voice"], off).select("note_id")


@query("p11_limit_selected", "", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a,c,d' ELSE 'c,a' END AS selected FROM part")
def p11(v: Views):
    asked = F.when(F.col("p_partkey") % 2 == 0, F.array(*[F.lit(x) for x in (" a", "a", "b", "c ", "d", "e")])).otherwise(F.array(*[F.lit(x) for x in ("c", "b", "a", "c")]))
    return P.limit_selected(v("part").select("p_partkey", asked.alias("requested")), ["a", "c", "d", "e"]).select("p_partkey", F.array_join("selected", ",").alias("selected"))
