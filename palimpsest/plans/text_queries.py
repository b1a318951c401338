"""Queries over sources, document structure, style and model output, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import parse as P
from ..operators import structure as S
from ..sources import tables as T
from .fixtures import ENTITY_TYPES, RELATIONS, Views, query

DUCK_WORDS = r"regexp_extract_all({}, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)?')".replace("{L}", "{{L}}").replace("{N}", "{{N}}")


def words(x: str) -> str:
    return DUCK_WORDS.format(x)


def tok(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE strlen({x}) // 4 + 1 END)"


COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in T.TABLES)


@query("s1_table_scan", sql=COUNTS)
def s1(v: Views):
    out = None
    for t in T.TABLES:
        one = v(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("s3_new_jobs", "chapters jobs", """
WITH b AS (SELECT chapter_id AS batch_id, chapter_id % 5 AS universe, sha256(CAST(chapter_id % 700 AS STRING)) AS content_hash FROM chapters),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY universe, content_hash ORDER BY batch_id) = 1)
SELECT batch_id, universe, content_hash FROM f ANTI JOIN (SELECT * FROM jobs WHERE status <> 'failed') j USING (universe, content_hash)""")  # fmt: skip
def s3(v: Views):
    batch = v("chapters").select(F.col("chapter_id").alias("batch_id"), (F.col("chapter_id") % 5).alias("universe"), F.sha2((F.col("chapter_id") % 700).cast("string"), 256).alias("content_hash"))
    return T.new_jobs(batch, v("jobs")).select("batch_id", "universe", "content_hash")


@query("s4_job_view", "jobs", """
SELECT job_id, universe, status, place, CASE WHEN status <> 'pending' THEN CAST(created_at AS DATE) END AS started, CASE WHEN status IN ('completed', 'failed') THEN CAST(created_at AS DATE) END AS completed
FROM (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY created_at DESC, job_id DESC) AS place FROM jobs) AS x WHERE place <= 50""")  # fmt: skip
def s4(v: Views):
    return T.job_view(v("jobs")).select("job_id", "universe", "status", "place", F.to_date("started_at").alias("started"), F.to_date("completed_at").alias("completed"))


def clean(x: str) -> str:
    out = f"""regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g')"""
    return f"CASE WHEN length({out}) <= 160 THEN {out} ELSE '' END"


def is_chapter(x: str) -> str:
    return f"(starts_with(lower({x}), 'chapter ') OR starts_with(lower({x}), 'capítulo ') OR starts_with(lower({x}), 'capitulo '))"


_CASED = r"'^\s*\p{Lu}\p{Ll}*(\s+\p{Lu}\p{Ll}*){0,7}\s*$'"


@query("s5_infer_title", "titled", rf"""
WITH b AS (SELECT doc_id, ext, list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM titled),
m AS (SELECT *, CASE WHEN l[1] = '---' THEN list_filter(l[2:CASE WHEN list_position(l[2:], '---') > 0 THEN list_position(l[2:], '---') ELSE len(l) END], lambda x: contains(x, ':') AND lower(trim(split_part(x, ':', 1))) = 'title')[1] END AS named,
  {clean("substr(list_filter(l, lambda x: starts_with(x, '# '))[1], 3)")} AS h1, {clean('l[1]')} AS first FROM b),
h AS (SELECT doc_id, count(*) AS heads FROM (SELECT doc_id, i, l, CASE WHEN regexp_matches(l[i], '^#{{1,3}} ') THEN {clean("regexp_replace(l[i], '^#{1,3} ', '')")} ELSE l[i] END AS name FROM b, unnest(range(1, len(l) + 1)) AS u(i)) AS x
  WHERE regexp_matches(name, {_CASED}) AND NOT {is_chapter('name')} AND (regexp_matches(l[i], '^#{{1,3}} ') OR ((i = 1 OR l[i - 1] = '') AND coalesce(l[i + 1], '') = '')) GROUP BY doc_id)
SELECT doc_id, CASE WHEN ext = 'md' THEN CASE WHEN named IS NOT NULL THEN {clean("substr(named, strpos(named, ':') + 1)")} WHEN h1 IS NULL OR {is_chapter('h1')} THEN '' ELSE h1 END
  WHEN len(l) > 1 AND l[2] = '' AND NOT {is_chapter('first')} AND coalesce(heads, 0) < 2 THEN first ELSE '' END AS title FROM m LEFT JOIN h USING (doc_id)""")
def s5(v: Views):
    return T.infer_title(v("titled"), ext="ext").select("doc_id", "title")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def duck_map(d: dict[str, str]) -> str:
    return f"map([{', '.join(map(quoted, d))}], [{', '.join(map(quoted, d.values()))}])"


_MARKS = duck_map({name: mark.replace("\n", "\\n") for name, mark in S.MARKS.items()})  # line ends put in afterwards
_ENDS = r"[\s\v\x{85}\p{Z}]+"
#: One reference per piece after an ampersand: number, name, or a name that lacks its semicolon.
_REFERENCE = rf"""CASE WHEN i = 1 THEN p
  WHEN regexp_matches(p, '^#[0-9]+') THEN chr(CAST(regexp_extract(p, '^#([0-9]+)', 1) AS INT)) || regexp_replace(p, '^#[0-9]+;?', '')
  WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]+') THEN chr(CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1) AS INT)) || regexp_replace(p, '^#[xX][0-9a-fA-F]+;?', '')
  WHEN named[regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)] IS NOT NULL THEN named[regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)] || regexp_replace(p, '^[A-Za-z0-9]+;', '')
  WHEN regexp_matches(p, '^({"|".join(X.LOOSE)})') THEN loose[regexp_extract(p, '^({"|".join(X.LOOSE)})', 1)] || regexp_replace(p, '^({"|".join(X.LOOSE)})', '')
  ELSE '&' || p END"""


@query("s6_html_to_markdown", "", rf"""
WITH k AS (SELECT {_MARKS} AS marks, {duck_map(X.NAMED)} AS named, {duck_map({n: X.html5[n] for n in X.LOOSE})} AS loose),
a AS (SELECT page_id, html, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '\r\n?', chr(10), 'g'), {quoted(S.SILENT)}, '', 'g'), {quoted(S.TAG.replace("++", "+").replace("*+", "*"))}, chr(1) || '\1\2' || chr(2), 'g'), chr(1)) AS x FROM pages),
b AS (SELECT page_id, html, array_to_string(list_transform(x, lambda p, i: CASE WHEN i = 1 THEN p ELSE replace(coalesce(marks[lower(split_part(p, chr(2), 1))], ''), '\n', chr(10)) || split_part(p, chr(2), 2) END), '') AS t FROM a, k),
c AS (SELECT page_id, html, array_to_string(list_transform(string_split(t, '&'), lambda p, i: {_REFERENCE}), '') AS t FROM b, k),
d AS (SELECT page_id, html, list_transform(string_split(regexp_replace(t, '\x03\s*', '- ', 'g'), chr(10) || chr(10)), lambda u: regexp_replace(regexp_replace(u, '^{_ENDS}', ''), '{_ENDS}$', '')) AS u FROM c)
SELECT page_id, CASE WHEN contains(html, '<') THEN array_to_string(list_filter(u, lambda y: y <> ''), chr(10) || chr(10)) ELSE coalesce(regexp_replace(regexp_replace(html, '^{_ENDS}', ''), '{_ENDS}$', ''), '') END AS markdown FROM d""")
def s6(v: Views):
    return S.html_to_markdown(v("pages"))


@query("s7_markdown_to_html")
def s7(v: Views):
    return v("manuscripts").select("manuscript", S.markdown_to_html(F.col("text")).alias("html"))


@query("s8_strip_markup", "", r"""
SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS text FROM pages""")  # fmt: skip
def s8(v: Views):
    return v("pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


@query("s9_export_works", "chapters", r"""
SELECT work, order_index // 5 AS part, regexp_replace(lower(work), '[^a-z0-9]+', '-', 'g') || '.md' AS filename,
       CASE WHEN order_index // 5 = 0 THEN '# ' || work ELSE '' END || chr(10) || chr(10) || string_agg('## Chapter ' || order_index || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY order_index) AS markdown FROM chapters GROUP BY work, order_index // 5""")  # fmt: skip
def s9(v: Views):
    return T.export_works(v("chapters"), 5)


@query("s10_upsert", "para_vecs", """
SELECT para_id, CASE WHEN para_id % 3 = 0 THEN chapter_id + 100 ELSE chapter_id END AS chapter_id FROM para_vecs""")
def s10(v: Views):
    base = v("para_vecs").select("para_id", "chapter_id")
    news = base.where("para_id % 3 = 0")
    updates = news.select("para_id", (F.col("chapter_id") + 50).alias("chapter_id"), F.lit(1).cast("long").alias("version")).unionByName(news.select("para_id", (F.col("chapter_id") + 100).alias("chapter_id"), F.lit(2).cast("long").alias("version")))
    return T.upsert(base, updates, ["para_id"])


_NUMBERS = (S._ENGLISH, S._SPANISH)
_HEADS = rf"""l AS (SELECT script, i AS n, x[i] AS line, regexp_replace(x[i], '^\s+|\s+$', '', 'g') AS t FROM (SELECT script, string_split(text, chr(10)) AS x FROM scripts) AS s, unnest(range(1, len(x) + 1)) AS u(i)),
c AS (SELECT *, strlen(t) BETWEEN 3 AND 60 AND NOT regexp_matches(t, '[.!?"»,;:]$') AND NOT regexp_matches(t, '\p{{Ll}}') AND regexp_matches(t, '(\p{{Lu}}[^\p{{Lu}}]*){{3}}') AS cap,
  regexp_matches(line, '^[ \t]*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)[ \t]*$') AS cased, regexp_matches(t, '^\p{{Lu}}\p{{Ll}}*(\s+\p{{Lu}}\p{{Ll}}*){{0,7}}$') AS proper, regexp_matches(t, '^\d{{1,4}}\.?$') AS bare FROM l),
d AS (SELECT *, last_value(CASE WHEN t <> '' THEN {{'cased': cased, 'bare': bare}} END IGNORE NULLS) OVER (PARTITION BY script ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  first_value(CASE WHEN t <> '' THEN proper END IGNORE NULLS) OVER (PARTITION BY script ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next,
  coalesce(lag(t) OVER w, '') = '' AND coalesce(lead(t) OVER w, '') = '' AS alone FROM c WINDOW w AS (PARTITION BY script ORDER BY n)),
k AS (SELECT DISTINCT script, unnest(list_filter(string_split_regex(s, '[^\p{{L}}]+'), lambda x: x <> '')[2:]) AS name FROM (SELECT script, unnest(string_split_regex(line, '[.!?]')) AS s FROM c WHERE NOT cap) AS p),
h AS (SELECT d.script, n, line, t, cased, bare, [
  regexp_matches(line, '^#{{1,3}} (.+)$'), regexp_matches(line, '(?i)^[ \t]*(chapter[ \t]+(?:\d+|[ivxlc]+|{_NUMBERS[0]})\b.*)$'), regexp_matches(line, '(?i)^[ \t]*(cap[ií]tulo[ \t]+(?:\d+|[ivxlc]+|{_NUMBERS[1]})\b.*)$'),
  regexp_matches(line, '^[ \t]*([IVXLC]{{1,7}}\.?)[ \t]*$'), regexp_matches(t, '(?i)^(pr[oó]logo|prologue|ep[ií]logo|epilogue)(\s*:\s*.+)?$') OR (bare AND coalesce(next, false)), cased AND NOT coalesce(prev.cased, false),
  cap AND (length(t) >= 10 OR name IS NOT NULL) AND (strlen(t) >= 10 OR alone)] AS heads, proper AND coalesce(prev.bare, false) AS tail
  FROM d LEFT JOIN k ON k.script = d.script AND k.name = upper(substr(t, 1, 1)) || lower(substr(t, 2)) AND cap AND length(t) < 10 AND NOT contains(t, ' '))"""
_CLASSES = "['" + "', '".join(S.CLASSES) + "']"


@query("t1_heading_lines", "scripts", f"WITH {_HEADS} SELECT script, n - 1 AS line_no, line, {_CLASSES}[i] AS class FROM h, unnest(range(1, 8)) AS u(i) WHERE heads[i]")
def t1(v: Views):
    return S.heading_lines(v("scripts"), "script")


def packed(source: str, most: int, between: str) -> str:
    """Greedy packing of ``text`` by ``id``, by recursion over its paragraphs."""
    return rf"""pt AS (SELECT id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM {source}),
pp AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS k, p FROM (SELECT id, i, regexp_replace(x[i], '^\s+|\s+$', '', 'g') AS p FROM (SELECT id, string_split(body, {between}) AS x FROM pt WHERE strlen(body) > {most}) AS s, unnest(range(1, len(x) + 1)) AS u(i)) AS q WHERE p <> ''),
pg AS (SELECT id, k, p, 0 AS part, strlen(p) AS size FROM pp WHERE k = 1 UNION ALL
SELECT pp.id, pp.k, pp.p, CASE WHEN size + strlen(pp.p) > {most} THEN part + 1 ELSE part END, CASE WHEN size + strlen(pp.p) > {most} THEN strlen(pp.p) ELSE size + strlen({between}) + strlen(pp.p) END FROM pg JOIN pp ON pp.id = pg.id AND pp.k = pg.k + 1),
packed AS (SELECT id, 0 AS part, 'Untitled' AS title, body FROM pt WHERE body <> '' AND strlen(body) <= {most} UNION ALL SELECT id, part, 'Part ' || (part + 1), string_agg(p, {between} ORDER BY k) FROM pg GROUP BY id, part)"""


_NL2 = "chr(10) || chr(10)"


@query("t2_split_chapters", "scripts", rf"""
WITH RECURSIVE {_HEADS},
n AS (SELECT script, [count(*) FILTER (heads[1]), count(*) FILTER (heads[2]), count(*) FILTER (heads[3]), count(*) FILTER (heads[4]), count(*) FILTER (heads[5]), count(*) FILTER (heads[6]), count(*) FILTER (heads[7])] AS n FROM h GROUP BY script),
z AS (SELECT script, list_filter(range(1, 8), lambda i: n[i] BETWEEN CASE i WHEN 5 THEN 1 ELSE 2 END AND 500)[1] AS z FROM n),
q AS (SELECT h.*, z, count(*) FILTER (heads[z]) OVER (PARTITION BY script ORDER BY n) AS seq, heads[z] OR (z = 5 AND tail) OR (z = 6 AND cased) AS inside FROM h JOIN z USING (script) WHERE z IS NOT NULL),
e AS (SELECT *, seq > 0 AND n <= max(CASE WHEN inside THEN n END) OVER (PARTITION BY script, seq) AS head FROM q),
parts AS (SELECT script, seq, CASE WHEN seq = 0 THEN 'Front Matter' ELSE regexp_replace(coalesce(string_agg(CASE WHEN z = 1 THEN regexp_replace(line, '^#+ ', '') WHEN z = 5 AND bare THEN NULL ELSE line END, chr(10) ORDER BY n) FILTER (head), ''), '^\s+|\s+$', '', 'g') END AS title,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT coalesce(head, false)), ''), '^\s+|\s+$', '', 'g') AS body FROM e GROUP BY script, seq),
rest AS (SELECT script AS id, text FROM scripts JOIN z USING (script) WHERE z IS NULL), {packed('rest', 2000, _NL2)}
SELECT script, seq, title, body FROM parts WHERE body <> '' UNION ALL SELECT id, part, title, body FROM packed""")
def t2(v: Views):
    return S.split_chapters(v("scripts"), "script", most=2000)


@query("t3_pack_paragraphs", "chapters", f"WITH RECURSIVE c AS (SELECT chapter_id AS id, text FROM chapters), {packed('c', 2000, 'chr(10)')} SELECT id AS chapter_id, part, title, body FROM packed")
def t3(v: Views):
    return S.pack_paragraphs(v("chapters"), "chapter_id", most=2000, between="\n")


_WHITE = r"[\s\v\x{85}\p{Z}]+"


@query("t4_paragraphs", "broken", rf"""
WITH p AS (SELECT chapter_id, i - 1 AS paragraph_index, parts[i] AS part FROM (SELECT chapter_id, string_split(text, chr(10) || chr(10)) AS parts FROM broken) AS c, unnest(range(1, len(parts) + 1)) AS u(i)),
o AS (SELECT *, coalesce(sum(strlen(part) + 2) OVER (PARTITION BY chapter_id ORDER BY paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(part) - strlen(regexp_replace(part, '^{_WHITE}', '')) AS off, regexp_replace(regexp_replace(part, '^{_WHITE}', ''), '{_WHITE}$', '') AS body FROM p)
SELECT chapter_id, paragraph_index, CAST(off AS BIGINT) AS "offset", body AS text FROM o WHERE body <> '' AND strlen(body) <= 30000""")  # fmt: skip
def t4(v: Views):
    return S.paragraphs(v("broken"), ["chapter_id"])


@query("t5_word_count", "chapters", r"SELECT chapter_id, len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')) AS n_words FROM chapters")
def t5(v: Views):
    return v("chapters").select("chapter_id", X.word_count(F.col("text")).alias("n_words"))


@query("t6_locate_mentions", "paragraphs asked", """
WITH j AS (SELECT n.chapter_id, name, paragraph_index, text, strpos(lower(text), lower(name)) AS pos FROM asked n JOIN paragraphs USING (chapter_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY chapter_id, name ORDER BY pos = 0, paragraph_index) AS k FROM j)
SELECT chapter_id, name, paragraph_index, pos - 1 AS "at", substr(text, greatest(pos - 1 - 80, 0) + 1, 240) AS snippet FROM r WHERE k = 1""")  # fmt: skip
def t6(v: Views):
    return S.locate_mentions(v("asked"), v("paragraphs").select("chapter_id", "paragraph_index", "text"), ["chapter_id"]).select("chapter_id", "name", "paragraph_index", "at", X.snippet(F.col("text"), F.col("at")).alias("snippet"))


@query("t7_snippet", "paragraphs", "SELECT chapter_id, paragraph_index, substr(text, greatest(length(text) // 2 - 80, 0) + 1, 240) AS snippet FROM paragraphs")
def t7(v: Views):
    return v("paragraphs").select("chapter_id", "paragraph_index", X.snippet(F.col("text"), F.floor(F.char_length("text") / 2).cast("int")).alias("snippet"))


_PIECE = "'[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]'".replace("\\\\", "\\")


def is_word(x: str) -> str:
    return rf"coalesce(regexp_matches({x}, '^[\p{{L}}\p{{N}}_]'), false)"


@query("t8_match_gazetteer", "paragraphs lexicon", rf"""
WITH RECURSIVE k AS (SELECT min(entity_id) AS entity_id, regexp_extract_all(norm, {_PIECE}) AS b FROM (SELECT entity_id, lower(regexp_replace(name, '^\s+|\s+$', '', 'g')) AS norm FROM lexicon) AS x WHERE norm <> '' GROUP BY norm),
p AS (SELECT chapter_id * 100000 + paragraph_index AS para, text, regexp_extract_all(lower(text), {_PIECE}) AS w FROM paragraphs),
best AS (SELECT para, i, i + len(b) AS e, entity_id FROM p, unnest(range(1, len(w) + 1)) AS u(i) JOIN k ON b[1] = w[i] WHERE w[i:i + len(b) - 1] = b AND NOT (i > 1 AND {is_word('w[i - 1]')}) AND NOT {is_word('w[i + len(b)]')} QUALIFY row_number() OVER (PARTITION BY para, i ORDER BY len(b) DESC) = 1),
g AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY para ORDER BY i) = 1 UNION ALL
SELECT para, i, e, entity_id FROM (SELECT best.*, row_number() OVER (PARTITION BY best.para ORDER BY best.i) AS n FROM g JOIN best ON best.para = g.para AND best.i > g.e) AS x WHERE n = 1),
s AS (SELECT para, entity_id, length(array_to_string(w[1:i - 1], '')) AS start, length(array_to_string(w[1:e - 1], '')) AS "end", text FROM g JOIN p USING (para))
SELECT para, entity_id, start, "end", substr(text, start + 1, "end" - start) AS form FROM s""")
def t8(v: Views):
    paras = v("paragraphs").select((F.col("chapter_id") * 100000 + F.col("paragraph_index")).alias("para"), "text")
    return S.match_gazetteer(paras, v("lexicon"), "para")


@query("t9_truncate_to_tokens", "paragraphs", f"""
WITH p AS (SELECT chapter_id, paragraph_index, text, sum({tok('text')}) OVER w AS used, row_number() OVER w AS n FROM paragraphs WINDOW w AS (PARTITION BY chapter_id ORDER BY paragraph_index))
SELECT chapter_id, paragraph_index, CASE WHEN used <= 100 THEN text ELSE substr(text, 1, list_max(list_filter(range(99, 400), lambda i: strlen(substr(text, 1, i)) <= 399))) END AS text FROM p WHERE used <= 100 OR n = 1""")
def t9(v: Views):
    return S.truncate_to_tokens(v("paragraphs").select("chapter_id", "paragraph_index", "text"), "chapter_id", "paragraph_index", 100)


@query("t10_cap_corpus", "chapters", """
WITH c AS (SELECT work, order_index, text, CAST(12000 - coalesce(sum(strlen(text) + 2) OVER (PARTITION BY work ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest FROM chapters)
SELECT work, order_index, CASE WHEN strlen(text) <= rest THEN text ELSE substr(text, 1, coalesce(list_max(list_filter(range(greatest(rest // 4 - 1, 1), rest + 1), lambda i: strlen(substr(text, 1, i)) <= rest)), 0)) END AS text FROM c WHERE rest > 0""")
def t10(v: Views):
    return S.cap_corpus(v("chapters").select("work", "order_index", "text"), "work", "order_index")


@query("t11_count_tokens", "chapters", f"SELECT chapter_id, {tok('text')} AS tokens FROM chapters")
def t11(v: Views):
    return v("chapters").select("chapter_id", X.count_tokens(F.col("text")).alias("tokens"))


@query("t12_conversation_tokens", "turns", f"""SELECT conv_id, CAST(2 + sum(4 + {tok('role')} + {tok('text')} + CASE WHEN role = 'assistant' THEN {tok('calls')} ELSE 0 END) AS BIGINT) AS tokens
FROM (SELECT *, '[{{"name": "' || conv_id || '"}}]' AS calls FROM turns) AS t GROUP BY conv_id""")
def t12(v: Views):
    calls = F.when(F.col("role") == "assistant", F.concat(F.lit('[{"name": "'), F.col("conv_id").cast("string"), F.lit('"}]')))
    return S.conversation_tokens(v("turns").withColumn("calls", calls), "calls")


@query("t13_compaction_plan", "turns", f"""
WITH c AS (SELECT conv_id, 2 + sum(4 + {tok('role')} + {tok('text')}) AS tokens, coalesce(max(CASE WHEN role = 'assistant' THEN turn END), 0) AS boundary FROM turns GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN tokens * 100 <= 80 * 600 OR boundary <= 2 OR turn < 2 THEN 'keep' WHEN turn <= boundary THEN 'summarize' ELSE 'tail' END AS action FROM turns JOIN c USING (conv_id)""")
def t13(v: Views):
    return S.compaction_plan(v("turns"), 600)


@query("t14_short_title", "", """
WITH b AS (SELECT item_id, text, least(CASE WHEN strpos(text, '. ') > 0 THEN strpos(text, '. ') END, CASE WHEN strpos(text, '; ') > 0 THEN strpos(text, '; ') END,
  CASE WHEN strpos(text, ': ') > 0 THEN strpos(text, ': ') END, CASE WHEN strpos(text, ', ') > 0 THEN strpos(text, ', ') END) AS c FROM benchmark)
SELECT item_id, CASE WHEN strlen(text) > 60 THEN substr(text, 1, list_max(list_filter(range(14, 60), lambda i: strlen(substr(text, 1, i)) <= 59))) || '…' ELSE text END AS cut,
       CASE WHEN length(text) <= 80 THEN text WHEN c <= 90 THEN substr(text, 1, c - 1) ELSE regexp_replace(substr(text, 1, 80), '\\s+\\S*$', '') END AS title FROM b""")
def t14(v: Views):
    return v("benchmark").select("item_id", X.truncate(F.col("text"), 60).alias("cut"), X.short_title(F.col("text")).alias("title"))


@query("y1_tokens", "chapters", f"SELECT chapter_id, array_to_string({words('text')}, ' ') AS tokens FROM chapters")
def y1(v: Views):
    return v("chapters").select("chapter_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query("y2_sentence_lengths", "chapters", f"SELECT chapter_id, array_to_string(list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda s: len({words('s')})), lambda n: n > 0), ',') AS lengths FROM chapters")
def y2(v: Views):
    return v("chapters").select("chapter_id", F.array_join(X.sentence_lengths(F.col("text")).cast("array<string>"), ",").alias("lengths"))


_ADVERBS = ", ".join(f"'{a}'" for a in X.ADVERBS)
_PROFILE = f"""
s AS (SELECT chapter_id, universe, len(w) AS n_words, len(list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda s: len({words('s')})), lambda n: n > 0)) AS n_sentences,
  len(list_filter(w, lambda x: (ends_with(lower(x), 'ly') AND length(x) > 3) OR lower(x) IN ({_ADVERBS}))) AS n_adverbs,
  coalesce(list_sum(list_transform(range(2, len(q), 2), lambda i: len({words('q[i]')}))), 0)::BIGINT AS n_quoted, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_distinct
  FROM (SELECT *, {words('text')} AS w, string_split_regex(text, '["“”]') AS q FROM chapters) AS c)"""


@query("y3_adverb_density", "chapters", f"WITH {_PROFILE} SELECT chapter_id, CASE WHEN n_words > 0 THEN round(100.0::DOUBLE * n_adverbs / n_words, 6) ELSE 0 END AS density FROM s")
def y3(v: Views):
    w = X.tokens(F.col("text"))
    return v("chapters").select("chapter_id", X.share(X.adverbs(w), F.size(w), 100).alias("density"))


@query("y4_dialogue_ratio", "chapters", f"WITH {_PROFILE} SELECT chapter_id, CASE WHEN n_words > 0 THEN round(n_quoted::DOUBLE / n_words, 6) ELSE 0 END AS ratio FROM s")
def y4(v: Views):
    return v("chapters").select("chapter_id", X.share(X.quoted_words(F.col("text")), F.size(X.tokens(F.col("text")))).alias("ratio"))


@query("y5_lexical_richness", "chapters", f"WITH {_PROFILE} SELECT chapter_id, CASE WHEN n_words > 0 THEN round(n_distinct::DOUBLE / n_words, 6) ELSE 0 END AS richness FROM s")
def y5(v: Views):
    c = X.stylometry(F.col("text"))
    return v("chapters").select("chapter_id", X.share(c["n_distinct"], c["n_words"]).alias("richness"))


_METRICS = "round({w}::DOUBLE / greatest({s}, 1), 6) AS sentence_length, round(100.0::DOUBLE * {a} / greatest({w}, 1), 6) AS adverb_density, round({q}::DOUBLE / greatest({w}, 1), 6) AS dialogue_ratio, round({d}::DOUBLE / greatest({w}, 1), 6) AS lexical_richness"


def metrics(n: dict):
    return [X.share(n["n_words"], n["n_sentences"]).alias("sentence_length"), X.share(n["n_adverbs"], n["n_words"], 100).alias("adverb_density"), X.share(n["n_quoted"], n["n_words"]).alias("dialogue_ratio"), X.share(n["n_distinct"], n["n_words"]).alias("lexical_richness")]


@query("y6_stylometry", "chapters", f"WITH {_PROFILE} SELECT chapter_id, n_words, n_sentences, {_METRICS.format(w='n_words', s='n_sentences', a='n_adverbs', q='n_quoted', d='n_distinct')} FROM s")
def y6(v: Views):
    told = v("chapters").select("chapter_id", *[c.alias(n) for n, c in X.stylometry(F.col("text")).items()])
    names = ("n_words", "n_sentences", "n_adverbs", "n_quoted", "n_distinct")
    return told.select("chapter_id", "n_words", "n_sentences", *metrics({n: F.col(n) for n in names}))


def corpus_profile(chapters, by: str):
    """One sample over all texts of an owner; distinct words are counted over the owner."""
    sums = chapters.select(by, *[c.alias(n) for n, c in X.stylometry(F.col("text")).items() if n != "n_distinct"]).groupBy(by).agg(*[F.sum(n).alias(n) for n in ("n_words", "n_sentences", "n_adverbs", "n_quoted")])
    distinct = chapters.select(by, F.explode(F.transform(X.tokens(F.col("text")), F.lower)).alias("w")).distinct().groupBy(by).agg(F.count("*").alias("n_distinct"))
    told = sums.join(distinct, by, "left").fillna(0, ["n_distinct"])
    return told.select(by, "n_words", *metrics({n: F.col(n) for n in told.columns if n.startswith("n_")}))


_CORPUS = f"""{_PROFILE}, t AS (SELECT universe, sum(n_words) AS w, sum(n_sentences) AS s, sum(n_adverbs) AS a, sum(n_quoted) AS q FROM s GROUP BY universe),
d AS (SELECT universe, count(DISTINCT lower(x)) AS d FROM (SELECT universe, unnest({words('text')}) AS x FROM chapters) AS u GROUP BY universe)"""


@query("y7_stylometry_corpus", "chapters", f"WITH {_CORPUS} SELECT universe, CAST(w AS BIGINT) AS n_words, {_METRICS.format(w='w', s='s', a='a', q='q', d='d')} FROM t JOIN d USING (universe)")
def y7(v: Views):
    return corpus_profile(v("chapters"), "universe")


@query("y8_observations", "chapters", f"""WITH {_CORPUS}, m AS (SELECT universe, CAST(w AS BIGINT) AS sample_size, {_METRICS.format(w='w', s='s', a='a', q='q', d='d')} FROM t JOIN d USING (universe))
SELECT universe, sample_size, metric, value FROM m UNPIVOT (value FOR metric IN (sentence_length, adverb_density, dialogue_ratio, lexical_richness))""")
def y8(v: Views):
    told = corpus_profile(v("chapters"), "universe").withColumnRenamed("n_words", "sample_size")
    return told.unpivot(["universe", "sample_size"], ["sentence_length", "adverb_density", "dialogue_ratio", "lexical_richness"], "metric", "value")


def extractions(v: Views):
    """JSON made from parts: a type of five goes to a category, every third confidence is left out."""
    e = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.when(F.col("p_size") % 4 == 0, "archived").otherwise("active").alias("status"), F.when(F.col("p_partkey") % 3 != 0, (F.col("p_size") % 13) / 10.0).alias("confidence"))
    cats = [F.when(F.col("p_partkey") % 7 == i, F.array(e)).otherwise(F.array().cast("array<struct<name:string,description:string,status:string,confidence:double>>")).alias(c) for i, c in enumerate(P.CATEGORIES)]
    return v("part").select("p_partkey", F.to_json(F.struct(*cats)).alias("raw"))


_X1 = f"SELECT p_partkey, CASE p_partkey % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{t}{chr(39)}' for i, t in enumerate(ENTITY_TYPES))} END AS type, p_name AS name, p_brand AS description, CASE WHEN p_size % 4 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN p_partkey % 3 <> 0 THEN (p_size % 13)::DOUBLE / 10 END AS confidence FROM part"


@query("x1_flatten_extractions", "", _X1)
def x1(v: Views):
    return P.flatten_extractions(extractions(v), "p_partkey", "raw").drop("seq")


@query("x2_parse_json_loose", "", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events")
def x2(v: Views):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("no json")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.col("props"))
    return v("events").select("event_id", P.parse_json_loose(raw, "struct<k:bigint>")["k"].alias("k"))


_KINDS = ", ".join(f"'{r}'" for r in RELATIONS[:12])


@query("x3_validate_relations", "edges", f"SELECT rel_type, CASE WHEN src % 10 = 0 THEN 'missing end' WHEN rel_type NOT IN ({_KINDS}) THEN 'unknown type' ELSE 'ok' END AS reason, count(*) AS n FROM edges GROUP BY 1, 2")
def x3(v: Views):
    given = v("edges").withColumn("src", F.when(F.col("src") % 10 != 0, F.col("src")))
    good, bad = P.validate_relations(given, RELATIONS[:12])
    return good.withColumn("reason", F.lit("ok")).unionByName(bad).groupBy("rel_type", "reason").agg(F.count("*").alias("n"))


@query("x3_validate_entities", "", f"SELECT reason, type, count(*) AS n FROM (SELECT CASE p_partkey % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{t}{chr(39)}' for i, t in enumerate(ENTITY_TYPES))} END AS type, CASE WHEN p_partkey % 6 = 0 THEN 'empty name' WHEN p_partkey % 7 >= 5 THEN 'unknown type' ELSE 'ok' END AS reason FROM part) AS x GROUP BY ALL")
def x3b(v: Views):
    given = P.flatten_extractions(extractions(v), "p_partkey", "raw").withColumn("name", F.when(F.col("p_partkey") % 6 != 0, F.col("name")).otherwise("  "))
    good, bad = P.validate_entities(given, ENTITY_TYPES[:5])
    return good.withColumn("reason", F.lit("ok")).unionByName(bad).groupBy("reason", "type").agg(F.count("*").alias("n"))


@query("x4_gate", "", f"WITH x AS ({_X1}), y AS (SELECT p_partkey, least(coalesce(confidence, 1), 1) AS confidence FROM x) SELECT p_partkey, confidence, CASE WHEN confidence < 0.7::DOUBLE THEN 'candidate' ELSE 'active' END AS status FROM y")
def x4(v: Views):
    return P.gate(P.flatten_extractions(extractions(v), "p_partkey", "raw")).select("p_partkey", "confidence", "status")


@query("x5_normalize_taxonomy", "", "SELECT p_partkey, CASE lower(trim(p_type)) WHEN 'economy' THEN 'object' WHEN 'standard' THEN 'place' WHEN 'promo' THEN 'faction' ELSE 'event' END AS kind FROM part")
def x5(v: Views):
    return v("part").select("p_partkey", P.normalize_taxonomy(F.col("p_type"), {"economy": "object", "standard": "place", "promo": "faction"}, "event").alias("kind"))


@query("x6_valid_identifier", "", "SELECT p_partkey, regexp_full_match(p_type, '[A-Za-z_][A-Za-z0-9_]*') AS type_ok, regexp_full_match(p_brand, '[A-Za-z_][A-Za-z0-9_]*') AS brand_ok FROM part")
def x6(v: Views):
    return v("part").select("p_partkey", P.valid_identifier(F.col("p_type")).alias("type_ok"), P.valid_identifier(F.col("p_brand")).alias("brand_ok"))


@query("x7_guard_dims", "para_vecs", "SELECT para_id, para_id % 9 <> 0 AS ok FROM para_vecs")
def x7(v: Views):
    good, bad = P.guard_dims(v("para_vecs").withColumn("embedding", F.when(F.col("para_id") % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))), 64)
    return good.select("para_id", F.lit(True).alias("ok")).unionByName(bad.select("para_id", F.lit(False).alias("ok")))


@query("x8_properties", "", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k_number FROM events")
def x8(v: Views):
    return v("events").select("event_id", P.prop(F.col("props"), "k").alias("k"), P.num_prop(F.col("props"), "k").alias("k_number"))
