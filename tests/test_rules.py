"""Cases that tell rules apart: headings, names in texts, phrases, containment, prefixes, merged fields, clones, injected models."""

import html
import html.entities

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import feedback as P
from palimpsest.operators import resolve as R
from palimpsest.operators import retrieval as V
from palimpsest.operators import stages
from palimpsest.operators import structure as S
from palimpsest.plans.fixtures import Views
from palimpsest.sources import scratch
from palimpsest.sources import tables as T


def split(spark, texts, **more):
    rows = S.split_chapters(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", **more).orderBy("id", "seq").collect()
    return {i: [(r.title, r.body) for r in rows if r.id == i] for i in range(len(texts))}


def test_chapter_cascade(spark):
    got = split(spark, [
        "no heading here\n\nat all", "preface\n\n## One\n\na\n\n### Two\n\nb", "Chapter One\na\nchapter 2: more\nb\n# single", "HOLDEN\n\nHe spoke to Holden. No.\n\nYES\n\nMILLER\n\nthen Miller left.\n\nNO\n\nend",
        "Prologue: Julie\n\na\n\n1\n\nHolden\n\nb\n\n2.\n\nThe Long Road\n\nc", "Holden\n\nMiller\n\na\n\nThe Road\n\nb", "I\n\na\n\nII.\n\nb", "Capítulo uno\na\nCAPITULO DOS\nb", "THE LONG ROAD HOME\na\nTHE WAY BACK AGAIN\nb", " \n ", "x " * 40,
    ], most=50)
    assert got[0] == [("Untitled", "no heading here\n\nat all")]
    assert got[1] == [("Front Matter", "preface"), ("One", "a"), ("Two", "b")]
    assert got[2] == [("Chapter One", "a"), ("chapter 2: more", "b\n# single")]
    assert got[3] == [("HOLDEN", "He spoke to Holden. No.\n\nYES"), ("MILLER", "then Miller left.\n\nNO\n\nend")]
    assert got[4] == [("Prologue: Julie", "a"), ("Holden", "b"), ("The Long Road", "c")]
    assert got[5] == [("Holden\n\nMiller", "a"), ("The Road", "b")]
    assert got[6] == [("I", "a"), ("II.", "b")] and got[7] == [("Capítulo uno", "a"), ("CAPITULO DOS", "b")]
    assert got[8] == [("THE LONG ROAD HOME", "a"), ("THE WAY BACK AGAIN", "b")]
    assert got[9] == [] and got[10] == [("Part 1", ("x " * 40).strip())]


def test_names_in_texts(spark):
    names = [(1, "alpha beta"), (2, "beta gamma delta"), (3, "house of the rising sun"), (4, "Jean-Luc"), (5, "Ann"), (7, "ann"), (6, "J.R."), (8, " ")]
    paras = [(1, "Alpha beta gamma delta"), (2, "the House of the Rising Sun, Jean-Luc!"), (3, "Annex Ann ann_ joann ANN"), (4, "by J.R.Tolkien and J.R. too"), (5, ""), (6, "beta gamma delta alpha beta")]
    rows = S.match_gazetteer(spark.createDataFrame(paras, "para int, text string"), spark.createDataFrame(names, "entity_id long, name string"), "para")
    got = sorted((r.para, r.start, r.end, r.entity_id, r.form) for r in rows.collect())
    assert got == [
        (1, 0, 10, 1, "Alpha beta"), (2, 4, 27, 3, "House of the Rising Sun"), (2, 29, 37, 4, "Jean-Luc"), (3, 6, 9, 5, "Ann"), (3, 21, 24, 5, "ANN"),
        (4, 19, 23, 6, "J.R."), (6, 0, 16, 2, "beta gamma delta"), (6, 17, 27, 1, "alpha beta"),
    ]


def test_longest_prefix(spark):
    rows = [("é" * 900,), ("a" * 900,), ("日本語" * 300,), ("a😀" * 300,), ("short",)]
    for budget in (1, 7, 100):
        for r in spark.createDataFrame(rows, "t string").select("t", X.longest_prefix(F.col("t"), budget).alias("p")).collect():
            fits = [n for n in range(len(r.t) + 1) if n == 0 or len(r.t[:n].encode()) // 4 + 1 <= budget]
            assert r.p == r.t[: fits[-1]]


def test_keyword_rules(spark):
    paras = spark.createDataFrame([(1, 0, "a zebra"), (2, 0, "The lord of the rings"), (3, 0, "lord rings of"), (4, 0, "rings, said the lord of mice"), (5, 1, "a zebra")], "para_id long, universe long, text string")
    asked = {1: "zebra", 2: '"lord of the rings"', 3: "lord -mice", 4: "zebra OR mice", 5: '"of the"', 6: "lord rings"}
    queries = spark.createDataFrame([(q, 0, t) for q, t in asked.items()], "query_id long, universe long, text string")
    hits = lambda **more: {q: sorted(r.para_id for r in V.keyword_search(queries, paras, 10, **more).where(F.col("query_id") == q).collect()) for q in asked}
    assert hits() == {1: [1], 2: [2], 3: [2, 3], 4: [1, 4], 5: [], 6: [2, 3, 4]}
    assert hits(own=False)[1] == [] and hits(own=False)[2] == []


def test_containment_and_prefixes(spark):
    ents = spark.createDataFrame([(1, 1, "p", "Anna", ["The Bold One", "Bold"]), (2, 1, "p", "X", ["Y Z"]), (3, 1, "q", "Anna", [])], "entity_id long, universe int, type string, name string, aliases array<string>")
    asked = spark.createDataFrame([(10, 1, "p", "Joanna"), (11, 1, "p", "an"), (12, 1, "p", "Maximilian"), (13, 1, "q", "Hannah Anna"), (14, 2, "p", "Anna"), (15, 1, "p", "")], "mention_id long, universe int, type string, name string")
    assert {r.mention_id: r.entity_id for r in R.match_fuzzy(asked, ents).collect()} == {10: 1, 11: 1, 12: 2, 13: 3}
    names = spark.createDataFrame([("The Bold",), ("the  bold one",), ("Bol",), ("anna",), ("Y",)], "name string")
    assert {r.name: (r.entity_id, r.reason) for r in R.resolve_relation_names(names, ents).collect()} == {"The Bold": (1, "prefix"), "the  bold one": (1, "exact"), "Bol": (None, "unknown"), "anna": (None, "ambiguous"), "Y": (2, "prefix")}


def test_rewrites(spark):
    rows = [("one two three four", "one two three four five six", True), ("one two three", "one two three", False), ("one one one one", "one two three four", False), ("a b c d x", "a b c d e", True), ("a b c y x", "a b c d e", False)]
    got = spark.createDataFrame(rows, "note string, quote string, want boolean").select("want", P.is_rewrite(F.col("note"), F.col("quote")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_clones_leave_nothing_dangling(spark):
    a = spark.createDataFrame([(1, "u"), (2, "u")], "id long, universe string")
    b = spark.createDataFrame([(7, 1, [2, 9, 1], "f"), (8, 9, [], "")], "id long, a_id long, many array<long>, fingerprint string")
    e = spark.createDataFrame([(1, 2), (1, 9)], "src long, dst long")
    out, skipped = R.clone_universe({"a": R.Cloned(a, "id"), "b": R.Cloned(b, "id", {"a_id": "a"}, {"many": "a"}, "fingerprint"), "e": R.Cloned(e, None, {"src": "a", "dst": "a"}, linked=True)}, "t")
    ids = {r.id for r in out["a"].collect()}
    rows = sorted(out["b"].collect(), key=lambda r: r.fingerprint)
    assert len(ids) == 2 and {r.universe for r in out["a"].collect()} == {"t"}
    assert [(r.a_id in ids, len(r.many), r.fingerprint) for r in rows] == [(False, 0, ""), (True, 2, "f:t")] and set(rows[1].many) == ids and rows[0].a_id is None
    assert out["e"].count() == 1 and [tuple(r) for r in skipped.collect()] == [("e", 1)]


def test_injected_models(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}") for i in range(60)], "id long, text string").repartition(2)
    sizes = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert 0 < len(texts) <= 10
        sizes.add(1)
        return [[float(len(t))] for t in texts]

    got = {r.id: r.v for r in stages.apply_model(df, embed, "text", "v", "array<double>").collect()}
    assert got == {i: None if i % 7 == 0 else [float(len(f"t{i}"))] for i in range(60)} and sizes.value >= 6
    with pytest.raises(Exception, match="answered"):
        stages.apply_model(df, lambda x: x[:1], "text", "v", "string").collect()


def test_markdown_and_html(spark):
    pages = spark.createDataFrame([(1, "<h1>T</h1><p>a <b>b</b> &amp; <i>c</i><br>d</p><script>x</script><hr><ul><li>e<li>f</ul>"), (2, None)], "page_id long, html string")
    got = {r.page_id: r.markdown for r in S.html_to_markdown(pages).collect()}
    assert got == {1: "# T\n\na **b** & *c*\nd\n\n---\n\n- e\n- f", 2: ""}
    text = "# T\n\na **b** & *c*\nd < e\n\n***\n\n### S"
    assert spark.range(1).select(S.markdown_to_html(F.lit(text)).alias("h")).first().h == "<h1>T</h1>\n<p>a <strong>b</strong> &amp; <em>c</em><br>d &lt; e</p>\n<hr>\n<h3>S</h3>"


def test_character_references_as_the_standard_library_reads_them(spark):
    texts = ["a &amp; b", "&lt;&gt;", "&#8212;&#x2014;&#X41;", "&#128;&#150;", "&nbsp;x", "&ampx &copy 2", "&notit; &unknown; & x", "&#0;&#xD800;&#99999999999;", "&", "&&amp;amp;", "", "&NotEqualTilde;", "&#x1F600;", "é&eacute"]
    texts += [f"&{name}" for name in sorted(html.entities.html5)[::40]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)  # not a local table: the expressions run as on any other
    assert {r.t: r.d for r in rows.select("t", X.decode_references(F.col("t")).alias("d")).collect()} == {t: html.unescape(t) for t in texts}


def test_markdown_of_odd_pages(spark):
    given = {
        "<ul><li><p>x</p></li><li><p>y</p></li></ul>z": "- x\n\n- y\n\nz", "a<a href='x>y'>b</a><!-- <p> --><img alt=\"unclosed><p>c": "ab\n\nc", " plain &lt;\n": "plain &lt;",
        "<P CLASS='q'>up</P><STYLE>p{}</STYLE><blockquote>t</blockquote>u": "up\n\nt\n\nu", "<script>never closed <p>x": "", "<p>" + "w " * 200000 + "</p>": ("w " * 200000).strip(), "<b></b>": "****", "": "",
        "<p " + "a='1' " * 3000 + ">x": "x",
    }
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, html string").repartition(2)
    got = {r.page_id: r.markdown for r in S.html_to_markdown(pages).collect()}
    assert got == dict(enumerate(given.values()))
    assert S.html_to_markdown(pages.limit(0)).count() == 0


def test_chapters_of_odd_texts(spark):
    got = split(spark, [None, "", "\n\n", "## A\n## B", "## A\nx\n## B\n\n", "w " * 100000 + "\n## A\nx\n## B\ny"])
    assert [got[i] for i in range(5)] == [[], [], [], [], [("A", "x")]]
    assert [t for t, _ in got[5]] == ["Front Matter", "A", "B"]
    same = spark.createDataFrame([(1, "## A\nx\n## B\ny", 0)] * 2, "id int, text string, lines int")  # repeated rows, and a column called as one of ours
    assert sorted((r.seq, r.title, r.body) for r in S.split_chapters(same, "id").collect()) == [(1, "A", "x")] * 2 + [(2, "B", "y")] * 2


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_approximate_search_recall_at_two_scales(spark, sf):
    v = Views(spark, f"/root/testdata/sf{sf}")
    exact = V.vector_topk(v("query_vecs"), v("para_vecs"), 10, own=False).select("query_id", "para_id")
    near = V.ann_topk(v("query_vecs"), v("para_vecs"), 10, own=False).select("query_id", "para_id")
    assert exact.join(near, ["query_id", "para_id"]).count() >= 0.9 * exact.count()


def test_exported_parts_make_the_file(spark):
    rows = [("A b", i, f"text {i}") for i in range(7)]
    parts = T.export_works(spark.createDataFrame(rows, "work string, order_index long, text string"), 3).orderBy("part").collect()
    assert [r.part for r in parts] == [0, 1, 2] and {r.filename for r in parts} == {"a-b.md"}
    assert "".join(r.markdown for r in parts) == "# A b\n\n" + "\n\n".join(f"## Chapter {i}\n\ntext {i}" for i in range(7))


def test_no_local_scratch_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.scratch_folder(Cluster())


def test_recall_beyond_the_first_items(spark, monkeypatch):
    """Queries that are not done among the first items go on to the end of their lists."""
    long = "w" * 9000  # never fits
    lists = spark.createDataFrame([(q, "recency", n, f"{q}-{n}", long if q == 1 and n < 8 else f"fact {n}") for q in (1, 2, 3) for n in range(1, 4 if q == 3 else 13)], "query_id long, pipeline string, rank long, item string, fact string")
    want = sorted(map(tuple, V.recall(None, {}, 5, lists=lists).select("query_id", "item", "place").collect()))
    assert [x for x in want if x[0] == 1] == sorted((1, f"1-{n}", p) for p, n in enumerate(range(8, 13), 1)) and len(want) == 13
    for head in (2, 6, 100):
        monkeypatch.setattr(V, "HEAD", head)
        assert sorted(map(tuple, V.recall(None, {}, 5, lists=lists, keep=scratch.keep).select("query_id", "item", "place").collect())) == want


def test_pages_of_evidence_show_every_event_once(spark):
    events = spark.createDataFrame([(i, i % 3, "accept") for i in range(50)], "event_id long, pref_id long, signal string")
    seen, before = [], None
    while True:
        page = P.evidence_page(events, "event_id", before, 7).collect()
        if not page:
            break
        seen += page
        places = {}
        for r in page:
            places[r.pref_id] = min(r.event_id, places.get(r.pref_id, r.event_id))
        before = spark.createDataFrame(list(places.items()), "pref_id long, place long")
    assert sorted(r.event_id for r in seen) == list(range(50)) and page == []
    assert [r.event_id for r in P.evidence_page(events.where("pref_id = 1"), "event_id", n=3).orderBy("event_id").collect()] == [43, 46, 49]
