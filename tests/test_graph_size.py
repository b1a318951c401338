"""Graph operators whose tasks follow the rows, and ego graphs from a node's best neighbours, against plain Python."""

import itertools
import random

import pytest

from palimpsest.operators import graph as G


def tasks_before_shuffles(df):
    """Numbers of partitions of all exchanges in the plan."""
    import re

    return [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]


@pytest.mark.parametrize("capped", [False, True])
def test_pairs_take_more_tasks_as_they_grow(spark, monkeypatch, capped):
    monkeypatch.setattr(G, "ROWS", 50)
    rng = random.Random(3)
    rows = [(c, rng.randrange(40), c % 3) for c in range(60) for _ in range(9)]
    df = spark.createDataFrame(rows, "chunk long, entity_id long, run long")
    got = G.cooccurrence(df, "chunk", 20, "run") if capped else G.cooccurrence(df, "chunk")
    assert min(tasks_before_shuffles(got)) > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = {}
    for c, e in itertools.groupby(sorted(set(rows)), lambda r: (r[0], r[2])):
        for a, b in itertools.combinations(sorted({x[1] for x in e}), 2):
            first.setdefault((c[1], a, b), c[0])
    want = {(a, b) for _, a, b in first}
    if capped:
        want = {x for r in range(3) for x in sorted((k for k in first if k[0] == r), key=lambda k: (first[k], k))[:20]}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_ego_graph_of_odd_edges(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS", 20)
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(34), rng.choice("AB")) for _ in range(220)]  # loops, parallel edges, unknown ends
    relevance = {i: rng.randrange(4) / 4 for i in range(30)}
    e = spark.createDataFrame(edges, "src long, dst long, rel_type string")
    nodes = spark.createDataFrame(list(relevance.items()), "entity_id long, relevance double")
    focal = [0, 3, 7, 7, 29]
    near = {}
    for a, b, _ in edges:
        for x, y in ((a, b), (b, a)):
            if x != y and y in relevance:
                near.setdefault(x, set()).add(y)
    best = lambda some: sorted(some, key=lambda x: (-relevance[x], x))
    want = set()
    for f in set(focal):
        one = best(near.get(f, ()))[:3]
        hops = {f: 0} | dict.fromkeys(one, 1)
        two = {y for x in one for y in best(near[x] - set(hops))[:2]}
        want |= {(f, x, h) for x, h in (hops | dict.fromkeys(two, 2)).items()}
    shown = G.ego_graph(nodes, e, spark.createDataFrame([(x,) for x in focal], "entity_id long"), 3, 2)
    assert sorted(map(tuple, shown.collect())) == sorted(want)
    hop = {(f, x): h for f, x, h in want}
    between = sorted((f, a, b, t, max(hop[f, a], hop[f, b]), 0 if f in (a, b) else max(hop[f, a], hop[f, b])) for f in set(focal) for a, b, t in edges if (f, a) in hop and (f, b) in hop)
    got = G.ego_edges(shown, e)
    assert sorted(map(tuple, got.collect())) == between and between
    assert max(tasks_before_shuffles(got)) >= len(edges) // 20


def test_edges_at_given_ends_are_those_of_the_view(spark, monkeypatch):
    from palimpsest.plans import fixtures

    views = fixtures.Views(spark, "/root/testdata/sf0.001")
    ends = spark.createDataFrame([(x,) for x in (1, 2, 2, 20, 10**9)], "end long")
    want = sorted(map(tuple, views("edges").where("src IN (1, 2, 20) OR dst IN (1, 2, 20)").collect()))
    assert sorted(map(tuple, views.edges_at(ends).collect())) == want and want
    monkeypatch.setattr(fixtures, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, views.edges_at(ends).collect())) == want


def test_recall_pairs_no_order_without_a_seed(spark, monkeypatch):
    from palimpsest.plans import fixtures
    from palimpsest.plans import retrieval_queries as RQ

    monkeypatch.setattr(fixtures, "_edges", lambda lines: pytest.fail("the whole view is paired"))
    views = fixtures.Views(spark, "/root/testdata/sf0.001")
    assert RQ.v17(views).count() > 0
    monkeypatch.setattr(fixtures, "_edges_at", lambda lines, ends: pytest.fail("edges are not fused here"))
    assert RQ.v12(views).count() > 0


def test_cloned_edges_meet_in_more_tasks_as_lines_grow(spark, monkeypatch):
    from palimpsest.plans import fixtures, resolve_queries

    monkeypatch.setattr(fixtures, "LINES", 500)
    n = 2 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500
    assert tasks_before_shuffles(resolve_queries.r16(fixtures.Views(spark, "/root/testdata/sf0.001"))).count(n) >= 4


def test_neighbors_by_name_pair_no_order_without_a_seed(spark, monkeypatch):
    from palimpsest.plans import fixtures
    from palimpsest.plans import retrieval_queries as RQ

    views = fixtures.Views(spark, "/root/testdata/sf0.001")
    edges = [tuple(r) for r in views("edges").collect()]
    monkeypatch.setattr(fixtures, "_edges", lambda lines: pytest.fail("the whole view is paired"))
    got = sorted(map(tuple, RQ.v19b(fixtures.Views(spark, "/root/testdata/sf0.001")).collect()))
    seeds = {(name, seed) for name, seed, _, _ in got}
    assert len(seeds) > 1
    assert got == sorted((name, seed, b if a == seed else a, kind) for name, seed in seeds for a, b, kind in edges if seed in (a, b))


@pytest.mark.parametrize("names", [1 << 17, 0])
def test_entities_of_few_names_are_not_dealt_by_name(spark, monkeypatch, names):
    monkeypatch.setattr(G, "NAMES", names, raising=False)
    rng = random.Random(7)
    rows = [(i, rng.choice(["Ann", "ANN", "Bo", "Cy"]), rng.sample(["ann", "Bo", "Dee", "dee"], 2), rng.randrange(3) / 3, rng.choice(["active", "archived"])) for i in range(400)]
    ents = spark.createDataFrame(rows, "entity_id long, name string, aliases array<string>, relevance double, status string")
    asked = ["ann", "BO", "dee", "DEE", "dee", "eve", None]
    got = G.entities_by_name(spark.createDataFrame([(x,) for x in asked], "name string"), ents)
    assert ("hashpartitioning(_low" in got._jdf.queryExecution().executedPlan().toString()) == (not names)
    want = {}
    for low in {x for x in asked if x}:
        found = [(own.lower() != low.lower(), -r, own, i) for i, own, also, r, s in rows if s == "active" and low.lower() in (own.lower(), *map(str.lower, also))]
        if found:
            want[low] = min(found)[3]
    assert {r.name: r.seed for r in got.collect()} == want and len(want) == 4 and got.count() == 4
