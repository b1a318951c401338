"""Graph operators over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep
from .aggregates import nth
from .resolve import repoint


def load_edges(nodes: DataFrame, relations: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of known kinds whose two ends exist; parallel edges stay."""
    ids = nodes.select("entity_id")
    good = relations.where(F.col("rel_type").isin(kinds))
    return good.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """(seed, neighbor, rel_type) in both directions."""
    return edges.select(F.col("src").alias("seed"), F.col("dst").alias("neighbor"), "rel_type").unionByName(edges.select(F.col("dst").alias("seed"), F.col("src").alias("neighbor"), "rel_type"))


def neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One hop around each seed; seeds are a table of any size."""
    return both_ways(edges).join(seeds.select("seed").distinct(), "seed")


#: Asked names that are broadcast after a look at how many there are.
NAMES = 1 << 17


def entities_by_name(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, seed): of each asked name, in any case, the active entity that bears it, else one that has it as an alias.

    Of several the most relevant, then by name and id. As many names as ``NAMES`` are sent to the entities, so that entities of few
    names, all in a few tasks if dealt by name, are neither shuffled nor sorted unless they bear an asked one.
    """
    wanted = keep(asked.select(F.col("name"), F.lower("name").alias("_low")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= NAMES else wanted.hint("merge")
    live = entities.where("status = 'active'").select("entity_id", "relevance", F.col("name").alias("_own"), "aliases")
    called = live.select("entity_id", "relevance", "_own", F.lit(0).alias("_pass"), F.lower("_own").alias("_low"))
    known = called.unionByName(live.select("entity_id", "relevance", "_own", F.lit(1).alias("_pass"), F.explode("aliases").alias("_low")).withColumn("_low", F.lower("_low")))
    best = F.min(F.struct("_pass", (-F.col("relevance")).alias("r"), "_own", "entity_id"))
    return known.join(wanted, "_low").groupBy("name").agg(best.alias("b")).select("name", F.col("b.entity_id").alias("seed"))


def cocitation(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, neighbor, score): edges between a query's seeds and each neighbour, ranked; parallel edges count."""
    hits = both_ways(edges).join(seeds.select("query_id", "seed").distinct(), "seed")
    counts = hits.groupBy("query_id", "neighbor").agg(F.count("*").alias("score"))
    return counts.withColumn("rank", nth(["query_id"], F.desc("score"), "neighbor"))


def ego_graph(nodes: DataFrame, edges: DataFrame, focal: DataFrame, first: int = 8, second: int = 2) -> DataFrame:
    """(focal, node, hop): each focal node, its best neighbours by relevance, and the best new neighbours of those.

    Edges are looked at once: a graph has shown 1 + first nodes before its second hop, so that many of a node's best neighbours, and
    second more, hold all that either hop can take.
    """
    pairs = both_ways(edges).where("seed <> neighbor").select("seed", "neighbor")
    n = _tasks(edges, 2 * edges.count())
    known = nodes.select(F.col("entity_id").alias("neighbor"), "relevance").repartition(n, "neighbor")
    scored = pairs.repartition(n, "neighbor").join(known.hint("merge"), "neighbor").repartition(n, "seed")
    place = F.dense_rank().over(Window.partitionBy("seed").orderBy(F.desc("relevance"), "neighbor"))  # parallel edges share a place
    best = keep(scored.withColumn("n", place).where(F.col("n") <= max(first, 1 + first + second)).distinct())
    start = focal.select(F.col("entity_id").alias("focal")).distinct()
    one = best.where(F.col("n") <= first).join(start.hint("merge"), F.col("seed") == F.col("focal")).select("focal", F.col("neighbor").alias("node"))
    shown = start.select("focal", F.col("focal").alias("node"), F.lit(0).alias("hop")).unionByName(one.withColumn("hop", F.lit(1)))
    n = _tasks(best, best.count())
    reach = one.withColumnRenamed("node", "seed").repartition(n, "seed").join(best.drop("n").repartition(n, "seed").hint("merge"), "seed").join(shown.select("focal", F.col("node").alias("neighbor")).hint("merge"), ["focal", "neighbor"], "left_anti")
    two = reach.withColumn("n", nth(["focal", "seed"], F.desc("relevance"), "neighbor")).where(F.col("n") <= second)
    return shown.unionByName(two.select("focal", F.col("neighbor").alias("node"), F.lit(2).alias("hop")).distinct())


def ego_edges(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges between the shown nodes of each focal node, with the larger hop of their ends.

    The few shown nodes of a focal node meet each other, and these pairs meet the edges, so no edge is copied for each graph that shows an end.
    """
    a = shown.select("focal", F.col("node").alias("src"), F.col("hop").alias("ha"))
    b = shown.select("focal", F.col("node").alias("dst"), F.col("hop").alias("hb"))
    hop = F.greatest("ha", "hb").alias("hop")
    met = a.join(b.hint("merge"), "focal").select("focal", "src", "dst", hop, F.when((F.col("src") == F.col("focal")) | (F.col("dst") == F.col("focal")), 0).otherwise(hop).alias("tier"))
    sizes = shown.groupBy("focal").agg(F.count("*").alias("n"))
    n = _tasks(edges, max(edges.count(), sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0))
    return edges.repartition(n, "src", "dst").join(met.repartition(n, "src", "dst").hint("merge"), ["src", "dst"]).select("focal", "src", "dst", "rel_type", "hop", "tier")


def bounded(nodes: DataFrame, edges: DataFrame, key: str, most_nodes: int = 96, most_edges: int = 160) -> DataFrame:
    """Counts of each graph, what the caps leave, and whether anything was cut."""
    n = nodes.groupBy(key).agg(F.count("*").alias("nodes"))
    e = edges.groupBy(key).agg(F.count("*").alias("edges"))
    told = n.join(e, key, "left").fillna(0, ["edges"])
    return told.select(key, F.least("nodes", F.lit(most_nodes)).alias("nodes"), F.least("edges", F.lit(most_edges)).alias("edges"), ((F.col("nodes") > most_nodes) | (F.col("edges") > most_edges)).alias("truncated"))


def bounded_rows(nodes: DataFrame, edges: DataFrame, key: str, most_nodes: int = 96, most_edges: int = 160) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of each graph within the caps, and its counts with whether anything was cut.

    Nodes (key, node, hop) stay by hop and id; edges (key, src, dst, rel_type, tier) only between nodes that stay, by tier and ends.
    """
    kept = nodes.withColumn("_n", nth([key], "hop", "node")).where(F.col("_n") <= most_nodes).drop("_n")
    a, b = (kept.select(key, F.col("node").alias(c)).hint("merge") for c in ("src", "dst"))
    inside = edges.join(a, [key, "src"]).join(b, [key, "dst"])
    inside = inside.withColumn("_n", nth([key], "tier", "src", "dst", "rel_type")).where(F.col("_n") <= most_edges).drop("_n")
    return kept, inside, bounded(nodes, edges, key, most_nodes, most_edges)


def full_graph(graph_nodes: DataFrame, edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Every node with its degree; entities that only the registry knows are marked as not graph backed."""
    degree = both_ways(edges).groupBy("seed").agg(F.count("*").alias("degree")).withColumnRenamed("seed", "entity_id")
    inside = graph_nodes.select("entity_id").join(degree, "entity_id", "left").fillna(0, ["degree"]).withColumn("graph_backed", F.lit(True))
    outside = registry.select("entity_id").join(graph_nodes.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(0).cast("long").alias("degree"), F.lit(False).alias("graph_backed"))
    return inside.unionByName(outside)


def cooccurrence(mentions: DataFrame, chunk: str, cap: int | None = None, run: str | None = None) -> DataFrame:
    """Different unordered pairs of one chunk, smaller id first; with a cap, the first of each run in chunk order."""
    pairs, n = chunk_pairs(mentions.select(chunk, "entity_id", *([run] if run else [])), chunk)
    if cap is None:
        return pairs.select("src", "dst").repartition(n, "src", "dst").distinct()
    # of a chunk, only the first pairs can be among the first of its run
    few = pairs.repartition(n, chunk).withColumn("_m", F.row_number().over(Window.partitionBy(chunk).orderBy("src", "dst"))).where(F.col("_m") <= cap)
    first = few.select(run, "src", "dst", chunk).repartition(n, run, "src", "dst").groupBy(run, "src", "dst").agg(F.min(chunk).alias("_chunk"))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy("_chunk", "src", "dst"))).where(F.col("_n") <= cap).select(run, "src", "dst")


#: Members of a chunk that meet in one task.
BLOCK = 512
#: Mentions, pairs or edges that one task takes, however many there are.
ROWS = 250000


def _tasks(rows: DataFrame, n: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS)


def chunk_pairs(mentions: DataFrame, chunk: str, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Pairs src < dst of the different members (chunk, entity_id, more) of each chunk, with the columns of src; and tasks in proportion to their number.

    Members of a large chunk lie in blocks, and every pair of blocks meets under a key of its own, so a chunk with many members spreads.
    """
    members = mentions.repartition(_tasks(mentions, mentions.count()), chunk).distinct()
    sizes = members.groupBy(chunk).agg(F.count("*").alias("_size"))
    blocks = F.ceil(F.col("_size") / block).cast("int")
    dealt = keep(members.join(sizes.hint("merge"), chunk).withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("entity_id"), F.col("_blocks")).cast("int")))
    n = _tasks(dealt, (dealt.agg(F.sum(F.col("_size") - 1)).first()[0] or 0) // 2)
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    a = dealt.drop("_size").withColumnRenamed("entity_id", "src").withColumn("_other", others).withColumnRenamed("_own", "_a").withColumnRenamed("_other", "_b").drop("_blocks")
    b = dealt.select(chunk, F.col("entity_id").alias("dst"), F.col("_own").alias("_b"), "_blocks").withColumn("_a", others).drop("_blocks")
    met = a.repartition(n, chunk, "_a", "_b").join(b.repartition(n, chunk, "_a", "_b").hint("merge"), [chunk, "_a", "_b"])
    return met.where("src < dst").drop("_a", "_b"), n


def edge_sentences(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge as a sentence, its kind in lower case with blanks."""
    names = nodes.select("entity_id", "name")
    told = edges.join(names.withColumnsRenamed({"entity_id": "src", "name": "a"}), "src").join(names.withColumnsRenamed({"entity_id": "dst", "name": "b"}), "dst")
    return told.withColumn("sentence", F.format_string("%s %s %s.", "a", F.lower(F.replace(F.col("rel_type"), F.lit("_"), F.lit(" "))), "b"))


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys, ["src", "dst", "rel_type"], "left_anti")


def remap_nodes(edges: DataFrame, losers: DataFrame) -> DataFrame:
    """Edges with the winner in place of each merged node; edges between the two stay, as loops."""
    for end in ("src", "dst"):
        edges = repoint(edges, losers, end)
    return edges


def sync_nodes(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Score and status of the registry where it knows the node."""
    new = registry.select("entity_id", F.col("relevance").alias("_r"), F.col("status").alias("_s"))
    told = nodes.join(new, "entity_id", "left")
    return told.withColumn("relevance", F.coalesce("_r", "relevance")).withColumn("status", F.coalesce("_s", "status")).drop("_r", "_s")


def pick_focal(entities: DataFrame) -> DataFrame:
    """Of each universe the most relevant active entity, else the most relevant archived one."""
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "archived", 1)
    told = entities.withColumn("_rank", rank).where("_rank IS NOT NULL")
    return told.withColumn("_n", nth(["universe"], "_rank", F.desc("relevance"), "entity_id")).where("_n = 1").drop("_n", "_rank")
