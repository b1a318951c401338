"""How good retrieval is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import nth
from .retrieval import fuse


def judged(retrieved: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query with its hits (rank, relevant); a query without hits has one row without rank."""
    marks = gold.select("query_id", "item").distinct().withColumn("relevant", F.lit(1))
    hits = retrieved.select("query_id", "item", "rank").join(marks, ["query_id", "item"], "left").fillna(0, ["relevant"])
    return queries.select("query_id").distinct().join(hits, "query_id", "left")


def relevant(gold: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """(query_id, n): relevant items of each query, counted in ``gold`` or, where that has only those that were retrieved, given."""
    return gold.select("query_id", "item").distinct().groupBy("query_id").agg(F.count("*").alias("n")) if sizes is None else sizes.select("query_id", "n")


def alike(retrieved: DataFrame, queries: DataFrame, items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(query_id, item) of what was retrieved and is relevant, and (query_id, n): an item is relevant if it has the query's ``keys`` and is not the query itself.

    Items (item, keys) hold the queries under their own ids. No query ever meets all its relevant items.
    """
    own = queries.select("query_id").distinct().join(items.select(F.col("item").alias("query_id"), *keys).hint("merge"), "query_id")
    some = retrieved.select("query_id", "item").where("item <> query_id").distinct()
    gold = some.join(own.hint("merge"), "query_id").join(items.select("item", *keys).hint("merge"), ["item", *keys]).select("query_id", "item")
    n = own.join(items.groupBy(*keys).agg((F.count_distinct("item") - 1).alias("n")).hint("merge"), keys)
    return gold, n.select("query_id", "n")


def recall_precision(retrieved: DataFrame, gold: DataFrame, queries: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """Recall and precision in the first k; 0 without relevant items."""
    n = relevant(gold, sizes)
    got = judged(retrieved, gold, queries).groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0)).alias("hits"))
    told = got.join(n, "query_id", "left").fillna(0, ["n"])
    return told.select("query_id", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0).alias("recall"), (F.col("hits") / F.lit(float(k))).alias("precision"))


def mrr(retrieved: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    first = judged(retrieved, gold, queries).groupBy("query_id").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("r"))
    return first.select("query_id", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("mrr"))


def ndcg(retrieved: DataFrame, gold: DataFrame, queries: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """Binary gains; the ideal list has as many relevant items as there are, k at most."""
    n = relevant(gold, sizes)
    gain = judged(retrieved, gold, queries).groupBy("query_id").agg(F.sum(F.when((F.col("rank") <= k) & (F.col("relevant") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    told = gain.join(n, "query_id", "left").fillna(0, ["n"])
    return told.select("query_id", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def expand_hits(hits: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that the hits mention, each at its best rank, ranked again."""
    best = hits.select("query_id", "para_id", "rank").join(mentions, "para_id").groupBy("query_id", "entity_id").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", nth(["query_id"], "best", "entity_id")).select("query_id", "entity_id", "rank")


def ablation(lists: DataFrame, gold: DataFrame, queries: DataFrame, subsets: dict[str, list[str]], k: int = 5, sizes: DataFrame | None = None) -> DataFrame:
    """Mean recall of each subset of pipelines; all subsets are fused in one plan."""
    rows = [(s, p) for s, names in subsets.items() for p in names]
    grid = lists.sparkSession.createDataFrame(rows, "subset string, pipeline string")
    told = lists.join(F.broadcast(grid), "pipeline")  # one row for each pipeline of a subset
    keyed = told.withColumn("query_id", F.concat_ws("|", "subset", F.col("query_id").cast("string"))).drop("subset")
    subset = F.broadcast(grid.select("subset").distinct())
    key = F.concat_ws("|", "subset", F.col("query_id").cast("string")).alias("query_id")
    g, q = gold.crossJoin(subset).select(key, "item"), queries.select("query_id").distinct().crossJoin(subset).select(key)
    n = None if sizes is None else sizes.crossJoin(subset).select(key, "n")
    got = recall_precision(fuse(keyed).withColumnRenamed("position", "rank"), g, q, k, n)
    return got.groupBy(F.substring_index("query_id", "|", 1).alias("subset")).agg(F.round(F.avg("recall"), 6).alias("recall"))


def paired_report(before: DataFrame, after: DataFrame, measure: str) -> DataFrame:
    """Measure of each query before and after, and the difference; the last row has the means."""
    told = before.select("query_id", F.col(measure).alias("before")).join(after.select("query_id", F.col(measure).alias("after")), "query_id").withColumn("delta", F.col("after") - F.col("before"))
    mean = told.agg(*[F.avg(c).alias(c) for c in ("before", "after", "delta")]).select(F.lit("mean").alias("query_id"), "before", "after", "delta")
    return told.select(F.col("query_id").cast("string").alias("query_id"), "before", "after", "delta").unionByName(mean)


def fidelity(memories: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Cosine between a memory and the mean of its vectors; 0 if one of them is zero."""
    from .retrieval import dot, norm

    mean = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    center = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))
    told = memories.join(center.hint("merge"), key)
    n = norm(F.col("embedding")) * norm(F.col("center"))
    return told.select(key, F.when(n > 0, dot(F.col("embedding"), F.col("center")) / n).otherwise(0.0).alias("fidelity"))


def synthetic_vectors(ids: DataFrame, dims: int) -> DataFrame:
    """Sine vectors of the ids."""
    return ids.select("id", F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: F.sin((F.col("id") + 1) * i * F.lit(0.1))).alias("embedding"))
