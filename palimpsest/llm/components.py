"""Connected components of a graph that may be as large as the data, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or smaller) neighbours of each vertex on its smallest neighbour."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # as an expression the key is dealt anew for the join, and Spark can then split the pairs of a hub over tasks
    key = least.select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), "m")
    hung = pairs.join(key.hint("merge"), "u")
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of the edges (u, v); the component is its smallest vertex.

    Each round is written to a table and read back. No edges, no rows; repeated edges and loops do no harm.
    """
    now = stored(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(now)
    while before[0]:
        now = stored(_stars(_stars(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    star = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return star.union(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
