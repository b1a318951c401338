"""Filters, counts, top-k, percentiles and inventories."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import keep


def nth(keys: list[str], *order: Column | str) -> Column:
    """Place of a row within its keys; filtered to a few, Spark prunes before the shuffle."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def number(df: DataFrame, keys: list[str], order: list[Column | str], name: str, of: str | None = None) -> DataFrame:
    """Place of every row within its keys, in a new column, where all places are wanted; with ``of``, the sum of this column up to the row.

    Rows are dealt by ranges of keys and order. Each range is numbered by itself and moved on by the rows of its key that lie
    before it, so that a key with a third of all rows is numbered by many tasks. Null keys are a key.
    """
    # written once: the ranges come from a sample, and both sides below must see the same ones
    dealt = keep(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy(*keys, "_range").agg((F.count("*") if of is None else F.sum(of)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.select(*[F.col(k).alias(f"_run_{k}") for k in keys], F.col("_range").alias("_run"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_run_{k}")) for k in keys], F.col("_range") == F.col("_run"))
    upto = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = dealt.join(runs.hint("merge"), same).withColumn("_nth", nth([*keys, "_range"], *order) if of is None else F.sum(of).over(upto))
    return told.select(*df.columns, (F.col("_nth") + F.col("_before")).alias(name))


def inventory(entities: DataFrame, active_only: bool = False) -> DataFrame:
    """Every entity of each universe, or only the active ones, with its place by relevance, then name, then id."""
    some = entities.where("status = 'active'") if active_only else entities
    return number(some, ["universe"], [F.desc("relevance"), "name", "entity_id"], "place")


def list_entities(df: DataFrame, kind: str | None = None, status: str | None = None, least: float | None = None, like: str | None = None) -> DataFrame:
    """Entities of a type, a status, a least relevance, and a part of the name or of an alias in any case."""
    if kind is not None:
        df = df.where(F.col("type") == kind)
    if status is not None:
        df = df.where(F.col("status") == status)
    if least is not None:
        df = df.where(F.col("relevance") >= least)
    if like is not None:
        has = lambda c: F.contains(F.lower(c), F.lit(like.lower()))
        df = df.where(has(F.col("name")) | F.exists("aliases", has))
    return df


def page(df: DataFrame, order: list[Column], number: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of a page (limit 1 to 100), and one row of page metadata."""
    limit = min(max(limit, 1), 100)
    meta = df.agg(F.count("*").alias("total")).select("total", F.lit(number).alias("page"), F.ceil(F.col("total") / limit).cast("long").alias("pages"))
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit), meta


def count_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("universe", "type").agg(F.count("*").alias("n"))


def mentions_of(mentions: DataFrame, n: int) -> DataFrame:
    """Newest n mentions of each entity, and how many it has in all."""
    place = mentions.withColumn("place", nth(["entity_id"], F.desc("created_at"), F.desc("mention_id"))).where(F.col("place") <= n)
    return place.join(mentions.groupBy("entity_id").agg(F.count("*").alias("total")), "entity_id")


def max_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Most mentions of one entity in each universe, 0 where there are none."""
    counts = mentions.groupBy("universe", "entity_id").count().groupBy("universe").agg(F.max("count").alias("n"))
    return entities.select("universe").distinct().join(counts, "universe", "left").select("universe", F.coalesce("n", F.lit(0)).alias("most"))


def next_index(df: DataFrame, parent: str) -> DataFrame:
    return df.groupBy(parent).agg((F.max("order_index") + 1).alias("next_index"))


def review_inbox(contradictions: DataFrame, plot_holes: DataFrame) -> DataFrame:
    """Both kinds of finding, open ones first, then by severity, newest first."""
    both = contradictions.select(F.lit("contradiction").alias("kind"), "id", "severity", "status", "created").unionByName(plot_holes.select(F.lit("plot_hole").alias("kind"), "id", F.lit("medium").alias("severity"), "status", "created"))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return both.withColumn("open_first", F.when(F.col("status") == "open", 0).otherwise(1)).withColumn("rank", rank).orderBy("open_first", "rank", F.desc("created"), "kind", "id")


def telemetry(events: DataFrame, *keys: Column | str) -> DataFrame:
    """Per key: events, those of two kinds counted as client and server errors, mean and greatest value."""
    return events.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "signup").alias("client_errors"), F.count_if(F.col("event_type") == "error").alias("server_errors"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


#: Pieces in which a range of values is counted, and values of a key that are looked at one by one in the end.
PIECES, FEW = 256, 4096


def order_statistic(df: DataFrame, key: str, value: str, place: Column, pieces: int = PIECES, few: int = FEW) -> DataFrame:
    """(key, value): of each key the value at a 0-based place, an expression of its number of values ``n``; nulls do not count.

    For all keys at once: the range of a key's values is counted in pieces, and only the piece that holds the place is looked into
    again, until few values or one different value are left. No task ever holds or sorts the values of a key.
    """
    given = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    wide = F.col("_v").cast("double")
    facts = given.groupBy("_k").agg(F.count("*").alias("n"), F.min(wide).alias("low"), F.max(wide).alias("high"))
    open_ = keep(facts.select("_k", place.cast("long").alias("place"), F.col("n").alias("inside"), "low", "high"))
    done = []
    while True:
        ready = (F.col("inside") <= few) | (F.col("low") >= F.col("high"))
        done.append(open_.where(ready))
        open_ = open_.where(~ready)
        if open_.isEmpty():
            break
        # the sum of the ends may pass the largest number, their halves do not
        span = F.col("high") / 2 - F.col("low") / 2
        piece = F.least(F.floor((wide / 2 - F.col("low") / 2) / span * pieces), F.lit(pieces - 1)).cast("int")
        asked = given.join(open_.hint("merge"), "_k").where(wide.between(F.col("low"), F.col("high"))).withColumn("piece", piece)
        counts = asked.groupBy("_k", "place", "piece").agg(F.count("*").alias("c"), F.min(wide).alias("low"), F.max(wide).alias("high"))
        upto = F.sum("c").over(Window.partitionBy("_k").orderBy("piece"))  # PIECES rows a key
        held = counts.withColumn("before", upto - F.col("c")).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("c")))
        open_ = keep(held.select("_k", (F.col("place") - F.col("before")).alias("place"), F.col("c").alias("inside"), "low", "high"))
    ends = reduce(DataFrame.unionByName, done)
    left = given.join(ends.hint("merge"), "_k").where(wide.between(F.col("low"), F.col("high")))
    counts = left.groupBy("_k", "place", "_v").agg(F.count("*").alias("c"))
    told = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("_k").orderBy("_v"))).where(F.col("upto") > F.col("place"))
    return told.groupBy("_k").agg(F.min("_v").alias("value")).select(F.col("_k").alias(key), "value")


def percentile_nearest(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Nearest-rank percentile, the value at place ceil(q n)."""
    return order_statistic(df, key, value, F.greatest(F.ceil(F.col("n") * F.lit(q)) - 1, F.lit(0)))


def percentile_at(df: DataFrame, key: str, value: str, percent: int) -> DataFrame:
    """The value at 0-based place n * percent / 100, in whole numbers."""
    return order_statistic(df, key, value, F.least(F.floor(F.col("n") * percent / 100), F.col("n") - 1))


def distinct_on(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", nth(keys, *order)).where("_n = 1").drop("_n")


def fold(df: DataFrame, keys: list[str], order: list[str], need: list[str], start: Callable[[tuple], tuple], step: Callable[[tuple, tuple], tuple], fields: list[T.StructField]) -> DataFrame:
    """Every row with the state of its key's fold after it, in new columns ``fields``.

    ``start`` makes a state from a key, ``step`` the next one from a state and the columns ``need`` of a row. Spark deals the rows by key
    and sorts them; only the state is carried from batch to batch, so a key may have any number of rows.
    """
    key_at, need_at = ([df.columns.index(c) for c in names] for names in (keys, need))
    names = [*df.columns, *[f.name for f in fields]]
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = [{"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, ()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = []
            for key, row in zip(*[zip(*[batch.column(i).to_pylist() for i in at], strict=True) for at in (key_at, need_at)], strict=True):
                if key != last:
                    last, state = key, start(key)
                state = step(state, row)
                made.append(state)
            new = [pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
