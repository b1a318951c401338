"""How relevance fades, recovers and is recorded."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep
from .aggregates import nth

#: Decay rate, archive threshold, bump of a mention, score after archive, least change that counts (fixed values).
DECAY, ARCHIVE_AT, BUMP, REACTIVATED, EPSILON = 0.1, 0.15, 0.15, 0.8, 0.01


def decay(entities: DataFrame, mentioned: DataFrame, rate: float = DECAY) -> DataFrame:
    """One tick: active entities that were not mentioned fade."""
    told = entities.join(mentioned.select("entity_id").distinct().withColumn("_m", F.lit(True)), "entity_id", "left")
    fades = (F.col("status") == "active") & F.col("_m").isNull()
    return told.withColumn("relevance", F.when(fades, F.col("relevance") * math.exp(-rate)).otherwise(F.col("relevance"))).drop("_m")


def decay_idle(score: Column, idle: Column, rate: float = DECAY) -> Column:
    return score * F.exp(-rate * idle)


def archive(entities: DataFrame, threshold: float = ARCHIVE_AT) -> DataFrame:
    """Active entities at or below the threshold are archived; ``newly_archived`` tells which."""
    now = (F.col("status") == "active") & (F.col("relevance") <= threshold)
    return entities.withColumn("newly_archived", now).withColumn("status", F.when(now, "archived").otherwise(F.col("status")))


def reinforce(entities: DataFrame, mentions: DataFrame, bump: float = BUMP) -> DataFrame:
    """n mentions at once: the first brings an archived entity back, the others add the bump up to 1."""
    n = mentions.groupBy("entity_id").agg(F.count("*").alias("_n"), F.max("chapter_no").alias("_chapter"))
    told = entities.join(n, "entity_id", "left")
    touched = F.col("_n") > 0
    back = F.least(F.lit(1.0), F.lit(REACTIVATED) + bump * (F.col("_n") - 1))
    more = F.least(F.lit(1.0), F.col("relevance") + bump * F.col("_n"))
    score = F.when(touched & (F.col("status") == "archived"), back).when(touched & (F.col("status") == "active"), more).otherwise(F.col("relevance"))
    status = F.when(touched & (F.col("status") == "archived"), "active").otherwise(F.col("status"))
    last = F.when(touched & F.col("status").isin("active", "archived"), F.greatest("last_chapter", "_chapter")).otherwise(F.col("last_chapter"))
    return told.select(*[c for c in entities.columns if c not in ("relevance", "status", "last_chapter")], score.alias("relevance"), status.alias("status"), last.alias("last_chapter"))


def reactivate(entities: DataFrame, memories: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named entities become active with the reactivation score, and lose their memory."""
    told = entities.join(ids.select("entity_id").distinct().withColumn("_r", F.lit(True)), "entity_id", "left")
    out = told.withColumn("relevance", F.when(F.col("_r"), REACTIVATED).otherwise(F.col("relevance"))).withColumn("status", F.when(F.col("_r"), "active").otherwise(F.col("status"))).drop("_r")
    return out, memories.join(ids, "entity_id", "left_anti")


def snapshot(entities: DataFrame, at: Column) -> DataFrame:
    """History rows of all entities, whatever their status."""
    return entities.select("universe", "entity_id", "relevance", "status", at.alias("recorded_at"))


def recent_history(history: DataFrame, n: int = 30) -> DataFrame:
    """Last n records of each entity."""
    return history.withColumn("place", nth(["entity_id"], F.desc("recorded_at"))).where(F.col("place") <= n)


def lifecycle(entities: DataFrame, history: DataFrame, memories: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Label of each entity: consolidated, archived, reactivated, decaying or active."""
    w = Window.partitionBy("entity_id").orderBy("recorded_at")
    steps = recent_history(history).withColumn("was", F.lag("status").over(w)).withColumn("fell", F.lag("relevance").over(w) - F.col("relevance"))
    change = steps.groupBy("entity_id").agg(
        F.max_by(F.concat("was", F.lit(">"), "status"), F.when(F.col("was") != F.col("status"), F.col("recorded_at"))).alias("change"),
        F.max_by("fell", "recorded_at").alias("fell"),
    )
    told = entities.join(change.hint("merge"), "entity_id", "left").join(memories.select("entity_id").distinct().withColumn("_memory", F.lit(True)).hint("merge"), "entity_id", "left")
    label = F.when((F.col("status") == "archived") & F.col("_memory"), "consolidated").when(F.col("status") == "archived", "archived").when(F.col("change") == "archived>active", "reactivated").when(F.col("fell") > epsilon, "decaying").otherwise("active")
    return told.select("entity_id", "universe", "status", "relevance", label.alias("label"))


def memory_report(labels: DataFrame, history: DataFrame) -> DataFrame:
    """Labels with the recent history of each entity, oldest first, and the consolidated entities of its universe."""
    h = recent_history(history).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("recorded_at", "relevance", "status"))).alias("history"))
    n = labels.groupBy("universe").agg(F.count_if(F.col("label") == "consolidated").alias("consolidated"))
    return labels.join(h.hint("merge"), "entity_id", "left").join(keep(n), "universe")  # a row for each universe


def crossings(history: DataFrame, threshold: float = ARCHIVE_AT) -> DataFrame:
    """Records where the score first falls to the threshold, or first rises above it again."""
    w = Window.partitionBy("entity_id").orderBy("recorded_at")
    told = history.withColumn("was", F.lag("relevance").over(w))
    kind = F.when((F.col("was") > threshold) & (F.col("relevance") <= threshold), "archive").when((F.col("was") <= threshold) & (F.col("relevance") > threshold), "reactivate")
    return told.withColumn("kind", kind).where("kind IS NOT NULL").select("entity_id", "recorded_at", "kind")


def stale_arcs(entities: DataFrame, current: int, gap: int = 8) -> DataFrame:
    """Active entities of more than half relevance that no chapter has named for ``gap`` chapters."""
    idle = F.lit(current) - F.col("last_chapter")
    whole = lambda c: c.cast("long")
    title = F.format_string("Stale arc: %s (gap %d chapters)", "name", whole(idle))
    text = F.format_string("Entity '%s' has not been mentioned for %d chapters (last seen in chapter %d, currently at chapter %d)", "name", whole(idle), whole(F.col("last_chapter")), F.lit(current).cast("long"))
    return entities.where((F.col("status") == "active") & (F.col("relevance") > 0.5) & (idle >= gap)).select("entity_id", "universe", title.alias("title"), text.alias("description"))


def replay(entities: DataFrame, mentions: DataFrame, chapters: int, rate: float = DECAY, threshold: float = ARCHIVE_AT) -> DataFrame:
    """The whole history over chapters 1..n: mentioned entities are touched, active others fade, low ones are archived.

    One fold over the chapters of each entity, entities in parallel.
    """
    counts = mentions.groupBy("entity_id").agg(F.collect_set("chapter_no").alias("_in"))
    told = entities.join(counts, "entity_id", "left").withColumn("_in", F.coalesce("_in", F.array().cast("array<bigint>")))
    state = "struct<relevance:double,status:string,history:array<struct<chapter:bigint,relevance:double,status:string>>>"
    start = F.struct(F.col("relevance").cast("double").alias("relevance"), F.col("status").alias("status"), F.array().cast("array<struct<chapter:bigint,relevance:double,status:string>>").alias("history")).cast(state)

    def step(a: Column, c: Column) -> Column:
        hit = F.array_contains(F.col("_in"), c)
        up = F.when(a["status"] == "archived", F.lit(REACTIVATED)).otherwise(F.least(F.lit(1.0), a["relevance"] + BUMP))
        live = a["status"].isin("active", "archived")
        score = F.when(hit & live, up).when(a["status"] == "active", a["relevance"] * math.exp(-rate)).otherwise(a["relevance"])
        status = F.when(hit & (a["status"] == "archived"), "active").otherwise(a["status"])
        final = F.when((status == "active") & (score <= threshold), "archived").otherwise(status)
        return F.struct(score.alias("relevance"), final.alias("status"), F.array_append(a["history"], F.struct(c.alias("chapter"), score.alias("relevance"), final.alias("status"))).alias("history")).cast(state)

    fold = F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(chapters).cast("long")), start, step, lambda a: a["history"])
    return told.select("entity_id", "universe", F.explode(fold).alias("h")).select("entity_id", "universe", F.col("h.chapter").alias("recorded_at"), "h.relevance", "h.status")


def forgetting(entities: DataFrame, gold: DataFrame, ticks: int, rate: float = DECAY, threshold: float = ARCHIVE_AT) -> DataFrame:
    """After so many ticks: entities that should be archived and are not, and those that should stay and are gone."""
    gone = decay_idle(F.col("relevance"), F.lit(ticks), rate) <= threshold
    told = entities.where("status = 'active'").withColumn("gone", gone).join(gold, "entity_id", "left")
    return told.agg(F.count("*").alias("before"), F.count_if(~F.col("gone")).alias("after"), F.count_if((F.col("should") == "archive") & ~F.col("gone")).alias("false_negatives"), F.count_if((F.col("should") == "stay") & F.col("gone")).alias("false_positives"))
