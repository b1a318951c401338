"""Contradictions, timelines, and inputs for consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .aggregates import distinct_on, nth, number
from .folds import fit


#: The kind of contradiction, what is told of it, and its two pieces of evidence (fixed texts).
DECEASED = "deceased_alive"


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts one after another; a null part is empty."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def deceased_fingerprint(entity: Column, name: Column, text: Column, chapter: Column) -> Column:
    """Of entity, kind, both pieces of evidence and both chapters, so the same words in another chapter are another contradiction."""
    return fingerprint(entity, F.lit(DECEASED), F.format_string("Entity %s is deceased in DB", name), text, chapter, chapter)


def check_deceased(resolved: DataFrame) -> DataFrame:
    """A mention (``mention_text``) of an entity that was deceased before it is a critical contradiction."""
    text = F.format_string("Entity '%s' is marked as deceased but was mentioned as active: \"%s\"", "name", X.truncate(F.coalesce("mention_text", F.lit("")), 80))
    found = resolved.where("previous_status = 'deceased'")
    return found.select(
        "entity_id", F.lit(DECEASED).alias("kind"), F.lit("critical").alias("severity"), text.alias("description"), F.format_string("Entity %s status: deceased", "name").alias("evidence_a"),
        F.coalesce("mention_text", F.lit("")).alias("evidence_b"), "chapter_no", deceased_fingerprint(F.col("entity_id"), F.col("name"), F.col("mention_text"), F.col("chapter_no")).alias("fingerprint"),
    )


def new_contradictions(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found rows with a fingerprint that is not stored, the first of each."""
    return distinct_on(found, ["fingerprint"], "id").join(stored.select("fingerprint").distinct(), "fingerprint", "left_anti")


def apply_status(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """New status where the change comes from the row's own universe and the row is open."""
    c = changes.select("id", F.col("universe").alias("_u"), F.col("new_status").alias("_s"))
    told = rows.join(c, "id", "left")
    ok = (F.col("_u") == F.col("universe")) & (F.col("status") == "open")
    return told.withColumn("status", F.when(ok, F.col("_s")).otherwise(F.col("status"))).drop("_u", "_s")


def open_arcs(plot_holes: DataFrame, asked: DataFrame) -> DataFrame:
    """(universe, entity_id, id, place): open arcs of each asked entity of a universe, newest first.

    Arcs have universe, id, status, created and the entities related.
    """
    arcs = plot_holes.where("status = 'open'").select("universe", "id", "created", F.explode(F.array_distinct("related")).alias("entity_id"))
    told = arcs.join(asked.select("universe", "entity_id").distinct().hint("merge"), ["universe", "entity_id"])
    return told.select("universe", "entity_id", "id", nth(["universe", "entity_id"], F.desc("created"), "id").alias("place"))


def timeline(events: DataFrame) -> DataFrame:
    """Events by position, those without one last."""
    return number(events, ["universe"], [F.asc_nulls_last("position"), "id"], "place")


def validate_timeline(events: DataFrame, chapters: DataFrame) -> DataFrame:
    """An event after its work's last chapter is invalid, in it ambiguous; without chapter, valid."""
    present = chapters.groupBy("work").agg(F.max("order_index").alias("present"))
    told = events.join(present, "work", "left")
    verdict = F.when(F.col("chapter_index").isNull() | F.col("present").isNull(), "valid").when(F.col("chapter_index") > F.col("present"), "invalid").when(F.col("chapter_index") == F.col("present"), "ambiguous").otherwise("valid")
    return told.withColumn("verdict", verdict)


def seed_timeline(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """One event for each event entity of a chapter, with the characters of that chapter."""
    events, members = seeded_events(mentions, entities)
    people = members.groupBy("group_id").agg(F.array_sort(F.collect_set("entity_id")).alias("participants"))
    return events.join(people.hint("merge"), "group_id", "left").select("universe", "entity_id", "title", "position", F.coalesce("participants", F.array().cast("array<bigint>")).alias("participants"))


def seeded_events(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (universe, entity_id, title, position, group_id), and the members (group_id, entity_id) of each group.

    All events of a chapter have the same participants, so they name a group and no event has its own copy: rows grow with events
    plus participants.
    """
    told = mentions.select("universe", "chapter_no", "entity_id").distinct().join(entities.select("entity_id", "type", "name"), "entity_id")
    told = told.withColumn("group_id", F.concat_ws(":", "universe", "chapter_no"))
    events = told.where("type = 'event'").select("universe", "entity_id", F.col("name").alias("title"), F.col("chapter_no").alias("position"), "group_id")
    return events, told.where("type = 'character'").select("group_id", "entity_id")


def last_k_chapters(mentions: DataFrame, k: int) -> DataFrame:
    """Last k chapters of each universe that name an entity."""
    return mentions.select("universe", "chapter_no").distinct().withColumn("place", nth(["universe"], F.desc("chapter_no"))).where(F.col("place") <= k).select("universe", "chapter_no")


def consolidation_inputs(entities: DataFrame, mentions: DataFrame, n: int = 100) -> DataFrame:
    """Newest n mentions of each archived entity as lines, newest first; entities without any are left out."""
    some = mentions.where(F.trim(F.coalesce("snippet", F.lit(""))) != "").join(entities.where("status = 'archived'").select("entity_id"), "entity_id", "left_semi")
    top = some.withColumn("place", nth(["entity_id"], F.desc("created_at"), F.desc("mention_id"))).where(F.col("place") <= n)
    line = F.transform(F.array_sort(F.collect_list(F.struct("place", "snippet"))), lambda r: F.concat(F.lit("- "), r["snippet"]))
    return top.groupBy("entity_id").agg(F.array_join(line, "\n").alias("lines"))


def parse_memories(raw: DataFrame) -> DataFrame:
    """Memories with a summary; key facts default to none."""
    from .parse import parse_json_loose

    told = raw.withColumn("_m", parse_json_loose(F.col("raw"), "struct<summary:string,key_facts:array<string>>"))
    return told.where(F.trim(F.coalesce("_m.summary", F.lit(""))) != "").select("entity_id", F.col("_m.summary").alias("summary"), F.coalesce("_m.key_facts", F.array().cast("array<string>")).alias("key_facts"))


def fit_flags(items: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Each item with ``fits`` and the cost ``used`` up to it: an item that does not fit is skipped and the next one tried."""
    return fit(items, keys, order, cost, budget)


def greedy_fit(items: DataFrame, keys: list[str], order: list[str], cost: str, item: str, budget: int) -> DataFrame:
    """(keys, kept items in order, used); only what fits the budget goes into an array."""
    kept = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct(*order, F.col(item).alias("_i")))))
    told = fit_flags(items.select(*dict.fromkeys([*keys, *order, cost, item])), keys, order, cost, budget)
    return told.groupBy(*keys).agg(F.transform(kept, lambda r: r["_i"]).alias("kept"), F.max("used").alias("used"))


def entity_lines(entities: DataFrame, budget: int) -> DataFrame:
    """Prompt lines of the most relevant entities of each type that fit a token budget together."""
    line = F.format_string("- %s (%s): %s", "name", "type", "description")
    told = entities.withColumn("line", line).withColumn("cost", X.count_tokens(F.concat("line", F.lit("\n")))).withColumn("neg", -F.col("relevance"))
    return greedy_fit(told, ["universe", "type"], ["neg", "entity_id"], "cost", "line", budget).select("universe", "type", F.array_join("kept", "\n").alias("text"), "used")
