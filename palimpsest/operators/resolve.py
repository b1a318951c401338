"""Matching mentions to entities, and merging entities that are one."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import distinct_on, number

KEY = ["universe", "norm", "type"]


def normal(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", F.lower("name"))


def match_exact(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, entity_id): same universe, type, and name in any case; the smallest id wins."""
    known = normal(entities).groupBy(*KEY).agg(F.min("entity_id").alias("entity_id"))
    return normal(mentions).join(known, KEY).select("mention_id", "entity_id")


#: Characters at the start of the shorter name by which it meets longer ones that hold them anywhere.
GRAM = 6


def match_fuzzy(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """One name holds the other, same universe and type; the longest entity name wins, then the smallest id.

    A name that is held meets, by its first characters, the names that have these anywhere; a shorter name meets by all it has. Different
    names are matched once and given to all their mentions. Entities of equal name count as the smallest of them.
    """
    asked = normal(mentions).where("norm <> ''").select(*KEY).distinct()
    known = normal(entities).where("norm <> ''").groupBy(*KEY).agg(F.min("entity_id").alias("entity_id")).withColumnRenamed("norm", "known")
    length = lambda c: F.char_length(c)
    runs = lambda c, n: F.when(length(c) >= n, F.transform(F.sequence(F.lit(1), length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    holders = lambda df, c: df.withColumn("g", F.explode(F.array_distinct(F.flatten(F.array(*[runs(c, n) for n in range(1, GRAM + 1)])))))
    held = lambda df, c: df.withColumn("g", F.substring(c, 1, GRAM))
    on = ["universe", "type", "g"]
    longer = holders(asked, "norm").join(held(known, "known").hint("merge"), on).where(F.contains("norm", "known"))
    shorter = held(asked, "norm").join(holders(known, "known").hint("merge"), on).where(F.contains("known", "norm"))
    best = longer.unionByName(shorter).groupBy(*KEY).agg(F.max(F.struct(length("known").alias("n"), (-F.col("entity_id")).alias("e"))).alias("b"))
    return normal(mentions).join(best.hint("merge"), KEY).select("mention_id", (-F.col("b.e")).alias("entity_id"))


def match_alias(mentions: DataFrame, entities: DataFrame, typed: bool = True) -> DataFrame:
    """The name is an alias in any case; the smallest id wins."""
    keys = ["universe", "norm"] + (["type"] if typed else [])
    known = entities.select("universe", "type", "entity_id", F.explode("aliases").alias("a")).withColumn("norm", F.lower("a")).groupBy(*keys).agg(F.min("entity_id").alias("entity_id"))
    return normal(mentions).join(known.hint("merge"), keys).select("mention_id", "entity_id")


def resolve(mentions: DataFrame, entities: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Every mention with its entity: exact, else fuzzy, else alias, else semantic match, else a new entity.

    Mentions without a match that share a natural key make one new entity, known by its first mention.
    """
    steps = [("exact", match_exact(mentions, entities)), ("fuzzy", match_fuzzy(mentions, entities)), ("alias", match_alias(mentions, entities))]
    if semantic is not None:
        steps.append(("semantic", semantic))
    told = normal(mentions)
    for name, found in steps:
        told = told.join(found.withColumnRenamed("entity_id", name).hint("merge"), "mention_id", "left")
    names = [n for n, _ in steps]
    how = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names], F.lit("new"))
    told = told.withColumn("how", how).withColumn("entity_id", F.coalesce(*names))
    fresh = told.where("entity_id IS NULL").groupBy(*KEY).agg(F.min("mention_id").alias("new_of"))
    before = entities.select("entity_id", F.col("status").alias("previous_status")) if "status" in entities.columns else None
    told = told.join(fresh, KEY, "left").withColumn("new_of", F.when(F.col("entity_id").isNull(), F.col("new_of")))
    return told.join(before, "entity_id", "left") if before is not None else told


def merge_fields(old: DataFrame, new: DataFrame, gate: float = 0.7) -> DataFrame:
    """Existing rows with the incoming fields: aliases joined in order, the description of more bytes, only missing properties, the greater confidence.

    An incoming status counts unless it is empty or the writer has dismissed or merged the row; a candidate sure enough becomes active.
    """
    n = new if "status" in new.columns else new.withColumn("status", F.lit(""))
    n = n.select("entity_id", *[F.col(c).alias(f"n_{c}") for c in ("aliases", "description", "props", "confidence", "status")])
    told = old.join(n, "entity_id", "left")
    aliases = F.array_distinct(F.concat("aliases", F.coalesce("n_aliases", F.array().cast("array<string>"))))
    longer = F.when(F.octet_length("n_description") > F.octet_length("description"), F.col("n_description")).otherwise(F.col("description"))
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    props = F.when(F.col("n_props").isNull(), F.col("props")).otherwise(F.map_zip_with("props", "n_props", lambda k, a, b: F.when(empty(a), b).otherwise(a)))
    confidence = F.greatest("confidence", F.coalesce("n_confidence", "confidence"))
    status = F.when(F.col("status").isin("dismissed", "merged") | empty(F.col("n_status")), F.col("status")).otherwise(F.col("n_status"))
    status = F.when((status == "candidate") & (confidence >= gate), "active").otherwise(status)
    return told.select("entity_id", aliases.alias("aliases"), longer.alias("description"), props.alias("props"), confidence.alias("confidence"), status.alias("status"))


def duplicate_keys(entities: DataFrame) -> DataFrame:
    return normal(entities).groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def winner_map(entities: DataFrame) -> DataFrame:
    """(entity_id, winner) of each entity that loses to one of its natural key: longest description, then oldest, then smallest id.

    The winner of a key is found by aggregation, so that a key of very many rows is no single task's.
    """
    best = F.min(F.struct((-F.char_length("description")).alias("l"), "created", "entity_id"))
    winners = normal(entities).groupBy(*KEY).agg(best.alias("b")).select(*KEY, F.col("b.entity_id").alias("winner"))
    return normal(entities).join(winners, KEY).where("entity_id <> winner").select("entity_id", "winner")


def consolidate_attributes(entities: DataFrame, losers: DataFrame) -> DataFrame:
    """(winner, aliases, description): losing names and all aliases, different in any case, in the order of their lower case."""
    told = entities.join(losers, "entity_id", "left").withColumn("to", F.coalesce("winner", "entity_id"))
    own = entities.select(F.col("entity_id").alias("to"), F.lower("name").alias("own"))
    names = told.where("winner IS NOT NULL").select("to", F.col("name").alias("alias")).unionByName(told.select("to", F.explode("aliases").alias("alias")))
    some = names.join(own.hint("merge"), "to").where(F.lower("alias") != F.col("own"))
    first = some.groupBy("to", F.lower("alias").alias("low")).agg(F.min("alias").alias("alias"))
    lists = first.groupBy("to").agg(F.transform(F.array_sort(F.collect_list(F.struct("low", "alias"))), lambda s: s["alias"]).alias("aliases"))
    text = told.groupBy("to").agg(F.max(F.struct(F.char_length("description").alias("n"), "description"))["description"].alias("description"))
    return text.join(lists.hint("merge"), "to", "left").join(losers.select(F.col("winner").alias("to")).distinct(), "to", "left_semi").select(F.col("to").alias("winner"), "aliases", "description")


def repoint(fact: DataFrame, losers: DataFrame, column: str) -> DataFrame:
    """The fact table with losing ids replaced."""
    told = fact.join(losers.select(F.col("entity_id").alias(column), "winner"), column, "left")
    return told.withColumn(column, F.coalesce("winner", column)).drop("winner").select(*fact.columns)


def repoint_array(df: DataFrame, losers: DataFrame, key: str, column: str) -> DataFrame:
    """Arrays that hold a losing id with it replaced, different ids in order; other arrays as they are."""
    told = df.select(key, F.explode(column).alias("id")).join(losers.withColumnRenamed("entity_id", "id").hint("merge"), "id", "left")
    changed = told.groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("winner", "id"))).alias("_new"), F.count("winner").alias("_n")).where("_n > 0").drop("_n")
    return df.join(changed.hint("merge"), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def transfer_satellites(rows: DataFrame, losers: DataFrame, order: str) -> DataFrame:
    """One row for each entity: a winner's own, else its losers' newest; losers keep none."""
    moved = rows.join(losers, "entity_id").withColumn("entity_id", F.col("winner")).drop("winner")
    kept = rows.join(losers.select("entity_id"), "entity_id", "left_anti")
    return kept.unionByName(distinct_on(moved.join(kept.select("entity_id"), "entity_id", "left_anti"), ["entity_id"], F.desc(order)))


def review_candidates(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Candidates with their newest mention, least sure first, then the one changed longest ago (``updated_at``, if there), then by id."""
    last = mentions.groupBy("entity_id").agg(F.max_by(F.struct("snippet", "chapter_no"), F.struct("created_at", "mention_id")).alias("m"))
    told = entities.where("status = 'candidate'").join(last.hint("merge"), "entity_id", "left")
    changed = ["updated_at"] if "updated_at" in entities.columns else []
    return number(told.select("universe", "entity_id", "name", "confidence", *changed, "m.snippet", "m.chapter_no"), ["universe"], ["confidence", *changed, "entity_id"], "place").drop(*changed)


def decided(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """(entity_id, decision, target, decision_id) of each candidate's first decision that holds: accept, dismiss, or merge into an active entity of its universe."""
    d = distinct_on(decisions, ["entity_id"], "decision_id").select("entity_id", "decision", "target", "decision_id")
    told = entities.where("status = 'candidate'").select("entity_id", "universe").join(d.hint("merge"), "entity_id")
    targets = entities.where("status = 'active'").select(F.col("entity_id").alias("target"), F.col("universe").alias("_u"))
    told = told.join(targets.hint("merge"), "target", "left")
    merges = (F.col("decision") == "merge") & (F.col("_u") == F.col("universe")) & (F.col("target") != F.col("entity_id"))
    return told.where(F.col("decision").isin("accept", "dismiss") | merges).select("entity_id", "decision", F.when(F.col("decision") == "merge", F.col("target")).alias("target"), "decision_id")


def apply_decisions(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities after the first decision on each candidate, with ``merged_into``; decisions that do not hold change nothing.

    An entity that others merge into gets their aliases after its own, in the order of the decisions, the longest description, the properties
    that it lacks, and the greatest confidence (of those columns that there are).
    """
    d = decided(entities, decisions)
    mine = F.when(F.col("decision") == "accept", "active").when(F.col("decision") == "dismiss", "dismissed").when(F.col("decision") == "merge", "merged")
    told = entities.join(d.select("entity_id", "decision", F.col("target").alias("merged_into")).hint("merge"), "entity_id", "left").withColumn("status", F.coalesce(mine, "status")).drop("decision")
    merges = d.where("decision = 'merge'").select("entity_id", F.col("target").alias("to"), F.col("decision_id").alias("nth"))
    own = merges.select(F.col("to").alias("entity_id"), "to", F.lit(None).cast(merges.schema["nth"].dataType).alias("nth")).distinct()
    # a target and all that merge into it, the target first
    group = entities.join(merges.unionByName(own).hint("merge"), "entity_id")
    order = F.struct(F.col("nth").isNotNull().alias("later"), "nth")
    fields = []
    if "aliases" in entities.columns:
        first = group.select("to", order.alias("o"), F.posexplode("aliases").alias("i", "alias")).groupBy("to", "alias").agg(F.min(F.struct("o", "i")).alias("o"))
        fields.append(("aliases", first.groupBy("to").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "alias"))), lambda x: x["alias"]).alias("_aliases"))))
    if "description" in entities.columns:
        best = F.min(F.struct((-F.char_length(F.coalesce("description", F.lit("")))).alias("n"), order.alias("o"), "description"))
        fields.append(("description", group.groupBy("to").agg(best["description"].alias("_description"))))
    if "props" in entities.columns:
        known = group.select("to", order.alias("o"), F.explode("props").alias("k", "v"))
        best = known.groupBy("to", "k").agg(F.min(F.struct((F.coalesce("v", F.lit("")) == "").alias("empty"), "o", "v"))["v"].alias("v"))
        fields.append(("props", best.groupBy("to").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("_props"))))
    if "confidence" in entities.columns:
        fields.append(("confidence", group.groupBy("to").agg(F.max("confidence").alias("_confidence"))))
    for name, df in fields:
        told = told.join(df.withColumnRenamed("to", "entity_id").hint("merge"), "entity_id", "left").withColumn(name, F.coalesce(f"_{name}", name)).drop(f"_{name}")
    return told.select(*entities.columns, "merged_into")


def merge_references(entities: DataFrame, decisions: DataFrame, facts: dict | None = None, arrays: dict | None = None, satellites: dict | None = None) -> dict[str, DataFrame]:
    """Tables that refer to merged candidates, with their targets in place.

    ``facts`` are (table, id column), ``arrays`` (table, key, array column), ``satellites`` (table with one row for each entity, newest by column).
    """
    losers = decided(entities, decisions).where("decision = 'merge'").select("entity_id", F.col("target").alias("winner"))
    out = {name: repoint(df, losers, column) for name, (df, column) in (facts or {}).items()}
    out |= {name: repoint_array(df, losers, key, column) for name, (df, key, column) in (arrays or {}).items()}
    return out | {name: transfer_satellites(df, losers, order) for name, (df, order) in (satellites or {}).items()}


def resolve_relation_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_id, reason) of each name: the one entity of that name or alias, else the one with a name or alias that starts with it as whole words."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    forms = entities.select("entity_id", F.explode(F.array_append("aliases", F.col("name"))).alias("form")).select("entity_id", F.lower(squeeze(F.col("form"))).alias("norm")).where("norm <> ''").distinct()
    exact = forms.groupBy("norm").agg(F.count_distinct("entity_id").alias("n_exact"), F.min("entity_id").alias("e_exact"))
    words = F.split("norm", " ")
    shorter = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    heads = forms.where(F.size(words) > 1).select("entity_id", F.explode(shorter).alias("norm"))
    prefix = heads.groupBy("norm").agg(F.count_distinct("entity_id").alias("n_prefix"), F.min("entity_id").alias("e_prefix"))
    told = relations.select("name").distinct().withColumn("norm", F.lower(squeeze(F.col("name")))).join(exact.hint("merge"), "norm", "left").join(prefix.hint("merge"), "norm", "left")
    pick = F.when(F.col("n_exact") == 1, F.col("e_exact")).when(F.col("n_exact").isNull() & (F.col("n_prefix") == 1), F.col("e_prefix"))
    reason = F.when(F.col("n_exact") == 1, "exact").when(F.col("n_exact") > 1, "ambiguous").when(F.col("n_prefix") == 1, "prefix").when(F.col("n_prefix") > 1, "ambiguous").otherwise("unknown")
    return told.select("name", pick.alias("entity_id"), reason.alias("reason"))


def clone_id(column: Column, target: str) -> Column:
    """A new id that old id and target universe decide."""
    return F.sha2(F.concat(column.cast("string"), F.lit("/"), F.lit(target)), 256)


@dataclass
class Cloned:
    """A table of a universe: its own id, columns and arrays that hold ids of other tables (by name), and a fingerprint to be told apart.

    A row of a ``linked`` table is left out if an end is no row of the table that it refers to. A large table names the ``tasks`` that its ids meet in.
    """

    rows: DataFrame
    own: str | None = None
    refs: dict[str, str] = field(default_factory=dict)
    arrays: dict[str, str] = field(default_factory=dict)
    fingerprint: str | None = None
    linked: bool = False
    tasks: int | None = None


def clone_universe(tables: dict[str, Cloned], target: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deep copies under new ids, and (table_name, skipped): rows of linked tables that were left out.

    Single ids that point outside become null; arrays keep their order and lose ids that point outside. Tables with arrays need
    an own id. The copies can be made again: new ids follow from old ones.
    """
    ids = {name: t.rows.select(F.col(t.own).alias("_id")).distinct() for name, t in tables.items() if t.own}
    out, skipped = {}, None
    for name, t in tables.items():
        df = t.rows
        for column, other in t.refs.items():
            known = ids[other].withColumnsRenamed({"_id": column}).withColumn("_in", F.lit(True))
            if t.tasks:
                df, known = df.repartition(t.tasks, column), known.repartition(t.tasks, column)
            df = df.join(known.hint("merge"), column, "left")
            df = df.withColumn(column, F.when(F.col("_in"), clone_id(F.col(column), target))).drop("_in")
        for column, other in t.arrays.items():
            one = t.rows.select(F.col(t.own).alias("_key"), F.posexplode(column).alias("_i", "_id")).join(ids[other].hint("merge"), "_id")
            kept = one.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_id"))), lambda r: clone_id(r["_id"], target)).alias("_new"))
            df = df.join(kept.hint("merge"), F.col(t.own) == F.col("_key"), "left").withColumn(column, F.coalesce("_new", F.array().cast("array<string>"))).drop("_key", "_new")
        if t.fingerprint:
            df = df.withColumn(t.fingerprint, F.when(F.col(t.fingerprint) != "", F.concat(t.fingerprint, F.lit(f":{target}"))).otherwise(F.col(t.fingerprint)))
        if t.own:
            df = df.withColumn(t.own, clone_id(F.col(t.own), target))
        if t.linked:
            whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in t.refs])
            lost = df.agg(F.count_if(~whole).alias("skipped")).select(F.lit(name).alias("table_name"), "skipped")
            skipped, df = lost if skipped is None else skipped.unionByName(lost), df.where(whole)
        out[name] = (df.withColumn("universe", F.lit(target)) if "universe" in df.columns else df).select(*t.rows.columns)
    return out, skipped
