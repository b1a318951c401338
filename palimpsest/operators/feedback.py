"""What an author's feedback teaches about preferences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import nth
from .folds import applied, composed, step_of

SIGNALS = ("accept", "reject", "behavioural_accept")
WINDOW_SECONDS, NEEDED, DECAY, ARCHIVE_AT = 600, 3, 0.1, 0.15


def validate_feedback(events: DataFrame) -> DataFrame:
    """Every event with a reason, null if it counts: a known signal; a behavioural one needs a change seen within ten minutes."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    behaves = F.col("signal") == "behavioural_accept"
    reason = F.when(~F.col("signal").isin(*SIGNALS), "unknown signal").when(behaves & (blank("before") | F.col("after").isNull()), "missing text").when(behaves & (F.col("before") == F.col("after")), "unchanged").when(behaves & (F.col("age_seconds") < 0), "future").when(behaves & (F.col("age_seconds") > WINDOW_SECONDS), "too late")
    return events.withColumn("reason", reason)


def match_evidence(events: DataFrame, observations: DataFrame) -> DataFrame:
    """(event_id, obs_id): by the observation that an event names, else by its metric, else by its user."""
    o = observations.select("user_id", "obs_id", F.col("metric").alias("_metric"))
    named = events.where("obs_ref IS NOT NULL").join(o, (F.col("obs_ref") == F.col("obs_id")) & (events.user_id == o.user_id)).select("event_id", events.user_id, "signal", "obs_id")
    by_metric = events.where("obs_ref IS NULL AND metric IS NOT NULL").join(o.withColumnRenamed("_metric", "metric"), ["user_id", "metric"]).select("event_id", "user_id", "signal", "obs_id")
    anything = events.where("obs_ref IS NULL AND metric IS NULL").join(o, "user_id").select("event_id", "user_id", "signal", "obs_id")
    return named.unionByName(by_metric).unionByName(anything)


#: What a preference of each style measure is about, and of any other (fixed texts).
ABOUT = {"mean_sentence_length": "long sentence lengths", "adverb_density": "adverb-rich phrasing", "dialogue_ratio": "a dialogue-forward balance", "lexical_richness": "varied vocabulary"}
OTHERWISE = "this craft choice"


def preference_statement(metric: Column, signal: Column) -> Column:
    """What a promoted preference says."""
    verb = F.when(signal == "reject", "deliberately keeps").otherwise("values")
    about = F.coalesce(*[F.when(metric == m, t) for m, t in ABOUT.items()], F.lit(OTHERWISE))
    return F.concat(F.lit("The writer "), verb, F.lit(" "), about, F.lit("."))


def promote(evidence: DataFrame, needed: int = NEEDED) -> DataFrame:
    """Observations whose winning signal has enough events become preferences."""
    counts = evidence.groupBy("user_id", "obs_id", "signal").agg(F.count("*").alias("n"))
    rank = F.when(F.col("signal") == "accept", 0).when(F.col("signal") == "behavioural_accept", 1).otherwise(2)
    best = counts.groupBy("user_id", "obs_id").agg(F.sum("n").alias("events"), F.min_by(F.struct("signal", "n"), F.struct((-F.col("n")).alias("n"), rank.alias("r"))).alias("b"))
    told = best.where((F.col("events") >= needed) & (F.col("b.n") >= needed))
    told = told.join(evidence.select("obs_id", "metric").distinct().hint("merge"), "obs_id") if "metric" in evidence.columns else told.withColumn("metric", F.lit(""))
    text = preference_statement(F.col("metric"), F.col("b.signal"))
    return told.select("user_id", "obs_id", F.col("b.signal").alias("signal"), "events", text.alias("statement"), F.lit(0.5).alias("confidence"), F.lit(1.0).alias("relevance"))


def reinforce_preferences(prefs: DataFrame, events: DataFrame, rate: float = DECAY, threshold: float = ARCHIVE_AT) -> DataFrame:
    """Each preference after its events in order; both numbers stay within 0 and 1, a null one counts as 0.

    An accept of either kind raises confidence, sets relevance to 1 and makes the preference active; a reject fades both numbers; a relevance
    at the threshold archives, whatever the event and without any. Each number's steps compose, and as rejects only lower relevance, the last
    relevance tells whether anything since the last accept archived it.
    """
    fade, signal = math.exp(-rate), F.col("signal")
    accept, behaves, reject = (signal == s for s in ("accept", "behavioural_accept", "reject"))
    confidence = F.when(accept, step_of(1, 0.1, 0, 1)).when(behaves, step_of(1, 0.05, 0, 1)).when(reject, step_of(fade, 0, 0, 1)).otherwise(step_of(1, 0, 0, 1))
    relevance = F.when(accept | behaves, step_of(0, 1, 0, 1)).when(reject, step_of(fade, 0, 0, 1)).otherwise(step_of(1, 0, 0, 1))
    rows = events.select("pref_id", "event_id", "signal", confidence.alias("_c"), relevance.alias("_r"))
    told = composed(rows, ["pref_id"], ["event_id", "signal"], ["_c", "_r"])
    accepts = events.groupBy("pref_id").agg(F.count_if(accept | behaves).alias("_accepts"))
    told = prefs.join(told.hint("merge"), "pref_id", "left").join(accepts.hint("merge"), "pref_id", "left")
    held = F.col("_accepts").isNotNull()
    after = lambda step, c: F.when(held, applied(F.col(step), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))).otherwise(F.col(c))
    told = told.withColumns({"_c1": after("_c", "confidence"), "_r1": after("_r", "relevance")})
    life = F.when(F.col("_r1") <= threshold, "archived").when(F.col("_accepts") > 0, "active").otherwise(F.col("lifecycle"))
    return told.select("pref_id", F.col("_c1").alias("confidence"), F.col("_r1").alias("relevance"), life.alias("lifecycle"))


def decay_preferences(prefs: DataFrame, owners: DataFrame, rate: float = DECAY, threshold: float = ARCHIVE_AT) -> DataFrame:
    """One tick on all active preferences of the owners, whatever their genre."""
    told = prefs.join(owners.select("owner").distinct().withColumn("_o", F.lit(True)).hint("merge"), "owner", "left")
    fades = F.coalesce("_o", F.lit(False)) & (F.col("lifecycle") == "active")
    score = F.when(fades, F.col("relevance") * math.exp(-rate)).otherwise(F.col("relevance"))
    return told.withColumn("relevance", score).withColumn("lifecycle", F.when(fades & (F.col("relevance") <= threshold), "archived").otherwise(F.col("lifecycle"))).drop("_o")


def decay_history(prefs: DataFrame, owners: DataFrame, recorded_at: Column, rate: float = DECAY, threshold: float = ARCHIVE_AT) -> DataFrame:
    """(pref_id, recorded_at, relevance, confidence, lifecycle): the history row of each preference that a tick fades."""
    active = prefs.where("lifecycle = 'active'").join(owners.select("owner").distinct().hint("merge"), "owner", "left_semi")
    return decay_preferences(active, owners, rate, threshold).select("pref_id", recorded_at.alias("recorded_at"), "relevance", "confidence", "lifecycle")


def list_preferences(prefs: DataFrame, active_only: bool, n: int) -> DataFrame:
    some = prefs.where("lifecycle = 'active'") if active_only else prefs
    return some.withColumn("place", nth(["owner"], F.desc(F.round(F.col("relevance") * F.col("confidence"), 9)), F.desc("created"), "pref_id")).where(F.col("place") <= n)


#: Newest events and history records of a preference that its evidence shows.
SHOWN = 1000


def evidence_page(rows: DataFrame, order: str, before: DataFrame | None = None, n: int = SHOWN) -> DataFrame:
    """The newest n rows of each preference by ``order``; with ``before`` (pref_id, place), those older than the place, of its preferences only.

    With the least ``order`` of a page as the next page's place, pages show every row once; rows of one place must then differ in ``order``.
    """
    if before is not None:
        rows = rows.join(before.select("pref_id", F.col("place").alias("_place")).hint("merge"), "pref_id").where(F.col(order) < F.col("_place")).drop("_place")
    return rows.withColumn("_n", nth(["pref_id"], F.desc(order))).where(F.col("_n") <= n).drop("_n")


def evidence_bundle(prefs: DataFrame, events: DataFrame, observations: DataFrame | None = None, history: DataFrame | None = None, n: int = SHOWN) -> DataFrame:
    """Preferences with their observations, and their newest n events and history records, as nested arrays in order.

    Older ones follow page by page (``evidence_page``). ``observations`` and ``history`` have a pref_id; history has recorded_at, relevance, confidence and lifecycle.
    """

    def nested(df: DataFrame, order: str, columns: list[str], name: str, most: int | None) -> DataFrame:
        some = df if most is None else evidence_page(df, order, n=most)
        return some.groupBy("pref_id").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name)).hint("merge")

    out = prefs.join(nested(events, "event_id", ["signal"], "events", n), "pref_id", "left")
    if observations is not None:  # as many as the preference was made from
        out = out.join(nested(observations, "obs_id", ["metric", "value"], "observations", None), "pref_id", "left")
    if history is not None:
        out = out.join(nested(history, "recorded_at", ["relevance", "confidence", "lifecycle"], "history", n), "pref_id", "left")
    return out


def suppressed(applicable: DataFrame, events: DataFrame, needed: int = NEEDED) -> DataFrame:
    """(universe, category): categories that an applicable preference has seen rejected often enough, in any case."""
    n = events.where("signal = 'reject'").groupBy("pref_id", F.lower("category").alias("category")).agg(F.count("*").alias("n")).where(F.col("n") >= needed)
    return applicable.select("universe", "pref_id").join(n, "pref_id").select("universe", "category").distinct()


def normalize_scope(df: DataFrame) -> DataFrame:
    """Tags trimmed, empty ones and repeats gone; universal preferences have none."""
    tags = F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != ""))
    return df.withColumn("tags", F.when(F.col("scope") == "universal", F.array().cast("array<string>")).otherwise(tags))


def validate_scope(df: DataFrame, allowed: list[str]) -> DataFrame:
    """With a reason, null if the scope holds: universal without tags, genre-bound with allowed tags only, one at least."""
    unknown = F.size(F.array_except("tags", F.array(*[F.lit(a) for a in allowed]))) > 0
    reason = F.when(~F.col("scope").isin("universal", "genre_bound"), "unknown scope").when((F.col("scope") == "genre_bound") & (F.size("tags") == 0), "no tags").when(unknown, "unknown tag")
    return df.withColumn("reason", reason)


def is_rewrite(note: Column, quote: Column) -> Column:
    """The note mostly repeats its quote: both have four words or more, and different words in common are 80 in a hundred of the shorter one's."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    n, q = words(note), words(quote)
    return (F.size(n) >= 4) & (F.size(q) >= 4) & (F.size(F.array_intersect(n, q)) * 5 >= F.least(F.size(n), F.size(q)) * 4)


def filter_notes(notes: DataFrame, passages: DataFrame, skills: list[str], suppressed_categories: DataFrame) -> DataFrame:
    """Notes of an allowed skill whose quote is in the passage, that do not rewrite it, and of which neither category nor skill is suppressed.

    Fields are trimmed first; a note without severity is a suggestion.
    """
    told = notes
    for c in ("skill", "quote", "note", "category", "severity"):
        if c in notes.columns:
            told = told.withColumn(c, F.trim(F.coalesce(c, F.lit(""))))
    if "severity" in notes.columns:
        told = told.withColumn("severity", F.when(F.col("severity") == "", "suggestion").otherwise(F.col("severity")))
    told = told.join(passages.hint("merge"), "passage_id").where(F.col("skill").isin(skills) & (F.col("quote") != "") & (F.col("note") != "") & F.contains("text", "quote"))
    off = suppressed_categories.select(F.lower(F.trim("category")).alias("_off")).where("_off <> ''").distinct()
    told = told.where(~is_rewrite(F.col("note"), F.col("quote")))
    for c in ("category", "skill"):
        told = told.join(off.hint("merge"), F.lower(c) == F.col("_off"), "left_anti")
    return told


def limit_selected(df: DataFrame, active: list[str], n: int = 3) -> DataFrame:
    """First n different requested names that are active."""
    names = F.array_distinct(F.transform("requested", lambda t: F.trim(t)))
    return df.withColumn("selected", F.slice(F.array_intersect(names, F.array(*[F.lit(a) for a in active])), 1, n))
