"""Structured Streaming jobs. Each takes a streaming (or batch) table of events with event time ``ts``.

State is bounded by a watermark or kept per key in the RocksDB store; what a job emits in append mode is final.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import ARCHIVE_AT, BUMP, DECAY, REACTIVATED
from ..operators.aggregates import number
from ..operators.folds import applied, composed, step_of
from ..sources.scratch import keep, scratch_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EWMA_NEW, FADE = 0.35, math.exp(-DECAY)


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, zoneless times as timestamps."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select([F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in raw.dtypes])


def valid_submissions(stream: DataFrame) -> DataFrame:
    """Submissions with a user, a kind and a text."""
    return stream.where(F.col("user_id").isNotNull() & (F.trim(F.coalesce("event_type", F.lit(""))) != "") & (F.trim(F.coalesce("props", F.lit(""))) != ""))


def rejected_submissions(stream: DataFrame) -> DataFrame:
    reason = F.when(F.col("user_id").isNull(), "no user").when(F.trim(F.coalesce("event_type", F.lit(""))) == "", "no kind").when(F.trim(F.coalesce("props", F.lit(""))) == "", "no text")
    return stream.withColumn("reason", reason).where("reason IS NOT NULL")


def submission_key() -> Column:
    return F.sha2(F.concat_ws("|", F.col("event_type"), F.col("props")), 256)


def dedup_submissions(stream: DataFrame, delay: str) -> DataFrame:
    """The first of equal submissions within the watermark."""
    return stream.withColumn("key", submission_key()).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


class _PerWork(StatefulProcessor):
    """Numbers the rows of a work in order of event time, across batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        self.seen.update((n + len(batch),))
        yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"].to_numpy(), "seq": range(n + 1, n + len(batch) + 1)})

    def close(self) -> None:
        pass


def per_work(stream: DataFrame) -> DataFrame:
    """One ordered sequence for each user: rows of a batch in event time, batches as they come."""
    return stream.groupBy("user_id").transformWithStateInPandas(_PerWork(), "user_id bigint, event_id bigint, seq bigint", "append", "none")


class _Relevance(StatefulProcessor):
    """Score and status of an entity after each batch of its mentions and ticks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "relevance double, status string, mentions bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        score, status, n = self.now.get() if self.now.exists() else (0.5, "active", 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for tick in batch["tick"]:
            if not tick:
                score, status, n = (REACTIVATED if status == "archived" else min(1.0, score + BUMP)), "active", n + 1
            elif status == "active":
                score *= FADE
                status = "archived" if score <= ARCHIVE_AT else status
        self.now.update((float(score), status, int(n)))
        yield pd.DataFrame({"entity_id": [key[0]], "relevance": [float(score)], "status": [status], "mentions": [int(n)]})

    def close(self) -> None:
        pass


def relevance_stream(events: DataFrame) -> DataFrame:
    """Running relevance of each entity, one row for each batch that has any of its events.

    An event (entity_id, ts, event_id, tick) is a mention, which raises or brings back, or a tick without one, which fades
    and archives at the threshold.
    """
    return events.select("entity_id", "ts", "event_id", "tick").groupBy("entity_id").transformWithStateInPandas(_Relevance(), "entity_id bigint, relevance double, status string, mentions bigint", "update", "none")


def telemetry_stream(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and latencies of closed windows."""
    told = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    out = told.agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("slow"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    return out.select(F.col("window.start").alias("start"), "event_type", "total", "slow", "mean", "most")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Closed bursts of a user's edits with the last text."""
    told = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id")
    return told.agg(F.count("*").alias("n"), F.max_by("props", "ts").alias("last")).select("user_id", F.col("session_window.start").alias("start"), "n", "last")


def behavioural_accepts(notes: DataFrame, edits: DataFrame, within: str = "10 minutes", delay: str = "1 hour", text: str | None = None) -> DataFrame:
    """(note_id, edit_id): a note, and an edit of the same user that follows it in time; with ``text``, one that changed that column, which was not blank before."""
    told = [F.col(text).alias(n) if text else F.lit(None).cast("string").alias(n) for n in ("before", "after")]
    a = notes.select(F.col("event_id").alias("note_id"), "user_id", F.col("ts").alias("note_ts"), told[0]).withWatermark("note_ts", delay)
    b = edits.select(F.col("event_id").alias("edit_id"), F.col("user_id").alias("edit_user"), F.col("ts").alias("edit_ts"), told[1]).withWatermark("edit_ts", delay)
    on = (F.col("user_id") == F.col("edit_user")) & (F.col("edit_ts") >= F.col("note_ts")) & (F.col("edit_ts") <= F.col("note_ts") + F.expr(f"interval {within}"))
    if text:
        on = on & (F.trim("before") != "") & (F.col("before") != F.col("after"))
    return a.join(b, on).select("note_id", "edit_id")


def progress(events: DataFrame, total: int) -> DataFrame:
    """Per user: smoothed seconds for each event, and the time left once a tenth is done; in order of time.

    An event without a time counts as done and has no seconds. Events are numbered and meet their predecessor by number, and
    the smoothing steps compose, so a user with most of the events is no single task's.
    """
    at = events.select("user_id", "event_id", F.col("ts").cast("double").alias("_at"))
    placed = keep(number(at.where("_at IS NOT NULL"), ["user_id"], ["_at", "event_id"], "_n"))
    before = placed.select("user_id", (F.col("_n") + 1).alias("_n"), F.col("_at").alias("_was"))
    gaps = placed.join(before.hint("merge"), ["user_id", "_n"]).select("user_id", "_n", (F.col("_at") - F.col("_was")).alias("gap"))
    # the first gap is the first mean
    steps = gaps.withColumn("step", F.when(F.col("_n") == 2, step_of(0, F.col("gap"))).otherwise(step_of(1 - EWMA_NEW, EWMA_NEW * F.col("gap"))))
    told = composed(steps, ["user_id"], ["_n"], ["step"]).select("user_id", applied(F.col("step"), F.lit(0.0)).alias("_mean"))
    last = at.groupBy("user_id").agg(F.count("*").alias("done")).join(told.hint("merge"), "user_id", "left")
    left = F.round(F.col("_mean") * F.greatest(F.lit(total) - F.col("done"), F.lit(0)), 6)
    return last.select("user_id", "done", F.round("_mean", 6).alias("seconds"), F.when(F.col("done") * 10 >= total, left).alias("eta"))


#: How long after its mention an alert is remembered, in event time; the same alert later than that is told again.
REMEMBERED = "30 days"


class _Told(StatefulProcessor):
    """Lets the first of equal alerts through, and forgets it when the watermark passes its end."""

    def __init__(self, milliseconds: int):
        self.kept = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:  # one row at a time of a key is all that is held
            least = batch.sort_values(["ts", "entity_id"]).iloc[:1]
            first = least if first is None or least["ts"].iloc[0] < first["ts"].iloc[0] else first
        if self.until.exists():
            return
        end = int(first["ts"].iloc[0].timestamp() * 1000) + self.kept
        self.until.update((end,))
        self.handle.registerTimer(end)
        yield first[["entity_id", "kind", "fingerprint"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield pd.DataFrame({"entity_id": pd.Series([], dtype="int64"), "kind": pd.Series([], dtype="object"), "fingerprint": pd.Series([], dtype="object")})

    def close(self) -> None:
        pass


def alerts(mentions: DataFrame, entities: DataFrame, stored: DataFrame, remembered: str = REMEMBERED, delay: str = "1 hour") -> DataFrame:
    """(entity_id, kind, fingerprint) as they appear: mentions of deceased entities whose contradiction is not stored, and of entities that are not known.

    ``mentions`` have entity_id, ts, text and chapter. A contradiction's fingerprint holds its evidence and chapters, so each new place is
    told; equal ones are told once within ``remembered`` of event time, kept as state that a timer ends. A discovery's is the entity alone.
    """
    from ..operators.consistency import DECEASED, deceased_fingerprint, fingerprint

    told = mentions.withWatermark("ts", delay).join(entities.select("entity_id", "name", "status"), "entity_id", "left")
    kind = F.when(F.col("status").isNull(), "entity_discovered").when(F.col("status") == "deceased", DECEASED)
    told = told.withColumn("kind", kind).where("kind IS NOT NULL")
    mark = F.when(F.col("kind") == DECEASED, deceased_fingerprint(F.col("entity_id"), F.col("name"), F.col("text"), F.col("chapter"))).otherwise(fingerprint(F.col("entity_id"), F.col("kind")))
    found = told.select("ts", F.col("entity_id").cast("long").alias("entity_id"), "kind", mark.alias("fingerprint"))
    found = found.join(stored.select("fingerprint").distinct(), "fingerprint", "left_anti")
    milliseconds = int(pd.Timedelta(remembered).total_seconds() * 1000)
    return found.groupBy("fingerprint").transformWithStateInPandas(_Told(milliseconds), "entity_id bigint, kind string, fingerprint string", "append", "EventTime")


def batch_writer(folder: str):
    """Writes a batch under its number in place of whatever an earlier try left there, so a batch that is run again doubles nothing."""

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/_batch={n}")

    return write


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All that a stream emits from what its source holds now, as a table; each batch is a folder of its own, and column _batch has its number but in append mode.

    With ``folder`` a stopped stream goes on where it was.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark) if folder is None else folder
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.outputMode(mode).foreachBatch(batch_writer(f"{folder}/out")).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    # a stream without any row has no folder
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/_batch=-1")
    told = spark.read.schema(stream.schema.add("_batch", "integer")).parquet(f"{folder}/out")
    return told if mode != "append" else told.drop("_batch")
