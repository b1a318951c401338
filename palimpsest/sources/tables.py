"""Reading tables and manuscripts, idempotent loads, job progress, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; zoneless timestamps become timestamps, so that streams and watermarks accept them."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select([F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables by name, also registered as temporary views."""
    made = {name: scan(spark, sf_dir, name) for name in TABLES}
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return made


def read_manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, text, error): Markdown and text files without byte-order mark; others get an error and no text."""
    raw = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    ok = ext.isin("md", "markdown", "txt")
    error = F.when(~ok, F.lit("unsupported format")).when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit("empty document"))
    return raw.select("path", ext.alias("ext"), F.when(ok, text).alias("text"), error.alias("error"))


def new_jobs(batch: DataFrame, jobs: DataFrame) -> DataFrame:
    """Batch rows (universe, content_hash, ...) not loaded yet: no job of that content that did not fail, first of its kind in the batch."""
    first = Window.partitionBy("universe", "content_hash").orderBy("batch_id")
    fresh = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    done = jobs.where("status <> 'failed'").select("universe", "content_hash").distinct()
    return fresh.join(done, ["universe", "content_hash"], "left_anti")


def job_view(jobs: DataFrame, n: int = 50) -> DataFrame:
    """Newest n jobs of each universe; a running job has a start, a finished one an end too."""
    newest = Window.partitionBy("universe").orderBy(F.desc("created_at"), F.desc("job_id"))
    started = F.when(F.col("status") != "pending", F.col("created_at"))
    ended = F.when(F.col("status").isin("completed", "failed"), F.col("created_at"))
    return jobs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n).withColumn("started_at", started).withColumn("completed_at", ended)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the update if there is one, else the base row. A later ``version`` wins among updates."""
    both = base.withColumn("version", F.lit(-1).cast("long")).unionByName(updates)
    last = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "version")


#: Chapters in one exported part: a work of any length is a sequence of parts, so no row grows with it.
PART_CHAPTERS = 100


def export_works(chapters: DataFrame, size: int = PART_CHAPTERS) -> DataFrame:
    """(work, part, filename, markdown): chapters in order under second-level headings, in parts that make the file one after another.

    The first part begins with the work's name, later ones with the blank line that parts them from the one before. Chapters are
    numbered by ``order_index`` without gaps.
    """
    parts = F.array_sort(F.collect_list(F.struct("order_index", "text")))
    body = F.array_join(F.transform(parts, lambda c: F.concat(F.lit("## Chapter "), c["order_index"].cast("string"), F.lit("\n\n"), c["text"])), "\n\n")
    name = F.concat(F.regexp_replace(F.lower("work"), "[^a-z0-9]+", "-"), F.lit(".md"))
    part = F.floor(F.col("order_index") / size).cast("long")
    told = chapters.groupBy("work", part.alias("part")).agg(body.alias("markdown"))
    lead = F.when(F.col("part") == 0, F.concat(F.lit("# "), F.col("work"), F.lit("\n\n"))).otherwise(F.lit("\n\n"))
    return told.select("work", "part", name.alias("filename"), F.concat(lead, "markdown").alias("markdown"))


#: Characters of a title at most, and words of a title-case heading.
TITLE_CHARS, TITLE_WORDS = 160, 8


def _clean(value: Column) -> Column:
    """Without blanks and quotation marks around it; empty if it is too long for a title."""
    out = F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")
    return F.when(F.char_length(out) <= TITLE_CHARS, out).otherwise("")


def _is_chapter(value: Column) -> Column:
    return F.lower(F.trim(value)).rlike("^(chapter|capítulo|capitulo) ")


def markdown_title(text: Column) -> Column:
    """The front matter's title; else the first H1, unless it is a chapter's."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    front = F.regexp_extract(body, r"(?s)\A---\r?\n(.*?)(?:\n[ \t]*---[ \t]*\r?(?:\n|\z)|\z)", 1)
    named = F.get(F.filter(F.split(front, "\n"), lambda x: x.rlike(r"(?i)^\s*title\s*:")), 0)
    head = F.get(F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.startswith("# ")), 0)
    h1 = _clean(F.substring(head, 3, 1 << 30))
    return F.when(named.isNotNull(), _clean(F.regexp_replace(named, r"^[^:]*:", ""))).when(head.isNull() | _is_chapter(h1), "").otherwise(h1)


def plain_title(text: Column) -> Column:
    """The first line if a blank one follows, it is no chapter's, and no two title-case headings stand in the text."""
    told = F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    blank = lambda i: F.coalesce(F.get(told, i), F.lit("")) == ""
    marked = lambda x: x.rlike("^#{1,3} ")
    name = lambda x: F.when(marked(x), _clean(F.regexp_replace(x, "^#{1,3} ", ""))).otherwise(x)
    cased = lambda x: name(x).rlike(rf"^\s*\p{{Lu}}\p{{Ll}}*(\s+\p{{Lu}}\p{{Ll}}*){{0,{TITLE_WORDS - 1}}}\s*$") & ~_is_chapter(name(x))
    heads = F.filter(told, lambda x, i: cased(x) & (marked(x) | (F.when(i > 0, blank(i - 1)).otherwise(True) & blank(i + 1))))
    first = _clean(F.get(told, 0))
    return F.when((F.size(told) > 1) & blank(F.lit(1)) & ~_is_chapter(first) & (F.size(heads) < 2), first).otherwise("")


def infer_title(df: DataFrame, text: str = "text", ext: str | None = None) -> DataFrame:
    """With ``title``: by the rule of Markdown, or of plain text where ``ext`` says txt; empty if there is none."""
    t = F.col(text)
    return df.withColumn("title", markdown_title(t) if ext is None else F.when(F.lower(ext) == "txt", plain_title(t)).otherwise(markdown_title(t)))


def latest(keys: list[str], order: list[Column]) -> Column:
    """Place of a row among those of its keys, the first being 1."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
