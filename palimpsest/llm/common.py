"""What the corpus operators share: reading tables, cutting lineage, appending columns in Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch: whole texts may be long, so a batch holds few of them.
BATCH_ROWS = 512
#: Bytes of text that a task handles at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts, unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(spark))
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in spark.checkpoint.dir; a temporary one only where all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="palimpsest-")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the scratch folder. Unlike a checkpoint it also forgets how large Spark thinks them, which every join of a loop would square."""
    path = f"{scratch_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes, each text whole."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (n + "_" * i for i in range(len(taken) + 1)) if x.lower() not in taken) for n in names]


def append(df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.Table], list], need: list[str], keep: list[str] | None = None) -> DataFrame:
    """Columns computed from the columns ``need`` of each Arrow batch, after the columns ``keep`` (all by default).

    A new column replaces an input column of the same name; other columns pass untouched.
    """
    small_batches(df.sparkSession)
    new = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    hidden = dict(zip(need, fresh(df, *[f"_need_{i}" for i in range(len(need))]), strict=True))
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = pa.table([batch.column(batch.schema.get_field_index(h)) for h in hidden.values()], names=list(hidden))
            made = compute(given)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *[x if isinstance(x, pa.Array) else pa.array(x) for x in made]], names=[*kept, *new])

    return source.mapInArrow(run, schema)


def sample(rows: DataFrame, key: str, value: str, n: int, each: int = 1 << 20, total: int = 32 << 20) -> DataFrame:
    """(key, value) of the n keys with the smallest hashes, to fit a model on: at most ``total`` bytes, no value above ``each``.

    Every key has one row, with the least of its values, however often it is given. Rows without key or value are left out.
    """
    known = rows.select(F.col(f"`{key}`").alias(key), F.col(f"`{value}`").alias(value)).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    order = [F.xxhash64("_k"), F.col("_k")]
    sizes = known.groupBy(F.col(key).alias("_k")).agg(F.max(F.octet_length(value).cast("long")).alias("_bytes")).where(F.col("_bytes") <= each)
    # n rows at most from here on
    first = sizes.orderBy(*order).limit(n).withColumn("_sum", F.sum("_bytes").over(Window.orderBy(*order))).where(F.col("_sum") <= total)
    return known.join(F.broadcast(first.select("_k")), F.col(key) == F.col("_k")).groupBy(key).agg(F.min(value).alias(value))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` or PALIMPSEST_TOKENIZERS replaces the installed ones."""
    if folder := folder or os.environ.get("PALIMPSEST_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
