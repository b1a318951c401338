"""Tables that a query writes once and reads where it needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one where all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='palimpsest-')).rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """The rows written out and read back: later uses read columns of a table instead of computing them anew."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
