"""Columns of the user's keep their values under whatever names the operators use inside."""

import pytest

from palimpsest.llm import op01_bpe, op02_decontamination, op03_suffix_array_dedup, op04_language_id, op05_substring_dedup, op09_simhash, op10_quality_rules
from palimpsest.llm.common import append

NAMES = ("_block", "_row_1", "_Row_2", "_row_key", "_need_0", "_need_1", "_row", "_words", "_lines", "_key", "_k")


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3, "another text", "", None]
    return spark.createDataFrame([(i, t, "en", *range(700, 700 + len(NAMES))) for i, t in enumerate(texts)], ["doc_id", "text", "lang", *NAMES])


def kept(df):
    names = [c for c in df.columns if c in NAMES]
    assert names == list(NAMES)
    rows = df.collect()
    assert rows and all([r[c] for c in NAMES] == list(range(700, 700 + len(NAMES))) for r in rows)


def test_appended_columns(docs):
    from pyspark.sql import types as T

    kept(append(docs, [T.StructField("n", T.LongType())], lambda t: [[len(x or "") for x in t.column("text").to_pylist()]], need=["text", "doc_id"]))


@pytest.mark.parametrize("drop", [op03_suffix_array_dedup.drop_repeats, op05_substring_dedup.drop_repeats, op09_simhash.keep_first, op10_quality_rules.judge])
def test_filters_and_cuts(docs, drop):
    kept(drop(docs))


def test_decontamination(spark, docs):
    kept(op02_decontamination.decontaminate(docs, spark.createDataFrame([(1, "one two three")], "item_id long, text string")))


def test_models_and_tokens(spark, docs):
    kept(op01_bpe.encode(docs))
    learn = spark.createDataFrame([(i, f"{w} " * 30, lang) for i, (w, lang) in enumerate([("north", "en"), ("nord", "de")] * 12)], "doc_id long, text string, lang string")
    kept(op04_language_id.identify(docs, op04_language_id.train(learn)))
