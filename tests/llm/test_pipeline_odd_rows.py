"""Pipeline stages on nulls, empty and long texts, repeated rows, clashing columns and no rows at all."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
EXTRA = ("rejected", "score", "fp", "n_words", "items", "spans", "ids", "key", "block")


def test_stages(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    long = " ".join(r.text for r in base if r.lang == "en") * 20
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *EXTRA) for r in base]
    rows += [(1001, None, "en", None, None, *EXTRA), (1002, "", None, "s", 0, *EXTRA), (1003, "  \n ", None, "s", 4, *EXTRA), (1004, long, "en", "s", len(long), *EXTRA), (1004, long, "en", "s", len(long), *EXTRA), (None, "a text without a number", "en", "s", 1, *EXTRA)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(tuple(r[-len(EXTRA) :]) == EXTRA for r in kept), name
        docs = spark.createDataFrame(kept, schema)
        assert {r.doc_id for r in kept} <= {r.doc_id for r in before.collect()}
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and 1004 in ids and not {1001, 1002, 1003, None} & set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in last.collect()) == sorted(ids)


def test_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
