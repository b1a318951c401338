"""The corpus queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op01_bpe import op1_bpe
from .op02_decontamination import ORACLE as ORACLE_2
from .op02_decontamination import op2_decontamination
from .op03_suffix_array_dedup import op3_suffix_array_dedup
from .op04_language_id import op4_language_id
from .op05_substring_dedup import ORACLE as ORACLE_5
from .op05_substring_dedup import op5_substring_dedup
from .op06_sharding import op6_sharding
from .op07_quality_classifier import op7_quality_classifier
from .op08_html_extraction import op8_html_extraction
from .op09_simhash import op9_simhash
from .op10_quality_rules import ORACLE as ORACLE_10
from .op10_quality_rules import op10_quality_rules
from .op11_ngram_join import op11_ngram_join
from .op12_whitening import op12_whitening
from .op13_prefix_trie import op13_prefix_trie


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_bpe, op2_decontamination, op3_suffix_array_dedup, op4_language_id, op5_substring_dedup,
        op6_sharding, op7_quality_classifier, op8_html_extraction, op9_simhash, op10_quality_rules, op11_ngram_join, op12_whitening, op13_prefix_trie, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": ORACLE_2, "op5_substring_dedup": ORACLE_5, "op10_quality_rules": ORACLE_10}
