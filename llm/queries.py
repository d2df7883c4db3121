"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fill_in_middle, filter_audit, html_extract, line_dedup, mixing, ngram_join, pieces, pii, quality, secrets, substring_dedup, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    """The vocabulary that op13 encodes with."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": lambda s, d: line_dedup.query(table(s, d, "documents")),
        "op2_html_extraction": lambda s, d: html_extract.query(table(s, d, "pages")),
        "op3_benchmark_decontamination": lambda s, d: decontaminate.query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
        "op5_quality_rules": lambda s, d: quality.query(table(s, d, "documents")),
        "op6_ngram_jaccard_join": lambda s, d: ngram_join.jaccard_join(table(s, d, "documents")),
        "op7_personal_data": lambda s, d: pii.query(table(s, d, "documents")),
        "op8_source_mixing": lambda s, d: mixing.query(table(s, d, "documents")),
        "op9_secret_scan": lambda s, d: secrets.query(table(s, d, "documents")),
        "op10_substring_dedup": lambda s, d: substring_dedup.query(table(s, d, "documents")),
        "op11_fill_in_middle": lambda s, d: fill_in_middle.query(table(s, d, "documents")),
        "op12_filter_audit": lambda s, d: filter_audit.query(table(s, d, "documents"), table(s, d, "labels")),
        "op13_sentencepiece": lambda s, d: pieces.query(table(s, d, "documents"), piece_model()),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op5_quality_rules": quality.ORACLE, "op11_fill_in_middle": fill_in_middle.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
