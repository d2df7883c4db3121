"""The corpus pipeline: quality rules, line dedup, Jaccard join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents.  All but the last return the columns of
documents; each works on everything its predecessor kept.

Defined cases: documents with a null or blank text go at the first stage; a null doc_id comes
last among equal lines and among near copies; of equal lines and of near copies the one with the
least doc_id stays; rows that repeat a doc_id stand at the same place, and of rows that are near
copies one stays, whatever their ids are; a null source is a source of its own; columns of any other name pass through, but for
``size``, ``shard``, ``copy`` and ``place``, which the last stage sets; empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, line_dedup, mixing, ngram_join, quality
from llm.common import table, written

#: Near copies in a corpus; the defaults of the join are those of the op6 contract.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Lines are near copies at one edit in ten code points or more; "}" is no copy of "{".  Equal lines are copies at any length.
NEAR_LINE_CHARS = 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_filter(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, equal or within one edit (from NEAR_LINE_CHARS on), are taken out; documents without a line left go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, min_chars=NEAR_LINE_CHARS).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones (NEAR_PERCENT of their NEAR_WORDS-word shingles shared) stays: the least doc_id, null last.

    Rows are linked, not doc_ids: each gets a number, stored with it, so that rows which share an id are judged by their texts.
    """
    number = next(c for k in range(len(docs.columns) + 1) if (c := f"row_number{k or ''}") not in docs.columns)
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-rows")
    groups = ngram_join.jaccard_join(numbered, doc_id=number, n=NEAR_WORDS, percent=NEAR_PERCENT).select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select(F.col(number).alias("row"), "doc_id")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    stays = groups.join(ids, "row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("stays"))
    return numbered.join(stays, F.col(number) == F.col("stays"), "left_semi").drop(number)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each copy taken, with its shard, copy and place in the shard's order."""
    mixed = mixing.shuffled(mixing.mix_sources(docs))
    own = [c for c in docs.columns if c not in ("mix", "size", "shard", "copy", "place")]
    return mixed.select(*own, F.col("mix.size").alias("size"), F.col("mix.shard").alias("shard"), F.col("mix.copy").alias("copy"), F.col("mix.place").alias("place"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: The last stage draws at random (seeded), which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
