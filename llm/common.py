"""Shared-folder tables, hot-key bounds and small helpers for the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests), one below the warehouse."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and any executor can read it again.

    Results read these tables until they are done; ``clear_written`` then removes all that a session wrote.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Delete the table behind a DataFrame made by written(); only when nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, f)


def clear_written(spark: SparkSession) -> int:
    """Delete every table that this session's operators wrote, once their results are stored; says how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)


ARROW_ROWS = 2000


def small_batches(df: DataFrame) -> None:
    """Send texts to Python workers in batches of ARROW_ROWS rows unless the session asks for fewer: a batch of Spark's
    default size holds tens of megabytes of text, twice over while its buffers grow."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, null: 0; counted as starts of words, without an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
