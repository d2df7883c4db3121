"""Cutting lineage where one plan would grow too large to analyse."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is set (tests), one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the cluster names in spark.checkpoint.dir; where none is set (tests), below the warehouse."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


_STORED: dict[str, dict[str, object]] = {}
_FOLDERS: dict[str, list[str]] = {}


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, which ``clear_stored`` removes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def kept_table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, path: str, missing: str | None = None) -> str:
    """The files below a path by name, length and time: what has been derived from them holds while these do.  missing: said of a path that is not there, else an error."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if missing is not None and not fs.exists(root):
        return missing
    left, found = [root], []
    while left:
        for s in fs.listStatus(left.pop()):
            if s.isDirectory():
                left.append(s.getPath())
            else:
                found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return "\n".join(sorted(found))


def derived_once(spark: SparkSession, name: str, path: str, make: Callable[[], T]) -> T:
    """What ``make`` stores in the shared folder, made once a session for the files that now lie under path."""
    mine = _STORED.setdefault(spark.sparkContext.applicationId, {})
    key = f"{name}\n{files_of(spark, path)}"
    if key not in mine:
        mine[key] = make()
    return mine[key]


def clear_stored(spark: SparkSession) -> int:
    """Delete what this session stored, once nothing reads it any more; says how many folders there were."""
    app = spark.sparkContext.applicationId
    _STORED.pop(app, None)
    folders = _FOLDERS.pop(app, [])
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)
