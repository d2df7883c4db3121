"""One committed version of several tables: a manifest that names their files, put in place by compare-and-set.

Under a base folder lie data folders, which nothing changes once they are written, and manifests ``_versions/<n>``.  A
manifest names, for each of a fixed number of buckets (chats by hash), the folder that holds its rows of every table, the
writer's epoch and the last micro-batch.  Readers take the highest manifest that is whole, so they see the tables of one moment;
a writer makes new folders for the buckets it touches, and version n + 1 comes to be when its manifest is created, which fails if it is
there already.  A writer of an older epoch than the version's fails.  What a stopped writer left behind is named by
no manifest; ``clear_unnamed`` deletes it.

Defined cases: without a manifest the tables are empty; a manifest cut short by a fault is none, and the next version takes the next
number; a micro-batch that was committed is not written again; a bucket left without rows is an empty folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
END = "\n.\n"


class Conflict(Exception):
    """Another writer committed first, or a newer epoch has begun."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    epoch: int = -1
    batch: int = -1
    schemas: dict[str, str] = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)


class Versions:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, chat: str | Column = "chat_id") -> Column:
        return F.pmod(F.xxhash64(chat), F.lit(self.buckets)).cast("int")

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.base}/_versions")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest(self, number: int) -> Version | None:
        stream = self._fs.open(self._path(f"{self.base}/_versions/{number:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text.removesuffix(END))) if text.endswith(END) else None

    def current(self) -> Version:
        for n in reversed(self._numbers()):
            if (v := self._manifest(n)) is not None:
                return v
        return Version()

    def table(self, name: str, of: Version | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of a table in a version, of some buckets if asked; None before the first version."""
        v = of or self.current()
        if name not in v.schemas:
            return None
        some = sorted({f"{self.base}/data/{f}/{name}/bucket={b}" for b, f in v.folders.items() if buckets is None or int(b) in buckets})
        some = [p for p in some if self._fs.exists(self._path(p))]
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(v.schemas[name]))
        return self.spark.read.schema(schema).parquet(*some) if some else self.spark.createDataFrame([], schema)

    def write(self, tables: dict[str, DataFrame]) -> str:
        """New folders for the rows of some buckets; no version names them yet."""
        folder = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(f"{self.base}/data/{folder}/{name}")
        return folder

    def commit(self, seen: Version, folder: str, touched: set[int], tables: dict[str, DataFrame], epoch: int, batch: int) -> Version:
        """The version after ``seen`` with the touched buckets in folder; fails if it is not the next one or the epoch is older."""
        if epoch < seen.epoch:
            raise Conflict(f"epoch {epoch} is over, {seen.epoch} has begun")
        numbers = self._numbers()
        if self.current().number != seen.number:
            raise Conflict(f"version {seen.number} is no longer the last")
        number = max([0, *numbers]) + 1
        made = Version(number, epoch, batch, seen.schemas | {n: t.schema.json() for n, t in tables.items()}, seen.folders | {str(b): folder for b in touched})
        at = self._path(f"{self.base}/_versions/{number:012d}")
        try:
            out = self._fs.create(at, False)  # fails where it exists: the one who creates it has won
        except Exception as e:
            raise Conflict(f"version {number} was committed by another writer") from e
        try:
            out.write(bytearray((json.dumps(made.__dict__) + END).encode()))
        finally:
            out.close()
        return made

    def clear_unnamed(self, keep: int = 2) -> int:
        """Delete manifests but the last ``keep`` whole ones, and folders that none of these names; only when no writer is at work."""
        whole = [(n, v) for n in self._numbers() if (v := self._manifest(n)) is not None][-keep:]
        named = {f for _, v in whole for f in v.folders.values()}
        gone = 0
        for n in self._numbers():
            if n not in {k for k, _ in whole}:
                self._fs.delete(self._path(f"{self.base}/_versions/{n:012d}"), False)
        data = self._path(f"{self.base}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in named:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def versioned_sink(base: str, change: Callable[[DataFrame, Callable[[str], DataFrame | None]], dict[str, DataFrame]], epoch: int = 0, buckets: int = BUCKETS, step: Callable[[str], None] = lambda name: None):
    """A foreachBatch function that commits one version for each micro-batch.

    change(batch, table) gives the tables' new rows of the batch's buckets; table(name) are the rows of these buckets now (None at first).
    step is told what has been done: tests stop there.
    """

    def write(batch: DataFrame, number: int) -> None:
        v = Versions(batch.sparkSession, base, buckets)
        seen = v.current()
        if epoch < seen.epoch:
            raise Conflict(f"epoch {epoch} is over, {seen.epoch} has begun")
        if seen.epoch == epoch and seen.batch >= number:
            return
        batch = batch.persist()
        try:
            # at most as many rows as there are buckets
            touched = {r.b for r in batch.select(v.bucket().alias("b")).distinct().collect()}
            step("read")
            tables = change(batch, lambda name: v.table(name, seen, touched))
            step("changed")
            folder = v.write(tables)
            step("written")
            v.commit(seen, folder, touched, tables, epoch, number)
            step("committed")
        finally:
            batch.unpersist()

    return write
