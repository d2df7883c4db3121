"""Streaming ingestion and extraction: deduplicated messages, batches of unread replies, folding by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import text as tx
from ..operators import state
from ..operators.lineage import cut
from .versions import BUCKETS, versioned_sink

LIVE_WINDOW = 6
CHAR_BUDGET = 4500


def char_budget(quota: int | None, overhead: int = 0) -> int:
    """Characters that one extraction may read: by the model's quota less the prompt, between 2,000 and 12,000."""
    return CHAR_BUDGET if not quota else max(2000, min(12000, int(quota * 0.9 / 0.8) - overhead))


def deduplicated(stream: DataFrame, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Messages with roles that count, each id once; with an event time the state is bounded by the watermark."""
    kept = stream.filter(F.col("role").isin("user", "assistant") & (F.length(tx.trim(F.coalesce("text", F.lit("")))) > 0))
    if ts:
        return kept.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["chat_id", "id"])
    return kept.dropDuplicates(["chat_id", "id"])


BATCHES = "chat_id string, batch int, from_turn int, to_turn int, last_id string, size int"
STATE = "batch int, pending string"


def form_batches(rows: list[dict], budget: int = CHAR_BUDGET, deadline: int = LIVE_WINDOW, force: bool = False) -> tuple[list[tuple[int, int, str, int]], list[dict]]:
    """(batches, unread rest) of messages in order (turn, role, id, size).

    Replies join a batch while their text, with the user text before them, fits; the first always fits.  A batch is read
    when the next reply would not fit, when ``deadline`` replies wait, or when forced.
    """
    out: list[tuple[int, int, str, int]] = []
    rest = list(rows)
    while True:
        ends = [i for i, r in enumerate(rest) if r["role"] == "assistant"]
        if not ends:
            return out, rest
        used, count, start = 0, 0, 0
        for e in ends:
            size = sum(r["size"] for r in rest[start : e + 1])
            if count and used + size > budget:
                break
            used, count, start = used + size, count + 1, e + 1
        full = count < len(ends)
        if not (full or len(ends) >= deadline or force):
            return out, rest
        last = rest[ends[count - 1]]
        out.append((rest[0]["turn"], last["turn"], last["id"], used))
        rest = rest[ends[count - 1] + 1 :]


def extraction_batches(messages: DataFrame, budget: int = CHAR_BUDGET, deadline: int = LIVE_WINDOW, force: bool = False) -> DataFrame:
    """BATCHES of a table of messages: the batch twin of the stream."""
    m = messages.select("chat_id", "turn", "role", "id", tx.units(tx.strip_own_block("text")).alias("size"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made, _ = form_batches(pdf.sort_values("turn").to_dict("records"), budget, deadline, force)
        return pd.DataFrame([(pdf.chat_id.iloc[0], i, *b) for i, b in enumerate(made)], columns=["chat_id", "batch", "from_turn", "to_turn", "last_id", "size"])

    return m.groupBy("chat_id").applyInPandas(run, BATCHES)


def stream_batches(messages: DataFrame, budget: int = CHAR_BUDGET, deadline: int = LIVE_WINDOW) -> DataFrame:
    """BATCHES of a stream of messages (chat_id, turn, role, id, text).

    State a chat: how many batches went out, and turn, role, id and size of the unread messages, which the deadline bounds.
    A row of role ``flush`` forces what waits.
    """
    import json

    m = messages.select("chat_id", "turn", "role", "id", tx.units(tx.strip_own_block("text")).alias("size"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        batch, pending = state.get if state.exists else (0, "[]")
        rows, forced = json.loads(pending), False
        for pdf in frames:
            for r in pdf.itertuples():
                if r.role == "flush":
                    forced = True
                else:
                    rows.append({"turn": int(r.turn), "role": r.role, "id": r.id, "size": int(r.size)})
        seen: dict[str, dict] = {}
        for r in sorted(rows, key=lambda r: r["turn"]):
            seen.setdefault(r["id"], r)
        made, rest = form_batches(list(seen.values()), budget, deadline, forced)
        state.update((batch + len(made), json.dumps(rest)))
        yield pd.DataFrame([(key[0], batch + i, *b) for i, b in enumerate(made)], columns=["chat_id", "batch", "from_turn", "to_turn", "last_id", "size"])

    return m.groupBy("chat_id").applyInPandasWithState(run, BATCHES, STATE, "append", "NoTimeout")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what a stream has now as Parquet; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_every(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "10 minutes") -> StreamingQuery:
    """A job that hands what is new to ``write`` once an interval.  One query of a name runs at a time: where it runs already, it is returned."""
    running = [q for q in stream.sparkSession.streams.active if q.name == name]
    if running:
        return running[0]
    return stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def windows_of_stream(messages: DataFrame, size: int = 4) -> DataFrame:
    """(chat_id, win, first, last) of every window of ``size`` messages that a stream has filled; state a chat: how many messages it had."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        now = seen + sum(len(pdf) for pdf in frames)
        state.update((now,))
        yield pd.DataFrame([(key[0], w, w * size + 1, w * size + size) for w in range(seen // size, now // size)], columns=["chat_id", "win", "first", "last"])

    return messages.select("chat_id", "id").groupBy("chat_id").applyInPandasWithState(run, "chat_id string, win int, first int, last int", "seen int", "append", "NoTimeout")


def memory_sink(path: str, parse, epoch: int = 0):
    """A foreachBatch function that appends the facts of a micro-batch under its epoch and batch number.

    Written by number, a micro-batch that is run again replaces its own files, so nothing counts twice; rows of an older
    epoch are fenced off when reading.
    """

    def write(batch: DataFrame, number: int) -> None:
        parse(batch).withColumn("epoch", F.lit(epoch)).withColumn("micro_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}/micro_batch={number}")

    return write


def read_log(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """The fact log of one epoch."""
    return spark.read.parquet(f"{path}/epoch={epoch}/*")


def swap(staging: str, target: str, spark: SparkSession) -> None:
    """Put a finished rebuild in the place of the old log; called only when the rebuild has succeeded.

    The old log steps aside first and goes last, so one of the two is always whole; a swap that was interrupted is finished
    by calling it again.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(target).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = p(target.rstrip("/") + ".old")
    if fs.exists(p(staging)):
        if fs.exists(p(target)):
            if fs.exists(aside):
                fs.delete(aside, True)
            fs.rename(p(target), aside)
        if not fs.rename(p(staging), p(target)):
            raise OSError(f"cannot move {staging} to {target}")
    if fs.exists(p(target)) and fs.exists(aside):
        fs.delete(aside, True)


def recover(facts: DataFrame, messages: DataFrame, read_to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts that still hold, messages to read again) once history was rewritten: facts whose source is gone go, and reading
    starts after the last message read, or after the last source that survives."""
    kept = state.surviving_facts(facts, messages)
    at = state.resume_point(kept, messages, read_to).withColumnRenamed("turn", "_from")
    again = messages.join(at, "chat_id", "left").filter(F.col("turn") > F.coalesce("_from", F.lit(0))).drop("_from")
    return kept, again


def recovering_sink(base: str, parse: Callable[[DataFrame], DataFrame], epoch: int = 0, buckets: int = BUCKETS, step: Callable[[str], None] = lambda name: None):
    """A foreachBatch function over whole chats (chat_id, turn, id, role, text): each micro-batch recovers its chats' facts and
    reads on from where they still hold.  parse(messages) gives facts (chat_id, sourceId, ...).

    Facts and reading place are one version (``versions``): a batch that stopped midway leaves the last version whole, and is done
    anew; one that was committed is not done again.  A chat of which no source is left keeps no facts.
    """

    def change(batch: DataFrame, table: Callable[[str], DataFrame | None]) -> dict[str, DataFrame]:
        chats = batch.select("chat_id").distinct()
        old, seen = table("facts"), table("read_to")
        last = batch.groupBy("chat_id").agg(F.max_by("id", F.when(F.col("role") == "assistant", F.col("turn"))).alias("lastId"))
        if old is None:
            return {"facts": cut(parse(batch)), "read_to": cut(last)}
        kept, again = recover(old.join(chats, "chat_id", "left_semi"), batch, seen.join(chats, "chat_id", "left_semi"))
        others = old.join(chats, "chat_id", "left_anti")
        facts = others.unionByName(kept.select(old.columns)).unionByName(parse(cut(again)).select(old.columns))
        return {"facts": cut(facts), "read_to": cut(seen.join(chats, "chat_id", "left_anti").unionByName(last))}

    return versioned_sink(base, change, epoch, buckets, step)


def seeded_batches(messages: DataFrame, seeds: DataFrame, budget: int = CHAR_BUDGET, deadline: int = LIVE_WINDOW) -> DataFrame:
    """extraction_batches() of branches that begin where their origin was read to: seeds (chat_id, shared) skip the shared turns."""
    own = messages.join(seeds.select("chat_id", "shared"), "chat_id", "left").filter(F.col("turn") > F.coalesce("shared", F.lit(0))).drop("shared")
    return extraction_batches(own, budget, deadline)


class Progress(StreamingQueryListener):
    """What streams have done: rows read and the last batch of each query by id; ``stop`` asks a query to end after its batch."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.batches[str(p.id)] = p.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


def fenced(write, still: Callable[[], bool]):
    """A foreachBatch function that does nothing once ``still()`` is false: a stop that takes effect between batches."""

    def run(batch: DataFrame, number: int) -> None:
        if still():
            write(batch, number)

    return run


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """An addition of ours: event-time windows with a watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
