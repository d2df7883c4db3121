"""Batches of unread replies as a stateful stream with timers: nothing waits for ever, nothing is kept for ever.

State a chat: the unread messages as a list, which messages came lately, and how many batches went out.  A timer in event
time stands at the oldest unread reply plus ``wait``; when the watermark passes it, what waits is read, full or not.  Ids
are forgotten when the watermark is ``remember`` beyond them.  Branches begin from an initial state: the turns that they
share with their origin are read already.

The stream needs the RocksDB state store: ``with_store`` sets it for the session.

Defined cases: messages that come again within ``remember`` count once; messages of one turn are taken by id; a user's messages without a
reply wait for one; shared turns of a branch are skipped; rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as tx
from .ingest import BATCHES, CHAR_BUDGET, LIVE_WINDOW, form_batches

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Waiting(StatefulProcessor):
    """One chat's unread messages; see the module."""

    def __init__(self, budget: int, deadline: int, wait_ms: int, remember_ms: int):
        self.budget, self.deadline, self.wait_ms, self.remember_ms = budget, deadline, wait_ms, remember_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.unread = handle.getListState("unread", "turn int, role string, id string, size int, ms long")
        self.known = handle.getMapState("known", "id string", "ms long")
        self.place = handle.getValueState("place", "batch int, shared int")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N803  names of the interface
        self.place.update((0, int(initialState["shared"].max())))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        shared = self.place.get()[1] if self.place.exists() else 0
        fresh = []
        for pdf in rows:
            for r in pdf.itertuples():
                if r.turn > shared and not self.known.containsKey((r.id,)):
                    self.known.updateValue((r.id,), (int(r.ms),))
                    fresh.append({"turn": int(r.turn), "role": r.role, "id": r.id, "size": int(r.size), "ms": int(r.ms)})
        if fresh:
            self.handle.registerTimer(max(r["ms"] for r in fresh) + self.remember_ms)
        yield self._read(key, fresh, False)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        for known in [k for k, v in self.known.iterator() if v[0] + self.remember_ms <= now]:
            self.known.removeKey(known)
        unread = self._unread()
        yield self._read(key, [], self._due(unread) is not None and self._due(unread) <= now)

    def close(self) -> None:
        pass

    def _unread(self) -> list[dict]:
        return [dict(zip(("turn", "role", "id", "size", "ms"), r, strict=True)) for r in self.unread.get()] if self.unread.exists() else []

    def _due(self, unread: list[dict]) -> int | None:
        replies = [r["ms"] for r in unread if r["role"] == "assistant"]
        return min(replies) + self.wait_ms if replies else None

    def _read(self, key: tuple, fresh: list[dict], force: bool) -> pd.DataFrame:
        before = self._unread()
        batch, shared = self.place.get() if self.place.exists() else (0, 0)
        made, rest = form_batches(sorted(before + fresh, key=lambda r: (r["turn"], r["id"])), self.budget, self.deadline, force)
        self.place.update((batch + len(made), shared))
        if rest:
            self.unread.put([(r["turn"], r["role"], r["id"], r["size"], r["ms"]) for r in rest])
        else:
            self.unread.clear()
        was, due = self._due(before), self._due(rest)
        if due != was and due is not None:
            self.handle.registerTimer(due)
        return pd.DataFrame([(key[0], batch + i, *b) for i, b in enumerate(made)], columns=["chat_id", "batch", "from_turn", "to_turn", "last_id", "size"])


def timed_batches(messages: DataFrame, budget: int = CHAR_BUDGET, deadline: int = LIVE_WINDOW, wait: int = 600, remember: int = 86_400, delay: str = "1 minute", seeds: DataFrame | None = None) -> DataFrame:
    """BATCHES of a stream of messages (chat_id, turn, role, id, text, ts); wait and remember in seconds of event time.

    seeds (chat_id, shared) are branches that begin behind the turns they share.
    """
    marked = messages.withWatermark("ts", delay)
    m = marked.select("chat_id", "turn", "role", "id", tx.units(tx.strip_own_block("text")).alias("size"), F.unix_millis(F.col("ts")).alias("ms"), "ts")
    first = seeds.select("chat_id", F.col("shared").cast("int").alias("shared")).groupBy("chat_id") if seeds is not None else None
    return m.groupBy("chat_id").transformWithStateInPandas(Waiting(budget, deadline, 1000 * wait, 1000 * remember), BATCHES, "append", "eventTime", initialState=first)
