"""Exact removal of repeated passages with fixed-block anchors.

Reference blocks are the non-overlapping BLOCK-word blocks of each document.  A repeated
window of WINDOW = 2 * BLOCK words always holds one whole block of its other copy, so
every rolling BLOCK-word window of the corpus probes the blocks; where a probe meets a
block (in another chunk) the hit is extended over all WINDOW-word windows around it, and
those are compared by 64-bit fingerprint and position.  A word covered by a window whose
words also start earlier (smaller doc_id, or the same document further left) goes;
runs of such windows are the maximal exact repeats.  Windows are judged on the input.

Blocks and probes travel as filter fingerprints (a chance meeting costs work, never a
word).  Windows are compared by 64 bits: with N repeated windows the chance that any two
different ones meet is below N*N / 2**65.

Defined cases: a null text has no words; a row without doc_id is left whole and repeats
nothing; rows that repeat a doc_id are ordered by text; a very long text is one document of
one chunk, whole; doc_ids that are no integers are refused, as they order the copies; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import probes as pr
from . import textkit as tk

WINDOW = 20
BLOCK = 10


class _Chunk:
    """Anchors and windows of one chunk."""

    def __init__(self, table: pa.Table, window: int, block: int, bits: int):
        self.table = pr.ordered(table)
        self.words = w = pr.ChunkWords(tk.column(self.table, "text"))
        self.window, self.block = window, block
        self.at, h = w.grams(block)
        f = h >> np.uint64(64 - bits)
        self.anchors, self.anchor_of = np.unique(f, return_inverse=True)
        self.aligned = np.zeros(len(self.anchors), np.uint64)
        self.aligned[self.anchor_of[(self.at - w.first[w.doc[self.at]]) % block == 0]] = 1

    def windows(self, hit: np.ndarray) -> None:
        """All windows here, which are repeats of earlier ones here, and which may have copies elsewhere."""
        w = self.words
        self.w_at, h = w.grams(self.window)
        self.keys, first, self.key_of = np.unique(h, return_index=True, return_inverse=True)
        self.repeat = first[self.key_of] != np.arange(len(h))
        near = np.zeros(w.n + 1, np.int64)
        near[self.at[hit[self.anchor_of]] + 1] = 1
        near = np.cumsum(near)
        may = near[self.w_at[first] + self.window - self.block + 1] > near[self.w_at[first]]
        self.may = np.flatnonzero(may)
        self.first_doc = w.doc[self.w_at[first]]


def _finish(c: _Chunk, elsewhere: np.ndarray) -> pa.Table:
    w = c.words
    gone = c.repeat.copy()
    known = np.zeros(len(c.keys), bool)
    known[c.may[elsewhere]] = True
    gone |= known[c.key_of]
    step = np.zeros(w.n + 1, np.int64)
    starts = c.w_at[gone]
    np.add.at(step, starts, 1)
    np.add.at(step, starts + c.window, -1)
    covered = np.cumsum(step[:-1]) > 0
    texts, total = [], 0
    for _, part in w.parts:
        keep = ~covered[total : total + len(part.start)]
        s, e = part.start[keep], part.end[keep]
        size = e - s + 1
        ends = np.cumsum(size)
        out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        take = np.repeat(s - (ends - size), size) + np.arange(len(out))
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = part.data[take[inside]]
        edge = np.concatenate([[0], ends])[np.searchsorted(np.flatnonzero(keep), part.first)]
        raw = out.tobytes()
        texts += [raw[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        total += len(part.start)
    removed = np.bincount(w.doc, weights=covered, minlength=c.table.num_rows).astype(np.int64)
    change = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    runs: list[list[dict]] = [[] for _ in range(c.table.num_rows)]
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        while a < b:  # a run may reach from one document's end into the next one's start
            d = int(w.doc[a])
            z = min(b, int(w.first[d + 1]))
            runs[d].append({"from": a - int(w.first[d]), "to": z - int(w.first[d])})
            a = z
    return pa.table({
        "doc_id": c.table.column("doc_id"), "n_words": pa.array(np.diff(w.first)), "n_removed": pa.array(removed),
        "text": pa.array(texts, pa.binary()).cast(pa.string()),
        "removed": pa.array(runs, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
    })


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, text (kept words joined by one space) and removed, the maximal repeats as word ranges."""
    block = window // 2
    base, z = pr.chunked(docs, doc_id, text)
    kind = base.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("doc_id must be an integer: it orders the copies")
    base = base.withColumn("doc_id", F.col("doc_id").cast("long"))
    bits, ranges = z.filter_bits, min(z.range_bits, z.filter_bits)

    def anchors(table: pa.Table, _replies) -> pa.Table:
        c = _Chunk(table, window, block, bits)
        return pr.send(table.column("chunk")[0].as_py(), c.anchors, c.aligned, bits, ranges)

    def meets(group: np.ndarray, _chunk: np.ndarray, aligned: np.ndarray) -> np.ndarray:
        n = np.bincount(group)
        return ((n > 1) & (np.bincount(group, weights=aligned) > 0))[group]

    def windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        c = _Chunk(table, window, block, bits)
        c.windows(pr.read_bits(replies, 1, c.anchors, bits, ranges))
        ids = c.table.column("doc_id").fill_null(0).to_numpy()[c.first_doc[c.may]]
        order = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        return pr.send(table.column("chunk")[0].as_py(), c.keys[c.may], order, 64, ranges)

    def earlier(group: np.ndarray, _chunk: np.ndarray, order: np.ndarray) -> np.ndarray:
        least = np.full(group.max() + 1, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, group, order)
        return least[group] < order

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        c = _Chunk(table, window, block, bits)
        c.windows(pr.read_bits(replies, 1, c.anchors, bits, ranges))
        return _finish(c, pr.read_bits(replies, 2, c.keys[c.may], 64, ranges)).cast(RESULT)

    def whole(table: pa.Table) -> pa.Table:
        c = _Chunk(table, window, block, bits)
        c.windows(np.zeros(len(c.anchors), bool))
        c.repeat[:] = False
        return _finish(c, np.zeros(0, bool)).cast(RESULT)

    one = pr.answer(pr.ask(base, anchors, None), 1, meets)
    two = pr.answer(pr.ask(base, windows, one), 2, earlier)
    replies = one.unionByName(two)
    kinds = "doc_id long, n_words long, n_removed long, text string, removed array<struct<from: long, to: long>>"
    met = base.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, kinds)
    return met.union(pr.alone(docs, doc_id, text, whole, kinds))


def query(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("removed", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])
