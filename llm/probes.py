"""Compact exchange of n-gram fingerprints between chunks of documents.

Documents are dealt into chunks of a few megabytes by a hash of their id.  A chunk sends
each fingerprint once, sorted, as differences in packed bytes, one row a hash range; a
range's task sees every chunk's fingerprints there, decides, and answers with a bit or half a byte each.
A chunk then reads its own answers beside its documents.  A frequent n-gram is one entry
a chunk, so no key is hot, and a task holds one range or one chunk, both of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import small_batches

CHUNK_BYTES = 3_000_000
RANGE_ENTRIES = 1_000_000
WORD_BYTES = 5.0


def pack(values: np.ndarray) -> tuple[int, bytes]:
    """(width, bytes) of non-negative integers in the fewest bytes each."""
    if not len(values):
        return 1, b""
    top = int(values.max())
    width = max(1, (top.bit_length() + 7) // 8)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return width, np.ascontiguousarray(raw.T).tobytes()


def unpack(width: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_extra(values: np.ndarray) -> tuple[int, bytes]:
    """Flags as bits (width 0), else differences from the least."""
    if not len(values) or int(values.max()) <= 1:
        return 0, np.packbits(values.astype(bool)).tobytes()
    least = values.min()
    width, data = pack(values - least)
    return width, np.array([least], "<u8").tobytes() + data


def unpack_extra(width: int, data: bytes, n: int) -> np.ndarray:
    if width == 0:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.uint64)
    return unpack(width, data[8:]) + np.frombuffer(data[:8], "<u8").astype(np.uint64)


def pack_sorted(values: np.ndarray) -> tuple[int, bytes]:
    steps = values.copy()
    steps[1:] -= values[:-1]
    first = steps[:1].copy()
    steps[:1] = 0
    width, data = pack(steps)
    return width, first.astype("<u8").tobytes() + data


def unpack_sorted(width: int, data: bytes) -> np.ndarray:
    steps = unpack(width, data[8:])
    steps[:1] = np.frombuffer(data[:8], "<u8")
    return np.cumsum(steps, dtype=np.uint64)


class Sizes:
    """How many chunks, hash ranges and fingerprint bits a corpus of so many bytes gets."""

    def __init__(self, text_bytes: int):
        words = max(1, int(text_bytes / WORD_BYTES))
        self.chunks = max(1, -(-text_bytes // CHUNK_BYTES))
        self.range_bits = max(0, (words // RANGE_ENTRIES).bit_length())
        #: A filter's fingerprints: enough that chance meetings stay below one in some thousands.
        self.filter_bits = min(64, max(32, words.bit_length() + 12))


def chunked(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Sizes]:
    """(chunk, doc_id, text) of the rows with an id, dealt by chunk, and the sizes.  All steps on it share one shuffle of the texts.

    Ids are taken to name one document each, or a few: rows of one id are one chunk.
    """
    small_batches(docs)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    sizes = Sizes(int(total))
    key = F.xxhash64(F.col(doc_id).cast("string"))
    named = docs.filter(F.col(doc_id).isNotNull())
    return named.select(F.pmod(key, F.lit(sizes.chunks)).alias("chunk"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), sizes


def alone(docs: DataFrame, doc_id: str, text: str, make: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """make() of the rows without an id, batch by batch: they meet nothing, so they are not dealt."""
    def run(batches):
        for b in batches:
            yield from make(pa.table({"doc_id": b.column(0), "text": b.column(1)})).to_batches()

    return docs.filter(F.col(doc_id).isNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def ordered(table: pa.Table) -> pa.Table:
    """A chunk's rows by id (nulls last), then text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def own_ranges(f: np.ndarray, bits: int, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash ranges that sorted fingerprints fall in, where each begins, with the end): work follows the entries, not the ranges."""
    r = f >> np.uint64(bits - range_bits) if range_bits else np.zeros(len(f), np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(f) else np.zeros(0, np.int64)
    return r[begin].astype(np.int64), np.append(begin, len(f))


SENT = "range int, chunk long, width int, keys binary, extra_width int, extra binary"
SENT_PA = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("width", pa.int32()), ("keys", pa.binary()), ("extra_width", pa.int32()), ("extra", pa.binary())])
BITS = "chunk long, step int, range int, bits binary"
BITS_PA = pa.schema([("chunk", pa.int64()), ("step", pa.int32()), ("range", pa.int32()), ("bits", pa.binary())])


def send(chunk: int, f: np.ndarray, extra: np.ndarray, bits: int, range_bits: int) -> pa.Table:
    """Rows of SENT for a chunk's sorted distinct fingerprints and a number beside each."""
    own, cut = own_ranges(f, bits, range_bits)
    rows = [(r, chunk, *pack_sorted(f[a:b]), *pack_extra(extra[a:b])) for r, a, b in zip(own.tolist(), cut[:-1], cut[1:], strict=True)]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, SENT_PA.types, strict=True)], schema=SENT_PA)


def _pack_answers(hit: np.ndarray) -> bytes:
    """Booleans as bits, small numbers (below 16) as half bytes."""
    if hit.dtype == bool:
        return np.packbits(hit).tobytes()
    even = np.append(hit, np.zeros(len(hit) % 2, hit.dtype)).astype(np.uint8)
    return (even[::2] << 4 | even[1::2]).tobytes()


def answers(step: int, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """A function for one hash range: decide(group, chunk index, extra) gives a boolean or a number below 16 for each entry; group numbers equal fingerprints."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("range", "chunk", "width", "keys", "extra_width", "extra")), strict=True), key=lambda r: r[1])
        keys = [unpack_sorted(r[2], r[3]) for r in rows]
        n = [len(k) for k in keys]
        extra = np.concatenate([unpack_extra(r[4], r[5], k) for r, k in zip(rows, n, strict=True)])
        _, group = np.unique(np.concatenate(keys), return_inverse=True)
        hit = decide(group, np.repeat(np.arange(len(n)), n), extra)
        ends = np.cumsum([0, *n])
        out = [(r[1], step, r[0], _pack_answers(hit[a:b])) for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), BITS_PA.types, strict=True)], schema=BITS_PA)

    return run


def read_bits(replies: pa.Table, step: int, f: np.ndarray, bits: int, range_bits: int) -> np.ndarray:
    """The answer to each of a chunk's fingerprints."""
    hit = np.zeros(len(f), bool)
    own, cut = own_ranges(f, bits, range_bits)
    place = dict(zip(own.tolist(), range(len(own)), strict=True))
    for s, r, b in zip(*(replies.column(c).to_pylist() for c in ("step", "range", "bits")), strict=True):
        if s == step:
            a, z = cut[place[r]], cut[place[r] + 1]
            hit[a:z] = np.unpackbits(np.frombuffer(b, np.uint8), count=z - a).astype(bool)
    return hit


def read_levels(replies: pa.Table, step: int, f: np.ndarray, bits: int, range_bits: int) -> np.ndarray:
    """The number below 16 for each of a chunk's fingerprints."""
    level = np.zeros(len(f), np.uint8)
    own, cut = own_ranges(f, bits, range_bits)
    place = dict(zip(own.tolist(), range(len(own)), strict=True))
    for s, r, b in zip(*(replies.column(c).to_pylist() for c in ("step", "range", "bits")), strict=True):
        if s == step:
            raw = np.frombuffer(b, np.uint8)
            a, z = cut[place[r]], cut[place[r] + 1]
            level[a:z] = np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[: z - a]
    return level


def ask(base: DataFrame, make: Callable, replies: DataFrame | None) -> DataFrame:
    """SENT rows of every chunk; make(table, replies) for one chunk."""
    if replies is None:
        return base.groupBy("chunk").applyInArrow(lambda t: make(t, None), SENT)
    return base.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda t, r: make(t, r) if t.num_rows else SENT_PA.empty_table(), SENT)


def answer(sent: DataFrame, step: int, decide: Callable) -> DataFrame:
    return sent.groupBy("range").applyInArrow(answers(step, decide), BITS)


class ChunkWords:
    """Words of all texts of a chunk, slice after slice, with n-gram hashes at every word."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.parts: list[tuple[int, tk.Words]] = []
        self.first = [0]
        doc, total = [], 0
        for at, _to, data, offsets in tk.slices(texts):
            w = tk.Words(data, offsets, lower)
            w.forget()
            self.parts.append((at, w))
            doc.append(w.doc + at)
            self.first += (w.first[1:] + total).tolist()
            total += len(w.start)
        self.n = total
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        self.first = np.array(self.first, np.int64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        at, found, total = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        for _, w in self.parts:
            a, h = w.grams(n)
            at.append(a + total)
            found.append(h)
            total += len(w.start)
        return np.concatenate(at), np.concatenate(found)
