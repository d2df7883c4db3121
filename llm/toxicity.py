"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its lower-cased words, word pairs (2-grams)
and pairs with one word skipped (skip-grams), and beginnings of words (4 to 7 bytes), which
stand for a word in its many endings; a text is the set of them.
Per-coordinate learning rates and L1 keep few weights other than zero; those, bounded by
the feature space of 2**BITS slots, are sent to the executors.

Labels are learnt only from rows with crc32(doc_id as text) mod 3 other than 1, and from
about TRAIN_ROWS of each label of them, those with the smallest crc32, as far as their texts
stay within TRAIN_BYTES (documented bounds; of rows that repeat a doc_id one text is learnt).
labels, lang, source and doc_id are never inputs of a score.  Every whole text is scored.

Defined cases: a null or empty text gets the intercept's score; a null doc_id is never
labelled, and counts as not held out; repeated rows score alike; a very long text is scored
whole; labels that are null are not learnt from, of two labels for one doc_id the higher is;
with no usable labels, or only one kind, every score is 0; an empty table gives an empty
result; extra columns, also one named score, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import small_batches

BITS = 20
TRAIN_ROWS = 4000
TRAIN_BYTES = 64_000_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2.0, 1.0
THRESHOLD = 0.7


def slots(data: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the distinct features of each text, by text; with used, only of slots that are True there."""
    w = tk.Words(data, offsets, lower=True, punctuation=True)
    h = w.hash
    keys: list[np.ndarray] = []

    def add(doc: np.ndarray, found: np.ndarray) -> None:
        slot = found >> np.uint64(64 - BITS)
        if used is not None:
            at = np.flatnonzero(used[slot])
            doc, slot = doc[at], slot[at]
        keys.append((doc.astype(np.uint64) << np.uint64(BITS)) | slot)

    add(w.doc, h)
    for n in (2, 3):
        at = np.flatnonzero(np.arange(len(h)) + n <= w.first[1:][w.doc])
        add(w.doc[at], tk.mix(h[at] * np.uint64(3) + h[at + n - 1] * np.uint64(5) + np.uint64(n)))
    for width in (4, 5, 6, 7):
        at, p = w.prefixes(width)
        add(w.doc[at], p)
    key = np.unique(np.concatenate(keys))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for log loss on sets of slots; slot 2**BITS is the intercept, free of L1."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, l1 = self.z[i], np.where(i == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: int) -> None:
        i = np.append(i, 1 << BITS)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - s * w
        self.n[i] += g * g

    def dense(self) -> np.ndarray:
        return self.weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc(doc_id), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray | None:
    """Weights from about ``rows`` labelled rows of each label at most, or None without two labels.

    The rows are chosen from labels alone, so only their texts are read and sent.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = crc(F.col("doc_id"))
    count = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, rows / max(rows, count.get(1, 0))).otherwise(rows / max(rows, count.get(0, 0)))
    chosen = usable.filter(order <= share * (1 << 32))
    # About 2 * rows ids at most: a bounded side to broadcast; one row an id comes back, first its size, then its text.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sized = texts.groupBy("doc_id").agg(F.min(F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("m")).select("doc_id", "m.n", "m.h", order.alias("o")).collect()
    sized.sort(key=lambda r: (r.o, r.doc_id))
    room = np.cumsum([r.n for r in sized]) <= TRAIN_BYTES if sized else []
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.h) for r, ok in zip(sized, room, strict=True) if ok], T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("h", T.LongType())]))
    got = texts.join(F.broadcast(ids), "doc_id").filter(F.xxhash64("text") == F.col("h")).groupBy("doc_id", "toxic").agg(F.first("text").alias("text")).select(order.alias("o"), "doc_id", "toxic", "text").collect()
    got.sort(key=lambda r: (r.o, r.doc_id))
    y = np.array([r.toxic for r in got], int)
    if len(set(y.tolist())) < 2:
        return None
    col = pa.array([r.text for r in got], pa.large_string())
    each: list[np.ndarray] = []
    for at, to, data, offsets in tk.slices(col):
        d, s = slots(data, offsets)
        each += np.split(s.astype(np.int32), np.searchsorted(d, np.arange(1, to - at)))
    model, rng = Ftrl(), np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            model.learn(each[i], int(y[i]))
    return model.dense()


def toxicity(docs: DataFrame, weights: np.ndarray | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score.  One narrow pass; the weights other than zero travel as two short arrays."""
    small_batches(docs)
    docs = docs.select(doc_id, text)
    schema = T.StructType([docs.schema[0], T.StructField("score", T.DoubleType())])
    at = np.flatnonzero(weights) if weights is not None else np.zeros(0, int)
    sent = docs.sparkSession.sparkContext.broadcast((at, weights[at] if weights is not None else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, value = sent.value
        w = np.zeros((1 << BITS) + 1, np.float64)
        if value is not None:
            w[where] = value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if value is not None:
                for a, b, data, offsets in tk.slices(tk.column(batch, text)):
                    d, s = slots(data, offsets, w[:-1] != 0)
                    sums = np.bincount(d, weights=w[s], minlength=b - a) + w[1 << BITS]
                    score[a:b] = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema.names)

    return docs.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
