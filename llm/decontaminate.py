"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased runs without ASCII punctuation.  An alignment of m equal words has at
most 2 (m - THRESHOLD n) edits if it reaches THRESHOLD of an item of n words, so it holds at
least (2 THRESHOLD - 1) n - 1 of the item's word pairs unbroken, on diagonals at most
2 (1 - THRESHOLD) n apart.  Each item's pairs are counted over the whole corpus and the most
frequent are left out, never so many that such an alignment could hold fewer than the item's
need of the others, its seeds.  Where a document meets that many seeds near one diagonal, the
item is aligned with the words around: MATCH for an equal word, MISMATCH for a changed one,
GAP for one more or less.  A document leaks an item if the best score reaches THRESHOLD of
the item's own, so edited and partly paraphrased copies count, and none of them is missed.

The benchmark is collected in parts of about PART_BYTES of text (about five times that as
hashes, which is what a part broadcasts); a larger one takes more passes over the documents,
not more memory.  Documents are never shuffled.

Defined cases: null or empty texts and items leak nothing; an item of one or two
words must occur whole; one of up to five words, whose pairs may all be broken, has its
single words as seeds; repeated rows are judged one by one; repeated
item_ids are items of their own with the same id; a null item_id is reported as null;
empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import small_batches

SEED = 2
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
THRESHOLD = 0.6
PART_BYTES = 8_000_000


class Items:
    """A part of the benchmark: word hashes of each item and its n-grams."""

    def __init__(self, ids: list, texts: list[str]):
        w = tk.Words(*_flat(texts), lower=True, punctuation=True)
        self.ids, self.words, grams = [], [], []
        for i, item in enumerate(ids):
            h = w.hash[w.first[i] : w.first[i + 1]]
            if len(h):
                self.ids.append(item)
                self.words.append(h)
                grams.append(_grams(h, _width(len(h))))
        self.owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams]) if grams else np.zeros(0, np.int32)
        self.at = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        self.hash = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.sizes = sorted({_width(len(h)) for h in self.words})
        self.keys = np.unique(self.hash)

    def choose(self, counts: np.ndarray) -> None:
        """Leave out each item's most frequent n-grams as far as _held() allows, and those that do not occur."""
        n = counts[np.searchsorted(self.keys, self.hash)]
        held = np.array([_held(len(h)) for h in self.words], np.int64)
        self.need = (held + 1) // 2
        order = np.lexsort((-n, self.owner))
        first = np.searchsorted(self.owner, np.arange(len(self.ids)))
        keep = np.ones(len(n), bool)
        keep[order] = np.arange(len(n)) - first[self.owner] >= (held - self.need)[self.owner]
        keep &= n > 0
        order = np.argsort(self.hash[keep], kind="stable")
        self.owner, self.at, self.hash = self.owner[keep][order], self.at[keep][order], self.hash[keep][order]


def _width(n: int) -> int:
    """Words of a seed of an item of n words."""
    return SEED if n == 2 or _unbroken(n) > 0 else 1


def _unbroken(n: int) -> int:
    """Word pairs that an alignment reaching THRESHOLD of an item of n words holds at least."""
    return ceil((2 * THRESHOLD - 1) * n - 1 - 1e-9)


def _held(n: int) -> int:
    """Seeds that an alignment reaching THRESHOLD of an item of n words holds at least, before any are left out."""
    if n <= 2:
        return 1
    return _unbroken(n) if _width(n) == SEED else ceil(THRESHOLD * n - 1e-9)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of one run of words."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        out = tk.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


def _probe(w: tk.Words, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the n-grams of texts that are among the sorted keys; windows never reach over a text's end."""
    g = _grams(w.hash, n)
    inside = np.arange(len(g)) + n <= w.first[1:][w.doc[: len(g)]]
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # A small table of the keys' leading bits turns most n-grams away before the search.
    table = np.zeros(1 << 20, bool)
    table[keys >> np.uint64(44)] = True
    at = np.flatnonzero(inside & table[g >> np.uint64(44)])
    place = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
    at = at[keys[place] == g[at]]
    return at, g[at]


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """(score, from, to) of the best local alignment, as a share of the item's own score; from and to bound it in the window."""
    n = len(window)
    steps = GAP * np.arange(n + 1)
    before, start_before = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for x in item:
        diagonal = before[:-1] + np.where(window == x, MATCH, MISMATCH)
        up = before[1:] + GAP
        use = diagonal >= up
        row = np.zeros(n + 1)
        start = np.arange(n + 1)
        row[1:] = np.where(use, diagonal, up)
        start[1:] = np.where(use, start_before[:-1], start_before[1:])
        fresh = row <= 0
        row[fresh], start[fresh] = 0.0, np.arange(n + 1)[fresh]
        level = row - steps  # gaps along the window by a running maximum
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level >= top, np.arange(n + 1), 0))
        row, start = top + steps, start[source]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (float(row[j]), int(start[j]), j)
        before, start_before = row, start
    return best[0] / (MATCH * len(item)), best[1], best[2]


def leaks(w: tk.Words, items: Items) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, last word + 1) of the texts' leaked items."""
    hits = [_probe(w, n, items.keys_by_size[n]) for n in items.sizes]
    at, g = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if not len(at):
        return
    lo, hi = np.searchsorted(items.hash, g, "left"), np.searchsorted(items.hash, g, "right")
    n = hi - lo
    take = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    pos, own = np.repeat(at, n), items.owner[take]
    begin = pos - items.at[take]
    order = np.lexsort((begin, own, w.doc[pos]))
    pos, own, begin, doc = pos[order], own[order], begin[order], w.doc[pos][order]
    size = np.array([len(h) for h in items.words])
    slack = np.maximum(4, np.floor(2 * (1 - THRESHOLD) * size + 1e-9).astype(np.int64))
    # A seed stays if it is among its item's need of seeds within slack of each other.
    far = np.arange(len(pos)) + items.need[own] - 1
    last = np.minimum(far, len(pos) - 1)
    enough = np.flatnonzero((far == last) & (doc[last] == doc) & (own[last] == own) & (begin[last] - begin <= slack[own]))
    edge = np.zeros(len(pos) + 1, np.int64)
    np.add.at(edge, enough, 1)
    np.add.at(edge, last[enough] + 1, -1)
    near = np.cumsum(edge[:-1]) > 0
    pos, own, begin, doc = pos[near], own[near], begin[near], doc[near]
    if not len(pos):
        return
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (begin[1:] - begin[:-1] > slack[own[1:]])
    groups = np.flatnonzero(new)
    for a, b in zip(groups, [*groups[1:], len(pos)], strict=True):
        i, d = int(own[a]), int(doc[a])
        if len(np.unique(pos[a:b])) < items.need[i]:
            continue
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        u, v = max(lo, int(begin[a]) - int(slack[i])), min(hi, int(begin[b - 1]) + int(size[i]) + int(slack[i]))
        for x in range(u, v, 8 * int(size[i]) + 64):  # long stretches piece by piece, overlapping by more than an alignment
            y = min(v, x + 10 * int(size[i]) + 64)
            for score, s, e in _passages(items.words[i], w.hash, x, y):
                yield d, i, score, s - lo, e - lo


def _passages(item: np.ndarray, words: np.ndarray, x: int, y: int) -> Iterator[tuple[float, int, int]]:
    """(score, from, to) of the item's best alignment within words x to y and of those left and right of it, in order."""
    if np.isin(item, words[x:y]).sum() < THRESHOLD * len(item) - 1e-9:
        return
    score, s, e = align(item, words[x:y])
    if score >= THRESHOLD:
        yield from _passages(item, words, x, x + s)
        yield score, x + s, x + e
        yield from _passages(item, words, x + e, y)


def _parts(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> Iterator[Items]:
    small_batches(docs)
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    for p in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64(item_text), F.lit(parts)) == p).select(item_id, item_text).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1] or ""))
        items = Items([r[0] for r in rows], [r[1] or "" for r in rows])
        if not items.ids:
            continue
        items.choose(_counts(docs, items, text))
        items.keys_by_size = {n: np.unique(items.hash) for n in items.sizes}
        yield items


def _counts(docs: DataFrame, items: Items, text: str) -> np.ndarray:
    """How often each of the items' n-grams occurs in the documents: partial counts by task, summed by n-gram."""
    sent = docs.sparkSession.sparkContext.broadcast((items.keys, items.sizes))

    def run(batches):
        keys, sizes = sent.value
        counts = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, data, offsets in tk.slices(tk.column(batch, text)):
                w = tk.Words(data, offsets, lower=True, punctuation=True)
                for n in sizes:
                    _, g = _probe(w, n, keys)
                    counts += np.bincount(np.searchsorted(keys, g), minlength=len(keys))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["k", "n"])

    counts = np.zeros(len(items.keys), np.int64)
    found = docs.select(text).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return counts


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each leaked passage: doc_id, item_id, score, from_word, to_word (in the document's words as defined above)."""
    docs = docs.select(doc_id, text)
    schema = T.StructType([T.StructField("doc_id", docs.schema[0].dataType), *T._parse_datatype_string("item_id long, score double, from_word long, to_word long").fields])
    found = []
    for items in _parts(docs, benchmark, text, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                rows: list[tuple] = []
                for at, _, data, offsets in tk.slices(tk.column(batch, text)):
                    w = tk.Words(data, offsets, lower=True, punctuation=True)
                    rows += [(d + at, items.ids[i], *rest) for d, i, *rest in _best(leaks(w, items))]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True))], schema.names)

        found.append(docs.mapInArrow(run, schema))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def _best(found) -> list[tuple]:
    """Overlapping alignments of one item in one text as the best of them."""
    out: list[tuple] = []
    for x in found:
        if out and out[-1][:2] == x[:2] and x[3] < out[-1][4]:
            out[-1] = max(out[-1], x, key=lambda r: r[2])
        else:
            out.append(x)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that leak no item, with their own columns."""
    for items in _parts(docs, benchmark, text, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for at, _, data, offsets in tk.slices(tk.column(batch, text)):
                    for d, *_ in leaks(tk.Words(data, offsets, lower=True, punctuation=True), sent.value):
                        clean[at + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return benchmark_leaks(docs, benchmark)
