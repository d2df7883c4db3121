"""Exact n-gram Jaccard join as a metric-space join, down to components of linked documents.

Distance is 1 - Jaccard of the documents' sets of n-word shingles; documents link within
1 - percent / 100.  The steps, all exact:

1. A document can only link if ``percent`` of its shingles occur in another document too.
   Shingles meet once by fingerprint (see ``probes``); the others are done.
2. Equal sets become one class.
3. First pivots are sets of one shingle.  A class lies within distance < 1 of a pivot only
   if it holds that shingle, and by the triangle inequality two linked classes share one
   of the first n - ceil(percent * n) + 1 shingles of any fixed order, so each class is
   replicated to that window of pivots, rarest shingles first.  Connected pivots form
   regions; no link leaves a region.
4. Inside a region document pivots create Voronoi cells, whatever its size.  A pivot meets
   every class of its cell, so its links are known and it leaves; each other class joins its
   nearest pivot's cell and, as a boundary document, every cell whose pivot is at most
   2 * eps further; classes that share nothing with any pivot form a far cell; cells are
   joined recursively.  Pivots are taken from the classes outside
   the cell's largest component, so a cell is done once all its classes are connected.
   Where the windows hold nearly everything the cell stays whole and only loses its pivots.
   A region above REGION_CLASSES classes is split the same way by Spark: it is dealt into
   blocks that all see its pivots, and its cells are the regions of the next round.

Defined cases: null and empty texts have no shingles and link with nothing; fewer words
than n make one shingle of the whole sequence; a null doc_id links with nothing and is its
own component (null); rows that repeat a doc_id are taken as one document each and share
the id; a very long text is one set, whole; ties in distance go to the first pivot and
change no link; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import probes as pr
from . import textkit as tk
from .common import drop_written, written

N = 3
PERCENT = 90
REGION_CLASSES = 1000
PIVOTS = 16
MOST_PIVOTS = 1024

SETS = "row long, doc_id long, n_shingles long, a long, b long, shingles binary, often binary"
SETS_PA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("shingles", pa.binary()), ("often", pa.binary())])


class _Chunk:
    """The shingle sets of a chunk's documents."""

    def __init__(self, table: pa.Table, n: int):
        self.table = pr.ordered(table)
        w = pr.ChunkWords(tk.column(self.table, "text"), lower=True)
        size = np.diff(w.first)
        at, h = w.grams(n)
        doc = w.doc[at]
        for k in range(1, n):  # whole sequences of fewer words
            a, g = w.grams(k)
            few = size[w.doc[a]] == k
            doc, h = np.concatenate([doc, w.doc[a][few]]), np.concatenate([h, g[few]])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        self.doc, self.h = doc[new], h[new]
        self.first = np.searchsorted(self.doc, np.arange(self.table.num_rows + 1))

    def anchors(self, bits: int) -> None:
        f = self.h >> np.uint64(64 - bits)
        self.keys, self.key_of, count = np.unique(f, return_inverse=True, return_counts=True)
        self.count = count


def _similar(na: np.ndarray, nb: int, inter: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (na + nb - inter)


class _Sets:
    """Shingle sets in memory: intersections of one with many by an inverted index."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.n = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        self.keys, code = np.unique(every, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.owner = owner[order]
        self.start = np.searchsorted(code[order], np.arange(len(self.keys) + 1))

    def inter(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, s)
        at = at[at < len(self.keys)] if len(at) and at[-1] >= len(self.keys) else at
        at = at[self.keys[at] == s[: len(at)]]
        a, b = self.start[at], self.start[at + 1]
        size = b - a
        total = int(size.sum())
        if not total:
            return np.zeros(len(self.sets), np.int64)
        take = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
        return np.bincount(self.owner[take], minlength=len(self.sets))

    def distance(self, s: np.ndarray) -> np.ndarray:
        i = self.inter(s)
        return 1 - i / np.maximum(self.n + len(s) - i, 1)


class _Links:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


EPSILON = 1e-9


#: Name of the cell of classes that (nearly) share nothing with any pivot.
FAR = -1


def cells_of(d: np.ndarray, eps: float) -> np.ndarray:
    """Membership (cell, class) from distances (pivot, class); the last cell is the far one.

    Let x and y link and c be x's nearest pivot: d(c, y) <= d(c, x) + eps <= near(y) + 2 * eps, so y is in c's window.  Where
    d(c, y) = 1, y shares nothing with c, then near(x) >= 1 - eps and near(y) >= 1 - 2 * eps; if x shares nothing with any
    pivot, near(y) >= 1 - eps.  In both cases the far cell, all with near >= 1 - 2 * eps, has both, and windows end below 1.
    """
    near = d.min(axis=0)
    return np.concatenate([(d < 1) & (d <= near + 2 * eps + EPSILON), near[None] >= 1 - 2 * eps - EPSILON])


def splits(sizes: np.ndarray, n: int) -> bool:
    """Whether cells of these sizes are worth having in place of one of n classes: pairs shrink, so that recursion never adds work."""
    return float((sizes.astype(float) ** 2).sum()) <= 0.9 * n * n and sizes.sum() <= 2 * n


def voronoi_join(sets: list[np.ndarray], percent: int, compared: list[int] | None = None) -> list[int]:
    """Component (least index) of each set under links of at least percent: pivots, cells with windows, recursion.

    compared: if given, gets the number of (pivot, class) distances measured for each cell.
    """
    links = _Links(len(sets))
    eps = 1 - percent / 100
    stack = [np.arange(len(sets))]
    while stack:
        ids = stack.pop()
        part = np.array([links.find(int(i)) for i in ids])
        roots, count = np.unique(part, return_counts=True)
        if len(roots) < 2:
            continue
        outside = np.flatnonzero(part != roots[count.argmax()])
        store = _Sets([sets[i] for i in ids])
        most = min(PIVOTS, max(1, int(len(ids) ** 0.5)))
        pivots, d = [], []
        far = int(outside[0])
        while True:
            inter = store.inter(sets[ids[far]])
            n = store.n + store.n[far] - inter
            pivots.append(far)
            d.append(1 - inter / np.maximum(n, 1))
            for j in np.flatnonzero(100 * inter >= percent * n):
                links.join(int(ids[far]), int(ids[j]))
            if len(pivots) == most:
                break
            reach = np.min(d, axis=0)[outside]
            far = int(outside[reach.argmax()])
            if far in pivots:
                break
        if compared is not None:
            compared.append(len(pivots) * len(ids))
        stay = np.ones(len(ids), bool)
        stay[pivots] = False
        inside = cells_of(np.array(d), eps)[:, stay]
        rest = ids[stay]
        if not len(rest):
            continue
        inside = inside[inside.any(axis=1)]
        if splits(inside.sum(axis=1), len(rest)):
            stack += [rest[c] for c in inside]
        else:
            stack.append(rest)
    return [links.find(i) for i in range(len(sets))]


def _checksum(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(9), "v", "u"))).first())


HOT = 1000


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, component): least node reachable, by rounds of hooking to least neighbours and pointer jumping, each written out.

    A node with more than 1 / HOT of all edges is one of at most 2 * HOT: their least neighbours are broadcast, so that no join has a hot key.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name + "-edges")
    seen = _checksum(pairs)

    def with_least(rows: DataFrame, least: DataFrame, hot_above: int) -> DataFrame:
        """rows (u, v) and m, the least of u."""
        hot = F.broadcast(least.filter(F.col("c") > hot_above).select(F.col("n").alias("hn"), F.col("m").alias("hm")))
        marked = rows.join(hot, F.col("u") == F.col("hn"), "left")
        # A hot node has its answer; its rows are spread by v and meet nothing.
        key = F.when(F.col("hn").isNull(), F.col("u")).otherwise(F.xxhash64("v"))
        cold = least.filter(F.col("c") <= hot_above).select("n", "m")
        joined = marked.withColumn("k", key).join(cold, (F.col("k") == F.col("n")) & F.col("hn").isNull(), "left")
        return joined.select("u", "v", F.coalesce("hm", "m").alias("m"))

    while True:
        # Large star, then small star: all larger neighbours, and then all others, hang on the least one.
        hot_above = max(1000, 2 * seen[0] // HOT)
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("n"), F.least("m", "u").alias("m"), "c")
        large = with_least(both, least, hot_above).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("n"), "m", "c")
        small = with_least(large, low, hot_above).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.filter("u <> v").distinct(), name + "-round")
        now = _checksum(after)
        if now == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        drop_written(pairs)  # the next round is written: nothing reads this one again
        pairs, seen = after, now


def _sets_of(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """SETS rows: every document's shingle count; sets and their shingles' frequencies only where a link is possible."""
    base, z = pr.chunked(docs, doc_id, text)
    base = base.withColumn("doc_id", F.col("doc_id").cast("long"))
    bits, ranges = z.filter_bits, min(z.range_bits, z.filter_bits)

    def send(table: pa.Table, _replies) -> pa.Table:
        c = _Chunk(table, n)
        c.anchors(bits)
        return pr.send(table.column("chunk")[0].as_py(), c.keys, np.minimum(c.count, 255).astype(np.uint64), bits, ranges)

    def frequency(group: np.ndarray, _chunk: np.ndarray, count: np.ndarray) -> np.ndarray:
        """0 for a shingle of one document, then one more for each doubling."""
        return np.minimum(15, np.ceil(np.log2(np.bincount(group, weights=count)))).astype(np.uint8)[group]

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SETS_PA.empty_table()
        c = _Chunk(table, n)
        c.anchors(bits)
        level = pr.read_levels(replies, 1, c.keys, bits, ranges)[c.key_of]
        size = np.diff(c.first)
        met = np.bincount(c.doc, weights=level > 0, minlength=len(size))
        may = (100 * met >= percent * size) & (size > 0)
        a = np.zeros(len(size), np.uint64)
        b = np.zeros(len(size), np.uint64)
        np.add.at(a, c.doc, c.h)
        np.bitwise_xor.at(b, c.doc, tk.mix(c.h + np.uint64(7)))
        sets = [c.h[c.first[i] : c.first[i + 1]].tobytes() if may[i] else None for i in range(len(size))]
        often = [level[c.first[i] : c.first[i + 1]].tobytes() if may[i] else None for i in range(len(size))]
        return pa.table({
            "row": pa.array(np.arange(len(size))), "doc_id": c.table.column("doc_id"), "n_shingles": pa.array(size.astype(np.int64)),
            "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "shingles": pa.array(sets, pa.binary()), "often": pa.array(often, pa.binary()),
        }).cast(SETS_PA)

    def unlinked(table: pa.Table) -> pa.Table:
        c = _Chunk(table, n)
        size = np.diff(c.first).astype(np.int64)
        zero, none = pa.array(np.zeros(len(size), np.int64)), pa.nulls(len(size), pa.binary())
        return pa.table([zero, c.table.column("doc_id"), pa.array(size), zero, zero, none, none], schema=SETS_PA)

    replies = pr.answer(pr.ask(base, send, None), 1, frequency)
    met = base.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, SETS)
    return met.union(pr.alone(docs, doc_id, text, unlinked, SETS))


def _windows(classes: DataFrame, percent: int) -> DataFrame:
    """(class, pivot): each class's window of one-shingle pivots, by frequency (in doublings), then by hash.

    Pivots that no other document holds fill the window first and need no row.
    """

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for c, s, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                h = np.frombuffer(s.as_py(), np.uint64)
                level = np.frombuffer(b.as_py(), np.uint8)
                k = len(h) - (-(-percent * len(h) // 100)) + 1
                order = np.lexsort((tk.mix(h), level))[:k]
                first = tk.mix(h[order[level[order] > 0]])
                ids.append(np.full(len(first), c, np.int64))
                keys.append(first.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], ["class", "pivot"])

    return classes.select("class", "shingles", "often").mapInArrow(run, "class long, pivot long")


def _array(x) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _small(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        ids = table.column("class").to_pylist()
        root = voronoi_join([_array(x.as_py()) for x in table.column("shingles")], percent)
        pairs = [(ids[i], ids[r]) for i, r in enumerate(root) if i != r]
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    return run


SPLIT = "region long, class long, shingles binary, pivot boolean, cells array<long>, links array<long>"
SPLIT_PA = pa.schema([("region", pa.int64()), ("class", pa.int64()), ("shingles", pa.binary()), ("pivot", pa.bool_()), ("cells", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))])


def _split(percent: int):
    """SPLIT rows of a block's classes against all pivots of their region, both in one cogroup."""
    eps = 1 - percent / 100

    def run(block: pa.Table, chosen: pa.Table) -> pa.Table:
        if not block.num_rows or not chosen.num_rows:
            return SPLIT_PA.empty_table()
        ids = block.column("class").to_numpy()
        chosen = chosen.sort_by("class")
        names = chosen.column("class").to_numpy()
        store = _Sets([_array(x.as_py()) for x in block.column("shingles")])
        d = np.ones((len(names), len(ids)))
        near = np.zeros(d.shape, bool)
        for k, s in enumerate(chosen.column("shingles")):
            h = _array(s.as_py())
            inter = store.inter(h)
            near[k] = _similar(store.n, len(h), inter, percent) & (ids != names[k])
            d[k] -= inter / np.maximum(store.n + len(h) - inter, 1)
        inside = cells_of(d, eps)
        cells = np.append(names, FAR)
        return pa.table({
            "region": block.column("region"), "class": block.column("class"), "shingles": block.column("shingles"), "pivot": pa.array(np.isin(ids, names)),
            "cells": pa.array([cells[c] for c in inside.T], pa.list_(pa.int64())), "links": pa.array([names[c] for c in near.T], pa.list_(pa.int64())),
        }).cast(SPLIT_PA)

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """region, class, shingles and blocks: how many blocks of REGION_CLASSES the region fills."""
    size = members.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    return members.join(size, "region").select("region", "class", "shingles", F.ceil(F.col("_n") / REGION_CLASSES).cast("long").alias("blocks"))


def _divide(members: DataFrame, percent: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(tables of edges, tables of regions that fit one task) of the regions of more than one block in members (with blocks).

    Each round takes pivots outside each region's largest component and divides the region into their cells: a few pivots first,
    which connect or divide most regions, then many.
    """
    edges: list[DataFrame] = []
    small: list[DataFrame] = []
    parts, k = None, 0
    while True:
        small.append(members.filter("blocks = 1"))
        left = members.filter("blocks > 1")
        if left.isEmpty():
            return edges, small
        if edges:  # what is connected so far: the parts of the rounds before, and the last round's links
            known = [parts.select(F.col("node").alias("u"), F.col("component").alias("v"))] if parts is not None else []
            parts = components(reduce(DataFrame.union, [*known, edges[-1]]), "u", "v", f"jaccard-parts{k}")
        held = left.withColumn("part", F.col("class")) if parts is None else left.join(parts, F.col("class") == F.col("node"), "left").withColumn("part", F.coalesce("component", "class"))
        size = held.groupBy("region", "part").count()
        most = size.groupBy("region").agg(F.max_by("part", F.struct("count", "part")).alias("most"), F.sum("count").alias("all"), F.max("count").alias("top")).withColumn("outside", F.col("all") - F.col("top")).filter("outside > 0")
        open_ = written(held.join(most, "region").select("region", "class", "shingles", "blocks", (F.col("part") != F.col("most")).alias("out"), "outside"), f"jaccard-open{k}")
        # About so many pivots, by hash; always at least one, as the least hash of a region is taken too.
        want = PIVOTS if k == 0 else MOST_PIVOTS
        drawn = F.pmod(F.xxhash64(F.lit(k), "class"), F.col("outside")) < want
        outsiders = open_.filter("out")
        first = outsiders.groupBy("region").agg(F.min_by("class", F.xxhash64(F.lit(k), "class")).alias("_first"))
        pivots = outsiders.join(first, "region").filter(drawn | (F.col("class") == F.col("_first"))).select("region", "class", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).toDF("region", "class", "shingles", "block")
        dealt = open_.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "class"), F.col("blocks")))
        met = written(dealt.groupBy("region", "block").cogroup(pivots.groupBy("region", "block")).applyInArrow(_split(percent), SPLIT), f"jaccard-split{k}")
        edges.append(met.select(F.col("class").alias("u"), F.explode("links").alias("v")))
        rest = met.filter("not pivot")
        cell = rest.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").count()
        whole = rest.groupBy("region").agg(F.count(F.lit(1)).alias("_all"))
        good = cell.groupBy("region").agg(F.sum(F.pow("count", F.lit(2.0))).alias("_pairs"), F.sum("count").alias("_sum")).join(whole, "region").filter((F.col("_pairs") <= 0.9 * F.pow("_all", F.lit(2.0))) & (F.col("_sum") <= 2 * F.col("_all"))).select("region", F.lit(True).alias("_good"))
        rest = rest.join(good, "region", "left").withColumn("cell", F.explode(F.when(F.col("_good"), F.col("cells")).otherwise(F.array(F.lit(None).cast("long")))))
        rest = rest.select(F.when(F.col("cell").isNull(), F.col("region")).otherwise(F.xxhash64("region", "cell")).alias("region"), "class", "shingles")
        members = written(_blocks(rest), f"jaccard-cells{k}")
        k += 1


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included)."""
    sets = written(_sets_of(docs, doc_id, text, n, percent), "jaccard-sets")
    may = sets.filter("shingles is not null")
    classes = may.groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("class"), F.first("shingles").alias("shingles"), F.first("often").alias("often"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("class", "a", "b", "n_shingles", "copies", "shingles", "often"), "jaccard-classes")

    windows = _windows(classes, percent)
    met = windows.groupBy("pivot").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most").select("pivot", "least")
    region = components(windows.join(met, "pivot").filter(F.col("class") != F.col("least")).select("class", "least"), "class", "least", "jaccard-regions")
    # The head of a region is its least class; classes of no region link with nothing.
    inside = region.select(F.col("node").alias("class"), F.col("component").alias("region")).union(region.select("component", "component").distinct())
    members = written(_blocks(inside.join(classes.select("class", "shingles"), "class")), "jaccard-members")
    edges, small = _divide(members, percent)
    for table in small:
        edges.append(table.groupBy("region").applyInArrow(_small(percent), "u long, v long"))
    if len(edges) == 1:  # every region fits one task, which gives its components at once
        parts = edges[0].select(F.col("u").alias("node"), F.col("v").alias("component"))
    else:
        parts = components(reduce(DataFrame.union, edges), "u", "v", "jaccard-all")
    found = classes.select("class", "a", "b", "n_shingles", "copies").join(parts, F.col("class") == F.col("node"), "left").select("a", "b", "n_shingles", "copies", F.coalesce("component", "class").alias("component_id"))
    found = found.withColumnsRenamed({"a": "fa", "b": "fb", "n_shingles": "fn"})
    # A class with more than 1 / HOT of all documents is one of at most HOT: those are broadcast, and no key of the join is hot.
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(found.filter(F.col("copies") > max(1000, total // HOT)).select(F.col("fa").alias("ha"), F.col("fb").alias("hb"), F.col("fn").alias("hn"), F.col("component_id").alias("hot_id")))
    cold = found.filter(F.col("copies") <= max(1000, total // HOT))
    rows = sets.select("doc_id", "n_shingles", "a", "b", F.col("shingles").isNotNull().alias("may")).join(hot, F.col("may") & (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")) & (F.col("n_shingles") == F.col("hn")), "left")
    rows = rows.withColumn("key", F.when(F.col("hot_id").isNull(), F.col("a")).otherwise(F.xxhash64("doc_id")))
    same = (F.col("key") == F.col("fa")) & (F.col("b") == F.col("fb")) & (F.col("n_shingles") == F.col("fn")) & F.col("may") & F.col("hot_id").isNull()
    return rows.join(cold, same, "left").select("doc_id", "n_shingles", F.coalesce("hot_id", "component_id", "doc_id").alias("component_id"))
