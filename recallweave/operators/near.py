"""Which sets may share enough words: told block against block, so that no pair leaves a task but those that may.

Two sets of n and m words with a Jaccard of ``bound`` share bound / (1 + bound) * (n + m) of them, so what only one of them has is bounded too.
A set has a row of signs: for each of so many places, whether an odd number of its words falls there by hash.  The rows of two sets
differ in no more places than there are words that only one has.  So the product of two tables of signs, one matrix product a pair of tiles, tells which pairs are
too different.  Of the few that are left, all words are counted by a table of marks, in the same task.

Defined cases: sets with nothing in common never meet; marks that two words share only let more pairs through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .lineage import cut

#: Words of a block, about; blocks of a group of sizes at least, where it has FEW_WORDS for each.
BLOCK_WORDS, BLOCKS, FEW_WORDS = 8_000_000, 2, 200_000
#: Pairs, and signs of one side, that a task has at once.
CELLS = 4_000_000
#: Marks that words are told by: 16 bits of their hash.
MARKS = 1 << 16
#: Signs of a set for each word of a pair at least, and at least of any; the steps by which sizes grow from tile to tile.
SIGNS, LEAST, STEP = 1.5, 64, 1.25
#: Tasks for each pair of blocks and at most for each core, so that hardly any task gets two large pairs.
PAIR_TASKS, CORE_TASKS = 4, 32


def marked(sets: DataFrame) -> DataFrame:
    """(card, place, n, marks): how many words each set has and the marks of these, two bytes each."""
    hashed = sets.select("card", "place", F.transform("set", lambda w: F.hash(w)).alias("h"))

    def run(batches):
        for b in batches:
            lists = b.column("h")
            n = np.diff(lists.offsets.to_numpy())
            marks = (lists.flatten().to_numpy(zero_copy_only=False) & (MARKS - 1)).astype(np.uint16)
            ends = np.concatenate([[0], np.cumsum(2 * n.astype(np.int64))]).astype(np.int32)
            made = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(marks.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("card"), b.column("place"), pa.array(n, pa.int32()), made], ["card", "place", "n", "marks"])

    kind = {f.name: f.dataType for f in sets.schema}
    return hashed.mapInArrow(run, T.StructType([T.StructField("card", kind["card"]), T.StructField("place", kind["place"]), T.StructField("n", T.IntegerType()), T.StructField("marks", T.BinaryType())]))


def meeting(sets: DataFrame, bound: float) -> DataFrame:
    """(card, place, p2), p2 before place: pairs of one card among which are all with a Jaccard of ``bound``; sets: card, place, set (not empty)."""
    return close_pairs(sets, bound).drop("most")


def close_pairs(sets: DataFrame, bound: float) -> DataFrame:
    """meeting() with the Jaccard that each pair has at most (its own, but for words that share a mark).

    Sets are grouped by size, so that one meets its own group and the two beside it, and a group is dealt into blocks by hash.  A task holds two blocks.
    """
    group = F.floor(F.log("n") / math.log(1 / bound) + 1e-9).cast("int")
    rows = cut(marked(sets).withColumn("g", group))
    words = F.sum("n")
    blocks = F.greatest(F.ceil(words / BLOCK_WORDS), F.least(F.lit(BLOCKS), F.ceil(words / FEW_WORDS))).cast("int")
    groups = cut(rows.groupBy("card", "g").agg(blocks.alias("blocks")))
    beside = lambda d, name: groups.select("card", (F.col("g") - d).alias("g"), F.col("blocks").alias(name))
    placed = rows.join(groups, ["card", "g"]).join(beside(1, "above"), ["card", "g"], "left").join(beside(-1, "below"), ["card", "g"], "left")
    placed = placed.withColumn("i", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int"))
    none = F.array().cast("array<struct<g1:int,i1:int,g2:int,i2:int,side:int>>")

    def each(count, make):
        return F.when(F.col(count).isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1), make))

    key = lambda g1, i1, g2, i2, side: F.struct(g1.alias("g1"), i1.alias("i1"), g2.alias("g2"), i2.alias("i2"), side.cast("int").alias("side"))
    g, i = F.col("g"), F.col("i")
    same = each("blocks", lambda j: key(g, F.least(i, j), g, F.greatest(i, j), F.when(i > j, 1).otherwise(0)))
    up = each("above", lambda j: key(g, i, g + 1, j, F.lit(0)))
    down = each("below", lambda j: key(g - 1, j, g, i, F.lit(1)))
    dealt = placed.select("card", "place", "n", "marks", F.explode(F.concat(same, up, down)).alias("k")).select("card", "k.*", "place", "n", "marks")
    both = groups.join(beside(1, "above"), ["card", "g"], "left").agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2 + F.col("blocks") * F.coalesce("above", F.lit(0)))).first()[0] or 1
    tasks = int(min(PAIR_TASKS * both, CORE_TASKS * max(1, sets.sparkSession.sparkContext.defaultParallelism)))
    kind = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("card", kind["card"]), T.StructField("place", kind["place"]), T.StructField("p2", kind["place"]), T.StructField("most", T.DoubleType())])
    names = to_arrow_schema(schema)

    def run(key, table):
        one = table.filter(pc.equal(table.column("side"), 0))
        own = key[1].as_py() == key[3].as_py() and key[2].as_py() == key[4].as_py()
        other = one if own else table.filter(pc.equal(table.column("side"), 1))
        found = list(_near(_Side(one), None if own else _Side(other), bound)) if one.num_rows and other.num_rows else []
        place, p2 = one.column("place").combine_chunks(), other.column("place").combine_chunks()
        x = pa.concat_arrays([place.take(pa.array(x)) for x, _, _ in found] or [place.slice(0, 0)])
        y = pa.concat_arrays([p2.take(pa.array(y)) for _, y, _ in found] or [place.slice(0, 0)])
        most = pa.array(np.concatenate([m for _, _, m in found] or [np.zeros(0)]))
        later = pc.greater(x, y)
        late, early = pc.if_else(later, x, y), pc.if_else(later, y, x)
        out = pa.Table.from_arrays([pa.array([key[0].as_py()] * len(x), names.field("card").type), late, early, most], schema.names).filter(pc.not_equal(x, y))
        return out.cast(names)

    of = ("card", "g1", "i1", "g2", "i2")
    return dealt.repartition(tasks, *of).groupBy(*of).applyInArrow(run, schema)


class _Side:
    """The sets of a block by size, in tiles of like sizes."""

    def __init__(self, table: pa.Table):
        n = table.column("n").to_numpy().astype(np.int64)
        self.order = np.argsort(n, kind="stable")
        self.n = n[self.order]
        lists = table.column("marks").combine_chunks().take(pa.array(self.order))
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.marks = np.frombuffer(b"".join(lists.to_pylist()), np.uint16)
        self.tiles = []
        rows = max(1, math.isqrt(CELLS))
        f = 0
        while f < len(n):
            most = int(self.n[f] * STEP)
            t = min(f + rows, int(np.searchsorted(self.n, most, side="right")), f + max(1, CELLS // _signs(2 * most)))
            self.tiles.append((f, t))
            f = t

    def words(self, rows: np.ndarray) -> np.ndarray:
        """The marks of some sets, one after the other."""
        many = self.n[rows]
        begin = np.cumsum(many) - many
        return self.marks[np.repeat(self.first[rows] - begin, many) + np.arange(many.sum())]

    def signs(self, tile: tuple[int, int], width: int, less: float, last: bool) -> np.ndarray:
        """The signs of a tile's sets, and two columns more, by which the product of two sides is below 0 where they are too different."""
        f, t = tile
        cell = np.repeat(np.arange(t - f) * width, self.n[f:t]) + self.marks[self.first[f] : self.first[t]] % width
        odd = np.bincount(cell, minlength=(t - f) * width).reshape(t - f, width) & 1
        weight = ((odd.sum(1) - less * self.n[f:t]) / -2)[:, None]
        one = np.ones_like(weight)
        return np.concatenate([odd, one, weight] if last else [odd, weight, one], 1, dtype=np.float32)


def _signs(words: int) -> int:
    """Signs for sets that have so many words together, in few steps, so that tiles share them."""
    need = max(LEAST, SIGNS * words)
    whole = 1 << math.ceil(math.log2(need))
    return min(MARKS, whole * 3 // 4 if whole * 3 // 4 >= need else whole)


def _near(one: _Side, other: _Side | None, bound: float):
    """(rows of one, rows of the other, Jaccard at most) of pairs that may share enough, some at a time; without another, each pair of one once."""
    own, other = other is None, other or one
    share = bound / (1 + bound)
    meet: dict[int, list] = {}
    for i, (f, t) in enumerate(one.tiles):
        for f2, t2 in other.tiles[i if own else 0 :]:
            low, high, low2, high2 = one.n[f], one.n[t - 1], other.n[f2], other.n[t2 - 1]
            if high >= bound * low2 and high2 >= bound * low:
                meet.setdefault(_signs(high + high2), []).append(((f, t), (f2, t2)))
    table = np.zeros(MARKS, np.uint8)
    for width, tiles in sorted(meet.items()):
        mine, signs, known = None, None, {}
        for tile, tile2 in tiles:
            if tile != mine:
                mine, signs = tile, one.signs(tile, width, 1 - 2 * share, False)
            if tile2 not in known:
                known[tile2] = other.signs(tile2, width, 1 - 2 * share, True)
            x, y = np.nonzero(signs @ known[tile2].T >= -0.5)  # below 0 by a half at least, or by nothing but rounding
            x, y = x + tile[0], y + tile2[0]
            if own and tile == tile2:
                x, y = x[x < y], y[x < y]
            for r, ys in zip(*_by_row(x, y), strict=True):
                words, many = one.words(np.array([r])), other.n[ys]
                table[words] = 1
                held = np.add.reduceat(table[other.words(ys)], np.cumsum(many) - many, dtype=np.int32)
                table[words] = 0
                near = held >= share * (one.n[r] + many) - 1e-9
                if near.any():
                    common = np.minimum(held, one.n[r])[near]
                    yield np.full(len(common), one.order[r]), other.order[ys[near]], common / (one.n[r] + many[near] - common)


def _by_row(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct rows of sorted x and the columns of each."""
    rows, at = np.unique(x, return_index=True)
    return rows, np.split(y, at[1:]) if len(rows) else []
