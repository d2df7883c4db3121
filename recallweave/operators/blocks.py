"""The best k hits by upper bounds: postings in blocks by impact, so that most are never summed.

What a term adds to a unit's score, its impact, does not depend on the query.  ``BlockIndex`` keeps it:

* ``blocks`` (chat_id, term, block, top, n, entries): a term's postings by descending level of impact, some BLOCK to a
  row, with the greatest impact in it;
* ``terms`` (chat_id, term, df, most, lead, lead_n): the bound of a term and its block of greatest impacts;
* ``impacts`` of the index (chat_id, unit_id, term, ord, gain): the same numbers by unit.

``top_bm25`` is exact, in three steps, and meant for short queries over many units: where
dozens of words weigh alike, no bound tells units apart and ``rank.bm25`` over stored impacts is cheaper.  Sums over leading blocks name TRIED * k units that promise most; their scores are
looked up by unit, and the k-th best of them is a floor that k units reach.  Terms by ascending bound whose bounds together stay below the floor cannot lift a unit
into the best k alone: only units with one of the other terms are summed, over those terms.  Of these units the ones
whose sum and the bounds of all left terms reach the floor are looked up for the left terms, by unit, a few terms at a time.

Defined cases: a query without terms, or with terms that no unit has, has no hits; with fewer than k hits the floor is 0 and
every hit is summed; ties go by ord, then unit; a bound max_ord holds for the floor too; terms that credit longer
words with the same beginning are always summed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from .index import Index, idf, lasting_words
from .lineage import cut, fresh_folder, kept_table
from .rank import query_rows

#: Entries of a block, about; levels of impact; entries of leading blocks that a query reads for its floor, at least one block.
BLOCK, LEVELS, SEEDS = 128, 8, 2048
#: Units whose scores are looked up for the floor, as a multiple of k.
TRIED = 2
#: Steps in which left terms are looked up.
ROUNDS = 3
#: Sums of the same numbers in another order may differ by less; scores are compared after rounding to six digits.
SLACK = 2e-6


@dataclass(frozen=True)
class BlockIndex:
    words: Index
    blocks: DataFrame
    terms: DataFrame

    @property
    def impacts(self) -> DataFrame:
        return self.words.impacts


def build_blocks(ix: Index, name: str = "blocks", block: int = BLOCK) -> BlockIndex:
    """The blocks of an index, as tables in the shared folder; the index has units with ``ord``.

    A block is a level of impact (a share of the term's greatest possible one) and, for terms of many units, a part of its units by hash,
    so no term is sorted or gathered in one place.
    """
    if ix.impacts is None:
        ix = ix.stored(name)
    base = fresh_folder(ix.units.sparkSession, name)
    # a gain stays below k1 + 1 times the rarity of its term
    most = idf(F.col("n"), F.col("df")) * (vocab.BM25_K1 + 1)
    level = F.least(F.lit(LEVELS - 1), F.floor(F.col("gain") / most * LEVELS)).cast("int")
    part = F.pmod(F.xxhash64("unit_id"), F.ceil(F.col("df") / (4 * block))).cast("int")
    rated = ix.impacts.join(ix.df.join(ix.stats, "chat_id"), ["chat_id", "term"]).select("chat_id", "unit_id", "term", "ord", "gain", level.alias("level"), part.alias("part"))
    entry = F.struct("unit_id", "ord", "gain")
    blocks = rated.groupBy("chat_id", "term", "level", "part").agg(F.max("gain").alias("top"), F.count(F.lit(1)).alias("n"), F.collect_list(entry).alias("entries"))
    blocks = kept_table(blocks.select("chat_id", "term", F.struct("level", "part").alias("block"), "top", "n", "entries"), f"{base}/blocks")
    lead = F.struct("top", "block", "n")
    terms = blocks.groupBy("chat_id", "term").agg(F.sum("n").alias("df"), F.max("top").alias("most"), F.max(lead).alias("l"))
    terms = kept_table(terms.select("chat_id", "term", "df", "most", F.col("l.block").alias("lead"), F.col("l.n").alias("lead_n")), f"{base}/terms")
    return BlockIndex(ix, blocks, terms)


def _credited(term: str = "term") -> Column:
    return F.col(term).rlike(f"^[{tx.HANGUL}]{{3,}}\\z")


class TopSearch:
    """The steps of a search, each a DataFrame: what is summed can be counted."""

    def __init__(self, bx: BlockIndex, queries: DataFrame, k: int, text: str = "query", prefix: bool = True):
        self.k = k
        every = query_rows(queries, text)
        known = every.join(bx.terms, ["chat_id", "term"], "left")
        self.asked = cut(known.withColumn("always", _credited() if prefix else F.lit(False)))
        by_most = W.partitionBy("query_id").orderBy(F.desc("most"), "term")
        read = self.asked.filter("df is not null").withColumn("read", F.sum("lead_n").over(by_most.rowsBetween(W.unboundedPreceding, W.currentRow)))
        seeds = read.filter((F.col("read") <= SEEDS) | (F.col("read") == F.col("lead_n"))).select("query_id", "chat_id", "term", "max_ord", F.col("lead").alias("block"))
        self.seeds = self._entries(seeds.join(bx.blocks, ["chat_id", "term", "block"]))
        sums = self.seeds.groupBy("query_id", "unit_id").agg(F.sum("gain").alias("part"))
        best = sums.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("part"), "unit_id"))).filter(F.col("r") <= TRIED * k).select("query_id", "unit_id")
        self.tried = best.join(self.asked.select("query_id", "chat_id", "term"), "query_id").join(bx.impacts.select("chat_id", "unit_id", "term", "gain"), ["chat_id", "unit_id", "term"])
        scores = self.tried.groupBy("query_id", "unit_id").agg(F.sum("gain").alias("score"))
        scores = scores.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("r") <= k)
        floor = scores.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("c")).filter(F.col("c") == k).select("query_id", "least")
        rising = W.partitionBy("query_id").orderBy("always", "most", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
        split = self.asked.filter("df is not null or always").join(floor, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
        split = split.withColumn("below", F.sum(F.coalesce("most", F.lit(0.0))).over(rising))
        self.split = cut(split.withColumn("summed", F.col("always") | (F.col("below") >= F.col("least"))).select("query_id", "chat_id", "term", "max_ord", "df", "most", "least", "summed"))
        self.summed = self._entries(self.split.filter("summed and df is not null").select("query_id", "chat_id", "term", "max_ord").join(bx.blocks, ["chat_id", "term"]))
        parts = self.summed.select("query_id", "chat_id", "unit_id", "ord", "gain", F.lit(1).alias("is_term"))
        if prefix:
            parts = parts.unionByName(self._credits(bx))
        sums = parts.groupBy("query_id", "chat_id", "unit_id", "ord").agg(F.sum("gain").alias("part"), F.sum("is_term").alias("terms"))
        # left terms by descending bound in ROUNDS parts; what a unit can still gain shrinks with each
        falling = W.partitionBy("query_id").orderBy(F.desc("most"), "term")
        left = self.split.filter("not summed").select("query_id", "chat_id", "term", "most", F.ntile(ROUNDS).over(falling).alias("turn"))
        self.looked_up = []
        for turn in range(1, ROUNDS + 1):
            bound = left.filter(F.col("turn") >= turn).groupBy("query_id").agg(F.sum("most").alias("may_gain"))
            least = self.split.groupBy("query_id").agg(F.max("least").alias("least")).join(bound, "query_id", "left")
            reached = cut(sums.join(least, "query_id").filter(F.col("part") + F.coalesce("may_gain", F.lit(0.0)) >= F.col("least")).select("query_id", "chat_id", "unit_id", "ord", "part", "terms"))
            asked = left.filter(F.col("turn") == turn).select("query_id", "chat_id", "term")
            found = reached.join(asked, ["query_id", "chat_id"]).join(bx.impacts.select("chat_id", "unit_id", "term", "gain"), ["chat_id", "unit_id", "term"]).select("query_id", "chat_id", "unit_id", "ord", F.col("gain").alias("part"), F.lit(1).cast("long").alias("terms"))
            self.looked_up.append(found)
            sums = reached.unionByName(found).groupBy("query_id", "chat_id", "unit_id", "ord").agg(F.sum("part").alias("part"), F.sum("terms").alias("terms"))
        self.sums = sums

    @staticmethod
    def _entries(blocks: DataFrame) -> DataFrame:
        e = blocks.select("query_id", "chat_id", "max_ord", F.explode("entries").alias("e")).select("query_id", "chat_id", "max_ord", "e.*")
        return e.filter(F.col("max_ord").isNull() | (F.col("ord") < F.col("max_ord"))).drop("max_ord")

    def _credits(self, bx: BlockIndex) -> DataFrame:
        """A flat credit for units that lack a term but have a longer word which begins with it."""
        long = self.asked.filter("always").select("query_id", "chat_id", "max_ord", "term", F.substring("term", 1, 3).alias("p3"))
        near = long.join(lasting_words(bx.words.postings), ["chat_id", "p3"]).filter(F.startswith("word", "term") & (F.col("word") != F.col("term"))).select("query_id", "chat_id", "unit_id", "max_ord", "term").distinct()
        near = near.join(bx.words.postings.select("chat_id", "unit_id", "term"), ["chat_id", "unit_id", "term"], "left_anti").join(bx.words.units.select("chat_id", "unit_id", "ord"), ["chat_id", "unit_id"])
        near = near.filter(F.col("max_ord").isNull() | (F.col("ord") < F.col("max_ord")))
        return near.select("query_id", "chat_id", "unit_id", "ord", F.lit(vocab.PREFIX_CREDIT).alias("gain"), F.lit(1).alias("is_term"))

    def hits(self, digits: int | None = None) -> DataFrame:
        """query_id, chat_id, unit_id, ord, score, n_matched, rank of the best k; with digits, scores are rounded before they are compared."""
        score = F.col("part") if digits is None else F.round("part", digits)
        done = self.sums.select("query_id", "chat_id", "unit_id", "ord", score.alias("score"), F.col("terms").alias("n_matched")).filter("score > 0")
        w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ord"), F.asc("unit_id"))
        return done.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= self.k)


def top_bm25(bx: BlockIndex, queries: DataFrame, k: int, text: str = "query", prefix: bool = True, digits: int | None = None) -> DataFrame:
    """The best k of each query (query_id, chat_id, query[, max_ord]), as the first k rows of ``rank.bm25``."""
    return TopSearch(bx, queries, k, text, prefix).hits(digits)
