"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks of about BLOCK_WORDS words by a hash of their id;
blocks grow in number with the source (MIN_BLOCKS to MAX_BLOCKS; beyond that, in size).
What the mix needs of a source is its quota: so many block draws, pass after pass over the
source's blocks, each pass in a hashed order of its own, until the target is reached; the
last block is cut inside by documents in hashed order.  The quotas of all sources are dealt
to output shards by halving the list of shards again and again; at each node a multivariate-
hypergeometric draw says how many blocks of each source go left.  A shard so gets a range
of each source's permuted sequence, disjoint from all others', draws those blocks, and
shuffles its documents by a hash.  Only blocks that a shard draws are taken.

The driver holds one row a source and the tree's counts (one for each source that a shard
draws from); blocks stay in Spark.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; a null doc_id counts as one document and hashes by its text; repeated
rows share a block and are taken alike; ties in hash share a place; a very long text is one
document, taken whole or not; sources without words have target 0 and nothing is taken; an
empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, written

BLOCK_WORDS = 500_000
MIN_BLOCKS, MAX_BLOCKS = 256, 1 << 20
SHARD_WORDS = 20_000_000
MIN_SHARDS = 64
SHARE = 1.5
CAP = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
#: Tables of at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Mix:
    """shards None: one for each SHARD_WORDS words of the mix, and MIN_SHARDS at least, but never more than a quarter of the block draws."""

    share: float = SHARE
    cap: float = CAP
    weights: tuple[float, ...] = WEIGHTS
    block_words: int = BLOCK_WORDS
    shards: int | None = None
    seed: int = 17


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """share * sum(sizes) split by weight; none above cap * its size, the excess reshared by weight until none is."""
    total = share * sum(sizes)
    most = [cap * s for s in sizes]
    fixed: dict[int, float] = {i: 0.0 for i, s in enumerate(sizes) if s == 0}
    while True:
        left = total - sum(fixed.values())
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most[i]]
        if not over:
            return [fixed[i] if i in fixed else left * weights[i] / w for i in range(len(sizes))]
        fixed |= {i: most[i] for i in over}


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, blocks of each) by shard: at each node a draw says how many blocks of every source its left half gets."""
    some = np.flatnonzero(quotas)
    stack = [(0, shards, some, np.asarray(quotas, np.int64)[some])]
    while stack:
        lo, hi, ids, q = stack.pop()
        if hi - lo == 1:
            yield lo, ids, q
            continue
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, n, method="marginals") if n else np.zeros_like(q)
        for a, z, part in ((mid, hi, q - left), (lo, mid, left)):
            stack.append((a, z, ids[part > 0], part[part > 0]))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (t.lower() for t in taken):
        name += "_"
    return name


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def source_goals(docs: DataFrame, mix: Mix, text: str, source: str) -> list[tuple[str | None, int, float, int]]:
    """(source, words, target, blocks) in the sources' order."""
    rows = docs.groupBy(F.col(source).alias("s")).agg(F.sum(n_words(F.col(text))).alias("w")).toArrow()
    got = sorted(zip(rows.column("s").to_pylist(), rows.column("w").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [w for _, w in got]
    goal = targets(sizes, [mix.weights[i % len(mix.weights)] for i in range(len(got))], mix.share, mix.cap) if got else []
    return [(s, w, float(g), max(MIN_BLOCKS, min(MAX_BLOCKS, -(-w // mix.block_words)))) for (s, w), g in zip(got, goal, strict=True)]


def block_draws(blocks: DataFrame, mix: Mix) -> DataFrame:
    """(s, b, copy, rank, cut) for every block draw of every source's quota, from (s, b, w, size, goal).

    rank is the place in the source's permuted sequence; cut: for a block of which only a part is taken, the words still wanted.
    A source has at most MAX_BLOCKS blocks, so its windows are bounded.
    """
    some = blocks.filter("w > 0 and goal >= 1").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("s")))
    passes = some.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.round("goal") / F.col("size")).cast("int") - 1)))
    order = W.partitionBy("s", "copy").orderBy(F.xxhash64(F.lit(mix.seed), "copy", "b"), "b")
    run = F.sum("w").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    wanted = F.round("goal").cast("long") - F.col("copy") * F.col("size")
    seen = passes.select("s", "b", "w", "copy", (F.col("copy") * F.col("n") + F.row_number().over(order) - 1).alias("rank"), (run - F.col("w")).alias("before"), wanted.alias("wanted"))
    return seen.filter("before < wanted").select("s", "b", "copy", "rank", F.when(F.col("before") + F.col("w") > F.col("wanted"), F.col("wanted") - F.col("before")).alias("cut"))


def dealt(draws: DataFrame, goals: list[tuple], mix: Mix) -> DataFrame:
    """draws with shard: the tree gives each shard a range of ranks of each source."""
    n = draws.groupBy("s").agg(F.count(F.lit(1)).alias("n")).toArrow()
    quota = dict(zip(n.column("s").to_pylist(), n.column("n").to_pylist(), strict=True))
    names = [g[0] for g in goals]
    quotas = np.array([quota.get(s, 0) for s in names], np.int64)
    words = sum(g[2] for g in goals)
    shards = mix.shards or max(1, min(max(round(words / SHARD_WORDS), MIN_SHARDS), int(quotas.sum()) // 4))
    at = np.zeros(len(names), np.int64)
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for shard, ids, count in split_tree(quotas, shards, np.random.default_rng(mix.seed)):
        for c, x in zip(cols, (ids, np.full(len(ids), shard), at[ids].copy(), at[ids] + count - 1), strict=True):
            c.append(x)
        at[ids] += count
    ids, shard, lo, hi = (np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in cols)
    table = pa.table({"qs": pa.array(names, pa.string()).take(pa.array(ids)), "shard": pa.array(shard.astype(np.int32)), "lo": lo, "hi": hi})
    ranges = draws.sparkSession.createDataFrame(table).select("qs", "shard", F.explode(F.sequence("lo", "hi")).alias("r"))
    return draws.join(ranges, F.col("s").eqNullSafe(F.col("qs")) & (F.col("rank") == F.col("r"))).select("s", "b", "copy", "cut", "shard")


def with_draws(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs and struct ``mix`` (an input column of that name is replaced): size, source_size, target and
    draws, an array of (shard, copy, place) with one entry for each time that the mix takes the document.

    The documents do not move while the table of drawn blocks is small enough to broadcast; beyond, they are joined by block.
    """
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c != "mix"))
    own = docs.columns
    c = {k: _free(f"_{k}", own) for k in ("hash", "block", "source", "words", "size", "target", "blocks", "s", "b", "draws")}
    goals = source_goals(docs, mix, text, source)
    kinds = f"{c['source']} string, {c['size']} long, {c['target']} double, {c['blocks']} long"
    per = _small(spark.createDataFrame(goals or [], kinds), len(goals))
    id_, src = F.col(f"`{doc_id}`"), F.col(f"`{source}`")
    key = F.when(id_.isNull(), F.xxhash64(F.lit(mix.seed), F.col(f"`{text}`"))).otherwise(F.xxhash64(F.lit(mix.seed), id_.cast("string")))
    keyed = docs.withColumns({c["hash"]: key, c["words"]: n_words(F.col(f"`{text}`"))}).join(per, src.eqNullSafe(F.col(c["source"])), "left")
    keyed = keyed.withColumn(c["block"], F.pmod(F.col(c["hash"]), F.col(c["blocks"])))

    totals = keyed.groupBy(F.col(c["source"]).alias("s"), F.col(c["block"]).alias("b"), F.col(c["size"]).alias("size"), F.col(c["target"]).alias("goal")).agg(F.sum(c["words"]).alias("w"))
    plan = written(dealt(written(block_draws(totals, mix), "mix-draws"), goals, mix), "mix-shards")
    n_plan = plan.count()
    cuts = plan.filter("cut is not null").select("s", "b", "cut").toDF("cs", "cb", "cut")
    inside = keyed.select(F.col(c["source"]).alias("s"), F.col(c["block"]).alias("b"), F.col(c["hash"]).alias("h"), F.col(c["words"]).alias("w"))
    last = _last_hash(inside.join(_small(cuts, len(goals)), F.col("s").eqNullSafe(F.col("cs")) & (F.col("b") == F.col("cb"))).select("s", "b", "cut", "h", "w"))
    draws = (
        plan.alias("p")
        .join(_small(last, len(goals)).alias("q"), F.col("p.s").eqNullSafe(F.col("q.s")) & (F.col("p.b") == F.col("q.b")) & F.col("p.cut").isNotNull(), "left")
        .groupBy(F.col("p.s").alias(c["s"]), F.col("p.b").alias(c["b"]))
        .agg(F.collect_list(F.struct("shard", "copy", F.col("cut").isNotNull().alias("partly"), "last")).alias(c["draws"]))
    )
    joined = keyed.join(_small(draws, n_plan), F.col(c["source"]).eqNullSafe(F.col(c["s"])) & (F.col(c["block"]) == F.col(c["b"])), "left")
    hash_ = F.col(c["hash"])
    taken = F.filter(F.coalesce(F.col(c["draws"]), F.array().cast(draws.schema[c["draws"]].dataType)), lambda x: ~x["partly"] | (hash_ <= x["last"]))
    made = F.struct(
        F.col(c["words"]).alias("size"), F.coalesce(c["size"], F.lit(0)).cast("long").alias("source_size"),
        F.coalesce(c["target"], F.lit(0.0)).alias("target"), F.transform(taken, lambda x: _draw(x, hash_, mix)).alias("draws"),
    )
    return joined.select(*(F.col(f"`{x}`") for x in own), made.alias("mix"))


def _draw(x: Column, hash_: Column, mix: Mix) -> Column:
    return F.struct(x["shard"].alias("shard"), x["copy"].alias("copy"), F.xxhash64(F.lit(mix.seed + 1), hash_, x["copy"]).alias("place"))


def _last_hash(rows: DataFrame) -> DataFrame:
    """For each cut block (one a source at most): the last hash that is still taken."""
    one = rows.groupBy("s", "b", "cut", "h").agg(F.sum("w").alias("w"))
    run = one.withColumn("run", F.sum("w").over(W.partitionBy("s", "b").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return run.filter(F.col("run") - F.col("w") / 2 <= F.col("cut")).groupBy("s", "b").agg(F.max("h").alias("last"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each taken copy of a document: its columns and struct ``mix`` of size, source_size, target, shard, copy, place."""
    drawn = with_draws(docs, mix, doc_id, text, source)
    own = [F.col(f"`{c}`") for c in drawn.columns if c != "mix"]
    flat = drawn.filter(F.size("mix.draws") > 0).select(*own, "mix", F.explode("mix.draws").alias("_draw"))
    return flat.select(*own, F.struct("mix.size", "mix.source_size", "mix.target", "_draw.shard", "_draw.copy", "_draw.place").alias("mix"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix laid out by shard, each in its own order; partitions follow the session's setting."""
    return mixed.repartition(F.col("mix.shard")).sortWithinPartitions("mix.shard", "mix.place")


def query(docs: DataFrame) -> DataFrame:
    drawn = with_draws(docs.select("doc_id", "text", "source"))
    return drawn.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.size("mix.draws")).cast("long").alias("taken"))
