"""Rankers over an index: BM25, topics, embeddings, fusion, exact-then-close search, scene extraction, baselines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import vocab
from ..functions import text as tx
from .grams import find_phrases
from .index import Index, earlier_terms, idf, lasting_words, tf_norm
from .lineage import cut

HITS = ("query_id", "chat_id", "unit_id", "score", "matched", "strong")


def query_rows(queries: DataFrame, text: str = "query", terms: Callable[[str], Column] = tx.query_terms) -> DataFrame:
    """(query_id, chat_id, max_ord, term) of queries; max_ord null means no bound."""
    bound = F.col("max_ord").cast("long") if "max_ord" in queries.columns else F.lit(None).cast("long")
    return queries.select("query_id", "chat_id", bound.alias("max_ord"), F.posexplode(terms(text)).alias("place", "term"))


def bm25(ix: Index, queries: DataFrame, text: str = "query", prefix: bool = True, topics: tuple[DataFrame, DataFrame] | None = None, words: bool = True) -> DataFrame:
    """All hits of all queries (query_id, chat_id, query[, max_ord]) in one job.

    Statistics are those of the whole corpus, also under a bound.  With prefix, a Hangul term of three syllables
    that a document lacks but one of its words begins with adds a flat credit.  topics: (document vectors, query
    vectors) of ``lsa``; agreement above a floor adds to the score.  words: with the terms themselves, else only their number.
    """
    q = query_rows(queries, text)
    if ix.impacts is not None:  # what a term adds to a unit is stored
        hit, gain = q.join(ix.impacts.drop("ord"), ["chat_id", "term"]), F.col("gain")
    else:
        hit = q.join(ix.postings, ["chat_id", "term"]).join(ix.df, ["chat_id", "term"]).join(ix.stats, "chat_id").join(ix.docs, ["chat_id", "unit_id"])
        gain = tf_norm(F.col("tf"), F.col("length"), F.col("avg_length")) * idf(F.col("n"), F.col("df"))
    parts = hit.select("query_id", "chat_id", "unit_id", "max_ord", "place", "term", gain.alias("gain"), ((F.length("term") >= 3) & (gain >= 1.5)).alias("is_strong"))
    if prefix:
        lasting = lasting_words(ix.postings)
        long = q.filter(F.col("term").rlike(f"^[{tx.HANGUL}]{{3,}}\\z")).withColumn("p3", F.substring("term", 1, 3))
        near = long.join(lasting, ["chat_id", "p3"]).filter(F.startswith("word", "term") & (F.col("word") != F.col("term"))).select("query_id", "chat_id", "unit_id", "max_ord", "place", "term").distinct()
        near = near.join(ix.postings.select("chat_id", "unit_id", "term"), ["chat_id", "unit_id", "term"], "left_anti")
        parts = parts.unionByName(near.withColumn("gain", F.lit(vocab.PREFIX_CREDIT)).withColumn("is_strong", F.lit(False)))
    if topics is not None:
        docs, asked = topics
        dot = F.aggregate(F.zip_with("vec", "qvec", lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda a, x: a + x)
        agree = asked.join(docs, "chat_id").withColumn("dot", dot).filter(F.col("dot") > vocab.TOPIC_FLOOR)
        bound = F.col("max_ord").cast("long") if "max_ord" in queries.columns else F.lit(None).cast("long")
        agree = agree.join(queries.select("query_id", bound.alias("max_ord")), "query_id")
        parts = parts.unionByName(agree.select("query_id", "chat_id", "unit_id", "max_ord", F.lit(-1).alias("place"), F.lit(None).cast("string").alias("term"), (F.col("dot") * vocab.TOPIC_WEIGHT).alias("gain"), F.lit(False).alias("is_strong")))
    return _gather(ix, parts, q, words)


def _gather(ix: Index, parts: DataFrame, q: DataFrame, words: bool) -> DataFrame:
    """Hits from gains (query_id, chat_id, unit_id, max_ord, place, term, gain, is_strong).

    Which of a query's terms (120 at most) a document has is kept as bits, so the sums stay in plain hash aggregation;
    with words, the bits become the terms themselves beside each hit.
    """
    bits = lambda lo, on: F.bit_or(F.when(on & (F.col("place") >= lo) & (F.col("place") < lo + 60), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") - lo)).otherwise(F.lit(0).cast("long")))
    every = F.lit(True)
    order = ix.units.select("chat_id", "unit_id", "ord")
    sums = parts.groupBy("query_id", "chat_id", "unit_id", "max_ord").agg(F.sum("gain").alias("score"), bits(0, every).alias("m0"), bits(60, every).alias("m1"), bits(0, F.col("is_strong")).alias("s0"), bits(60, F.col("is_strong")).alias("s1"))
    found = sums.filter(F.col("score") > 0).join(order, ["chat_id", "unit_id"]).filter(F.col("max_ord").isNull() | (F.col("ord") < F.col("max_ord")))
    found = found.withColumn("n_matched", F.bit_count("m0") + F.bit_count("m1")).withColumn("n_strong", F.bit_count("s0") + F.bit_count("s1"))
    if not words:
        return found.select("query_id", "chat_id", "unit_id", "ord", "score", "n_matched", "n_strong")
    asked = q.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("asked"))
    has = lambda lo, hi: lambda x: F.when(x["place"] < 60, F.call_function("shiftright", F.col(lo), x["place"])).otherwise(F.call_function("shiftright", F.col(hi), x["place"] - 60)).bitwiseAND(F.lit(1).cast("long")) == 1
    names = lambda lo, hi: F.transform(F.filter("asked", has(lo, hi)), lambda x: x["term"])
    found = found.join(asked, "query_id", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<struct<place: int, term: string>>")))
    return found.select("query_id", "chat_id", "unit_id", "ord", "score", names("m0", "m1").alias("matched"), names("s0", "s1").alias("strong"), "n_matched", "n_strong")


def earlier_bm25(ix: Index, queries: DataFrame, text: str = "query") -> DataFrame:
    """The earlier ranker: two-character terms that name nobody count a fifth, strong terms are the rare ones, prefix hits are strong."""
    def last(x: str) -> Column:
        t = earlier_terms(x)
        return F.array_distinct(F.when(F.size(t) > 120, F.slice(t, F.size(t) - 119, F.lit(120))).otherwise(t))

    q = query_rows(queries, text, last)
    named = ix.entities.select("chat_id", F.lower("name").alias("term"), F.lit(True).alias("named"))
    hit = q.join(ix.postings, ["chat_id", "term"]).join(ix.df, ["chat_id", "term"]).join(ix.stats, "chat_id").join(ix.docs, ["chat_id", "unit_id"]).join(named, ["chat_id", "term"], "left")
    weight = F.when((F.length("term") == 2) & F.col("named").isNull(), 0.2).otherwise(1.0)
    gain = weight * tf_norm(F.col("tf"), F.col("length"), F.col("avg_length")) * idf(F.col("n"), F.col("df"))
    rare = (F.length("term") >= 3) & (F.col("df") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.2)))
    parts = hit.select("query_id", "chat_id", "unit_id", "max_ord", "place", "term", gain.alias("gain"), rare.alias("is_strong"))
    lasting = lasting_words(ix.postings)
    near = q.filter(F.col("term").rlike(f"^[{tx.HANGUL}]{{3,}}\\z")).withColumn("p3", F.substring("term", 1, 3)).join(lasting, ["chat_id", "p3"]).filter(F.startswith("word", "term") & (F.col("word") != F.col("term")))
    near = near.select("query_id", "chat_id", "unit_id", "max_ord", "place", "term").distinct().join(ix.postings.select("chat_id", "unit_id", "term"), ["chat_id", "unit_id", "term"], "left_anti")
    parts = parts.unionByName(near.withColumn("gain", F.lit(vocab.PREFIX_CREDIT)).withColumn("is_strong", F.lit(True)))
    return _gather(ix, parts, q, True)


def top(hits: DataFrame, k: int, order: Sequence[Column] | None = None, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """The best k of each query with a 1-based rank; ties by order, then unit."""
    order = order or [F.desc("score"), F.asc("ord"), F.asc("unit_id")]
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def by_message(hits: DataFrame) -> DataFrame:
    """The best hit of each message."""
    w = W.partitionBy("query_id", "message_id").orderBy(F.desc("score"), F.asc("ord"), F.asc("unit_id"))
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def fuse(rankings: Sequence[DataFrame], key: str = "unit_id", base: int = vocab.RRF_BASE) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, key, rank0): sum of 1 / (base + rank), ranks from 0."""
    every = rankings[0].select("query_id", key, "rank0")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", key, "rank0"))
    return every.groupBy("query_id", key).agg(F.sum(1.0 / (base + F.col("rank0"))).alias("fused"))


def rank0(scores: DataFrame, score: str = "score", tie: Sequence[str] = ("unit_id",), limit: int | None = None) -> DataFrame:
    """scores with rank0, the 0-based place of each row in its query."""
    out = scores.withColumn("rank0", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), *tie)) - 1)
    return out if limit is None else out.filter(F.col("rank0") < limit)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(tx.col(a), tx.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries that are sent to all tasks at once, in bytes of their vectors; more go in further passes over the vectors.
QUERY_BYTES = 32_000_000
#: Queries of one pass at most: a task keeps k hits, or the coarse bins, of each.
PASS_QUERIES = 4000
#: Cosines that a task has at once.
BLOCK_CELLS = 4_000_000


def _passes(n: int, width: int | None) -> int:
    return max(1, -(-8 * n * (width or 0) // QUERY_BYTES), -(-n // PASS_QUERIES))


def _slices(batches, queries: int):
    """Batches in slices whose cosines with so many queries stay within BLOCK_CELLS."""
    step = max(1, BLOCK_CELLS // max(1, queries))
    for b in batches:
        for f in range(0, b.num_rows, step):
            yield b.slice(f, step)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of unit length from a list column; a vector of zeros stays one."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = lists.flatten(), pc.list_value_length(lists)
    if len(lists) and not lists.null_count and not flat.null_count and pc.count_distinct(sizes).as_py() == 1:
        v = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    else:
        v = np.array(lists.to_pylist(), float).reshape(len(lists), -1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1.0)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "vec", key: str = "unit_id", digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank): the k nearest vectors of each query by rounded cosine, ties by key; vectors of zeros are near nothing.

    A task multiplies its vectors, block by block, with the queries and keeps k of each, so only k rows a query and task are shuffled.
    """
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    passes = _passes(n, width)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    found = []
    for p in range(passes):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).select("query_id", F.col(vec).alias("v")).toArrow().combine_chunks()
        names, side = some.column("query_id").to_pylist(), some.column("v")
        sent = vectors.sparkSession.sparkContext.broadcast((names, _matrix(side) if names else np.zeros((0, 1))))

        def run(batches, sent=sent):
            names, side = sent.value
            best: list[list[tuple]] = [[] for _ in names]
            for b in _slices(batches, len(names)):
                if not names:
                    continue
                keys, v = b.column(0).to_pylist(), _matrix(b.column(1))
                some = np.linalg.norm(v, axis=1) > 0
                score = np.round(v @ side.T, digits)
                for j, have in enumerate(best):
                    least = -have[-1][0] if len(have) == k else -np.inf
                    near = np.flatnonzero(some & (score[:, j] >= least))
                    if len(near) > k:
                        cut = np.partition(score[near, j], -k)[-k]
                        near = near[score[near, j] >= cut]
                    best[j] = sorted([*have, *((-score[i, j], keys[i]) for i in near)])[:k]
            rows = [(q, name, -s) for q, have in zip(names, best, strict=True) for s, name in have]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, to_arrow_schema(schema), strict=True)], schema.names)

        found.append(vectors.select(key, vec).mapInArrow(run, schema))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cosines(vectors: DataFrame, queries: DataFrame, vec: str = "vec", key: str = "unit_id", digits: int = 6) -> DataFrame:
    """(query_id, key, score) of every vector and query, for statistics of a query's whole distribution; queries as in cosine_top."""
    unit = lambda v: F.sqrt(dot(v, v))
    pairs = vectors.select(key, F.col(vec).alias("_v"), unit(vec).alias("_n")).crossJoin(queries.select("query_id", F.col(vec).alias("_q"), unit(vec).alias("_m")))
    return pairs.select("query_id", key, F.round(dot("_v", "_q") / F.nullif(F.col("_n") * F.col("_m"), F.lit(0.0)), digits).alias("score"))


#: Coarse bins of a cosine, of BIN millionths each; the middle element is then looked for in one of them.
BIN = 2000


def middle_gap(vectors: DataFrame, queries: DataFrame, gap: float = 0.04, vec: str = "vec", key: str = "unit_id") -> DataFrame:
    """(query_id, key, score, gap): the nearest vector of each query if it is more than gap above the middle one (place floor(n / 2)
    of the descending list), by cosines rounded to six digits; vectors of zeros count for nothing.

    No pair leaves a task: a first reading counts coarse bins, a second the values of the one bin that holds the middle.  Queries go
    out in passes as in cosine_top, and what returns to the driver is a row a query of the pass.
    """
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    passes = _passes(n, width)
    name, unit = queries.schema["query_id"].dataType, vectors.schema[key].dataType
    coarse = T.StructType([T.StructField("query_id", name), T.StructField("bin", T.LongType()), T.StructField("c", T.LongType()), T.StructField("best", T.LongType()), T.StructField(key, unit)])
    fine = T.StructType([T.StructField("query_id", name), T.StructField("value", T.LongType()), T.StructField("c", T.LongType())])
    spark = vectors.sparkSession
    found = None

    def cosine_blocks(batches, side):
        for b in _slices(batches, len(side)):
            v = _matrix(b.column(1))
            some = np.flatnonzero(np.linalg.norm(v, axis=1) > 0)
            if len(some) and len(side):
                yield b.column(0).take(pa.array(some)).to_pylist(), np.rint(v[some] @ side.T * 1e6).astype(np.int64)

    for p in range(passes):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).select("query_id", F.col(vec).alias("v")).toArrow().combine_chunks()
        names, side = some.column("query_id").to_pylist(), some.column("v")
        matrix = _matrix(side) if names else np.zeros((0, 1))
        live = [i for i in range(len(names)) if np.linalg.norm(matrix[i]) > 0]
        names, matrix = [names[i] for i in live], matrix[live]
        sent = spark.sparkContext.broadcast((names, matrix))

        def count_bins(batches, sent=sent):
            names, side = sent.value
            low, n = -1_000_000 // BIN - 1, 2_000_000 // BIN + 3
            counts = np.zeros((len(names), n), np.int64)
            best: list[tuple | None] = [None] * len(names)
            for keys, score in cosine_blocks(batches, side):
                cell = score // BIN - low + np.arange(len(names)) * n
                counts += np.bincount(cell.ravel(), minlength=counts.size).reshape(counts.shape)
                top = score.max(0)
                for j in range(len(names)):
                    if best[j] is None or -int(top[j]) <= best[j][0]:
                        first = (-int(top[j]), min(keys[i] for i in np.flatnonzero(score[:, j] == top[j])))
                        best[j] = first if best[j] is None else min(best[j], first)
            for f in range(0, len(names), 100):
                j, x = np.nonzero(counts[f : f + 100])
                made = [[names[f + i] for i in j], x + low, counts[f : f + 100][j, x], [-best[f + i][0] if best[f + i] else None for i in j], [best[f + i][1] if best[f + i] else None for i in j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(made, to_arrow_schema(coarse), strict=True)], coarse.names)

        bins = cut(vectors.select(key, vec).mapInArrow(count_bins, coarse).groupBy("query_id", "bin").agg(F.sum("c").alias("c"), F.min(F.struct((-F.col("best")).alias("low"), key)).alias("top")))
        whole = bins.groupBy("query_id").agg(F.sum("c").alias("n"), F.min("top").alias("top"))
        down = F.sum("c").over(W.partitionBy("query_id").orderBy(F.desc("bin")))
        mid = bins.select("query_id", "bin", "c").withColumn("run", down).join(whole, "query_id").filter((F.col("run") > F.floor(F.col("n") / 2)) & (F.col("run") - F.col("c") <= F.floor(F.col("n") / 2)))
        rows = mid.select("query_id", "bin", (F.floor(F.col("n") / 2) - (F.col("run") - F.col("c"))).alias("place"), "top.low", f"top.{key}").collect()
        where = spark.sparkContext.broadcast({r.query_id: r.bin for r in rows})

        def count_values(batches, sent=sent, where=where):
            names, side = sent.value
            counts: dict[tuple, int] = {}
            for _, score in cosine_blocks(batches, side):
                for j, q in enumerate(names):
                    mine = score[:, j][score[:, j] // BIN == where.value[q]]
                    for x, c in zip(*np.unique(mine, return_counts=True), strict=True):
                        counts[q, int(x)] = counts.get((q, int(x)), 0) + int(c)
            out = [(q, x, c) for (q, x), c in counts.items()]
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, to_arrow_schema(fine), strict=True)], fine.names)

        values = vectors.select(key, vec).mapInArrow(count_values, fine).groupBy("query_id", "value").agg(F.sum("c").alias("c"))
        known = spark.createDataFrame([(r.query_id, r.place, -r.low, r[key]) for r in rows], T.StructType([coarse[0], T.StructField("place", T.LongType()), T.StructField("best", T.LongType()), coarse[4]]))
        down = F.sum("c").over(W.partitionBy("query_id").orderBy(F.desc("value")))
        middle = values.withColumn("run", down).join(known, "query_id").filter(F.col("run") > F.col("place")).groupBy("query_id", key, "best").agg(F.max("value").alias("mid"))
        one = middle.select("query_id", key, (F.col("best") / 1e6).alias("score"), ((F.col("best") - F.col("mid")) / 1e6).alias("gap")).filter(F.col("gap") > gap)
        found = one if found is None else found.unionByName(one)
    return found


def missing_vectors(items: DataFrame, stored: DataFrame, text: str = "text") -> DataFrame:
    """Items whose text key has no stored vector yet."""
    return items.withColumn("key", tx.text_key(text)).join(stored.select("key"), "key", "left_anti")


def embed_with(items: DataFrame, embed: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """Items with vec from an injected model, batch by batch."""
    return items.withColumn("vec", F.pandas_udf(embed, "array<float>")(text))


def refresh_vectors(items: DataFrame, stored: DataFrame, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(key, vec) for the current items: stored ones kept, missing ones embedded, vanished ones dropped."""
    keyed = items.withColumn("key", tx.text_key("text"))
    kept = stored.join(keyed.select("key").distinct(), "key", "left_semi").select("key", "vec")
    fresh = embed_with(missing_vectors(items, stored).dropDuplicates(["key"]), embed).select("key", "vec")
    return kept.unionByName(fresh)


def stands_out(scores: DataFrame, gap: float = 0.04) -> DataFrame:
    """The top row of each query if it is more than gap above the middle one (place floor(n / 2) of the descending list).

    Scores are counted by value first; nothing is sorted but distinct values.
    """
    best = scores.groupBy("query_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    top = scores.join(best.select("query_id", "score"), ["query_id", "score"], "left_semi").groupBy("query_id").agg(F.min("unit_id").alias("unit_id"))
    values = scores.groupBy("query_id", "score").agg(F.count(F.lit(1)).alias("c"))
    run = F.sum("c").over(W.partitionBy("query_id").orderBy(F.desc("score")))
    mid = values.withColumn("run", run).join(best.select("query_id", "n"), "query_id").filter(F.col("run") > F.floor(F.col("n") / 2)).groupBy("query_id").agg(F.max("score").alias("mid"))
    r = best.join(top, "query_id").join(mid, "query_id").withColumn("gap", F.col("score") - F.col("mid"))
    return r.filter(F.col("gap") > gap).select("query_id", "unit_id", "score", "gap")


# --- topics ----------------------------------------------------------------------------------


def topic_vectors(rows: list[tuple[str, str, float]], n_terms: dict[str, int], k: int = 8, steps: int = 12):
    """Vt and document vectors of one corpus by seeded power iteration in single precision; None if it is too small.

    rows: (unit, term, tf) with units and terms in first-seen order; n_terms: documents a term occurs in.
    """
    units = list(dict.fromkeys(r[0] for r in rows))
    n = len(units)
    vocabulary = [t for t in dict.fromkeys(r[1] for r in rows) if 2 <= n_terms[t] <= 0.75 * n and "_" not in t]
    if n < 2 * k or len(vocabulary) < 2 * k:
        return None
    at, term = {u: i for i, u in enumerate(units)}, {t: j for j, t in enumerate(vocabulary)}
    a = np.zeros((n, len(vocabulary)), np.float32)
    for u, t, tf in rows:
        if t in term:
            d = n_terms[t]
            a[at[u], term[t]] = np.sqrt(tf) * max(0.1, np.log(1 + (n - d + 0.5) / (d + 0.5)))
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    a = np.where(norm > 1e-8, a / np.maximum(norm, 1e-30), a).astype(np.float32)
    left, found = a.copy(), []
    for c in range(1, k + 1):
        v = np.sin(c * np.arange(1, len(vocabulary) + 1)).astype(np.float32)
        v /= np.linalg.norm(v)
        for _ in range(steps):
            u = left @ v
            size = np.linalg.norm(u)
            if size < 1e-8:
                break
            fresh = left.T @ (u / size)
            size = np.linalg.norm(fresh)
            if size < 1e-8:
                break
            v = (fresh / size).astype(np.float32)
        u = left @ v
        if np.linalg.norm(u) < 1e-6:
            break
        found.append(v)
        left = left - np.outer(u, v).astype(np.float32)
    if not found:
        return None
    vt = np.stack(found)
    docs = a @ vt.T
    size = np.linalg.norm(docs, axis=1, keepdims=True)
    docs = np.where(size > 1e-8, docs / np.maximum(size, 1e-30), docs)
    return vocabulary, vt, dict(zip(units, docs, strict=True))


def lsa(ix: Index, queries: DataFrame, text: str = "query", k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(chat_id, unit_id, vec) and (query_id, chat_id, qvec): topics of each corpus, one corpus a task.

    The iteration is the definition, so it runs whole in one place; corpora are single conversations.
    For a corpus beyond one worker use lsa_spread.
    """
    rows = ix.postings.join(ix.df, ["chat_id", "term"]).join(ix.units.select("chat_id", "unit_id", "ord"), ["chat_id", "unit_id"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "unit_id", "term"])
        made = topic_vectors(list(zip(pdf.unit_id, pdf.term, pdf.tf, strict=True)), dict(zip(pdf.term, pdf.df, strict=True)), k)
        if made is None:
            return pd.DataFrame({"chat_id": [], "kind": [], "name": [], "vec": []})
        vocabulary, vt, docs = made
        chat = pdf.chat_id.iloc[0]
        out = [(chat, "unit", u, v.astype(float).tolist()) for u, v in docs.items()] + [(chat, "term", t, vt[:, j].astype(float).tolist()) for j, t in enumerate(vocabulary)]
        return pd.DataFrame(out, columns=["chat_id", "kind", "name", "vec"])

    made = rows.groupBy("chat_id").applyInPandas(fit, "chat_id string, kind string, name string, vec array<double>")
    docs = made.filter("kind = 'unit'").select("chat_id", F.col("name").alias("unit_id"), "vec")
    terms = made.filter("kind = 'term'").select("chat_id", F.col("name").alias("term"), F.col("vec").alias("tvec"))
    q = query_rows(queries, text).join(terms, ["chat_id", "term"]).select("query_id", "chat_id", F.posexplode("tvec").alias("i", "x"))
    q = q.groupBy("query_id", "chat_id", "i").agg(F.sum("x").alias("x")).groupBy("query_id", "chat_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    q = q.select("query_id", "chat_id", F.transform("v", lambda x: x["x"]).alias("v")).withColumn("size", F.sqrt(dot("v", "v")))
    return docs, q.filter("size >= 1e-8").select("query_id", "chat_id", F.transform("v", lambda x: x / F.col("size")).alias("qvec"))


def lsa_spread(units: DataFrame, queries: DataFrame, text: str = "query", k: int = 8, steps: int = 12, terms: Callable[[str], Column] = tx.query_terms) -> tuple[DataFrame, DataFrame]:
    """lsa() for units of one corpus of any size: the same iteration, each step one pass over rows that stay where they are.

    Rows are checkpointed sparse, about eight bytes a term of a unit, many units packed in one.  Terms are told apart by 64-bit hashes and
    stay in Spark; of the vocabulary the driver has a hash and a frequency, and a number a topic.  A step sends one vector out and gets
    one, added up, back.
    """
    spark = units.sparkSession
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    listed = units.select("chat_id", "unit_id", "ord", tx.searchable("text").alias("clean"))
    listed = listed.select("chat_id", "unit_id", "ord", tx.terms_of("clean").alias("term"))
    # Hashes in the order of their terms.  Whether a unit has any term is a column: a filter would be pushed down and clean each text again.
    listed = listed.select("chat_id", "unit_id", "ord", (F.size("term") > 0).alias("some"), hashes(F.sort_array(F.filter("term", lambda w: ~F.contains(w, F.lit("_"))))).alias("h")).persist()
    n = listed.filter("some").count()
    kind = {f.name: f.dataType for f in listed.schema}
    fields = T.StructType([T.StructField("key", T.LongType()), T.StructField("ord", kind["ord"]), T.StructField("unit_id", kind["unit_id"]), T.StructField("place", T.IntegerType()), T.StructField("df", T.LongType())])

    def count_units(batches):
        for b in batches:
            b = b.take(pc.sort_indices(b, sort_keys=[("ord", "ascending"), ("unit_id", "ascending")], null_placement="at_start"))
            row, h, _ = _runs(b.column("h"))
            key, at, df = np.unique(h, return_index=True, return_counts=True)
            unit, place = pa.array(row[at]), at - np.searchsorted(row, row[at])
            made = [pa.array(key), b.column("ord").take(unit), b.column("unit_id").take(unit), pa.array(place.astype(np.int32)), pa.array(df)]
            yield pa.RecordBatch.from_arrays(made, ["key", "ord", "unit_id", "place", "df"])

    first = listed.select("ord", "unit_id", "h").mapInArrow(count_units, fields).groupBy("key").agg(F.min(F.struct("ord", "unit_id", "place")).alias("f"), F.sum("df").alias("df"))
    known = first.filter((F.col("df") >= 2) & (F.col("df") <= 0.75 * n)).orderBy("f").select("key", F.col("df").cast("double").alias("df")).toArrow()
    size = known.num_rows
    none = spark.createDataFrame([], "chat_id string, unit_id string, vec array<double>"), spark.createDataFrame([], "query_id string, chat_id string, qvec array<double>")
    if n < 2 * k or size < 2 * k:
        listed.unpersist()
        return none
    key, d = known.column("key").to_numpy(), known.column("df").to_numpy()
    del known
    by = np.argsort(key).astype(np.int32)
    # hashes in order, the place of each, and the weight of each place
    places = spark.sparkContext.broadcast((key[by], by, np.maximum(0.1, np.log(1 + (n - d + 0.5) / (d + 0.5)))))
    del key, d, by

    def known_terms(h):
        """Which hashes are in the vocabulary, and the places of these."""
        keys, by, _ = places.value
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        has = keys[at] == h
        return has, by[at[has]]

    def look_up(batches):
        for b in batches:
            b = b.filter(b.column("some"))
            row, h, tf = _runs(b.column("h"))
            has, j = known_terms(h)
            row, x = row[has], (np.sqrt(tf[has]) * places.value[2][j]).astype(np.float32)
            many = np.bincount(row, minlength=b.num_rows)
            norm = np.sqrt(np.bincount(row, x.astype(float) ** 2, b.num_rows))
            upto = np.concatenate([[0], np.cumsum(many)])
            f = 0
            while f < b.num_rows:
                t = max(f + 1, int(np.searchsorted(upto, upto[f] + PACKED, side="right")) - 1)
                some = slice(upto[f], upto[t])
                packed = [pa.array([y.tobytes()], pa.binary()) for y in (many[f:t].astype(np.int32), j[some].astype(np.int32), x[some], norm[f:t])]
                names = [pa.ListArray.from_arrays(pa.array([0, t - f], pa.int32()), b.column(c).slice(f, t - f)) for c in ("chat_id", "unit_id")]
                yield pa.RecordBatch.from_arrays([*names, *packed], ["chat_id", "unit_id", "many", "j", "x", "norm"])
                f = t

    blocks = cut(listed.select("chat_id", "unit_id", "some", "h").mapInArrow(look_up, "chat_id array<string>, unit_id array<string>, many binary, j binary, x binary, norm binary"))
    listed.unpersist()
    narrow = blocks.select("many", "j", "x", "norm").coalesce(max(1, spark.sparkContext.defaultParallelism))

    def less(v, topics):
        """v less what it has of each topic, one after the other."""
        for t in topics:
            v = v - t * (t @ v)
        return v

    found: list[np.ndarray] = []
    with _batches_of(spark, PACKED_ROWS):
        for c in range(1, k + 1):
            v = np.sin(c * np.arange(1, size + 1))
            v /= np.linalg.norm(v)
            for step in range(steps + 1):
                # The rows less the topics found are the rows times one projection after the other, so rows meet one vector only.
                square, fresh = _pass(narrow, less(v, found[::-1]))
                fresh = less(fresh, found)
                # The last pass only tells whether the topic has any weight; an empty one ends the search.
                if step == steps or square < 1e-16 or np.linalg.norm(fresh) < 1e-8 * np.sqrt(square):
                    break
                v = fresh / np.linalg.norm(fresh)
            if np.sqrt(square) < 1e-6:
                break
            found.append(v)
    if not found:
        return none
    topics = len(found)
    sent = spark.sparkContext.broadcast(np.stack(found, 1))
    found.clear()

    def lists_of(y):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * topics, pa.int32()), pa.array(y.ravel()))

    def project(batches):
        for b in batches:
            for i, (row, j, x, size) in enumerate(_sparse(b)):
                y = np.stack([np.bincount(row, x * sent.value[j, t], len(size)) for t in range(topics)], 1) / size[:, None]
                norm = np.linalg.norm(y, axis=1, keepdims=True)
                y = np.where(norm > 1e-8, y / np.maximum(norm, 1e-30), y)
                yield pa.RecordBatch.from_arrays([b.column("chat_id")[i].values, b.column("unit_id")[i].values, lists_of(y)], ["chat_id", "unit_id", "vec"])

    def project_queries(batches):
        for b in batches:
            lists = b.column("h")
            has, j = known_terms(lists.flatten().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))[has]
            y = np.stack([np.bincount(row, sent.value[j, t], b.num_rows) for t in range(topics)], 1)
            norm = np.linalg.norm(y, axis=1)
            some = np.flatnonzero(norm >= 1e-8)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(some)) for c in ("query_id", "chat_id")), lists_of(y[some] / norm[some, None])], ["query_id", "chat_id", "qvec"])

    docs = blocks.mapInArrow(project, "chat_id string, unit_id string, vec array<double>")
    asked = queries.select("query_id", "chat_id", hashes(F.coalesce(terms(text), tx.no_strings())).alias("h"))
    return docs, asked.mapInArrow(project_queries, "query_id string, chat_id string, qvec array<double>")


#: Terms of units that are packed in one row, about, and such rows that a task gets at once.
PACKED, PACKED_ROWS = 250_000, 4


@contextmanager
def _batches_of(spark, rows: int):
    """Meanwhile Python gets so many rows at once: a task's packed rows in one batch took twice as long as some at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _runs(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, how often) of each run of equal values in each list."""
    h = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    begins = np.ones(len(h), bool)
    begins[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(begins)
    return row[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def _sparse(batch: pa.RecordBatch):
    """(row, column, value, length of each row) of sparse rows, empty ones counting as long as any: lists of one row each, or many rows packed."""
    if pa.types.is_list(batch.schema.field("j").type):
        lists, x = batch.column("j"), batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        yield row, lists.flatten().to_numpy(zero_copy_only=False), x, np.maximum(np.sqrt(np.bincount(row, x * x, batch.num_rows)), 1e-30)
        return
    read = lambda name, i, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
    for i in range(batch.num_rows):
        many = read("many", i, np.int32)
        yield np.repeat(np.arange(len(many)), many), read("j", i, np.int32), read("x", i, np.float32).astype(float), np.maximum(read("norm", i, float), 1e-30)


#: Numbers of a vector that are added up in one group.
SLICE = 131_072


def _pass(rows: DataFrame, v: np.ndarray) -> tuple[float, np.ndarray]:
    """(|u|^2, rows' u) with u = rows v.  Tasks' vectors are added up slice by slice in Spark, so the driver gets one."""
    sent = rows.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        v = sent.value
        total, square = np.zeros(len(v)), 0.0
        for b in batches:
            for row, j, x, size in _sparse(b):
                u = np.bincount(row, x * v[j], len(size)) / size
                total += np.bincount(j, x * (u / size)[row], len(v))
                square += float(u @ u)
        for s, f in enumerate(range(0, len(v), SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([square if s == 0 else 0.0]), pa.array([total[f : f + SLICE].tobytes()], pa.binary())], ["slice", "square", "total"])

    def add_up(group):
        total = 0.0
        for x in group.column("total"):
            total = total + np.frombuffer(x.as_py())
        return pa.table({"slice": group.column("slice").slice(0, 1), "square": pa.array([pc.sum(group.column("square")).as_py()]), "total": pa.array([total.tobytes()], pa.binary())})

    made = rows.mapInArrow(run, "slice int, square double, total binary").groupBy("slice").applyInArrow(add_up, "slice int, square double, total binary")
    square, fresh = 0.0, np.zeros(len(v))
    for r in made.collect():
        square += r.square
        fresh[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.total)
    sent.destroy()
    return square, fresh


#: Tasks a core that pairs are dealt to.
PAIR_TASKS = 4


def agreeing(vectors: DataFrame, queries: DataFrame, floor: float, digits: int) -> DataFrame:
    """(query_id, unit_id, agreement) of all pairs of one corpus whose rounded agreement is above floor.  Queries are sent to all.

    Every pair is told in the JVM, from columns of numbers, so a row of the result is made once and where it is wanted.
    """
    asked = cut(queries.select("query_id", "qvec"))
    width = asked.agg(F.max(F.size("qvec"))).first()[0] or 0
    tasks = PAIR_TASKS * max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    v = vectors.select("unit_id", *(F.col("vec")[i].alias(f"v{i}") for i in range(width))).repartition(tasks)
    q = asked.select("query_id", *(F.col("qvec")[i].alias(f"q{i}") for i in range(width)))
    dot = sum((F.col(f"v{i}") * F.col(f"q{i}") for i in range(width)), F.lit(0.0))
    # F.round goes through decimals, at several times the cost of all the rest
    rounded = F.floor(dot * 10**digits + 0.5) / 10**digits
    return v.crossJoin(F.broadcast(q)).select("query_id", "unit_id", rounded.alias("agreement")).filter(F.col("agreement") > floor)


# --- search in a conversation ------------------------------------------------------------------


def search_turns(messages: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Turns with the words as typed, oldest first, then turns with most of the words by BM25, the first ``limit`` if asked; with snippets and the exact total."""
    seen = tx.strip_own_block("text")
    seen = F.regexp_replace(seen, r"<!--[\s\S]*?-->|!\[[^\]]*\]\([^)]+\)|```(?:\w+)?", " ")
    seen = tx.squash(F.regexp_replace(tx.fold_width(seen), r"\*{1,3}|_{2,}", ""))
    # read and folded once: every further step would do it again, and each would plan all of them
    texts = cut(messages.select("chat_id", "turn", F.col("id").alias("message_id"), "role", seen.alias("text")).withColumn("folded", F.lower("text")))
    asked = queries.select("query_id", "chat_id", tx.squash(F.lower(tx.fold_width("query"))).alias("q")).filter(F.length("q") > 0)
    asked = cut(asked)
    found = cut(find_phrases(texts, asked, "folded", "turn", "q"))
    exact = found.join(asked, ["query_id", "chat_id"]).join(texts, ["chat_id", "turn"]).select("query_id", "chat_id", "turn", "message_id", "role", F.lit(True).alias("exact"), F.lit(0.0).alias("score"), tx.snippet(F.col("text"), F.col("at"), F.length("q")).alias("s"))
    from .index import build_index

    units = texts.select("chat_id", F.col("turn").cast("string").alias("unit_id"), "message_id", "role", "turn", F.col("turn").cast("long").alias("ord"), "text")
    hits = bm25(build_index(units).stored("turns"), asked.withColumnRenamed("q", "query"), words=False)
    words = F.filter(F.split("q", " "), lambda w: F.length(w) > 0)
    stem = lambda w: F.substr(w, F.lit(1), F.greatest(F.lit(2), F.length(w) - 1))
    beginnings = F.filter(F.transform(words, lambda w: F.position(stem(w), F.col("folded")) - 1), lambda p: p >= 0)
    # only turns that the words hit; those that hold them as typed are told already
    close = hits.select("query_id", "chat_id", "score", F.col("unit_id").cast("int").alias("turn")).join(found.select("query_id", "chat_id", "turn"), ["query_id", "chat_id", "turn"], "left_anti")
    close = close.join(asked, ["query_id", "chat_id"]).join(texts, ["chat_id", "turn"]).withColumn("places", beginnings).filter(F.size("places") >= F.ceil(F.size(words) * 0.6))
    close = close.select("query_id", "chat_id", "turn", "message_id", "role", F.lit(False).alias("exact"), "score", tx.snippet(F.col("text"), F.coalesce(F.array_min("places"), F.lit(0)), F.lit(0)).alias("s"))
    w = W.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), F.asc("turn"))
    total = F.count_if("exact").over(W.partitionBy("query_id"))
    out = exact.unionByName(close).withColumn("total", total).withColumn("rank", F.row_number().over(w))
    out = out if limit is None else out.filter(F.col("rank") <= limit)
    return out.select("query_id", "chat_id", "rank", "turn", "message_id", "role", "exact", "s.before", "s.match", "s.after", "total")


def locate_turns(messages: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, chat_id, turn, message_id) by message id, else the latest message that holds the text's first 40 compact characters."""
    m = messages.select("chat_id", F.col("id").alias("message_id"), "turn", tx.compact(tx.strip_own_block("text")).alias("packed"))
    by_id = items.join(m.select("chat_id", "message_id", "turn"), ["chat_id", "message_id"]).select("item_id", "chat_id", "turn", "message_id")
    rest = items.join(by_id.select("item_id"), "item_id", "left_anti").withColumn("probe", F.substring(tx.compact("text"), 1, 40)).filter(F.length("probe") >= 6)
    held = find_phrases(m, rest.withColumnRenamed("item_id", "query_id"), "packed", "message_id", "probe").withColumnRenamed("query_id", "item_id")
    near = held.join(m.select("chat_id", "message_id", "turn"), ["chat_id", "message_id"]).groupBy("item_id", "chat_id").agg(F.max("turn").alias("turn"), F.max_by("message_id", "turn").alias("message_id"))
    return by_id.unionByName(near)


def sentence_information(messages: DataFrame, sentences: Callable[[Column], Column], last: int = 4) -> DataFrame:
    """(chat_id, turn, place, s, info) of the sentences, cut by ``sentences`` out of the searchable text, of each chat's last messages: rarity of
    their distinct terms in the chat's messages, summed, over the root of their number; none without terms.

    A task reads its chats newest message first and holds the terms of a chat's last messages and their counts, no index and no join.
    """
    back = F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("turn")))
    read = messages.select("chat_id", "turn", "text", back.alias("back")).select("chat_id", "turn", "back", "text", F.when(F.col("back") <= last, tx.search_text("text")).alias("clean"))
    parts = F.coalesce(sentences(F.col("clean")), tx.no_strings())
    each = read.select("chat_id", "turn", "back", F.posexplode(F.concat(F.array("text"), parts)).alias("place", "s"))
    # the message itself stands at place 0 and before its sentences; the window has put a chat's rows together and in order
    cleaned = each.select("chat_id", "turn", "back", "place", F.when(F.col("place") > 0, F.col("s")).alias("s"), F.lower(tx.search_text("s")).alias("clean"))
    listed = cleaned.select("chat_id", "turn", "back", "place", "s", F.array_distinct(tx.terms_of("clean")).alias("terms"))
    schema = T.StructType([*(listed.schema[c] for c in ("chat_id", "turn")), T.StructField("place", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("info", T.DoubleType())])
    fields = to_arrow_schema(schema)

    def told(chat: str, said: list[tuple], n: int, often: dict[str, int]) -> list[tuple]:
        return [(chat, turn, place, s, sum(math.log((n + 1) / (often[t] + 1)) for t in terms) / math.sqrt(len(terms))) for turn, place, s, terms in said]

    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, said, n, often = None, [], 0, {}
        for b in batches:
            out = []
            for c, turn, r, place, s, terms in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != chat:
                    out.extend(told(chat, said, n, often))
                    chat, said, n, often = c, [], 0, {}
                if place:
                    if terms:
                        said.append((turn, place - 1, s, terms))
                        for t in terms:
                            often.setdefault(t, 0)
                    continue
                n += 1
                for t in terms:
                    if r <= last:
                        often[t] = often.get(t, 0) + 1
                    elif t in often:
                        often[t] += 1
            yield made(out)
        yield made(told(chat, said, n, often))

    return listed.mapInArrow(run, schema)


def recent_scene(messages: DataFrame, max_chars: int = 360, last: int = 4) -> DataFrame:
    """(chat_id, scene): the most informative sentences of the last messages, in their order, within a budget."""
    cut_at = lambda text: F.transform(F.split(text, r"(?<=[.!?。…\"”])(?U)\s+|\n+"), tx.trim)
    scored = sentence_information(messages, cut_at, last).filter((F.length("s") >= 8) & (tx.units("s") < max_chars))
    from .pack import first_fit

    # a chat's sentences are those of its last messages, so they fit into one row
    ranked = scored.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct((-F.round("info", 9)).alias("a"), (-F.col("turn")).alias("b"), "place", "s"))).alias("line"))
    took = first_fit(F.col("line"), lambda x: tx.units(x["s"]) + 1, max_chars)
    told = F.array_sort(F.transform(took, lambda x: F.struct((-x["b"]).alias("turn"), x["place"].alias("place"), x["s"].alias("s"))))
    return ranked.select("chat_id", told.alias("told")).filter(F.size("told") > 0).select("chat_id", F.array_join(F.transform("told", lambda x: x["s"]), " ").alias("scene"))


# --- baselines for evaluation ---------------------------------------------------------------------


def tfidf_cosine(ix: Index, queries: DataFrame, text: str = "query") -> DataFrame:
    """Cosine of (1 + ln tf) * (ln((n + 1) / (df + 1)) + 1) vectors."""
    weight = (1 + F.ln("tf")) * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    docs = ix.postings.join(ix.df, ["chat_id", "term"]).join(ix.stats, "chat_id").select("chat_id", "unit_id", "term", weight.alias("w"))
    size = docs.groupBy("chat_id", "unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    q = queries.select("query_id", "chat_id", F.explode(tx.terms(text)).alias("term")).groupBy("query_id", "chat_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    q = q.join(ix.df, ["chat_id", "term"], "left").join(ix.stats, "chat_id").withColumn("df", F.coalesce("df", F.lit(0))).select("query_id", "chat_id", "term", weight.alias("qw"))
    qsize = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qsize"))
    hit = q.join(docs, ["chat_id", "term"]).groupBy("query_id", "chat_id", "unit_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return hit.join(size, ["chat_id", "unit_id"]).join(qsize, "query_id").select("query_id", "chat_id", "unit_id", (F.col("dot") / (F.col("size") * F.col("qsize"))).alias("score"))


def expanded(ix: Index, queries: DataFrame, hits: DataFrame, seeds: int = 3, words: int = 5, weight: float = 0.3) -> DataFrame:
    """Pseudo-relevance feedback: frequent but rare words of the best hits ask again at a low weight."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ord"), F.asc("unit_id"))
    best = hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= seeds).select("query_id", "chat_id", "unit_id")
    own = query_rows(queries).select("query_id", "term")
    more = best.join(ix.postings, ["chat_id", "unit_id"]).groupBy("query_id", "chat_id", "term").agg(F.sum("tf").alias("c")).join(ix.df, ["chat_id", "term"]).join(ix.stats, "chat_id")
    more = more.filter((F.col("c") >= 2) & (F.col("df") <= 0.05 * F.col("n"))).join(own, ["query_id", "term"], "left_anti")
    few = more.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("c"), F.asc("df"), F.asc("term")))).filter(F.col("r") <= words)
    again = few.groupBy("query_id", "chat_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("query"))
    second = bm25(ix, again).select("query_id", "chat_id", "unit_id", "ord", (F.col("score") * weight).alias("score"))
    return hits.select("query_id", "chat_id", "unit_id", "ord", "score").unionByName(second).groupBy("query_id", "chat_id", "unit_id", "ord").agg(F.sum("score").alias("score"))


def blended(lexical: DataFrame, semantic: DataFrame, share: float = 0.5) -> DataFrame:
    """Linear fusion of two scores, each divided by its query's best."""
    def scaled(df, name):
        return df.select("query_id", "unit_id", (F.col("score") / F.max("score").over(W.partitionBy("query_id"))).alias(name))

    both = scaled(lexical, "l").join(scaled(semantic, "s"), ["query_id", "unit_id"], "full")
    return both.select("query_id", "unit_id", (share * F.coalesce("l", F.lit(0.0)) + (1 - share) * F.coalesce("s", F.lit(0.0))).alias("score"))
