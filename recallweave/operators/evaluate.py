"""Evaluation: hit rates, thresholds, replay, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grams import find_phrases


def hit_rates(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """One row: hit@k for each k, mean reciprocal rank, and how many queries.  ranked: query_id, unit_id, rank; gold: query_id, unit_id."""
    first = ranked.join(gold, ["query_id", "unit_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    each = queries.select("query_id").distinct().join(first, "query_id", "left")
    return each.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("first") <= k).alias(f"hit_{k}") for k in ks), (F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))) / F.count(F.lit(1))).alias("mrr"))


def selection_metrics(best: DataFrame, cases: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: top-1, top-3, abstention and accuracy.  best: case_id, id, score, rank; cases: case_id, gold (null: nothing fits)."""
    b = best if threshold is None else best.filter(F.col("score") >= threshold)
    got = cases.join(b, "case_id", "left").groupBy("case_id", "gold").agg(F.min(F.when(F.col("id") == F.col("gold"), F.col("rank"))).alias("place"), F.count("id").alias("n"))
    pos, neg = F.col("gold").isNotNull(), F.col("gold").isNull()
    return got.agg(F.count_if(pos).alias("positive"), F.count_if(neg).alias("negative"), F.count_if(pos & (F.col("place") == 1)).alias("top1"), F.count_if(pos & (F.col("place") <= 3)).alias("top3"),
                   F.count_if(neg & (F.col("n") == 0)).alias("abstained"), (F.count_if((pos & (F.col("place") == 1)) | (neg & (F.col("n") == 0))) / F.count(F.lit(1))).alias("accuracy"))


def choose_threshold(best: DataFrame, cases: DataFrame) -> DataFrame:
    """(threshold, accuracy): the score that, as a floor, makes most cases right; the larger on ties.

    best: case_id, id, score of each case's first choice.  Counting right answers above and abstentions below each
    score needs one sorted pass, not a try of every score on every case.
    """
    top = cases.join(best, "case_id", "left")
    whole = cases.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold").isNull()).alias("base"))
    gain = F.when(F.col("gold").isNotNull() & (F.col("id") == F.col("gold")), 1).when(F.col("gold").isNull() & F.col("id").isNotNull(), -1).otherwise(0)
    r = top.withColumn("gain", gain).filter("score is not null").groupBy((-F.col("score")).alias("down")).agg(F.sum("gain").alias("gain"))
    run = running(r, "down", "gain").crossJoin(F.broadcast(whole)).withColumn("right", F.col("base") + F.col("run"))
    return run.orderBy(F.desc("right"), F.asc("down")).limit(1).select((-F.col("down")).alias("threshold"), (F.col("right") / F.col("n")).alias("accuracy"))


#: Stretches of the value range that running sums are made over side by side.
STRETCHES = 1000


def running(rows: DataFrame, value: str, amount: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows (keys, value distinct in each key, amount) with ``run``, the sum of amounts up to and with each value.

    The value range of a key is cut into stretches; sums run inside each, and over the stretches' totals, of which a key has STRETCHES.
    """
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    wide = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    cut = joined.withColumn("_s", F.coalesce(F.floor((F.col(value) - F.col("_lo")) / wide * STRETCHES), F.lit(0)).cast("int")).drop("_lo", "_hi")
    total = cut.groupBy(*keys, "_s").agg(F.sum(amount).alias("_t"))
    one = [F.col(k) for k in keys] or [F.lit(0)]
    before = total.withColumn("_before", F.coalesce(F.sum("_t").over(W.partitionBy(*one).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(*keys, "_s", "_before")
    inside = F.sum(amount).over(W.partitionBy(*keys, "_s").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    return cut.withColumn("_in", inside).join(F.broadcast(before) if not keys else before, [*keys, "_s"]).withColumn("run", F.col("_before") + F.col("_in")).drop("_s", "_before", "_in")


def replay(messages: DataFrame, keep_out: int = 20) -> DataFrame:
    """(chat_id, query_id, query, turn): each user message but the newest ``keep_out`` messages, to be asked as of its turn."""
    n = F.max("turn").over(W.partitionBy("chat_id"))
    return messages.withColumn("n", n).filter((F.col("role") == "user") & (F.col("turn") <= F.col("n") - keep_out)).select("chat_id", F.concat_ws("@", "chat_id", F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query"), "turn", (F.col("turn") - 1).alias("max_ord"))


def replay_stats(asked: DataFrame, hits: DataFrame, applied: DataFrame) -> DataFrame:
    """One row: drafts, drafts with candidates, drafts with context, characters added.  applied: query_id, added."""
    j = asked.select("query_id").join(hits.select("query_id").distinct().withColumn("hit", F.lit(1)), "query_id", "left").join(applied, "query_id", "left")
    return j.agg(F.count(F.lit(1)).alias("evaluated"), F.count("hit").alias("with_candidates"), F.count_if(F.col("added") > 0).alias("context_applied"), F.sum(F.coalesce("added", F.lit(0))).alias("characters"))


def gold_from_evidence(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, unit_id): units that hold a wanted phrase.  evidence: query_id, chat_id, contains."""
    return find_phrases(units, evidence, phrase="contains").select("query_id", "unit_id").distinct()


def latency(samples: DataFrame, ms: str = "ms") -> DataFrame:
    """(median, p95): the elements at floor((n - 1) / 2) and floor(0.95 (n - 1)) of the sorted samples."""
    keys = ("engine",) if "engine" in samples.columns else ()
    counted = running(samples.groupBy(*keys, ms).agg(F.count(F.lit(1)).alias("_c")), ms, "_c", keys)
    whole = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = counted.join(whole, list(keys)) if keys else counted.crossJoin(F.broadcast(whole))
    at = lambda place: F.min(F.when(F.col("run") > place, F.col(ms)))  # noqa: E731  the first value whose run goes beyond a 0-based place
    return r.groupBy(*keys).agg(at(F.floor((F.col("_n") - 1) / 2)).alias("median"), at(F.floor(0.95 * (F.col("_n") - 1))).alias("p95"))
