"""Passage retrieval without a language model: the draft decides, the latest reply supports, people link, age fills in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from . import rank
from .index import Index
from .lineage import cut


def age_boost(age: Column) -> Column:
    """What a passage gains for being likely forgotten."""
    return 1 + 0.3 * (1 - F.exp(-age / 30))


def _best(col: str = "score") -> Column:
    return F.max(col).over(W.partitionBy("query_id"))


def _top(hits: DataFrame, k: int) -> DataFrame:
    return rank.top(hits, k).drop("rank")


def scores(ix: Index, names: DataFrame, queries: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """(query_id, chat_id, unit_id, score) before the gate.  queries: query_id, chat_id, draft, context; names: chat_id, name.

    All steps are joins and windows over the hits of all drafts at once.
    """
    p = ix.units.select("chat_id", "unit_id", "turn", "ord", "speakers", "text")
    asked = queries.select("query_id", "chat_id", F.col("draft").alias("query"))
    weak = (F.size("strong") == 0) & (F.size("matched") < 3)
    own = _top(rank.bm25(ix, asked), 60).select("query_id", "chat_id", "unit_id", (F.col("score") * F.when(weak, 0.5).otherwise(1.0)).alias("score"))
    context = _top(rank.bm25(ix, queries.filter(F.length(tx.trim(F.coalesce("context", F.lit("")))) > 0).select("query_id", "chat_id", F.col("context").alias("query"))), 40)
    best = own.groupBy("query_id").agg(F.max("score").alias("best"))
    context = context.withColumn("top", _best()).join(best, "query_id", "left").select("query_id", "chat_id", "unit_id", (0.3 * F.coalesce(F.nullif("best", F.lit(0.0)), F.col("top")) * F.col("score") / F.col("top")).alias("score"))
    s = own.unionByName(context).groupBy("query_id", "chat_id", "unit_id").agg(F.sum("score").alias("score"))
    if semantic is not None:
        meaning = semantic.join(ix.units.select("chat_id", "unit_id"), ["chat_id", "unit_id"], "left_semi").select("query_id", "chat_id", "unit_id", "score")
        fused = rank.fuse([rank.rank0(s), rank.rank0(meaning, limit=60)])
        scale = s.groupBy("query_id").agg(F.greatest(F.lit(1.0), F.max("score")).alias("scale"))
        chats = queries.select("query_id", "chat_id")
        asked_by = semantic.select("query_id").distinct()
        mixed = fused.join(asked_by, "query_id", "left_semi").join(scale, "query_id", "left").join(chats, "query_id").select("query_id", "chat_id", "unit_id", (F.coalesce("scale", F.lit(1.0)) * F.col("fused") / F.max("fused").over(W.partitionBy("query_id"))).alias("score"))
        s = s.join(asked_by, "query_id", "left_anti").unionByName(mixed)
    drafted = queries.join(names, "chat_id").filter(tx.keyword_appears("draft", "name")).select("query_id", "name")
    listed = drafted.groupBy("query_id").agg(F.collect_set("name").alias("asked"))
    s = s.join(p, ["chat_id", "unit_id"]).join(listed, "query_id", "left").withColumn("asked", F.coalesce("asked", tx.no_strings()))
    factor = F.when(F.arrays_overlap("speakers", "asked"), 1.5).when(F.exists("asked", lambda n: tx.keyword_appears("text", n)), 1.3).otherwise(1.0)
    s = s.select("query_id", "chat_id", "unit_id", "turn", "ord", "text", (F.col("score") * factor).alias("score"))
    s = cut(s)
    # People named by the best three matches and not by the draft pull their passages in.
    seeds = s.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "ord"))).filter("r <= 3")
    seed_best = seeds.groupBy("query_id").agg(F.max("score").alias("seed_best"))
    related = seeds.join(names, "chat_id").filter(tx.keyword_appears("text", "name")).groupBy("query_id", "chat_id", "name").agg(F.min("r").alias("r")).join(drafted, ["query_id", "name"], "left_anti")
    related = related.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("r", "name"))).filter("k <= 3")
    more = rank.bm25(ix, related.select(F.concat_ws("\u0001", "query_id", "name").alias("query_id"), "chat_id", F.col("name").alias("query")))
    more = _top(more, 8).withColumn("top", _best()).withColumn("query_id", F.split("query_id", "\u0001")[0]).join(seed_best, "query_id")
    more = more.select("query_id", "chat_id", "unit_id", (0.2 * F.col("seed_best") * F.col("score") / F.col("top")).alias("score"))
    s = s.select("query_id", "chat_id", "unit_id", "score").unionByName(more).groupBy("query_id", "chat_id", "unit_id").agg(F.sum("score").alias("score"))
    last = p.groupBy("chat_id").agg(F.max_by("turn", "ord").alias("last"))
    s = s.join(p.select("chat_id", "unit_id", "turn"), ["chat_id", "unit_id"]).join(last, "chat_id")
    return s.select("query_id", "chat_id", "unit_id", (F.col("score") * age_boost(F.col("last") - F.col("turn"))).alias("score"))


PICKED = "query_id string, place int, unit_id string, turn int, line string, why string"


def passage_search(ix: Index, names: DataFrame, queries: DataFrame, semantic: DataFrame | None = None, per_turn: int = 2, most: int = 10) -> DataFrame:
    """PICKED rows.  queries: query_id, chat_id, draft, context, max_turn (null: none), budget.

    The gate compares with the best score of all passages, live ones included; picking under the budget and adding the
    newest word of the people in old picks is a fold over a draft's candidates (100 at most, by the top lists above).
    """
    s = cut(scores(ix, names, queries, semantic))
    p = ix.units.select("chat_id", "unit_id", "turn", "ord", "scene", "text")
    mark = F.concat(F.lit("["), F.col("turn").cast("string"), F.when(F.length("scene") > 0, F.concat(F.lit(" "), tx.clean_line("scene"))).otherwise(""), F.lit("] "))
    lines = p.withColumn("line", F.concat(mark, tx.clean_line("text"))).withColumn("size", tx.units("line"))
    c = s.withColumn("top", _best()).filter(F.col("score") >= 0.35 * F.col("top")).join(queries.select("query_id", "max_turn", "budget"), "query_id").join(lines, ["chat_id", "unit_id"])
    c = c.filter((F.col("max_turn").isNull() | (F.col("turn") < F.col("max_turn"))) & (F.col("budget") >= 60))
    # For each candidate, its first two people's newest passage outside the live window.
    people = c.select("query_id", "chat_id", "unit_id", "turn", "text", "max_turn").join(names, "chat_id").filter(tx.keyword_appears("text", "name"))
    people = people.withColumn("k", F.row_number().over(W.partitionBy("query_id", "unit_id").orderBy("name"))).filter("k <= 2").select("query_id", "chat_id", "unit_id", "name", "k", "max_turn")
    said = lines.join(names, "chat_id").filter(tx.keyword_appears("text", "name")).select("chat_id", "name", F.col("unit_id").alias("l_unit"), F.col("turn").alias("l_turn"), F.col("ord").alias("l_ord"), F.col("line").alias("l_line"), F.col("size").alias("l_size"))
    newest = people.join(said, ["chat_id", "name"]).filter(F.col("max_turn").isNull() | (F.col("l_turn") < F.col("max_turn")))
    newest = newest.groupBy("query_id", "unit_id", "k").agg(F.max_by(F.struct("l_unit", "l_turn", "l_line", "l_size"), "l_ord").alias("l")).groupBy("query_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("k", "l"))).alias("newest"))
    last = p.groupBy("chat_id").agg(F.max_by("turn", "ord").alias("last"))
    c = c.join(newest, ["query_id", "unit_id"], "left").join(last, "chat_id").select("query_id", "unit_id", "turn", "ord", "text", "line", "size", "score", "budget", "last", "newest")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left, got, seen = int(pdf.budget.iloc[0]), [], {}
        for r in pdf.sort_values(["score", "ord"], ascending=[False, True]).itertuples():
            same = seen.setdefault(r.turn, [])
            if len(got) >= most:
                break
            if len(same) >= per_turn or any(r.text[:30] in t or t[:30] in r.text for t in same) or r.size + 1 > left:
                continue
            got.append((r.unit_id, int(r.turn), r.line, ""))
            same.append(r.text)
            left -= r.size + 1
        by_unit = {r.unit_id: r for r in pdf.itertuples()}
        for unit, turn, *_ in list(got):
            r = by_unit[unit]
            if r.last - turn < 20 or r.newest is None:
                continue
            for x in r.newest:
                x = x["l"]
                if x["l_turn"] - turn >= 10 and x["l_size"] + 1 <= left and all(x["l_unit"] != g[0] for g in got):
                    got.append((x["l_unit"], int(x["l_turn"]), x["l_line"], "최신 상태"))
                    left -= x["l_size"] + 1
        got.sort(key=lambda g: g[1])
        return pd.DataFrame([(pdf.query_id.iloc[0], i + 1, *g) for i, g in enumerate(got)], columns=["query_id", "place", "unit_id", "turn", "line", "why"])

    return c.groupBy("query_id").applyInPandas(pick, PICKED)


