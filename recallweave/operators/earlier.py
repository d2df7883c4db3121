"""The earlier retrieval rules: borrowed anchors, the strict gate, keyword notes, the trailing block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from . import rank
from .index import Index, anchor_words, earlier_terms, lasting_words
from .pack import first_fit, stop_at_overflow
from .segment import earlier_search_text

_CUES = "|".join(vocab.RECALL_CUES)


def context_query(ix: Index, messages: DataFrame, drafts: DataFrame) -> DataFrame:
    """drafts (query_id, chat_id, draft) with ``query``: short ones borrow up to three rare words that the last user and assistant messages share."""
    d = drafts.withColumn("clean", F.right(earlier_search_text("draft"), F.lit(4000)))
    own = anchor_words("clean")
    enough = (F.length("clean") > 80) | (F.size(F.filter(own, lambda w: F.length(w) >= 3)) >= 3)
    w = W.partitionBy("chat_id").orderBy(F.desc("turn"))
    four = messages.filter(F.col("role").isin("user", "assistant")).withColumn("r", F.row_number().over(w)).filter("r <= 4")
    last = four.groupBy("chat_id").agg(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("u"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"))
    j = d.join(last, "chat_id", "left").withColumn("own", own)
    shared = F.filter(F.array_intersect(anchor_words(earlier_search_text("u")), anchor_words(earlier_search_text("a"))), lambda x: (F.length(x) >= 3) & ~F.array_contains("own", x))
    each = j.filter(~enough & F.col("u").isNotNull() & F.col("a").isNotNull()).select("query_id", "chat_id", F.posexplode(shared).alias("place", "term")).join(ix.df, ["chat_id", "term"]).join(ix.stats, "chat_id")
    each = each.filter(F.col("df") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.2)))
    few = each.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).filter("r <= 3").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias("more"))
    return d.join(few, "query_id", "left").withColumn("query", F.concat_ws(" ", "clean", "more")).drop("clean", "more")


def choose(ix: Index, drafts: DataFrame, budget: int = 1200) -> DataFrame:
    """(query_id, place, unit_id, line): at most two hits for drafts that recall something, name a rare known name and two more content words."""
    d = drafts.withColumn("anchors", anchor_words("draft"))
    cue = F.lower("draft").rlike(_CUES)
    named = d.select("query_id", "chat_id", F.explode("anchors").alias("term")).join(ix.entities.select("chat_id", F.lower("name").alias("term")), ["chat_id", "term"], "left_semi")
    exact = named.join(ix.postings, ["chat_id", "term"]).select("query_id", "chat_id", "term", "unit_id")
    near = named.withColumn("p3", F.substring("term", 1, 3)).join(lasting_words(ix.postings), ["chat_id", "p3"]).filter(F.startswith("word", "term")).select("query_id", "chat_id", "term", "unit_id")
    count = exact.unionByName(near).groupBy("query_id", "chat_id", "term").agg(F.count_distinct("unit_id").alias("c")).join(ix.stats, "chat_id").filter(F.col("c") <= F.greatest(F.lit(2), F.floor(F.col("n") * 0.2)))
    rare = count.groupBy("query_id").agg(F.collect_set("term").alias("rare"))
    names = ix.entities.groupBy("chat_id").agg(F.collect_set(F.lower("name")).alias("names"))
    ok = d.filter(cue & (F.size("anchors") >= 2)).join(ix.stats.filter("n >= 25"), "chat_id").join(rare, "query_id").join(names, "chat_id", "left")
    hits = rank.earlier_bm25(ix, ok.select("query_id", "chat_id", F.col("draft").alias("query"))).join(ok.select("query_id", "anchors", "rare", F.coalesce("names", tx.no_strings()).alias("names")), "query_id")
    mine = F.array_intersect("anchors", "matched")
    content = F.filter(mine, lambda x: ~F.array_contains("names", x) & (F.length(x) >= 3) & ~x.rlike(_CUES))
    hits = hits.filter(F.arrays_overlap(mine, F.col("rare")) & (F.size(content) >= 2) & (F.col("score") >= 2.5)).join(ix.units.select("chat_id", "unit_id", "message_id", "role", "text"), ["chat_id", "unit_id"])
    hits = hits.withColumn("top", F.max("score").over(W.partitionBy("query_id"))).filter(F.col("score") >= 0.65 * F.col("top"))
    line = F.concat(F.lit("[과거 "), F.when(F.col("role") == "user", "사용자").otherwise("AI"), F.lit(" 대화 · 메시지 "), "message_id", F.lit("]\n"), "text", F.lit("\n"))
    best = rank.by_message(hits).withColumn("line", line)
    g = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "unit_id", "line"))).alias("all"))
    took = F.slice(first_fit(F.col("all"), lambda x: tx.units(x["line"]), budget), 1, 2)
    return g.select("query_id", F.posexplode(took).alias("place", "x")).select("query_id", (F.col("place") + 1).alias("place"), "x.unit_id", "x.line")


def match_lore(lore: DataFrame, queries: DataFrame, budget: Column | int = 650) -> DataFrame:
    """(query_id, place, lore_id, line, score): always-on notes and notes with a keyword in the query, 12 a keyword, first fit."""
    n = lore.filter(F.coalesce("enabled", F.lit(True)) & (F.length(F.coalesce("content", F.lit(""))) > 0))
    q = queries.select("query_id", "chat_id", F.lower(tx.fold_width("query")).alias("q"), earlier_terms("query").alias("t"))
    always = F.coalesce("alwaysInclude", F.lit(False))
    hit = F.filter(F.coalesce("keywords", tx.no_strings()), lambda k: (F.length(tx.normalized_keyword(k)) > 0) & (F.contains(F.col("q"), F.lower(tx.fold_width(k))) | F.array_contains("t", F.lower(tx.fold_width(k)))))
    m = q.join(n, "chat_id").withColumn("score", F.when(always, F.lit(100)).otherwise(12 * F.size(hit))).filter("score > 0")
    line = F.concat(F.lit('{"type":"lore","id":"'), F.col("id"), F.lit('","title":"'), tx.trim(F.coalesce("title", F.lit("로어"))), F.lit('","content":"'), tx.trim(F.col("content")), F.lit('"}'))
    m = m.withColumn("line", line)
    g = m.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ins", F.col("id").alias("lore_id"), "line", "score"))).alias("all"))
    took = first_fit(F.col("all"), lambda x: tx.units(x["line"]), budget)
    return g.select("query_id", F.posexplode(took).alias("place", "x")).select("query_id", (F.col("place") + 1).alias("place"), "x.lore_id", "x.line", "x.score")


def context_with_lore(ix: Index, lore: DataFrame, queries: DataFrame, budget: int = 2000) -> DataFrame:
    """(query_id, type, place, line): notes in 45 % of the budget, then past units until the first that does not fit."""
    notes = match_lore(lore, queries, int(budget * 0.45))
    spent = notes.groupBy("query_id").agg(F.sum(tx.units("line")).alias("spent"))
    hits = rank.top(rank.earlier_bm25(ix, queries), 100).join(ix.units.select("chat_id", "unit_id", "message_id", "text"), ["chat_id", "unit_id"]).join(spent, "query_id", "left")
    line = F.to_json(F.struct(F.lit("memory").alias("type"), "message_id", F.col("text").alias("content")))
    hits = hits.withColumn("line", line).withColumn("cost", tx.units("line") + F.when(F.col("rank") == 1, F.coalesce("spent", F.lit(0))).otherwise(0))
    past = stop_at_overflow(hits, ["query_id"], [F.asc("rank")], F.col("cost"), budget)
    return notes.select("query_id", F.lit("lore").alias("type"), "place", "line").unionByName(past.select("query_id", F.lit("memory").alias("type"), F.col("rank").alias("place"), "line"))


def strip_tail(text: Column | str) -> Column:
    start, end = vocab.TAIL_MARKS
    return F.regexp_replace(F.regexp_replace(tx.strip_own_block(text, vocab.MARKERS[1:]), rf"\n*{start}\b[\s\S]*?{end}", ""), r"(?U)\s+\z", "")


def compose_tail(text: Column | str, lines: Column) -> Column:
    """A message with the block of lines behind it; composing again replaces the block."""
    start, end = vocab.TAIL_MARKS
    clean = strip_tail(text)
    return F.when(F.size(lines) == 0, clean).otherwise(F.concat(clean, F.lit(f"\n\n{start}\n[과거 대화 참고. 확정된 요약이 아닌 당시 기록이다.]\n"), F.array_join(lines, "\n"), F.lit(end)))


def carrier(messages: DataFrame) -> DataFrame:
    """(chat_id, id, problem): the reply before the newest user message, or why there is none."""
    m = messages.filter(F.col("role").isin("user", "assistant"))
    newest = m.groupBy("chat_id").agg(F.max_by(F.struct("role", F.lower("status").alias("status")), "turn").alias("n"))
    done = (F.col("n.role") == "assistant") & (F.col("n.status").isNull() | F.col("n.status").isin("end", "complete", "completed", ""))
    edge = m.groupBy("chat_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("edge"))
    target = m.join(edge, "chat_id").filter((F.col("role") == "assistant") & (F.col("turn") < F.col("edge"))).groupBy("chat_id").agg(F.max_by("id", "turn").alias("id"))
    j = newest.join(target, "chat_id", "left")
    return j.select("chat_id", F.when(done, F.col("id")).alias("id"), F.when(~done, "the reply is not complete").when(F.col("id").isNull(), "there is no earlier reply").alias("problem"))
