"""Context assembly: what goes in front of each draft, under one character budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from . import lore as lo
from . import passages as ps
from . import rank
from .cards import memory_cards
from .index import Index, build_index
from .lineage import cut
from .memory import effective_facts, fold_memory, pinned_cards
from .segment import passage_names, passages, units

LONGEST_TURN = 9999


def frame_units(turn: Column | int = LONGEST_TURN) -> Column:
    return tx.units(tx.header(turn)) + tx.units(tx.footer())


def context_budget(draft: Column | str, limit: int = vocab.MESSAGE_LIMIT) -> Column:
    """Characters left for memory beside a draft."""
    return F.greatest(F.lit(0), F.lit(limit) - tx.units(F.coalesce(tx.col(draft), F.lit(""))) - frame_units())


def recent_context(messages: DataFrame) -> DataFrame:
    """(chat_id, n, recent_context, last_two): length, the head of the last reply, and the last two texts of each chat."""
    g = messages.groupBy("chat_id").agg(F.max("turn").alias("n"), F.max_by(tx.strip_own_block("text"), F.when(F.col("role") == "assistant", F.col("turn"))).alias("reply"))
    w = W.partitionBy("chat_id").orderBy(F.desc("turn"))
    two = messages.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").groupBy("chat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", tx.strip_own_block("text").alias("t")))), lambda x: x["t"]), "\n").alias("last_two"))
    return g.join(two, "chat_id").select("chat_id", "n", F.substring(F.coalesce("reply", F.lit("")), 1, 600).alias("recent_context"), "last_two")


def compose(draft: Column | str, lines: Column, turn: Column | int = 0, limit: int = vocab.MESSAGE_LIMIT) -> Column:
    """The block of lines and the draft, or the bare draft without lines or beyond the limit; blank lines (merged cards) do not show."""
    d = tx.col(draft)
    shown = F.filter(lines, lambda x: F.length(x) > 0)
    block = F.concat(tx.header(turn), F.array_join(shown, "\n"), tx.footer())
    return F.when((F.size(shown) > 0) & (tx.units(block) + tx.units(d) <= limit), F.concat(block, d)).otherwise(d)


@dataclass(frozen=True)
class Excerpts:
    """How many excerpts of past messages, how long, and from what score on: heads of messages first, then matching units."""

    heads: int = 4
    head_chars: int = 220
    head_room: int = 120
    head_score: float | None = 1.8
    most: int = 12
    unit_chars: int = 200
    unit_room: int = 80
    unit_score: float | None = 1.0
    share: float = 0.2
    floor: float = 0.6
    least: int = 20


#: The earlier rules: strong terms only, JSON lines.
EARLIER_EXCERPTS = Excerpts(heads=3, head_chars=600, head_score=None, most=8, unit_chars=260, unit_room=120, unit_score=None, share=0.35, floor=0.0, least=60)
EXCERPT_LEAD = "과거대화｜"


def matched_units(ix: Index, messages: DataFrame, queries: DataFrame, earlier: bool = False) -> DataFrame:
    """(query_id, place, kind, message_id, unit_id, text, line) of excerpts of past messages: heads of the best messages, then matching units.

    queries: query_id, chat_id, query, budget[, max_ord].  A line costs its frame and its excerpt, so what still fits is the
    budget left less the frame; an excerpt is cut to that.  The fold sees at most the 60 best units of a draft.
    """
    rule = EARLIER_EXCERPTS if earlier else Excerpts()
    hits = rank.earlier_bm25(ix, queries) if earlier else rank.bm25(ix, queries)
    best = rank.top(hits, 60).join(ix.units.select("chat_id", "unit_id", "message_id", "text"), ["chat_id", "unit_id"])
    heads = messages.select("chat_id", F.col("id").alias("message_id"), tx.search_text("text").alias("head"))
    by_message = F.row_number().over(W.partitionBy("query_id", "message_id").orderBy("rank"))
    c = best.join(heads, ["chat_id", "message_id"], "left").withColumn("nth", by_message).withColumn("top", F.max("score").over(W.partitionBy("query_id")))
    strong = F.size("strong") > 0
    reaches = lambda least: F.lit(False) if least is None else F.col("score") >= least
    head_ok = (F.col("nth") == 1) & (F.length(F.coalesce("head", F.lit(""))) > 0) & (strong | reaches(rule.head_score))
    unit_ok = (F.col("score") >= F.greatest(F.lit(rule.floor), rule.share * F.col("top"))) & (strong | reaches(rule.unit_score) | F.lit(not earlier) & (F.size("matched") > 0))
    shown = (lambda x: tx.clean_line(x)) if not earlier else (lambda x: F.col(x))
    wanted = F.array(
        F.when(head_ok, F.struct(F.lit(0).alias("part"), "rank", F.lit("message_start").alias("kind"), "message_id", "unit_id", shown("head").alias("source"), F.lit(rule.head_chars).alias("chars"))),
        F.when(unit_ok, F.struct(F.lit(1).alias("part"), "rank", F.lit("matched_unit").alias("kind"), "message_id", "unit_id", shown("text").alias("source"), F.lit(rule.unit_chars).alias("chars"))),
    )
    asked = c.select("query_id", F.explode(F.array_compact(wanted)).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("wanted")).join(queries.select("query_id", F.col("budget").cast("int").alias("budget")), "query_id")

    def line(x: Column, excerpt: Column) -> Column:
        if not earlier:
            return F.concat(F.lit(EXCERPT_LEAD), excerpt)
        return F.to_json(F.struct(x["message_id"].alias("message_id"), x["kind"].alias("kind"), excerpt.alias("excerpt")))

    kinds = "array<struct<kind: string, message_id: string, unit_id: string, text: string, line: string>>"

    def take(acc: Column, x: Column) -> Column:
        head = x["part"] == 0
        opens = F.size(acc["out"]) < F.when(head, rule.heads).otherwise(rule.most)
        separator = F.when(F.size(acc["out"]) > 0, 1).otherwise(0)
        frame = F.length(line(x, x["source"])) - F.length(x["source"]) + separator  # escapes of the source included
        room = F.least(F.length(x["source"]), x["chars"], acc["left"] - frame)
        fits = opens & (acc["left"] >= F.when(head, rule.head_room).otherwise(rule.unit_room)) & (acc["left"] - frame >= rule.least) & (room > 0)
        text = F.when(room == F.length(x["source"]), x["source"]).otherwise(F.concat(F.substr(x["source"], F.lit(1), room - 1), F.lit("…")))
        core = F.rtrim(text, F.lit("…"))
        told = F.exists(acc["out"], lambda o: (o["message_id"] == x["message_id"]) & F.contains(o["text"], core))
        made = F.struct(x["kind"].alias("kind"), x["message_id"].alias("message_id"), x["unit_id"].alias("unit_id"), text.alias("text"), line(x, text).alias("line"))
        good = fits & ~told
        return F.struct(F.when(good, acc["left"] - F.length(made["line"]) - separator).otherwise(acc["left"]).alias("left"), F.when(good, F.array_append(acc["out"], made)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.col("budget").alias("left"), F.array().cast(kinds).alias("out"))
    out = asked.select("query_id", F.posexplode(F.aggregate("wanted", start, take, lambda acc: acc["out"])).alias("n", "x"))
    return out.select("query_id", (F.col("n") + 1).alias("place"), "x.kind", "x.message_id", "x.unit_id", "x.text", "x.line")


def pack_memory(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """(query_id, room, left, items): user note, board and cards of each draft, packed in order; cards of one mark share a line.

    queries: query_id, draft, budget, user_note, overview; cards: query_id, place, id, title, content, turn, who, why.
    An item is (type, sort, line, title, why); a merged card has an empty line.
    """
    room = F.greatest(F.lit(0), F.col("budget") - frame_units() - tx.units("draft"))
    q = queries.withColumn("room", room)
    note = tx.trim(F.coalesce("user_note", F.lit("")))
    note_line = F.when(F.length(note) > 0, tx.labelled_line("유저노트", None, note))
    q = q.withColumn("note", F.when(tx.units(note_line) <= F.least(F.lit(vocab.NOTE_BUDGET), F.col("room")), note_line))
    q = q.withColumn("left", F.col("room") - F.coalesce(tx.units("note"), F.lit(0)))
    board = F.array_join(F.filter(F.transform(F.split(F.coalesce("overview", F.lit("")), "\n"), tx.clean_line), lambda x: F.length(x) > 0), " / ")
    board_line = F.when(F.length(board) > 0, F.concat(F.lit("[현재 상황] "), board))
    cost = tx.units(board_line) + F.when(F.col("note").isNotNull(), 1).otherwise(0)
    q = q.withColumn("board", F.when(cost <= F.least(F.floor(F.col("room") / 3), F.col("left")), board_line))
    q = q.withColumn("left", F.col("left") - F.coalesce(tx.units("board") + F.when(F.col("note").isNotNull(), 1).otherwise(0), F.lit(0)))
    mark = F.when(F.col("turn") > 0, tx.memory_mark("turn", "who")).otherwise("")
    body, line = tx.memory_body("title", "content"), tx.memory_line("title", "content", "turn", "who")
    item = F.struct("place", mark.alias("mark"), body.alias("body"), line.alias("line"), tx.units(line).alias("n"), (tx.units(body) + 3).alias("m"), F.when(F.col("turn") > 0, F.col("turn")).otherwise(1 << 30).alias("turn"), F.coalesce("title", F.lit("")).alias("title"), "why")
    c = cards.filter(F.length(F.coalesce("content", F.lit(""))) > 0).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("cards"))
    q = q.join(c, "query_id", "left")
    has_lead = (F.col("note").isNotNull() | F.col("board").isNotNull()).cast("int")
    took_type = "array<struct<place: int, mark: string, line: string, turn: int, title: string, why: string>>"
    start = F.struct(F.col("left").cast("long").alias("left"), F.array().cast(took_type).alias("took"))

    def step(acc: Column, x: Column) -> Column:
        host = F.exists(acc["took"], lambda t: (F.length(x["mark"]) > 0) & (t["mark"] == x["mark"]) & (F.length(t["line"]) > 0))
        price = F.when(host, x["m"]).otherwise(x["n"] + F.when((F.size(acc["took"]) > 0) | (has_lead > 0), 1).otherwise(0))
        fresh = F.struct(x["place"].alias("place"), x["mark"].alias("mark"), F.when(host, "").otherwise(x["line"]).alias("line"), x["turn"].alias("turn"), x["title"].alias("title"), x["why"].alias("why"))
        joined = F.transform(acc["took"], lambda t: F.struct(t["place"].alias("place"), t["mark"].alias("mark"), F.when(host & (t["mark"] == x["mark"]) & (F.length(t["line"]) > 0), F.concat(t["line"], F.lit(" / "), x["body"])).otherwise(t["line"]).alias("line"), t["turn"].alias("turn"), t["title"].alias("title"), t["why"].alias("why")))
        fits = price <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - price).otherwise(acc["left"]).alias("left"), F.when(fits, F.array_append(joined, fresh)).otherwise(acc["took"]).alias("took"))

    cast_cards = F.transform(F.col("cards"), lambda x: F.struct(x["place"].cast("int").alias("place"), x["mark"].alias("mark"), x["body"].alias("body"), x["line"].alias("line"), x["n"].alias("n"), x["m"].alias("m"), x["turn"].cast("int").alias("turn"), x["title"].alias("title"), x["why"].alias("why")))
    q = q.withColumn("folded", F.when(F.col("cards").isNotNull(), F.aggregate(cast_cards, start, step)).otherwise(start))
    memory = F.transform(F.array_sort(F.transform(F.col("folded.took"), lambda t: F.struct(t["turn"].alias("turn"), t["place"].alias("place"), t["line"].alias("line"), t["title"].alias("title"), t["why"].alias("why")))), lambda t: F.struct(F.lit("summary").alias("type"), t["line"].alias("line"), t["title"].alias("title"), t["why"].alias("why")))
    lead = F.array_compact(F.array(
        F.when(F.col("note").isNotNull(), F.struct(F.lit("user_note").alias("type"), F.col("note").alias("line"), F.lit("").alias("title"), F.lit("").alias("why"))),
        F.when(F.col("board").isNotNull(), F.struct(F.lit("overview").alias("type"), F.col("board").alias("line"), F.lit("현재 상황").alias("title"), F.lit("항상").alias("why")))))
    return q.select("query_id", "room", F.col("folded.left").cast("int").alias("left"), F.concat(lead, memory).alias("items"))


def prepare_context(messages: DataFrame, queries: DataFrame, *, facts: DataFrame | None = None, overrides: DataFrame | None = None, dropped: DataFrame | None = None, decisions: DataFrame | None = None,
                    lore: DataFrame | None = None, pins: DataFrame | None = None, pinned_keywords: DataFrame | None = None, boards: DataFrame | None = None, notes: DataFrame | None = None, inferred: DataFrame | None = None,
                    semantic_lore: DataFrame | None = None, semantic_passages: DataFrame | None = None, limit: int = vocab.MESSAGE_LIMIT) -> DataFrame:
    """(query_id, chat_id, turn, items, prompt) for each draft (query_id, chat_id, draft): all rankers over all drafts in one plan.

    With facts, cards come from memory; without, passages of the conversation stand in.  The last message is the live window.
    """
    q = queries.select("query_id", "chat_id", F.coalesce("draft", F.lit("")).alias("draft")).join(recent_context(messages), "chat_id", "left").fillna({"n": 0, "recent_context": "", "last_two": ""})
    # Drafts, facts, cards and packed items are short tables; each is cut off so that the next plan starts small.
    q = cut(q.withColumn("cutoff", F.greatest(F.lit(1), F.col("n") - 1)).withColumn("recent_text", F.col("last_two")))
    older = messages.join(messages.groupBy("chat_id").agg((F.max("turn") - 1).alias("_c")), "chat_id").filter("turn < greatest(1, _c)").drop("_c")
    spark = messages.sparkSession
    cards = spark.createDataFrame([], "query_id string, place int, id string, title string, content string, turn int, who array<string>, why string")
    live = None
    if facts is not None:
        o = overrides if overrides is not None else spark.createDataFrame([], "chat_id string, fact_id string, seq long, keyword string, fact string, domain string, enabled boolean, pinned boolean, deleted boolean")
        d = dropped if dropped is not None else spark.createDataFrame([], "chat_id string, keyword string")
        live = cut(effective_facts(facts, o, d))
        made = cut(memory_cards(live, q, decisions, None if inferred is None else _topics(live, q, inferred)))
        shown = made.select("query_id", F.col("place"), "id", "title", "content", "turn", "who", "why")
        p = pins if pins is not None else spark.createDataFrame([], "chat_id string, messageId string, turn int, text string, ins long")
        k = pinned_keywords if pinned_keywords is not None else spark.createDataFrame([], "chat_id string, keyword string")
        fixed = pinned_cards(live, p, k, fold_memory(live.filter(F.coalesce("enabled", F.lit(True))), decisions)).join(q.select("query_id", "chat_id"), "chat_id")
        fixed = fixed.select("query_id", (F.col("place") - 100_000).alias("place"), "id", "title", "content", "turn", "who", "why")
        cards = fixed.unionByName(shown.join(fixed.select("query_id", "id"), ["query_id", "id"], "left_anti"))
    q = q.withColumn("budget", F.lit(limit))
    q = q.join(boards.filter(F.coalesce("enabled", F.lit(True))).select("chat_id", F.col("text").alias("overview")), "chat_id", "left") if boards is not None else q.withColumn("overview", F.lit(None).cast("string"))
    q = q.join(notes.select("chat_id", F.col("note").alias("user_note")), "chat_id", "left") if notes is not None else q.withColumn("user_note", F.lit(None).cast("string"))
    packed = cut(pack_memory(q, cut(cards)).join(q.select("query_id", "chat_id", "draft", "n", "recent_context"), "query_id"))
    if lore is not None:
        asked = packed.select("query_id", "chat_id", "draft", "recent_context", F.col("n").alias("turn"), "left")
        room = F.least(F.lit(vocab.LORE_BUDGET), F.floor(F.col("_left") * vocab.LORE_SHARE).cast("int"))
        chosen = cut(_lore_with_budget(lore, asked, live, semantic_lore, room))
        g = chosen.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line", "title", "why"))), lambda x: F.struct(F.lit("lore").alias("type"), x["line"].alias("line"), x["title"].alias("title"), x["why"].alias("why"))).alias("l"), F.sum(F.col("units") + 1).alias("spent"))
        packed = packed.join(g, "query_id", "left").withColumn("items", F.when(F.col("l").isNotNull(), F.concat("items", "l")).otherwise(F.col("items"))).withColumn("left", F.greatest(F.lit(0), F.col("left") - F.coalesce("spent", F.lit(0)))).drop("l", "spent")
        packed = cut(packed)
    if facts is None:
        pix = cut(passages(messages))
        names = cut(passage_names(pix))
        asked = packed.select("query_id", "chat_id", "draft", F.col("recent_context").alias("context"), F.greatest(F.lit(1), F.col("n") - 1).alias("max_turn"), F.col("left").alias("budget"))
        got = cut(ps.passage_search(build_index(pix), names, asked, semantic_passages))
        g = got.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line", F.concat(F.lit("대화 "), F.col("turn").cast("string")).alias("title"), "why"))), lambda x: F.struct(F.lit("passage").alias("type"), x["line"].alias("line"), x["title"].alias("title"), x["why"].alias("why"))).alias("p"))
    else:
        ix = build_index(units(older))
        asked = packed.select("query_id", "chat_id", F.concat_ws(" ", "draft", "recent_context").alias("query"), F.col("left").alias("budget"))
        got = matched_units(ix, older, asked)
        g = got.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line", "message_id"))), lambda x: F.struct(F.lit("message").alias("type"), x["line"].alias("line"), x["message_id"].alias("title"), F.lit("").alias("why"))).alias("p"))
    packed = packed.join(g, "query_id", "left").withColumn("items", F.when(F.col("p").isNotNull(), F.concat("items", "p")).otherwise(F.col("items"))).drop("p")
    lines = F.transform("items", lambda x: x["line"])
    return packed.select("query_id", "chat_id", F.col("n").alias("turn"), "items", compose("draft", lines, F.col("n"), limit).alias("prompt"))


def _topics(facts: DataFrame, q: DataFrame, inferred: DataFrame) -> DataFrame:
    from .cards import topics

    return topics(facts, q, inferred)


def _lore_with_budget(lore: DataFrame, asked: DataFrame, facts: DataFrame | None, semantic: DataFrame | None, room: Column) -> DataFrame:
    """Notes under a budget that differs by draft: selected at the largest budget's order, packed by each draft's own."""
    picked = lo.select_lore(lore, asked.select("query_id", "chat_id", "draft", "recent_context", "turn"), facts, semantic, budget=1 << 30)
    from .pack import first_fit

    g = picked.join(asked.select("query_id", F.col("left").alias("_left")), "query_id").groupBy("query_id", "_left").agg(F.array_sort(F.collect_list(F.struct("place", "lore_id", "title", "line", "why", "units"))).alias("all"))
    took = first_fit(F.col("all"), lambda x: x["units"], room, separator=1)
    return g.select("query_id", F.explode(took).alias("x")).select("query_id", "x.*")


def selected_for_send(items: DataFrame, excluded: DataFrame, draft: str = "draft") -> DataFrame:
    """items (query_id, draft, type, line) without those the user excluded (query_id, draft, type, line) for the same draft, white space aside."""
    same = lambda x: tx.squash(F.coalesce(F.col(x), F.lit("")))
    out = excluded.select("query_id", same(draft).alias("_d"), "type", "line").distinct()
    return items.withColumn("_d", same(draft)).join(out, ["query_id", "_d", "type", "line"], "left_anti").drop("_d")


def switched(queries: DataFrame, rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts to work on, drafts of rooms switched off, which pass unchanged).  rooms: chat_id, auto (null: on)."""
    j = queries.join(rooms.select("chat_id", "auto"), "chat_id", "left")
    on = F.coalesce("auto", F.lit(True))
    return j.filter(on).drop("auto"), j.filter(~on).drop("auto")


def user_notes(rooms: DataFrame, default: str | None, auto_default: bool = True) -> DataFrame:
    """(chat_id, note): the room's own note, else the default one unless that is off; nothing where the room's switch is off."""
    own = F.nullif(tx.trim(F.coalesce("note", F.lit(""))), F.lit(""))
    fall = F.lit(default if auto_default else None)
    return rooms.select("chat_id", F.when(F.coalesce("note_enabled", F.lit(True)), F.coalesce(own, fall, F.lit(""))).otherwise("").alias("note"))
