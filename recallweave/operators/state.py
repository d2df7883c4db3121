"""State: append-only logs and the views over them, counters, branches, model scores, housekeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from .memory import latest
from .names import longest_inside


def valid_overrides(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) edits: keyword 1 to 40 characters, fact 1 to 300, a known domain, each where it is set."""
    ok = (
        (F.col("keyword").isNull() | F.length(tx.trim(F.col("keyword"))).between(1, 40)) & (F.col("fact").isNull() | F.length(tx.trim(F.col("fact"))).between(1, 300))
        & (F.col("domain").isNull() | F.col("domain").isin(*vocab.DOMAINS)) & F.col("fact_id").isNotNull()
    )
    return edits.filter(ok), edits.filter(~ok)


def toggled(log: DataFrame, keys: list[str]) -> DataFrame:
    """Keys toggled an odd number of times."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select(*keys)


def pins_view(log: DataFrame) -> DataFrame:
    """(chat_id, messageId, turn, text, ins): pins by their last edit; an empty text or a deleted mark removes one."""
    last = latest(log, ["chat_id", "messageId"])
    first = log.groupBy("chat_id", "messageId").agg(F.min("seq").alias("ins"))
    live = last.filter(~F.coalesce("deleted", F.lit(False)) & (F.length(tx.trim(F.coalesce("text", F.lit("")))) > 0)).join(first, ["chat_id", "messageId"])
    return live.select("chat_id", "messageId", "turn", F.substring(tx.trim(F.col("text")), 1, 300).alias("text"), "ins")


def reset(tables: dict[str, DataFrame], chat_id: str) -> dict[str, DataFrame]:
    """Each table without a chat's rows."""
    return {k: t.filter(F.col("chat_id") != chat_id) for k, t in tables.items()}


def memory_cards_view(folded: DataFrame) -> DataFrame:
    """Keyword cards by last turn."""
    note = F.struct("place", "id", "fact", "kind", "turn", "reason")
    pick = lambda slot: F.array_sort(F.collect_list(F.when(F.col("slot") == slot, note)))
    return folded.groupBy("chat_id", "card", "keyword", "domain").agg(pick("current").alias("current"), pick("history").alias("history"), F.max("turn").alias("last_turn"), F.min("id").alias("first_id")).orderBy("chat_id", F.desc("last_turn"), "card").drop("first_id")


def keyword_review(facts: DataFrame, dropped: DataFrame, most: int = 50) -> DataFrame:
    """(chat_id, keyword): distinct keywords that were not dropped."""
    k = facts.select("chat_id", "keyword").distinct().join(dropped.select("chat_id", "keyword").distinct(), ["chat_id", "keyword"], "left_anti")
    return k.withColumn("r", F.row_number().over(W.partitionBy("chat_id").orderBy("keyword"))).filter(F.col("r") <= most).drop("r")


def deck(cards: DataFrame, domain: str | None = None, words: str = "") -> DataFrame:
    """Cards of a domain whose keyword or notes hold the words."""
    out = cards if domain is None else cards.filter(F.col("domain") == domain)
    q = words.strip().lower()
    held = F.contains(F.lower("keyword"), F.lit(q)) | F.exists(F.concat("current", "history"), lambda n: F.contains(F.lower(n["fact"]), F.lit(q)))
    return out.filter(held) if q else out


# --- counters ---------------------------------------------------------------------------------------


def send_counters(sends: DataFrame) -> DataFrame:
    """(day, room, sends, injected, total): by day, and by day and room; sends: ts, room, injected.  ``total`` marks rows over all rooms."""
    day = sends.select(F.to_date("ts").alias("day"), "room", F.coalesce("injected", F.lit(0)).alias("injected"))
    both = day.groupingSets([[F.col("day")], [F.col("day"), F.col("room")]], F.col("day"), F.col("room"))
    return both.agg(F.count(F.lit(1)).alias("sends"), F.sum("injected").alias("injected"), (F.grouping("room") == 1).alias("total"))


def chat_stats(messages: DataFrame, facts: DataFrame, nodes: DataFrame, read_to: DataFrame, sends: DataFrame | None = None) -> DataFrame:
    """(chat_id, turns, replies, processed, pending, facts, nodes[, sends_today]); read_to: chat_id, last_turn of the extraction."""
    m = messages.groupBy("chat_id").agg(F.max("turn").alias("turns"), F.count_if(F.col("role") == "assistant").alias("replies"))
    done = messages.join(read_to, "chat_id").filter((F.col("role") == "assistant") & (F.col("turn") <= F.col("last_turn"))).groupBy("chat_id").agg(F.count(F.lit(1)).alias("processed"))
    out = m.join(done, "chat_id", "left").join(facts.groupBy("chat_id").agg(F.count(F.lit(1)).alias("facts")), "chat_id", "left").join(nodes.groupBy("chat_id").agg(F.count(F.lit(1)).alias("nodes")), "chat_id", "left")
    out = out.fillna(0, ["processed", "facts", "nodes"]).withColumn("pending", F.col("replies") - F.col("processed"))
    if sends is not None:
        today = sends.filter(F.to_date("ts") == F.current_date()).groupBy(F.col("room").alias("chat_id")).agg(F.count(F.lit(1)).alias("sends_today"))
        out = out.join(today, "chat_id", "left").fillna(0, ["sends_today"])
    return out


def storage_usage(rows: DataFrame) -> DataFrame:
    """(chat_id, bytes, last_active) of key-value rows (chat_id, key, value, at)."""
    return rows.groupBy("chat_id").agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"), F.max("at").alias("last_active"))


def nth_last_reply(messages: DataFrame, n: int = 4) -> DataFrame:
    """(chat_id, id, turn): the n-th reply from the end of each chat; nothing for chats with fewer."""
    order = F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("turn")))
    return messages.filter("role = 'assistant'").withColumn("_r", order).filter(F.col("_r") == n).select("chat_id", "id", "turn")


def collect_garbage(rows: DataFrame) -> DataFrame:
    """Key-value rows without empty values."""
    return rows.filter(F.col("value").isNotNull() & ~F.trim("value").isin("", "null"))


def applied_history(log: DataFrame, most: int = 15) -> DataFrame:
    """The newest applied contexts of each chat."""
    return log.withColumn("r", F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("at"), F.desc("seq")))).filter(F.col("r") <= most).drop("r")


# --- branches and rewritten history ------------------------------------------------------------------


def shared_prefixes(messages: DataFrame, least: int = 4) -> DataFrame:
    """(chat_id, origin, shared): the other chat with the longest common beginning, of at least ``least`` messages.

    Chats meet on the hash of their whole beginning at each length, so only true common beginnings meet, and a group of
    branches is described by its least member instead of by pairs.
    """
    text = tx.trim(tx.strip_own_block("text"))
    w = W.partitionBy("chat_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    m = messages.select("chat_id", "turn", F.sha2(text, 256).alias("h"), (F.length(text) == 0).alias("blank"))
    m = m.withColumn("blanks", F.sum(F.col("blank").cast("int")).over(w)).filter("blanks = 0")
    # A beginning is the combination of its messages' hashes, each with its turn: two running 64-bit words, whatever the length.
    rolling = F.struct(*(F.bit_xor(F.xxhash64(F.lit(k), "turn", "h")).over(w).alias(f"x{k}") for k in (1, 2)))
    p = m.withColumn("prefix", rolling).select("chat_id", "turn", "prefix").filter(F.col("turn") >= least)
    g = p.groupBy("turn", "prefix").agg(F.min("chat_id").alias("lo"), F.max("chat_id").alias("hi")).filter("lo <> hi")
    j = p.join(g, ["turn", "prefix"]).withColumn("origin", F.when(F.col("chat_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    return j.groupBy("chat_id").agg(F.max_by("origin", "turn").alias("origin"), F.max("turn").alias("shared"))


def carry_branch(branches: DataFrame, facts: DataFrame, pins: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, pins) of each new chat copied from its origin up to the shared turn; a pin takes the new chat's own message id."""
    b = branches.select("chat_id", "origin", "shared")
    has = facts.select("chat_id").distinct().unionByName(pins.select("chat_id").distinct()).distinct()
    b = b.join(has, "chat_id", "left_anti")
    f = facts.withColumnRenamed("chat_id", "origin").join(b, "origin").filter(F.col("turn") <= F.col("shared")).select(facts.columns)
    own = messages.select("chat_id", "turn", F.col("id").alias("own_id"))
    p = pins.withColumnRenamed("chat_id", "origin").join(b, "origin").filter(F.col("turn") <= F.col("shared")).join(own, ["chat_id", "turn"], "left").withColumn("messageId", F.coalesce("own_id", "messageId")).select(pins.columns)
    return f, p


def surviving_facts(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """Facts whose source message still exists."""
    return facts.join(messages.select("chat_id", F.col("id").alias("sourceId")), ["chat_id", "sourceId"], "left_semi")


def resume_point(facts: DataFrame, messages: DataFrame, read_to: DataFrame) -> DataFrame:
    """(chat_id, turn): where reading goes on: after the last message read, or after the last source that survives if that one is gone."""
    m = messages.filter("role = 'assistant'").select("chat_id", "turn", "id")
    at = read_to.join(m.withColumnRenamed("id", "lastId"), ["chat_id", "lastId"], "left").select("chat_id", "turn")
    src = facts.select("chat_id", F.col("sourceId").alias("id")).distinct().join(m, ["chat_id", "id"]).groupBy("chat_id").agg(F.max("turn").alias("src"))
    return at.join(src, "chat_id", "left").select("chat_id", F.coalesce("turn", "src", F.lit(0)).alias("turn"))


# --- models -------------------------------------------------------------------------------------------


def merge_scores(fresh: DataFrame, previous: DataFrame, listed: DataFrame) -> DataFrame:
    """Scores of listed models: this round's where it came, else the previous row."""
    cols = [c for c in previous.columns if c != "id"]
    f, p = fresh.alias("f"), previous.alias("p")
    both = f.join(p, F.col("f.id") == F.col("p.id"), "full").select(F.coalesce("f.id", "p.id").alias("id"), *(F.when(F.col("f.id").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in cols))
    return both.join(listed.select("id"), "id", "left_semi")


def model_for_text(texts: DataFrame, models: DataFrame, text: str = "text") -> DataFrame:
    """texts with ``model``: the id whose longest alias stands in the text and is not followed by a digit; the least id on ties."""
    a = models.select(F.col("id").alias("model"), F.explode(tx.aliases_for("id")).alias("name"))
    return _named_in(texts, text, a.select("name", F.lit("").alias("tie"), "model"), no_digit=True)


def _named_in(texts: DataFrame, text: str, names: DataFrame, no_digit: bool) -> DataFrame:
    """texts with the ``model`` of the longest name (names: name, tie, model) that a text holds, the least by tie and model; each text is told
    in its row, so none is shuffled."""
    best = longest_inside(tx.norm_name(text), names, no_digit)
    return texts.withColumn("_best", best).withColumn("model", F.col("_best.model")).drop("_best")


def model_for_name(texts: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """texts with ``model`` of the longest remembered name (names: name, id) that they hold."""
    k = names.select(tx.norm_name("name").alias("name"), F.col("id").alias("model"))
    return _named_in(texts, text, k.select("name", F.col("name").alias("tie"), "model"), no_digit=False)


def expand_memo(drafts: DataFrame, memos: DataFrame) -> DataFrame:
    """drafts with a trigger at their end replaced by the memo's text; a room's own memo beats the general one (chat_id null)."""
    m = memos.select(F.col("chat_id").alias("_c"), tx.trim(F.col("trigger")).alias("_k"), F.col("text").alias("_m")).filter(F.length("_k") > 0)
    asked = drafts.select(F.col("chat_id").alias("_chat"), F.col("draft").alias("_draft")).distinct()
    hit = asked.join(m, F.endswith("_draft", "_k") & (F.col("_c").isNull() | (F.col("_c") == F.col("_chat"))))
    best = hit.groupBy("_chat", "_draft").agg(F.min_by(F.struct("_k", "_m"), F.struct((-F.length("_k")).alias("n"), F.col("_c").isNull().alias("g"), "_k", "_m")).alias("b"))
    fresh = best.select("_chat", "_draft", F.concat(F.substr("_draft", F.lit(1), F.length("_draft") - F.length("b._k")), "b._m").alias("_d"))
    same = F.col("chat_id").eqNullSafe(F.col("_chat")) & (F.col("draft") == F.col("_draft"))
    return drafts.join(fresh, same, "left").withColumn("draft", F.coalesce("_d", "draft")).select(drafts.columns)


# --- backups --------------------------------------------------------------------------------------------

#: Keys that a backup leaves out.
VOLATILE = r"^(?:snap:|cache:|job:|draft:|modelScores|updateInfo|lastSeen)"


def backup(rows: DataFrame, app: str, volatile: str = VOLATILE) -> DataFrame:
    return rows.filter(~F.col("key").rlike(volatile)).select(F.lit(app).alias("app"), "key", "value")


def restore(current: DataFrame, saved: DataFrame, app: str, volatile: str = VOLATILE) -> DataFrame:
    """current key-value rows with a backup's rows put over them; rows of another app or of volatile keys are ignored."""
    good = saved.filter((F.col("app") == app) & ~F.col("key").rlike(volatile)).dropDuplicates(["key"]).select("key", "value")
    return current.join(good.select("key"), "key", "left_anti").select("key", "value").unionByName(good)

