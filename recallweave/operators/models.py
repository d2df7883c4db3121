"""Injected language models: prompts that fit a quota, hosts tried in order within a deadline, and the slots that models fill."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Where the part of a prompt begins that may be shortened, and what stands where it was.
WINDOW, LEFT_OUT = "[대화]\n", "\n[중간 생략]\n"
#: (answer, quota of the host or 0) of a prompt; raises where the host cannot answer.
Host = Callable[[str], tuple[str, int]]


def fit_to_quota(prompt: Column | str, quota: Column | int, measure: Callable[[Column], Column], marker: str = WINDOW, tries: int = 4) -> Column:
    """A prompt whose measure is at most 0.9 of the quota, by leaving out more and more of the middle behind the marker; after
    ``tries`` cuts it is what it is.  Prompts without a marker, and hosts without a quota (0), are left alone."""
    quota = F.lit(quota) if isinstance(quota, int) else quota

    def shorter(text: Column) -> Column:
        at = F.locate(marker, text) + len(marker) - 1
        keep = F.floor((F.length(text) - at) * quota * 0.85 / measure(text))
        head, tail = F.floor(keep * 0.6).cast("int"), F.floor(keep * 0.4).cast("int")
        return F.concat(F.substr(text, F.lit(1), at + head), F.lit(LEFT_OUT), F.when(tail > 0, F.right(text, tail)).otherwise(""))

    fits = lambda text: (F.coalesce(quota, F.lit(0)) <= 0) | (F.locate(marker, text) == 0) | (measure(text) <= quota * 0.9)
    return F.aggregate(F.sequence(F.lit(1), F.lit(tries)), tx.col(prompt), lambda text, _: F.when(fits(text), text).otherwise(shorter(text)))


def ask(prompts: DataFrame, hosts: Sequence[Host], seconds: float = 60.0, prompt: str = "prompt") -> DataFrame:
    """prompts with raw, quota and error: the first host's answer that comes within the deadline, and the host's quota (0: unknown).

    A task asks for one prompt at a time, so a deadline bounds it; a prompt that no host answers has a null raw and the last error.
    """

    def one(pool: ThreadPoolExecutor, text: str) -> tuple[str | None, int, str | None]:
        error = "no host"
        for host in hosts:
            try:
                answer, quota = pool.submit(host, text).result(timeout=seconds)
                return answer.strip(), int(quota or 0), None
            except Late:
                error = "late"
            except Exception as e:  # a host's own failure: the next one is tried
                error = str(e) or type(e).__name__
        return None, 0, error

    def run(values: pd.Series) -> pd.DataFrame:
        pool = ThreadPoolExecutor(max_workers=max(1, len(hosts)))
        try:
            return pd.DataFrame([one(pool, x) for x in values], columns=["raw", "quota", "error"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return prompts.withColumn("_a", F.pandas_udf(run, "raw string, quota long, error string")(prompt)).select(*prompts.columns, "_a.raw", "_a.quota", "_a.error")


def overview_prompts(inputs: DataFrame, instruction: str) -> DataFrame:
    """(chat_id, full, prompt) from ``memory.overview_input``: the board so far and the facts, oldest first."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "id", "fact"))), lambda x: F.concat(F.lit("["), x["turn"].cast("string"), F.lit("] "), x["fact"]))
    g = inputs.groupBy("chat_id", "full", "previous").agg(F.array_join(lines, "\n").alias("told"), F.max("turn").alias("last_turn"))
    board = F.when(F.length("previous") > 0, F.concat(F.lit("\n[지금]\n"), "previous")).otherwise("")
    return g.select("chat_id", "full", "last_turn", F.concat(F.lit(instruction), board, F.lit("\n" + WINDOW), "told").alias("prompt"))


def rewritten_boards(boards: DataFrame, answers: DataFrame) -> DataFrame:
    """boards (chat_id, text, enabled, edited, lastTurn, updates) with each answered one rewritten; an empty answer changes nothing."""
    a = answers.select("chat_id", F.col("last_turn").alias("_last"), tx.parse_overview("raw").alias("_text")).filter(F.length("_text") > 0)
    j = boards.join(a, "chat_id", "full")
    new = F.col("_text").isNotNull()
    return j.select("chat_id", F.coalesce("_text", "text").alias("text"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.when(new, False).otherwise(F.coalesce("edited", F.lit(False))).alias("edited"),
                    F.coalesce("_last", "lastTurn").alias("lastTurn"), (F.coalesce("updates", F.lit(0)) + new.cast("int")).alias("updates"))


def edited_boards(boards: DataFrame, edits: DataFrame) -> DataFrame:
    """boards with a user's edits (chat_id, text, enabled) marked as such, so that a rewrite keeps them in view."""
    e = edits.select("chat_id", F.substring(tx.trim(F.col("text")), 1, 450).alias("_text"), F.col("enabled").alias("_on"))
    j = boards.join(e, "chat_id", "full")
    touched = F.col("_text").isNotNull()
    return j.select("chat_id", F.coalesce("_text", "text").alias("text"), F.coalesce("_on", "enabled", F.lit(True)).alias("enabled"), (touched | F.coalesce("edited", F.lit(False))).alias("edited"), F.coalesce("lastTurn", F.lit(0)).alias("lastTurn"), F.coalesce("updates", F.lit(0)).alias("updates"))


def intent_prompts(queries: DataFrame, keywords: DataFrame, instruction: str) -> DataFrame:
    """(query_id, chat_id, prompt): a draft and the keywords it may mean (``cards.intent_keywords``), newest first."""
    k = keywords.groupBy("chat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("o"), "keyword"))), lambda x: x["keyword"]), ", ").alias("names"))
    return queries.join(k, "chat_id").select("query_id", "chat_id", F.concat(F.lit(instruction + "\n"), "names", F.lit("\n" + WINDOW), "draft").alias("prompt"))


def meant_keywords(answers: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, keyword): the offered keywords that an answer (query_id, chat_id, raw) names."""
    return answers.filter("raw is not null").join(keywords.select("chat_id", "keyword").distinct(), "chat_id").filter(F.contains("raw", "keyword")).select("query_id", "keyword")
