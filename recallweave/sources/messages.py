"""Reading messages: tables, exports, increments; and writing them."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.lineage import cut, files_of

ROLES = ("user", "assistant")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files gave fewer; large tables stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def coerce(rows: DataFrame) -> DataFrame:
    """Older shapes in one: id or _id; text, content or message; ids and texts as strings.  Rows say their place in ``seq``: Spark keeps none."""
    have = set(rows.columns)
    if "seq" not in have:
        raise ValueError("rows need seq, their place in the source")
    first = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in have), F.lit(None).cast("string"))
    return rows.select(first("chat_id").alias("chat_id"), first("id", "_id").alias("id"), F.coalesce(first("role"), F.lit("assistant")).alias("role"), first("text", "content", "message").alias("text"), first("status").alias("status"), "seq")


def ingest(rows: DataFrame, include_system: bool = False, most: int | None = None) -> DataFrame:
    """Messages in order with 1-based turns: roles kept, empty ones dropped, the first of each id; at most ``most`` a chat if asked.

    rows: chat_id, seq (place in the source, oldest first), id, role, text.
    """
    roles = (*ROLES, "system") if include_system else ROLES
    kept = rows.filter(F.col("role").isin(*roles) & F.col("text").rlike(tx.NOT_SPACE) & F.col("id").isNotNull())
    # dealt by chat once: telling ids apart and numbering both stay in place
    first = kept.repartition("chat_id").groupBy("chat_id", "id").agg(F.min_by(F.struct("role", "text", "seq"), "seq").alias("m")).select("chat_id", "id", "m.*")
    turn = F.row_number().over(W.partitionBy("chat_id").orderBy("seq", "id"))
    numbered = first.withColumn("turn", turn).select("chat_id", "turn", "id", "role", "text")
    return numbered if most is None else numbered.filter(F.col("turn") <= most)


def from_conversations(conversations: DataFrame, include_system: bool = False) -> DataFrame:
    """The driver's conversations as messages: id is ``conv_id:turn``."""
    rows = conversations.select(F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").alias("seq"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "role", "text")
    return ingest(rows, include_system)


def newest_first(pages: DataFrame) -> DataFrame:
    """Rows of paged reads (chat_id, page, pos, ...), newest first, as rows oldest first; repeated pages count once."""
    first = pages.groupBy("chat_id", "id").agg(F.min(F.struct("page", "pos")).alias("at"), F.first("role").alias("role"), F.first("text").alias("text"))
    seq = F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("at.page"), F.desc("at.pos")))
    return first.select("chat_id", seq.alias("seq"), "id", "role", "text")


def append_new(messages: DataFrame, tail: DataFrame) -> DataFrame:
    """messages and the rows of a re-read tail whose id is new, in the tail's order, with turns that follow on."""
    fresh = tail.filter(F.col("role").isin(*ROLES)).join(messages.select("chat_id", "id"), ["chat_id", "id"], "left_anti").dropDuplicates(["chat_id", "id"])
    last = messages.groupBy("chat_id").agg(F.max("turn").alias("last"))
    numbered = fresh.withColumn("r", F.row_number().over(W.partitionBy("chat_id").orderBy("seq"))).join(last, "chat_id", "left")
    return messages.select("chat_id", "turn", "id", "role", "text").unionByName(numbered.select("chat_id", (F.coalesce("last", F.lit(0)) + F.col("r")).alias("turn"), "id", "role", "text"))


#: How a plain-text export marks its blocks: separator, header of a reply, header of the user's text.
RULE, HEADS = r"(?m)^─{8,}[^\S\n]*$", {"AI": "assistant", "유저": "user"}


def parse_export(texts: DataFrame, rule: str = RULE, heads: dict[str, str] = HEADS, drop_comments: bool = False) -> DataFrame:
    """Messages of plain-text exports (chat_id, text): blocks between rules, headed by a role; blank ones go; ids export-0001 on."""
    source = F.regexp_replace("text", r"(?m)^# .*\n?", "") if drop_comments else F.col("text")
    names = "|".join(heads)
    part = texts.select("chat_id", F.posexplode(F.split(source, rule)).alias("n", "part"))
    found = part.select("chat_id", "n", F.regexp_extract("part", rf"(?m)^\[({names})\][^\S\n]*\n([\s\S]*)\z", 1).alias("head"), tx.trim(F.regexp_extract("part", rf"(?m)^\[({names})\][^\S\n]*\n([\s\S]*)\z", 2)).alias("text"))
    found = found.filter((F.length("head") > 0) & (F.length("text") > 0))
    turn = F.row_number().over(W.partitionBy("chat_id").orderBy("n"))
    role = F.create_map(*(F.lit(x) for kv in heads.items() for x in kv))[F.col("head")]
    return found.select("chat_id", turn.alias("turn"), F.concat(F.lit("export-"), F.lpad(turn.cast("string"), 4, "0")).alias("id"), role.alias("role"), F.lit("end").alias("status"), "text")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return parse_export(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chat_id"), F.col("value").alias("text")))


#: Folders of a snapshot: chats are dealt to them by hash, so that files do not grow in number with the chats.
SNAPSHOT_PARTS = 128


def snapshot(messages: DataFrame, path: str) -> None:
    """Messages as a table in a fixed number of folders; a chat's rows are replaced whole, other chats stay.

    Only folders of the given chats are written anew, with the other chats' rows that lie in them.
    """
    new = messages.withColumn("part", F.pmod(F.xxhash64("chat_id"), F.lit(SNAPSHOT_PARTS)).cast("int"))
    if files_of(messages.sparkSession, path, missing=""):
        chats = cut(new.select("chat_id", "part").distinct())
        old = messages.sparkSession.read.parquet(path)
        others = old.join(chats.select("part").distinct(), "part", "left_semi").join(chats.select("chat_id"), "chat_id", "left_anti")
        new = new.unionByName(others, allowMissingColumns=True)
    new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def keep_snapshot(messages: DataFrame, path: str, version: int) -> None:
    """A snapshot that says which format it has."""
    snapshot(messages.withColumn("version", F.lit(version)), path)


def saved_snapshots(spark: SparkSession, path: str, chats: DataFrame, version: int) -> DataFrame:
    """The snapshots of chats (chat_id); none of a chat whose snapshot was written in another format, or is another chat's."""
    kept = spark.read.parquet(path).filter(F.col("version") == version)
    return kept.join(chats.select("chat_id"), "chat_id", "left_semi").drop("version", "part")


def fetch_pages(spark: SparkSession, addresses: DataFrame, fetch: Callable[[str], tuple[int, str]], attempts: int = 4, pause: float = 0.6) -> DataFrame:
    """addresses (address, ...) with status and body, read by an injected function (status, body).

    A read that fails is tried again after pause, 2 pause, ... seconds, up to ``attempts`` times; statuses 400 to 404 and
    410 to 419 are final.  A status of 0 stands for no answer at all.
    """
    def one(address: str) -> tuple[int, str | None]:
        status, body = 0, None
        for k in range(attempts):
            if k:
                time.sleep(pause * k)
            try:
                status, body = fetch(address)
            except OSError:
                status, body = 0, None
            if 200 <= status < 300 or 400 <= status <= 404 or 410 <= status <= 419:
                break
        return status, body if 200 <= status < 300 else None

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in values], columns=["status", "body"])

    return addresses.withColumn("_r", F.pandas_udf(run, "status int, body string")("address")).select(*addresses.columns, "_r.status", "_r.body")


def export_text(messages: DataFrame, form: str = "txt", labels: bool = True, strip_info: bool = True) -> DataFrame:
    """(chat_id, body): a chat as txt, md or json, in order."""
    body = F.regexp_replace(tx.strip_own_block("text"), r"```INFO[\s\S]*?```", "") if strip_info else F.col("text")
    body = tx.trim(body)
    who = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "AI").otherwise(F.col("role"))
    if form == "json":
        item = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), body.alias("text"))
        return messages.groupBy("chat_id").agg(F.array_sort(F.collect_list(item)).alias("m")).select("chat_id", F.to_json("m").alias("body"))
    lead = F.concat(F.lit("### "), who, F.lit("\n\n")) if form == "md" else F.concat(F.lit("["), who, F.lit("]\n"))
    line = F.concat(lead, body) if labels else body
    sep = "\n\n" if form == "md" else "\n\n────────\n\n"
    ordered = messages.select("chat_id", "turn", line.alias("line")).groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("m"))
    return ordered.select("chat_id", F.array_join(F.transform("m", lambda x: x["line"]), sep).alias("body"))


# --- socket frames ---------------------------------------------------------------------------------

_FRAME = r"(?s)^42(/[^,]+,)?(\d*)(\[.*)\z"


def parse_frame(frames: DataFrame, raw: str = "raw", namespaces: tuple[str, ...] = ("", "/v3/chats,")) -> DataFrame:
    """frames with kind (send or reroll) and payload (JSON); null for anything else."""
    event = F.regexp_extract(raw, _FRAME, 3)
    ok = (F.length(event) > 0) & F.regexp_extract(raw, _FRAME, 1).isin(*namespaces)
    parts = F.from_json(event, "array<string>")
    kind = F.get(parts, F.lit(0))
    good = ok & kind.isin("send", "reroll")
    return frames.withColumn("kind", F.when(good, kind)).withColumn("payload", F.when(good, F.coalesce(F.get(parts, F.lit(1)), F.lit("{}"))))


def replace_frame_message(frames: DataFrame, raw: str = "raw", message: str = "message", namespaces: tuple[str, ...] = ("", "/v3/chats,")) -> DataFrame:
    """frames with ``rewritten``: the first text field of message, content, text replaced; null where there is none."""
    event = F.regexp_extract(raw, _FRAME, 3)
    ok = (F.length(event) > 0) & F.regexp_extract(raw, _FRAME, 1).isin(*namespaces)
    parts = F.from_json(event, "array<string>")
    payload = F.from_json(F.get(parts, F.lit(1)), "map<string,string>")
    field = F.get(F.filter(F.array(*map(F.lit, ("message", "content", "text"))), lambda k: F.map_contains_key(payload, k)), F.lit(0))
    fresh = F.transform_values(payload, lambda k, v: F.when(k == field, F.col(message)).otherwise(v))
    lead = F.concat(F.lit("42"), F.regexp_extract(raw, _FRAME, 1), F.regexp_extract(raw, _FRAME, 2))
    made = F.concat(lead, F.lit('["send",'), F.to_json(fresh), F.lit("]"))
    return frames.withColumn("rewritten", F.when(ok & (F.get(parts, F.lit(0)) == "send") & field.isNotNull(), made))

