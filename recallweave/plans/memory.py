"""Queries: notes and facts in line, memory, graphs, context, streaming."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import cards, context, graph, lore, memory, segment
from ..operators.lineage import cut, fresh_folder
from ..sources import messages as src
from ..streaming import ingest, waiting
from .catalogue import MESSAGES, query
from .retrieval import messages

NOTES = [
    ("n1", "월광검", ["월광검", "검"], "아린이 쓰는 검은 월광검이다.", False), ("n2", "아린", ["아린"], "아린은 왕국의 기사이다.", False), ("n3", "은열쇠", ["은열쇠"], "은열쇠는 지하 서고를 여는 열쇠다.", False),
    ("n4", "북쪽 숲", ["북쪽 숲"], "북쪽 숲에는 안개가 낀다.", False), ("n5", "세계", [], "마력은 달의 주기를 따른다.", True),
]
DRAFTS = [("d1", "아린이 쓰는 무기는?", ""), ("d2", "은열쇠로 무엇을 열 수 있지?", ""), ("d3", "날씨가 좋다", "북쪽 숲에 도착했다."), ("d4", "안녕", "")]


def notes(spark):
    made = [("c", i, id_, t, k, body, None, always, True, "both") for i, (id_, t, k, body, always) in enumerate(NOTES)]
    return spark.createDataFrame(made, "chat_id string, ins int, id string, title string, keywords array<string>, content string, relations array<struct<subject: string, predicate: string, object: string>>, alwaysInclude boolean, enabled boolean, triggerType string")


def drafts(spark):
    return spark.createDataFrame([(i, "c", d, c, 10) for i, d, c in DRAFTS], "query_id string, chat_id string, draft string, recent_context string, turn int")


@query("""SELECT * FROM (VALUES ('n1', '아린', 'wield', '월광검'), ('n1', '월광검', 'wield', '아린')) t(lore_id, subject, predicate, object)""")
def q_lore_relations(spark, d):
    """Relations that the notes' own sentences tell, both ways; the answer is read off the five notes."""
    return lore.text_relations(lore.enabled(notes(spark))).select("lore_id", "subject", "predicate", "object")


@query("""WITH v AS (SELECT * FROM (VALUES ('n1', 'e:월광검', 3.0), ('n1', 'e:아린', 1.0), ('n1', 'p:wield', 1.0), ('n1', 'sp:아린:wield', 1.5), ('n1', 'sp:월광검:wield', 1.5), ('n2', 'e:아린', 2.0), ('n3', 'e:은열쇠', 2.0), ('n4', 'e:북쪽 숲', 2.0), ('n5', 'e:세계', 2.0)) t(lore_id, key, w))
SELECT lore_id, key, round(w / sqrt(sum(w * w) OVER (PARTITION BY lore_id)), 6)::DOUBLE AS w FROM v""")
def q_relation_vector(spark, d):
    n = lore.enabled(notes(spark))
    return lore.relation_vectors(n, lore.text_relations(n)).select("lore_id", "key", F.round("w", 6).alias("w"))


def story_facts(spark, d):
    """Events as facts: a user's event types are kinds of things said about them."""
    e = src.read_table(spark, d, "events")
    kinds = F.array(*map(F.lit, ("상태", "약속", "관계", "경험")))
    return e.select(
        F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("chat_id"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("keyword"),
        F.concat_ws(" ", F.concat(F.lit("user"), F.col("user_id").cast("string")), "event_type", F.date_format("ts", "EEEE"), F.round("value", 0).cast("string")).alias("fact"), F.lit("인물").alias("domain"),
        F.get(kinds, (F.abs(F.hash("event_type")) % 4).cast("int")).alias("kind"), F.array().cast("array<string>").alias("who"), (F.col("event_id") % 1000).cast("int").alias("turn"), F.col("event_id").alias("seq"))


@query()
def q_fold_memory(spark, d):
    return memory.fold_memory(story_facts(spark, d)).select("chat_id", "card", "slot", "place", "id", "reason", "by")


@query()
def q_memory_cards(spark, d):
    from_log = spark.createDataFrame(
        [("c", f"f{i}", k, t, dom, kind, [k], turn, f"s{turn}", None, True, False) for i, (k, t, dom, kind, turn) in enumerate([
            ("은열쇠", "로완은 은열쇠를 서고에 숨겼다.", "기술", "상태", 1), ("로완", "로완은 루카에게 복수를 맹세했다.", "인물", "약속", 4), ("은열쇠", "서린은 은열쇠를 새로 복제해 가졌다.", "기술", "상태", 30), ("탑", "탑은 북쪽 숲에 서 있다.", "장소", "설정", 2)])],
        "chat_id string, id string, keyword string, fact string, domain string, kind string, who array<string>, turn int, sourceId string, source string, enabled boolean, pinned boolean")
    q = drafts(spark).withColumn("recent_text", F.lit("")).withColumn("cutoff", F.lit(None).cast("int"))
    return cards.memory_cards(from_log, q).select("query_id", "place", "id", "content", "why")


@query()
def q_context_prompt(spark, d):
    """The last user message of each conversation as a draft, with passages of what came before."""
    m = cut(messages(spark, d))
    last = m.filter("role = 'user'").groupBy("chat_id").agg(F.max_by("text", "turn").alias("draft")).withColumn("query_id", F.col("chat_id"))
    return context.prepare_context(m, last).select("query_id", "turn", F.size("items").alias("n_items"), F.length("prompt").alias("n_chars"))


@query()
def q_passages(spark, d):
    return segment.passages(messages(spark, d)).select("chat_id", "unit_id", "turn", "scene", "len")


@query()
def q_evolution_cards(spark, d):
    """A story of 24 messages in line: the tables hold no Hangul, on which keywords rest."""
    told = [("c", i + 1, f"m{i}", "assistant", f"서린: 「{i}일째 훈련장에서 대련했다.」\n훈련장에서 서린은 고개를 숙이고 약속을 지켰다.") for i in range(24)]
    nodes, _ = graph.evolution_graph(spark.createDataFrame(told, "chat_id string, turn int, id string, role string, text string"))
    return graph.evolution_cards(nodes).select("chat_id", "keyword", "domain", "status", "node_count")


@query()
def q_sliding_memory(spark, d):
    return graph.sliding_memory(graph.window_details(graph.reply_windows(messages(spark, d)))).select("chat_id", "location", F.size("recent").alias("n_recent"), F.size("timeline").alias("n_epochs"))


@query()
def q_extraction_batches(spark, d):
    return ingest.extraction_batches(messages(spark, d))


@query(f"WITH {MESSAGES} SELECT chat_id, id, role FROM msg")
def q_stream_ingest(spark, d):
    """The stream of the conversations, run to its end; its result is what the batch gives."""
    rows = spark.readStream.schema(src.read_table(spark, d, "conversations").schema).parquet(f"{d}/conversations.parquet*")
    m = rows.select(F.col("conv_id").cast("string").alias("chat_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "role", "text")
    at = fresh_folder(spark, "stream")
    ingest.run_available(ingest.deduplicated(m), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select("chat_id", "id", "role")


_FORCED = f"""WITH RECURSIVE {MESSAGES}, b AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY chat_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM msg),
r AS (SELECT chat_id, k, min(turn) AS first, max(turn) AS last, sum(length(text)) AS size, max(id) FILTER (role = 'assistant') AS id FROM b GROUP BY ALL HAVING count(*) FILTER (role = 'assistant') > 0),
p(chat_id, k, batch, used) AS (SELECT chat_id, k, 0, size FROM r WHERE k = 0 UNION ALL SELECT r.chat_id, r.k, CASE WHEN p.used + r.size <= 1000 THEN p.batch ELSE p.batch + 1 END, CASE WHEN p.used + r.size <= 1000 THEN p.used + r.size ELSE r.size END FROM p JOIN r ON r.chat_id = p.chat_id AND r.k = p.k + 1)
SELECT chat_id, batch::INT AS batch, min(first)::INT AS from_turn, max(last)::INT AS to_turn, max_by(id, k) AS last_id, sum(size)::INT AS size FROM p JOIN r USING (chat_id, k) GROUP BY chat_id, batch"""


@query(_FORCED)
def q_forced_batches(spark, d):
    """Unread replies of all conversations in batches of 1,000 characters, none left waiting."""
    return ingest.extraction_batches(messages(spark, d), 1000, force=True)


@query(_FORCED)
def q_timed_batches(spark, d):
    """The same as a stream with state and timers: a batch is read as soon as a reply is there, with all that fits."""
    schema = src.read_table(spark, d, "conversations").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/conversations.parquet*")
    kept = rows.filter(F.col("role").isin("user", "assistant") & (F.length(F.trim("text")) > 0))
    # user messages and replies without a gap: a turn is its place in the conversation, counted by the table
    place = messages(spark, d).select(F.col("id").alias("_id"), F.col("turn").alias("_turn"))
    m = kept.withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).drop("turn").join(place, F.col("id") == F.col("_id"))
    m = m.select(F.col("conv_id").cast("string").alias("chat_id"), F.col("_turn").alias("turn"), "role", "id", "text", F.timestamp_seconds("_turn").alias("ts"))
    at = fresh_folder(spark, "waiting")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    waiting.with_store(spark)
    try:
        ingest.run_available(waiting.timed_batches(m, 1000, 1), f"{at}/out", f"{at}/checkpoint")
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(ingest.BATCHES).parquet(f"{at}/out")
