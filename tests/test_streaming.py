"""Streams against their batch twins."""

from pyspark.sql import functions as F

from recallweave.streaming import ingest, waiting


def rows(n, size=100):
    return [{"turn": i + 1, "role": "assistant" if i % 2 else "user", "id": f"m{i + 1}", "size": size} for i in range(n)]


def test_batches_fill_wait_and_flush():
    made, rest = ingest.form_batches(rows(8), budget=450)
    assert made == [(1, 4, "m4", 400)] and len(rest) == 4
    made, rest = ingest.form_batches(rows(4), budget=450)
    assert made == [] and len(rest) == 4
    made, rest = ingest.form_batches(rows(12), budget=10_000)
    assert made == [(1, 12, "m12", 1200)] and rest == []
    assert ingest.form_batches(rows(2), budget=10, force=True)[0] == [(1, 2, "m2", 200)]


def test_char_budget():
    assert ingest.char_budget(None) == 4500 and ingest.char_budget(1000) == 2000 and ingest.char_budget(10**6) == 12000


def test_stream_equals_batch(spark, tmp_path):
    m = spark.createDataFrame([(f"c{c}", i + 1, "assistant" if i % 2 else "user", f"c{c}m{i}", "글" * 300) for c in range(5) for i in range(20)], "chat_id string, turn int, role string, id string, text string")
    for part in range(2):
        m.filter((F.col("turn") > 10) == bool(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
        ingest.run_available(ingest.stream_batches(stream, 2000), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, ingest.extraction_batches(m, 2000).collect())) and len(got) > 5


def test_memory_sink_replaces_its_own_batch(spark, tmp_path):
    w = ingest.memory_sink(str(tmp_path / "log"), lambda df: df, epoch=1)
    df = spark.createDataFrame([("a",)], "x string")
    w(df, 0)
    w(df, 0)
    w(df, 1)
    assert ingest.read_log(spark, str(tmp_path / "log"), 1).count() == 2


MESSAGE = "chat_id string, turn int, role string, id string, text string, ts timestamp"


def told(spark, *rows):
    """Messages (chat, turn, role, minute), each of 100 characters."""
    made = [(c, t, role, f"{c}{t}", "x" * 100, 86_400 + minute * 60) for c, t, role, minute in rows]
    return spark.createDataFrame(made, "chat_id string, turn int, role string, id string, text string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def run_parts(spark, tmp_path, parts, **kw):
    """Each part in a run of its own, which begins from the checkpoint of the one before; the batches after each."""
    waiting.with_store(spark)
    seen = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
        ingest.run_available(waiting.timed_batches(stream, **kw), str(tmp_path / "out"), str(tmp_path / "ck"))
        seen.append(sorted(tuple(r) for r in spark.read.schema(ingest.BATCHES).parquet(str(tmp_path / "out")).collect()))
    return seen


def pairs(chat, turns, minute=0):
    return [(chat, t, "assistant" if t % 2 == 0 else "user", minute) for t in turns]


def test_timed_stream_equals_batch_after_restarts(spark, tmp_path):
    every = [x for c in ("a", "b", "c") for x in pairs(c, range(1, 21))]
    parts = [told(spark, *[x for x in every if x[1] <= 10]), told(spark, *[x for x in every if x[1] > 10])]
    got = run_parts(spark, tmp_path, parts, budget=450, deadline=3)
    want = sorted(map(tuple, ingest.extraction_batches(told(spark, *every), 450, 3).collect()))
    assert got[-1] == want and len(want) > 6 and 0 < len(got[0]) < len(want)


def test_what_waits_is_read_when_its_time_is_over(spark, tmp_path):
    parts = [told(spark, *pairs("a", (1, 2))), told(spark, *pairs("b", (1, 2), 5)), told(spark, *pairs("b", (3, 4), 30)), told(spark, *pairs("b", (5,), 31))]
    got = run_parts(spark, tmp_path, parts, wait=600)
    assert got[0] == got[1] == []  # five minutes later a's reply still waits
    assert got[-1] == [("a", 0, 1, 2, "a2", 200), ("b", 0, 1, 4, "b4", 400)]


def test_messages_that_come_again_count_once(spark, tmp_path):
    parts = [told(spark, *pairs("a", (1, 2))), told(spark, *pairs("a", (1, 2, 3, 4))), told(spark, *pairs("a", (2, 4, 5, 6)))]
    got = run_parts(spark, tmp_path, parts, deadline=3)
    assert got[-1] == [("a", 0, 1, 6, "a6", 600)] and got[1] == []


def test_branches_begin_from_their_shared_turns(spark, tmp_path):
    seeds = spark.createDataFrame([("branch", 4), ("idle", 2)], "chat_id string, shared int")
    rows = told(spark, *pairs("branch", range(1, 9)), *pairs("whole", range(1, 9)))
    got = run_parts(spark, tmp_path, [rows], deadline=1, seeds=seeds)
    assert got[-1] == [("branch", 0, 5, 8, "branch8", 400), ("whole", 0, 1, 8, "whole8", 800)]
