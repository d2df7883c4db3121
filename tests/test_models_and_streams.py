"""Model slots, readers that try again, snapshots, swaps and recovery of rewritten history."""

import random
import time

import pytest
from pyspark.sql import functions as F

from recallweave.operators import evaluate, models, pack
from recallweave.sources import messages as src
from recallweave.streaming import ingest
from recallweave.streaming.versions import Conflict, Versions


def test_prompts_shrink_in_the_middle(spark):
    body = "".join(f"{i:04d} " for i in range(400))
    d = spark.createDataFrame([("앞 " + models.WINDOW + body,), ("no marker " * 300,), (models.WINDOW + "short",)], "prompt string")
    got = [r.p for r in d.select(models.fit_to_quota("prompt", 1000, F.length).alias("p")).collect()]
    assert len(got[0]) <= 900 and got[0].startswith("앞 " + models.WINDOW + "0000") and got[0].endswith("0399 ") and models.LEFT_OUT in got[0]
    assert got[1] == "no marker " * 300 and got[2] == models.WINDOW + "short"
    assert d.select(models.fit_to_quota("prompt", 0, F.length).alias("p")).first().p == "앞 " + models.WINDOW + body


def test_hosts_are_tried_in_order_within_a_deadline(spark):
    def slow(text):
        if "slow" in text:
            time.sleep(3)
        if "fail" in text:
            raise ValueError("down")
        return f" one:{text} ", 700

    def second(text):
        if "fail hard" in text:
            raise ValueError("down too")
        return f"two:{text}", 0

    d = spark.createDataFrame([("a",), ("slow",), ("fail",), ("fail hard",)], "prompt string").coalesce(1)
    got = [(r.raw, r.quota, r.error) for r in models.ask(d, [slow, second], seconds=0.5).collect()]
    assert got == [("one:a", 700, None), ("two:slow", 0, None), ("two:fail", 0, None), (None, 0, "down too")]


def test_boards_and_intents(spark):
    boards = spark.createDataFrame([("a", "장소: 숲", True, True, 3, 1), ("b", "장소: 강", True, False, 2, 0)], "chat_id string, text string, enabled boolean, edited boolean, lastTurn int, updates int")
    answers = spark.createDataFrame([("a", 9, "장소·동행: 탑"), ("b", 8, "장소·동행: 없음"), ("c", 5, "장소·동행: 들")], "chat_id string, last_turn int, raw string")
    got = {r.chat_id: (r.text, r.edited, r.lastTurn, r.updates) for r in models.rewritten_boards(boards, answers).collect()}
    assert got == {"a": ("장소·동행: 탑", False, 9, 2), "b": ("장소: 강", False, 2, 0), "c": ("장소·동행: 들", False, 5, 1)}
    edits = spark.createDataFrame([("b", " 내가 쓴 판 ", False)], "chat_id string, text string, enabled boolean")
    got = {r.chat_id: (r.text, r.enabled, r.edited) for r in models.edited_boards(boards, edits).collect()}
    assert got == {"a": ("장소: 숲", True, True), "b": ("내가 쓴 판", False, True)}
    q = spark.createDataFrame([("q", "a", "그거 왜 했어?")], "query_id string, chat_id string, draft string")
    k = spark.createDataFrame([("a", "검", 1), ("a", "탑", 9), ("b", "강", 2)], "chat_id string, keyword string, turn int")
    assert "탑, 검\n" in models.intent_prompts(q, k, "고르라").first().prompt
    assert [(r.query_id, r.keyword) for r in models.meant_keywords(q.withColumn("raw", F.lit("탑과 강")), k).collect()] == [("q", "탑")]
    inputs = spark.createDataFrame([("a", "장소: 숲", False, "f2", "둘", 5), ("a", "장소: 숲", False, "f1", "하나", 4)], "chat_id string, previous string, full boolean, id string, fact string, turn int")
    assert models.overview_prompts(inputs, "쓰라").first().prompt.endswith("장소: 숲\n" + models.WINDOW + "[4] 하나\n[5] 둘")


def test_pages_are_tried_again_and_final_statuses_are_not(spark, tmp_path):
    log = tmp_path / "log"

    def fetch(address):
        with log.open("a") as f:
            f.write(address + "\n")
        n = log.read_text().split("\n").count(address)
        if address == "flaky" and n < 3:
            raise OSError("no route")
        return (404, "gone") if address == "gone" else (503, "busy") if address == "busy" else (200, "body of " + address)

    d = spark.createDataFrame([("ok",), ("flaky",), ("gone",), ("busy",)], "address string").coalesce(1)
    got = {r.address: (r.status, r.body) for r in src.fetch_pages(spark, d, fetch, pause=0.01).collect()}
    assert got == {"ok": (200, "body of ok"), "flaky": (200, "body of flaky"), "gone": (404, None), "busy": (503, None)}
    tried = log.read_text().split()
    assert [tried.count(a) for a in ("ok", "flaky", "gone", "busy")] == [1, 3, 1, 4]


def test_swap_keeps_a_whole_log(spark, tmp_path):
    old, new = str(tmp_path / "log"), str(tmp_path / "fresh")
    spark.range(3).write.parquet(old)
    spark.range(5).write.parquet(new)
    ingest.swap(new, old, spark)
    assert spark.read.parquet(old).count() == 5 and not (tmp_path / "log.old").exists() and not (tmp_path / "fresh").exists()
    # Interrupted between the two renames: the old log stands aside, and calling again finishes.
    spark.range(7).write.parquet(new)
    (tmp_path / "log").rename(tmp_path / "log.old")
    ingest.swap(new, old, spark)
    assert spark.read.parquet(old).count() == 7 and not (tmp_path / "log.old").exists()


MESSAGE = "chat_id string, turn int, id string, role string, text string"


def parse(m):
    return m.filter("role = 'assistant'").select("chat_id", F.concat(F.lit("f:"), "id").alias("id"), F.col("id").alias("sourceId"), "text", "turn")


def chats(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def facts_of(spark, base):
    return {r.id: r.text for r in Versions(spark, base).table("facts").collect()}


def test_rewritten_history_inside_the_sink(spark, tmp_path):
    first = [("c", n, f"m{n}", "assistant" if n % 2 == 0 else "user", f"t{n}") for n in range(1, 7)]
    changed = first[:3] + [("c", n, f"x{n}", "assistant" if n % 2 == 0 else "user", f"new{n}") for n in range(4, 9)]
    base, given = str(tmp_path / "log"), []

    def told(m):
        given.append(sorted(r.id for r in m.collect()))
        return parse(m)

    write = ingest.recovering_sink(base, told, buckets=2)
    write(chats(spark, first + [("d", 2, "d2", "assistant", "other")]), 0)
    assert set(facts_of(spark, base)) == {"f:m2", "f:m4", "f:m6", "f:d2"}
    write(chats(spark, changed), 1)
    assert facts_of(spark, base) == {"f:m2": "t2", "f:x4": "new4", "f:x6": "new6", "f:x8": "new8", "f:d2": "other"}
    assert given[1] == ["m3", "x4", "x5", "x6", "x7", "x8"]  # after m2, the last source that survives
    more = changed + [("c", 9, "x9", "user", "u"), ("c", 10, "x10", "assistant", "new10")]
    write(chats(spark, more), 2)
    assert given[2] == ["x10", "x9"] and facts_of(spark, base)["f:x10"] == "new10"
    write(chats(spark, more), 2)  # run again: committed already
    assert len(given) == 3 and len(facts_of(spark, base)) == 6
    write(chats(spark, [("c", 1, "y1", "user", "all new")]), 3)  # nothing is left of the chat's sources
    assert facts_of(spark, base) == {"f:d2": "other"} and given[3] == ["y1"]


@pytest.mark.parametrize("where", ["read", "changed", "written", "committed", "torn"])
def test_a_stop_at_any_step_leaves_one_whole_version(spark, tmp_path, where):
    base = str(tmp_path / "log")
    ingest.recovering_sink(base, parse, buckets=2)(chats(spark, [("c", 2, "m2", "assistant", "a"), ("d", 2, "d2", "assistant", "d")]), 0)
    more = chats(spark, [("c", 2, "m2", "assistant", "a"), ("c", 4, "m4", "assistant", "b")])

    def stop(name):
        if name == where:
            raise RuntimeError(name)

    if where == "torn":  # the manifest was begun and not ended
        (tmp_path / "log/_versions/000000000002").write_text('{"number": 2, "epo')
    else:
        with pytest.raises(RuntimeError):
            ingest.recovering_sink(base, parse, buckets=2, step=stop)(more, 1)
    after = {"f:m2", "f:d2", "f:m4"} if where == "committed" else {"f:m2", "f:d2"}
    v = Versions(spark, base, 2)
    assert set(facts_of(spark, base)) == after and {r.lastId for r in v.table("read_to").collect()} == ({"m4", "d2"} if where == "committed" else {"m2", "d2"})
    ingest.recovering_sink(base, parse, buckets=2)(more, 1)
    rows = [r.id for r in v.table("facts").collect()]
    assert sorted(rows) == ["f:d2", "f:m2", "f:m4"] and {r.lastId for r in v.table("read_to").collect()} == {"m4", "d2"}
    v.clear_unnamed(keep=1)
    assert sorted(r.id for r in v.table("facts").collect()) == ["f:d2", "f:m2", "f:m4"]


def test_one_of_two_writers_wins_and_old_epochs_fail(spark, tmp_path):
    base = str(tmp_path / "log")
    one = chats(spark, [("c", 2, "m2", "assistant", "a")])
    ingest.recovering_sink(base, parse)(one, 0)
    v = Versions(spark, base)
    seen = v.current()

    def meanwhile(name):  # another writer commits between reading and committing
        if name == "written":
            ingest.recovering_sink(base, parse)(chats(spark, [("e", 2, "e2", "assistant", "e")]), 1)

    with pytest.raises(Conflict):
        ingest.recovering_sink(base, parse, step=meanwhile)(chats(spark, [("f", 2, "f2", "assistant", "f")]), 1)
    assert set(facts_of(spark, base)) == {"f:m2", "f:e2"} and v.current().number == seen.number + 1
    ingest.recovering_sink(base, parse, epoch=1)(chats(spark, [("g", 2, "g2", "assistant", "g")]), 0)
    with pytest.raises(Conflict):
        ingest.recovering_sink(base, parse, epoch=0)(one, 5)
    assert set(facts_of(spark, base)) == {"f:m2", "f:e2", "f:g2"}


def test_the_sink_in_a_stream_that_begins_again(spark, tmp_path):
    base = str(tmp_path / "log")
    for k in range(2):
        chats(spark, [(f"c{k}", 2, f"m{k}", "assistant", "a")]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(ingest.recovering_sink(base, parse)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert set(facts_of(spark, base)) == {"f:m0", "f:m1"}


def test_branches_begin_after_the_shared_turns(spark):
    m = spark.createDataFrame([("b", n, f"b{n}", "assistant" if n % 2 == 0 else "user", "text " * 5) for n in range(1, 13)], MESSAGE)
    seeds = spark.createDataFrame([("b", 6)], "chat_id string, shared int")
    assert ingest.seeded_batches(m, seeds, deadline=3).first().from_turn == 7 and ingest.extraction_batches(m, deadline=3).first().from_turn == 1


def test_progress_and_stops(spark, tmp_path):
    listener, seen = ingest.Progress(), []
    spark.streams.addListener(listener)
    try:
        spark.range(9).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(ingest.fenced(lambda b, n: seen.append(b.count()), lambda: True)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if str(q.id) in listener.ended:
                break
            time.sleep(0.1)
        assert seen == [9] and listener.rows[str(q.id)] == 9
        stream.writeStream.foreachBatch(ingest.fenced(lambda b, n: seen.append(b.count()), lambda: False)).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
        assert seen == [9]
    finally:
        spark.streams.removeListener(listener)


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_against_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = [(f"g{i % 3}", i, r.randrange(0, 30)) for i in range(200)]
    got = {(x.g, x.i): x.pack_rank for x in pack.pack_groups(spark.createDataFrame(rows, "g string, i int, c int").repartition(5), ["g"], [F.asc("i")], F.col("c"), 60, separator=1).collect()}
    want = {}
    for g in ("g0", "g1", "g2"):
        used = n = 0
        for _, i, c in (x for x in rows if x[0] == g):
            price = c + (1 if n else 0)
            if c <= 60 and used + price <= 60:
                used, n = used + price, n + 1
                want[g, i] = n
    assert got == want


def test_running_sums_over_stretches(spark):
    r = random.Random(3)
    values = sorted({round(r.uniform(-5, 5), 3) for _ in range(300)})
    rows = [(k, v, r.randrange(9)) for k in "ab" for v in values]
    got = {(x.k, x.v): x.run for x in evaluate.running(spark.createDataFrame(rows, "k string, v double, n int"), "v", "n", ("k",)).collect()}
    for k in "ab":
        total = 0
        for _, v, n in (x for x in rows if x[0] == k):
            total += n
            assert got[k, v] == total
    one = evaluate.running(spark.createDataFrame([(2.0, 7)], "v double, n int"), "v", "n").collect()
    assert [(x.v, x.run) for x in one] == [(2.0, 7)]


def test_one_periodic_job_of_a_name(spark, tmp_path):
    seen = []
    spark.range(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = ingest.run_every(stream, "collector", lambda b, n: seen.append(b.count()), str(tmp_path / "c"), "1 second")
    try:
        assert ingest.run_every(stream, "collector", lambda b, n: seen.append(-1), str(tmp_path / "c2")).id == q.id
        q.processAllAvailable()
        spark.range(4, 9).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(80):
            q.processAllAvailable()
            if sum(seen) == 9:
                break
            time.sleep(0.1)
        assert sum(seen) == 9 and -1 not in seen
    finally:
        q.stop()


def test_windows_of_a_stream(spark, tmp_path):
    m = spark.createDataFrame([(c, f"{c}{n}") for c, k in (("a", 9), ("b", 3)) for n in range(k)], "chat_id string, id string")
    m.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    ingest.run_available(ingest.windows_of_stream(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    spark.createDataFrame([("b", "b3"), ("b", "b4")], m.schema).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.run_available(ingest.windows_of_stream(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 1, 4), ("a", 1, 5, 8), ("b", 0, 1, 4)]


def test_snapshots_in_few_folders_replace_whole_chats(spark, tmp_path):
    path = str(tmp_path / "snap")
    made = lambda lo, hi, turns, text: spark.range(lo, hi).select(F.col("id").cast("string").alias("chat_id"), F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn"), F.lit(text).alias("text"))
    src.keep_snapshot(made(0, 600, 3, "old"), path, 2)
    assert len(list((tmp_path / "snap").glob("part=*"))) <= src.SNAPSHOT_PARTS
    src.keep_snapshot(made(0, 40, 1, "new"), path, 2)
    src.keep_snapshot(made(40, 50, 2, "other format"), path, 1)
    asked = spark.range(0, 700).select(F.col("id").cast("string").alias("chat_id"))
    got = {(int(r.chat_id), r.text): r["count"] for r in src.saved_snapshots(spark, path, asked, 2).groupBy("chat_id", "text").count().collect()}
    assert got == {(i, "new"): 1 for i in range(40)} | {(i, "old"): 3 for i in range(50, 600)}
    assert src.saved_snapshots(spark, path, asked, 2).columns == ["chat_id", "turn", "text"]
