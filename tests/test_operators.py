"""Operators on small conversations."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallweave.operators import cards, context, earlier, evaluate, graph, lore, memory, pack, passages, rank, segment, state
from recallweave.operators.index import build_index
from recallweave.plans import catalogue
from recallweave.sources import messages as src

catalogue.load()


def msgs(spark, *rows, chat="c"):
    return spark.createDataFrame([(chat, i + 1, f"m{i + 1}", r, t) for i, (r, t) in enumerate(rows)], "chat_id string, turn int, id string, role string, text string")


def facts(spark, *rows):
    made = [("c", f"f{i + 1}", k, t, d, kind, who, turn, f"s{turn}", None, True, False, i) for i, (k, t, d, kind, who, turn) in enumerate(rows)]
    return spark.createDataFrame(made, "chat_id string, id string, keyword string, fact string, domain string, kind string, who array<string>, turn int, sourceId string, source string, enabled boolean, pinned boolean, seq int")


def test_units_advance_by_a_fixed_stride(spark):
    text = " ".join(f"word{i:03d}" for i in range(60))
    u = segment.units(msgs(spark, ("user", text))).orderBy("pos").collect()
    assert [r.pos for r in u] == [0, 180, 360] and all(r.len <= 220 for r in u) and text.startswith(u[0].text) and text[u[0].len] == " "


def test_ingest_keeps_first_of_an_id_and_order(spark):
    rows = spark.createDataFrame([("c", 3, "a", "user", "뒤"), ("c", 1, "a", "user", "앞"), ("c", 2, "b", "system", "s"), ("c", 4, "d", "assistant", " "), ("c", 5, "e", "assistant", "끝")], "chat_id string, seq long, id string, role string, text string")
    assert [(r.turn, r.id, r.text) for r in src.ingest(rows).orderBy("turn").collect()] == [(1, "a", "앞"), (2, "e", "끝")]
    assert src.ingest(rows, include_system=True).count() == 3


def test_append_new_numbers_on(spark):
    old = msgs(spark, ("user", "a"), ("assistant", "b"))
    tail = spark.createDataFrame([("c", 1, "m2", "assistant", "b"), ("c", 2, "m9", "user", "c")], "chat_id string, seq long, id string, role string, text string")
    assert [(r.turn, r.id) for r in src.append_new(old, tail).orderBy("turn").collect()] == [(1, "m1"), (2, "m2"), (3, "m9")]


def test_parse_export(spark):
    t = "# 머리\n[AI]\n안녕\n────────\n[유저]\n  \n────────\n[유저]\n그래\n좋아\n"
    got = src.parse_export(spark.createDataFrame([("c", t)], "chat_id string, text string"), drop_comments=True).orderBy("turn").collect()
    assert [(r.id, r.role, r.text) for r in got] == [("export-0001", "assistant", "안녕"), ("export-0002", "user", "그래\n좋아")]


def test_frames(spark):
    f = spark.createDataFrame([('42/v3/chats,7["send",{"chatId":"x","message":"안녕"}]', "새 글"), ('42["typing",{}]', "n"), ("41", "n"), ('42/other,["send",{"text":"a"}]', "n")], "raw string, message string")
    got = src.replace_frame_message(src.parse_frame(f)).collect()
    assert [r.kind for r in got] == ["send", None, None, None]
    assert got[0].rewritten == '42/v3/chats,7["send",{"chatId":"x","message":"새 글"}]' and got[1].rewritten is None


def test_export_text(spark):
    m = msgs(spark, ("user", "안녕"), ("assistant", "```INFO 1```그래"))
    assert src.export_text(m, "md").first().body == "### User\n\n안녕\n\n### AI\n\n그래"
    assert src.export_text(m, "txt", labels=False).first().body == "안녕\n\n────────\n\n그래"


def test_first_fit_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 9, 3, 4])], "g string, i int, c int")
    assert [r.i for r in pack.pack_groups(df, ["g"], [F.asc("i")], F.col("c"), 12).orderBy("i").collect()] == [0, 2, 3]
    assert [r.i for r in pack.stop_at_overflow(df, ["g"], [F.asc("i")], F.col("c"), 12).collect()] == [0]


def test_bm25_prefix_and_bound(spark):
    u = spark.createDataFrame([("c", "a", 0, "크리에게 검을 맡겼다"), ("c", "b", 1, "숲에서 쉬었다"), ("c", "d", 2, "검은 숲")], "chat_id string, unit_id string, ord long, text string")
    q = spark.createDataFrame([("q", "c", "크리에 이야기", None), ("r", "c", "검은 숲", 2)], "query_id string, chat_id string, query string, max_ord long")
    got = {(r.query_id, r.unit_id): r for r in rank.bm25(build_index(u), q).collect()}
    assert got["q", "a"].score > 2.5 and "크리에" in got["q", "a"].matched and ("r", "d") not in got
    plain = {(r.query_id, r.unit_id): r for r in rank.bm25(build_index(u), q, prefix=False).collect()}
    assert abs(got["q", "a"].score - plain["q", "a"].score - 2.5) < 1e-9


def test_lsa_agrees_with_itself(spark):
    words = ["검술 훈련 대련", "마법 주문 지팡이", "요리 냄비 소금"]
    u = spark.createDataFrame([("c", f"u{i}", i, f"{words[i % 3]} {words[i % 3]} 공통{i % 5}개") for i in range(30)], "chat_id string, unit_id string, ord long, text string")
    q = spark.createDataFrame([("q", "c", "검술 훈련")], "query_id string, chat_id string, query string")
    docs, asked = rank.lsa(build_index(u), q, k=3)
    got = {r.unit_id: r.d for r in docs.join(asked, "chat_id").select("unit_id", rank.dot("vec", "qvec").alias("d")).collect()}
    same, other = [v for k, v in got.items() if int(k[1:]) % 3 == 0], [v for k, v in got.items() if int(k[1:]) % 3]
    assert min(same) > 0.9 and max(other) < 0.5


def test_lsa_over_many_tasks_is_the_same_iteration(spark):
    r = random.Random(4)
    words = [[f"w{g}x{i}" for i in range(15)] for g in range(5)]
    u = spark.createDataFrame([("c", f"u{i}", i, " ".join(r.choices(words[i % 5], k=12) + r.choices(words[(i + 1) % 5], k=3))) for i in range(80)], "chat_id string, unit_id string, ord long, text string").repartition(6)
    q = u.filter("ord % 20 = 0").select(F.col("unit_id").alias("query_id"), "chat_id", F.col("text").alias("query"))
    one, spread = rank.lsa(build_index(u), q, k=4), rank.lsa_spread(u, q, k=4)
    for a, b, key, vec in ((one[0], spread[0], "unit_id", "vec"), (one[1], spread[1], "query_id", "qvec")):
        want, got = ({x[key]: x[vec] for x in t.collect()} for t in (a, b))
        assert want.keys() == got.keys() and all(abs(x - y) < 1e-3 for k in want for x, y in zip(want[k], got[k], strict=True))
    pairs = {(x.query_id, x.unit_id): x.agreement for x in rank.agreeing(*spread, 0.15, 4).collect()}
    brute = one[1].crossJoin(one[0].drop("chat_id")).select("query_id", "unit_id", rank.dot("vec", "qvec").alias("d")).collect()
    assert all(abs(pairs.get((x.query_id, x.unit_id), 0.15) - max(x.d, 0.15)) < 2e-3 for x in brute) and pairs


def test_topic_step_adds_vectors_up_in_slices(spark, monkeypatch):
    r = random.Random(8)
    rows = [sorted(r.sample(range(30), 5)) for _ in range(40)]
    df = spark.createDataFrame([(j, [float(i % 3 + 1) for i in j]) for j in rows], "j array<int>, x array<float>").repartition(5)
    a = np.zeros((40, 30))
    for i, j in enumerate(rows):
        a[i, j] = [c % 3 + 1 for c in j]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = np.sin(np.arange(1, 31))
    monkeypatch.setattr(rank, "SLICE", 7)
    square, fresh = rank._pass(df, v)
    assert abs(square - (a @ v) @ (a @ v)) < 1e-9 and np.allclose(fresh, a.T @ (a @ v))


def test_topics_keep_no_words_on_the_driver(spark, monkeypatch):
    u = spark.createDataFrame([("c", f"u{i}", i, " ".join(f"w{i % 4}x{j}" for j in range(12))) for i in range(40)], "chat_id string, unit_id string, ord long, text string")
    got = []
    arrow = type(u).toArrow
    monkeypatch.setattr(type(u), "toPandas", lambda self: pytest.fail("collected as rows of Python"))
    monkeypatch.setattr(type(u), "toArrow", lambda self: got.append(arrow(self)) or got[-1])
    rank.lsa_spread(u, u.limit(2).select(F.col("unit_id").alias("query_id"), "chat_id", F.col("text").alias("query")), k=2)
    assert [t.column_names for t in got] == [["key", "df"]]


def test_topics_read_many_units_a_row_and_clean_texts_once(spark, monkeypatch):
    """A step reads packed rows, empty and unknown units among them, and no filter is pushed below the cleaning."""
    r = random.Random(9)
    text = lambda i: "" if i == 7 else "only_marks a_b" if i == 9 else " ".join(r.choices([f"w{i % 4}x{j}" for j in range(12)], k=20))
    u = spark.createDataFrame([("c", f"u{i}", i, text(i)) for i in range(60)], "chat_id string, unit_id string, ord long, text string").repartition(3)
    q = u.filter("ord % 20 = 0").select(F.col("unit_id").alias("query_id"), "chat_id", F.col("text").alias("query"))
    one, seen, plans, step = rank.lsa(build_index(u), q, k=3), [], [], rank._pass
    persist = type(u).persist
    monkeypatch.setattr(type(u), "persist", lambda self, *a: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or persist(self, *a))
    monkeypatch.setattr(rank, "_pass", lambda rows, v: seen.append(rows) or step(rows, v))
    for packed in (rank.PACKED, 30):
        monkeypatch.setattr(rank, "PACKED", packed)
        seen.clear()
        spread = rank.lsa_spread(u, q, k=3)
        want, got = ({x.unit_id: x.vec for x in t.collect()} for t in (one[0], spread[0]))
        assert got.keys() == want.keys() and "u9" in got and "u7" not in got and all(abs(x - y) < 1e-3 for k in want for x, y in zip(want[k], got[k], strict=True))
        assert (seen[0].count() <= 3) == (packed > 30) and seen[0].count() < 59
    assert plans and "Filter" not in plans[0]


def test_agreement_is_told_without_python_and_rounded_as_decimals(spark):
    r = np.random.default_rng(3)
    v = [(f"u{i}", [float(x) for x in y / np.linalg.norm(y)]) for i, y in enumerate(r.normal(size=(50, 3)))]
    docs = spark.createDataFrame([*v, ("half", [0.28125, 0.0, 0.0])], "unit_id string, vec array<double>")
    asked = spark.createDataFrame([*((f"q{i}", x) for i, (_, x) in enumerate(v[:9])), ("one", [1.0, 0.0, 0.0])], "query_id string, qvec array<double>")
    found = rank.agreeing(docs, asked, 0.15, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "round(" not in plan
    got = {(x.query_id, x.unit_id): x.agreement for x in found.collect()}
    brute = docs.crossJoin(asked).select("query_id", "unit_id", F.round(rank.dot("vec", "qvec"), 4).alias("d")).filter("d > 0.15").collect()
    assert got == {(x.query_id, x.unit_id): x.d for x in brute} and got["one", "half"] == 0.2813
    assert rank.agreeing(docs, asked.limit(0), 0.15, 4).count() == 0


def test_lsa_query_takes_all_languages_and_whole_texts(spark, tmp_path):
    r = random.Random(5)
    words = [[f"w{g}x{i}" for i in range(40)] for g in range(4)]
    text = lambda i: " ".join(r.choices(words[i % 4], k=60))
    rows = [(i, "zzzz " * 60 + text(i) if i == 20 else text(i), ("en", "fr", "de", "es")[i // 2 % 4]) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.query_id, x.unit_id) for x in catalogue.QUERIES["q_lsa_similarity"](spark, str(tmp_path)).collect()}
    assert {u for q, u in got if q == "20"} >= {str(i) for i in range(0, 80, 4)}
    assert {u for _, u in got} >= {str(i) for i in range(0, 80, 4)} and {q for q, _ in got} == {"0", "20", "40", "60"}


def test_search_turns_exact_then_close(spark):
    m = msgs(spark, ("user", "푸른 반지를 찾았다"), ("assistant", "반지가 푸른 빛을 냈다"), ("user", "아무 말"))
    q = spark.createDataFrame([("q", "c", "푸른 반지")], "query_id string, chat_id string, query string")
    got = rank.search_turns(m, q).orderBy("rank").collect()
    assert [(r.turn, r.exact, r.total) for r in got] == [(1, True, 1), (2, False, 1)]


def test_locate_turns(spark):
    m = msgs(spark, ("user", "**푸른 반지**를 찾았다"), ("assistant", "푸른 반지를 찾았다 정말"))
    i = spark.createDataFrame([("a", "c", "m1", ""), ("b", "c", None, "푸른 반지를 찾았다"), ("z", "c", None, "짧다")], "item_id string, chat_id string, message_id string, text string")
    assert {r.item_id: r.turn for r in rank.locate_turns(m, i).collect()} == {"a": 1, "b": 2}


LORE = [
    ("l1", "월광검", ["월광검"], "아린이 쓰는 검은 월광검이다.", None), ("l2", "아린", ["아린"], "아린은 왕국의 기사이다.", None), ("l3", "은열쇠", ["은열쇠"], "은열쇠는 지하 서고를 여는 열쇠다.", [("은열쇠", "여는", "지하 서고")]),
    ("l4", "북쪽 숲", ["북쪽 숲"], "북쪽 숲에는 안개가 낀다.", None),
]


def lore_df(spark, rows=LORE, chat="c"):
    made = [(chat, i, *r, False, True, "both") for i, r in enumerate(rows)]
    return spark.createDataFrame(made, "chat_id string, ins int, id string, title string, keywords array<string>, content string, relations array<struct<subject: string, predicate: string, object: string>>, alwaysInclude boolean, enabled boolean, triggerType string")


def drafts(spark, *rows):
    return spark.createDataFrame([(f"q{i + 1}", "c", d, c, t) for i, (d, c, t) in enumerate(rows)], "query_id string, chat_id string, draft string, recent_context string, turn int")


def test_relations_put_the_weapon_before_its_wielder(spark):
    s = {(r.query_id, r.lore_id): r.score for r in lore.relation_scores(lore.enabled(lore_df(spark)), drafts(spark, ("아린이 쓰는 무기는?", "", None))).collect()}
    assert s["q1", "l1"] > 0.15 and ("q1", "l4") not in s
    got = lore.select_lore(lore_df(spark), drafts(spark, ("아린이 쓰는 무기는?", "", None))).orderBy("place").collect()
    assert {r.lore_id for r in got} >= {"l1", "l2"} and all(r.line.startswith("설정·") for r in got)


def test_facts_after_the_turn_do_not_exist_yet(spark):
    f = facts(spark, ("세라", "세라는 은열쇠를 보관하고 있다.", "인물", "상태", ["세라"], 20))
    at = lambda t: {r.lore_id: r.score for r in lore.relation_scores(lore.enabled(lore_df(spark)), drafts(spark, ("세라는 무엇을 보관했지?", "", t)), f).collect()}
    assert at(25).get("l3", 0) > at(10).get("l3", 0)


def test_baselines(spark):
    f = facts(spark, ("세라", "세라는 은열쇠를 보관하고 있다.", "인물", "상태", ["세라"], 20))
    got = lore.lookup_scores(lore_df(spark), drafts(spark, ("세라는 무엇을 보관했지?", "", 25), ("세라는 무엇을 보관했지?", "", 10)), f).collect()
    assert [(r.query_id, r.lore_id, r.score) for r in got] == [("q1", "l3", 21.0)]
    from recallweave.operators.index import stemmed_terms
    assert spark.createDataFrame([("훈련장에서 Sword 검",)], "t string").select(stemmed_terms("t").alias("v")).first().v == ["훈련장", "sword"]


def test_keyword_only_notes_and_meaning_gate(spark):
    rows = lore_df(spark).withColumn("triggerType", F.when(F.col("id") == "l4", "keyword").otherwise("both"))
    none = lore.select_lore(rows, drafts(spark, ("날씨가 좋다", "", None))).collect()
    assert none == []
    ctx = lore.select_lore(rows, drafts(spark, ("가자", "북쪽 숲에 왔다", None))).collect()
    assert [r.lore_id for r in ctx] == ["l4"]
    sem = spark.createDataFrame([("q1", "l3", 0.9), ("q1", "l1", 0.5), ("q1", "l2", 0.5)], "query_id string, lore_id string, score double")
    got = lore.select_lore(rows, drafts(spark, ("날씨가 좋다", "", None)), semantic=sem).collect()
    assert [(r.lore_id, r.why) for r in got] == [("l3", "의미")]


def test_lore_import_and_relation_lines(spark):
    t = '[{"title":"검","content":"빛난다","keywords":"a, b","relations":[["x","y","z"],["bad"]]},{"title":"빈"}]'
    r = lore.import_lore(spark.createDataFrame([("c", t)], "chat_id string, text string")).collect()
    assert len(r) == 1 and r[0].keywords == ["a", "b"] and r[0].enabled and r[0].relations[0].predicate == "y" and len(r[0].relations) == 1
    v = spark.createDataFrame([("a > 쓰는 > b\nbad",)], "x string").select(lore.parse_relation_lines(F.col("x")).alias("v")).first().v
    assert [(x.subject, x.object) for x in v] == [("a", "b")]


def test_fold_keeps_everything(spark):
    f = facts(
        spark, ("로완", "로완은 왼팔에 깊은 상처를 입었다.", "인물", "상태", ["로완"], 1), ("로완", "로완은 왼팔에 깊은 상처를 입었다.", "인물", "상태", ["로완"], 3), ("로완", "로완은 왼팔에 상처를 입고 쉬었다.", "인물", "상태", ["로완"], 5),
        ("로완", "로완은 루카와 동맹을 맺었다.", "인물", "약속", ["로완", "루카"], 6), ("루카", "루카는 비밀 통로를 알고 있다.", "개념", "비밀", [], 7))
    got = memory.fold_memory(f).collect()
    by = {r.id: r for r in got}
    assert len(got) == 5 and by["f1"].reason == "restated" and by["f1"].by == "f2" and by["f4"].slot == "current" and by["f5"].domain == "인물"
    told = spark.createDataFrame([("c", "f3", "update", "f2"), ("c", "f2", "new", None)], "chat_id string, fact_id string, action string, target string")
    by = {r.id: r for r in memory.fold_memory(f, told).collect()}
    assert by["f1"].slot == "current" and by["f2"].reason == "updated" and by["f2"].by == "f3"


def test_folding_compares_with_sets_of_words_and_keeps_its_order(spark, capsys):
    def plain(rows, limit):
        """The rule over lists: the first of equally near notes that hold, current ones before those that made room."""
        notes, out = [], []
        for id_, kind, words in rows:
            holding = [n for n in notes if n["why"] is None] + [n for n in out if n["why"] == "overflow"]
            share, _, near = max(((len(words & n["w"]) / len(words | n["w"]), -i, n) for i, n in enumerate(holding)), key=lambda x: x[:2], default=(0, 0, None))
            action = "dup" if share >= 0.75 and len(words) >= 3 else "update" if share >= 0.45 and kind == "상태" == near["kind"] else "new"
            me = {"id": id_, "kind": kind, "w": words, "why": None}
            notes.append(me)
            if action != "new":
                gone = me if action == "dup" and near["why"] is None and len(words) < len(near["w"]) else near
                if gone["why"] is None:
                    out.append(gone)
                gone["why"] = "restated" if action == "dup" else "updated"
            while len(now := [n for n in notes if n["why"] is None]) > limit:
                now[0]["why"] = "overflow"
                out.append(now[0])
        return [n["id"] for n in notes if n["why"] is None], [(n["id"], n["why"]) for n in out]

    r = random.Random(9)
    for n in (3, 30, 80):
        rows = [(str(i), r.choice(("상태", "경험")), {f"w{r.randrange(9)}" for _ in range(r.randint(1, 6))}) for i in range(n)]
        rows = [(i, "상태", w) for i, _, w in rows] if n == 30 else [(i, "경험", w) for i, _, w in rows]
        current, history = memory.fold_card([{"id": i, "fact": "", "kind": k, "who": [], "turn": int(i), "words": set(w)} for i, k, w in rows], {})
        assert ([x.id for x in current], [(x.id, x.reason) for x in history]) == plain(rows, 5)
    card = memory.Card()
    for i in range(50):
        card.add(memory.Note(id=str(i), fact="", kind="약속" if i < 5 else "", who=[], turn=1, words={"a", f"b{i % 3}"}))
    assert len(card.current) == 5 and len(card._sets) <= 3
    f = facts(spark, *[("로완", f"로완은 {i} 번째 탑에 올랐다.", "인물", "경험", [], i) for i in range(4)])
    memory.fold_memory(f).explain("formatted")
    assert "FlatMapGroupsInPandas" not in capsys.readouterr().out


def test_fuller_note_stays_and_weakest_overflows():
    w = lambda t: set(t.split())
    a = {"id": "a", "fact": "", "kind": "", "who": [], "turn": 1, "words": w("가 나 다 라 마")}
    b = {"id": "b", "fact": "", "kind": "", "who": [], "turn": 2, "words": w("가 나 다 라")}
    current, history = memory.fold_card([a, b], {})
    assert [n.id for n in current] == ["a"] and history[0].id == "b" and history[0].reason == "restated"
    many = [{"id": str(i), "fact": "", "kind": "약속" if i else "경험", "who": [], "turn": i, "words": {f"{i}a", f"{i}b", f"{i}c"}} for i in range(6)]
    current, history = memory.fold_card(many, {})
    assert [n.id for n in history] == ["0"] and history[0].reason == "overflow" and len(current) == 5


def test_effective_facts(spark):
    f = facts(spark, ("관계", "로완은 루카를 믿는다.", "인물", "관계", [], 1), ("검", "검은 부러졌다.", "기술", "상태", [], 2), ("탑", "탑은 무너졌다.", "장소", "상태", [], 3))
    o = spark.createDataFrame([("c", "f2", 1, None, "검은 고쳐졌다.", None, None, None, None), ("c", "f2", 2, None, "검은 빛났다.", None, None, None, None), ("c", "f3", 3, None, None, None, None, None, True)], "chat_id string, fact_id string, seq long, keyword string, fact string, domain string, enabled boolean, pinned boolean, deleted boolean")
    d = spark.createDataFrame([("c", "없음")], "chat_id string, keyword string")
    assert {(r.keyword, r.fact) for r in memory.effective_facts(f, o, d).collect()} == {("로완", "로완은 루카를 믿는다."), ("검", "검은 빛났다.")}


def test_people_and_witnesses(spark):
    f = facts(
        spark, ("박하린", "박하린은 검을 샀다.", "인물", "상태", ["하린", "나"], 1), ("정신", "정신은 흐려졌다.", "개념", "상태", ["정신"], 2), ("서린", "서린은 탑에 갔다.", "개념", "경험", ["서린"], 3), ("서린", "서린은 돌아왔다.", "개념", "경험", ["서린"], 4))
    p = {(r.name, r.standing) for r in memory.people(f).collect()}
    assert ("박하린", "person") in p and ("서린", "listed") in p and ("서린", "thing") not in p and ("정신", "thing") in p
    w = {r.id: r.witnesses for r in memory.witnesses(f, memory.people(f)).collect()}
    assert w["f1"] in (["하린"], ["박하린"]) and w["f2"] == [] and w["f3"] == ["서린"]


def test_extraction_gates(spark):
    src_ = spark.createDataFrame([("c", 0, 1, "서린은 탑에서 로완에게 은열쇠를 주었다."), ("c", 0, 2, "로완은 은열쇠를 숨겼다. 서린은 웃었다.")], "chat_id string, batch int, turn int, text string")
    raw = """```json
[{"keyword":"은열쇠","kind":"상태","domain":"기술","who":["로완","유령"],"fact":"로완은 은열쇠를 숨겼다."},
 {"keyword":"은열쇠","kind":"상태","domain":"기술","who":[],"fact":"로완은 은열쇠를 숨겼다."},
 {"keyword":"없는것","kind":"상태","domain":"개념","who":[],"fact":"없는것은 사라졌다."},
 {"keyword":"서린","kind":"x","domain":"인물","who":[],"fact":"서린은 로완에게 은열쇠를 주었다."},
 {"keyword":"서린","kind":"상태","domain":"인물","who":[],"fact":"상대는 웃었다."}]
```"""
    a = spark.createDataFrame([("c", 0, "m2", 16, raw)], "chat_id string, batch int, source_id string, limit int, raw string")
    got = {r.keyword: r for r in memory.parse_facts(a, src_).collect()}
    assert set(got) == {"은열쇠", "서린"} and got["은열쇠"].turn == 2 and got["은열쇠"].who == ["로완"] and got["서린"].turn == 1 and got["서린"].kind == "" and got["서린"].domain == "인물"
    bad = spark.createDataFrame([("c", 0, "m2", 16, "모르겠다")], "chat_id string, batch int, source_id string, limit int, raw string")
    assert memory.parse_facts(bad, src_).count() == 0


def test_cards_prefer_the_draft_and_bridge_to_now(spark):
    f = facts(
        spark, ("은열쇠", "로완은 은열쇠를 서고에 숨겼다.", "기술", "상태", ["로완"], 1), ("탑", "탑은 북쪽 숲에 서 있다.", "장소", "설정", [], 2), ("은열쇠", "서린은 은열쇠를 새로 복제해 가졌다.", "기술", "상태", ["서린"], 30), ("로완", "로완은 루카에게 복수를 맹세했다.", "인물", "약속", ["로완"], 4))
    q = spark.createDataFrame([("q1", "c", "서고에 숨긴 은열쇠 기억나?", "", "", None), ("q2", "c", "검?", "", "", None)], "query_id string, chat_id string, draft string, recent_context string, recent_text string, cutoff int")
    got = cards.memory_cards(f, q).orderBy("query_id", "place").collect()
    assert {r.query_id for r in got} == {"q1"} and {r.id for r in got} >= {"nano:f1", "nano:f3"} and "nano:f2" not in {r.id for r in got}
    assert next(r for r in got if r.id == "nano:f1").who == ["로완"]


def test_topics_and_intent(spark):
    f = facts(spark, ("은열쇠", "로완은 은열쇠를 숨겼다.", "기술", "상태", [], 1), ("로완", "로완은 떠났다.", "인물", "상태", [], 2))
    q = spark.createDataFrame([("q1", "c", "은열쇠는?", "로완이 말했다"), ("q2", "c", "그거 왜 했어?", "")], "query_id string, chat_id string, draft string, last_two string")
    assert {(r.topic, r.weight) for r in cards.topics(f, q).filter("query_id = 'q1'").collect()} == {("은열쇠", 1.0), ("로완", 0.5)}
    assert [r.query_id for r in cards.needs_intent(q, f).collect()] == ["q2"]


def test_passages_carry_scene_and_speakers(spark):
    m = msgs(
        spark, ("assistant", "⌛42｜7/21[월] 8일차 낮 13:10 🏢관리국 - 총장실\n서린｜\"오늘은 여기까지 하고 내일 다시 모이도록 하자.\""), ("user", "알겠다고 대답하고 나는 조용히 문을 닫고 나왔다."), ("assistant", "서린｜\"그래, 내일 아침에 훈련장에서 다시 보도록 하지.\""))
    p = segment.passages(m).orderBy("ord").collect()
    assert len(p) == 3 and "관리국" in p[0].scene and p[1].scene == p[0].scene and p[0].speakers == ["서린"]
    assert [r.name for r in segment.passage_names(segment.passages(m)).collect()] == ["서린"]


def test_long_lines_split_outside_quotes():
    line = "그는 말했다. " * 12 + "「절대로 나누지 말아야 할. 아주 긴 대사이다. 정말로 길다.」 그리고 떠났다. " * 4
    parts = segment.split_outside_quotes(line)
    assert "".join(parts).replace(" ", "") == line.replace(" ", "") and all(p.count("「") == p.count("」") for p in parts)


def test_passage_search_prefers_named_and_skips_live(spark):
    rows = [("assistant", f"서린｜\"{i}번째 훈련은 여기까지, 내일은 검술을 다시 연습하자.\"") if i % 2 else ("user", f"{i}번째 날에 나는 숲길을 걸으며 약초를 모았다고 적었다.") for i in range(1, 41)]
    pix = segment.passages(msgs(spark, *rows))
    q = spark.createDataFrame([("q", "c", "서린과 검술 훈련을 다시 하자", "", 39, 400)], "query_id string, chat_id string, draft string, context string, max_turn int, budget int")
    got = passages.passage_search(build_index(pix), segment.passage_names(pix), q).orderBy("place").collect()
    assert got and all(r.turn < 39 and "서린" in r.line for r in got) and [r.turn for r in got] == sorted(r.turn for r in got) and sum(len(r.line) + 1 for r in got) <= 400


def test_graph_chains_and_compaction(spark):
    m = msgs(spark, *[("assistant", f"서린: 「{i}일째 훈련장에서 대련했다.」\n훈련장에서 서린은 고개를 숙이고 약속을 지켰다.") for i in range(24)])
    nodes, edges = graph.evolution_graph(m)
    n = nodes.filter("keyword = '훈련장'").orderBy("turn").collect()
    assert [r.turn for r in n] == [4, 8, 12, 16, 20, 24]
    e = {(r.source, r.target) for r in edges.filter("type = 'evolves_to'").collect()}
    assert ("훈련장@4", "훈련장@8") in e
    kept, kept_edges = graph.compact_graph(nodes, edges, most=10)
    assert sorted(r.turn for r in kept.filter("keyword = '훈련장'").collect()) == [4, 16, 20, 24] and kept_edges.count() < edges.count()
    c = {r.keyword: r for r in graph.evolution_cards(nodes).collect()}
    assert c["훈련장"].domain == "장소" and c["서린"].domain == "인물" and len(c["훈련장"].history) == 3
    gone, _ = graph.drop_keywords(nodes, edges, spark.createDataFrame([("c", "훈련장")], "chat_id string, keyword string"))
    assert gone.filter("keyword = '훈련장'").count() == 0
    text = graph.query_graph(graph.evolution_cards(nodes), spark.createDataFrame([("q", "c", "훈련장")], "query_id string, chat_id string, draft string")).first().text
    assert "[훈련장] 현재 상태" in text


def test_sliding_memory(spark):
    m = msgs(spark, *[("user" if i % 2 == 0 else "assistant", f"{i}: 그는 정원에서 걸음을 멈추고 단호한 목소리로 약속했다.") for i in range(16)])
    d = graph.window_details(graph.reply_windows(m))
    s = graph.sliding_memory(d).first()
    assert s.location == "정원" and "약속" in s.states and len(s.recent) == 2 and "[당면 상황]" in s.prompt


def test_sliding_memory_of_many_chats_is_folded_in_order(spark, capsys):
    one = lambda c, n: [(c, i + 1, f"{c}{i}", "assistant" if i % 2 else "user", f"{i}: 그는 {'정원' if i % 4 < 2 else '서재 탑'}에서 걸음을 멈추고 단호한 목소리로 약속했다.") for i in range(n)]
    m = spark.createDataFrame([r for c in range(40) for r in one(f"c{c:02d}", 4 + c)], "chat_id string, turn int, id string, role string, text string").repartition(7)
    d = graph.window_details(graph.reply_windows(m))
    every = graph.sliding_memory(d)
    got = {r.chat_id: r for r in every.collect()}
    assert len(got) == 40
    for c in ("c00", "c17", "c39"):
        assert got[c] == graph.sliding_memory(d.filter(F.col("chat_id") == c)).first()
    assert [x.split(":")[0] for x in got["c39"].timeline] == ["발단 1~16", "전개 17~36"]
    every.explain("formatted")
    assert "FlatMapGroupsInPandas" not in capsys.readouterr().out


def test_pinned_cards_budget_and_order(spark):
    f = facts(spark, ("가", "가" * 400, "개념", "", [], 1), ("나", "나" * 400, "개념", "", [], 5), ("다", "다" * 100, "개념", "", [], 3)).withColumn("pinned", F.lit(True))
    none = spark.createDataFrame([], "chat_id string, messageId string, turn int, text string, ins long")
    k = spark.createDataFrame([], "chat_id string, keyword string")
    got = memory.pinned_cards(f, none, k, memory.fold_memory(f)).orderBy("place").collect()
    assert [r.id for r in got] == ["nano:f3", "nano:f2"]


def test_memory_cards_of_one_mark_share_a_line(spark):
    q = spark.createDataFrame([("q", "안녕", 2000, None, "장소: 탑")], "query_id string, draft string, budget int, user_note string, overview string")
    c = spark.createDataFrame([("q", 1, "a", "루카", "루카는 검을 샀다.", 14, ["루카"], ""), ("q", 2, "b", "루카", "루카는 탑에 갔다.", 14, ["루카"], ""), ("q", 3, "d", "서린", "서린은 떠났다.", 3, ["서린"], "")], "query_id string, place int, id string, title string, content string, turn int, who array<string>, why string")
    r = context.pack_memory(q, c).first()
    assert [x["line"] for x in r["items"]] == ["[현재 상황] 장소: 탑", "[3 서린] 서린은 떠났다.", "[14 루카] 루카는 검을 샀다. / 루카는 탑에 갔다.", ""]
    assert r.left == r.room - sum(len(x["line"]) for x in r["items"]) - 2


def test_compose_falls_back_when_too_long(spark):
    df = spark.createDataFrame([("안녕", ["줄"], 100), ("가" * 1990, ["줄"], 100), ("안녕", [""], 100)], "d string, l array<string>, t int")
    got = [r.p for r in df.select(context.compose("d", F.col("l"), F.col("t")).alias("p")).collect()]
    assert got[0].startswith("<!--MEMORY-->") and got[0].endswith("안녕") and "100번" in got[0] and got[1] == "가" * 1990 and got[2] == "안녕"


def test_prepare_context_end_to_end(spark):
    rows = [("assistant", f"서린｜\"{i}번째 훈련은 여기까지, 내일은 검술을 다시 연습하자.\"") if i % 2 else ("user", f"{i}번째 날에 나는 숲길을 걸으며 약초를 모았다고 적었다.") for i in range(1, 31)]
    m = msgs(spark, *rows)
    q = spark.createDataFrame([("q", "c", "서린, 월광검으로 검술 훈련을 하자")], "query_id string, chat_id string, draft string")
    plain = context.prepare_context(m, q, lore=lore_df(spark)).first()
    assert {x["type"] for x in plain["items"]} >= {"lore", "passage"} and len(plain.prompt) <= 2000 and plain.prompt.endswith("하자")
    f = facts(spark, ("서린", "서린은 월광검으로 검술을 가르치기로 약속했다.", "인물", "약속", ["서린"], 3))
    full = context.prepare_context(m, q, facts=f, lore=lore_df(spark), boards=spark.createDataFrame([("c", "장소: 훈련장", True)], "chat_id string, text string, enabled boolean")).first()
    assert [x["type"] for x in full["items"]][:2] == ["overview", "summary"] and len(full.prompt) <= 2000


def test_selection_and_switches(spark):
    i = spark.createDataFrame([("q", "안녕 하세요", "lore", "a"), ("q", "안녕 하세요", "lore", "b")], "query_id string, draft string, type string, line string")
    x = spark.createDataFrame([("q", " 안녕  하세요", "lore", "a"), ("q", "다른 글", "lore", "b")], "query_id string, draft string, type string, line string")
    assert [r.line for r in context.selected_for_send(i, x).collect()] == ["b"]
    rooms = spark.createDataFrame([("a", "내 글", True), ("b", None, True), ("d", "x", False)], "chat_id string, note string, note_enabled boolean")
    assert {r.chat_id: r.note for r in context.user_notes(rooms, "공통").collect()} == {"a": "내 글", "b": "공통", "d": ""}


def test_branches_copy_up_to_the_shared_turn(spark):
    a = msgs(spark, *[("user", f"글 {i}") for i in range(8)], chat="a")
    b = msgs(spark, *[("user", f"글 {i}" if i < 5 else f"새 {i}") for i in range(8)], chat="b").withColumn("id", F.concat(F.lit("b"), "id"))
    p = {r.chat_id: (r.origin, r.shared) for r in state.shared_prefixes(a.unionByName(b)).collect()}
    assert p == {"a": ("b", 5), "b": ("a", 5)}
    f = facts(spark, ("x", "하나", "", "", [], 2), ("y", "둘", "", "", [], 7)).withColumn("chat_id", F.lit("a"))
    pins = spark.createDataFrame([("a", "m3", 3, "고정")], "chat_id string, messageId string, turn int, text string")
    br = spark.createDataFrame([("b", "a", 5)], "chat_id string, origin string, shared int")
    ff, pp = state.carry_branch(br, f, pins, b)
    assert [r.id for r in ff.collect()] == ["f1"] and pp.first().messageId == "bm3"


def test_model_names(spark):
    models = spark.createDataFrame([("acme-opal-5",), ("acme-opal-5-5",), ("other-2.5-pro",)], "id string")
    t = spark.createDataFrame([("Opal 5를 쓰는 모드",), ("Opal 5.5 모드",), ("2.5 Pro",), ("Other 2.5 Pro",)], "text string")
    assert [r.model for r in state.model_for_text(t, models).collect()] == ["acme-opal-5", "acme-opal-5-5", None, "other-2.5-pro"]


def test_scores_keep_the_previous_row(spark):
    s = "id string, score double"
    got = state.merge_scores(spark.createDataFrame([("a", 2.0)], s), spark.createDataFrame([("a", 1.0), ("b", 3.0), ("z", 9.0)], s), spark.createDataFrame([("a",), ("b",)], "id string"))
    assert {r.id: r.score for r in got.collect()} == {"a": 2.0, "b": 3.0}


def test_counters_and_backup(spark):
    s = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1), ("2024-01-01 11:00:00", "b", 0)], "ts string, room string, injected int").withColumn("ts", F.to_timestamp("ts"))
    assert {(r.room, r.sends, r.total) for r in state.send_counters(s).collect()} == {(None, 2, True), ("a", 1, False), ("b", 1, False)}
    rows = spark.createDataFrame([("note:a", "1"), ("snap:a", "2")], "key string, value string")
    saved = state.backup(rows, "app")
    assert [r.key for r in saved.collect()] == ["note:a"]
    assert {(r.key, r.value) for r in state.restore(spark.createDataFrame([("note:a", "0"), ("x", "y")], "key string, value string"), saved, "app").collect()} == {("note:a", "1"), ("x", "y")}


def test_evaluation(spark):
    best = spark.createDataFrame([("a", "x", 3.0, 1), ("b", "y", 2.0, 1), ("n", "z", 1.0, 1)], "case_id string, id string, score double, rank int")
    cases = spark.createDataFrame([("a", "x"), ("b", "w"), ("n", None)], "case_id string, gold string")
    t = evaluate.choose_threshold(best, cases).first()
    assert t.threshold == 2.0 and abs(t.accuracy - 2 / 3) < 1e-9 or t.threshold == 3.0
    m = evaluate.selection_metrics(best, cases, 1.5).first()
    assert (m.top1, m.abstained, m.positive) == (1, 1, 2)
    r = spark.createDataFrame([("q", "u1", 2), ("q", "u2", 1)], "query_id string, unit_id string, rank int")
    h = evaluate.hit_rates(r, spark.createDataFrame([("q", "u1")], "query_id string, unit_id string"), spark.createDataFrame([("q",), ("p",)], "query_id string")).first()
    assert (h.hit_1, h.hit_3, h.mrr) == (0, 1, 0.25)


def test_earlier_rules(spark):
    filler = [(f"u{i}", i, f"assistant 글 {i} 그냥 평범한 이야기였다") for i in range(30)]
    u = spark.createDataFrame([("c", "a", 99, "💬 서린 | 은열쇠를 지하서고에 숨겼다 맹세했다")] + [("c", k, o, t) for k, o, t in filler], "chat_id string, unit_id string, ord long, text string").withColumn("message_id", F.col("unit_id")).withColumn("role", F.lit("assistant"))
    from recallweave.operators.index import earlier_terms
    ix = build_index(u, earlier_terms)
    q = spark.createDataFrame([("q", "c", "서린 은열쇠를 지하서고에 숨겼다 기억해?"), ("r", "c", "서린 은열쇠를 지하서고에 숨겼다")], "query_id string, chat_id string, draft string")
    assert [(r.query_id, r.unit_id) for r in earlier.choose(ix, q).collect()] == [("q", "a")]
    m = earlier.match_lore(lore_df(spark), spark.createDataFrame([("q", "c", "아린과 은열쇠")], "query_id string, chat_id string, query string"))
    assert {r.lore_id for r in m.collect()} == {"l2", "l3"}
    t = spark.createDataFrame([("글", ["a"])], "t string, l array<string>").select(earlier.compose_tail("t", F.col("l")).alias("a")).withColumn("b", earlier.compose_tail("a", F.array(F.lit("a")))).first()
    assert t.a == t.b and t.a.startswith("글\n\n")
    s = spark.createDataFrame([("c", 1, "m1", "assistant", None), ("c", 2, "m2", "user", None), ("c", 3, "m3", "assistant", "END"), ("d", 1, "x", "assistant", "writing")], "chat_id string, turn int, id string, role string, status string").withColumn("text", F.lit(""))
    got = {r.chat_id: (r.id, r.problem) for r in earlier.carrier(s).collect()}
    assert got["c"] == ("m1", None) and got["d"][0] is None


def test_vectors_refresh(spark):
    items = spark.createDataFrame([("안녕",), ("새 글",)], "text string")
    stored = items.limit(1).select(F.lit(None).cast("string").alias("x"), "text").withColumn("key", __import__("recallweave.functions.text", fromlist=["text_key"]).text_key("text")).select("key", F.array(F.lit(1.0).cast("float")).alias("vec"))
    got = rank.refresh_vectors(items, stored.unionByName(spark.createDataFrame([("gone:1", [2.0])], "key string, vec array<float>")), lambda s: pd.Series([[float(len(x))] for x in s]))
    assert sorted(r.vec[0] for r in got.collect()) == [1.0, 3.0]


def test_nearest_notes_against_all_pairs(spark):
    r = random.Random(31)
    words = [f"w{i}" for i in range(60)]
    base = [r.sample(words, r.randrange(1, 14)) for _ in range(25)]
    made = [(c, f"{c}{i}", i, r.choice(["상태", "경험", None]), r.sample(x := r.choice(base), max(1, len(x) - r.randrange(3))) + r.sample(["n1", "n2", "n3"], r.randrange(3))) for c in ("a", "b") for i in range(120)]
    made += [("a", "a900", 900, "상태", []), ("a", "a901", 901, "상태", []), ("a", "a902", 902, "상태", made[5][4])]
    d = spark.createDataFrame(made, "card string, id string, place int, kind string, words array<string>")
    want = {}
    for c, i, p, k, w in made:
        near = [(len({*w} & {*v}) / len({*w} | {*v}), -q, j, kk) for cc, j, q, kk, v in made if cc == c and q < p and w and v]
        near = [x for x in near if x[0] >= 0.45]
        if near:
            o, _, j, kk = max(near)
            want[c, i] = (j, round(o, 6), "dup" if o >= 0.75 and len(w) >= 3 else "update" if k == kk == "상태" else "new")
    got = {(x.card, x.id): (x.target, round(x.share, 6), x.action) for x in memory.nearest_notes(d).collect()}
    assert got == want and len(want) > 100 and {x[2] for x in want.values()} == {"dup", "update", "new"}


def test_plain_facts_keep_their_edge_quotes_and_empty_texts(spark):
    f = facts(spark, ("집", "he said \"yes\"", "", "", [], 1), ("집", "", "", "", [], 1), ("방", "x", "", "", [], 1))
    none = spark.createDataFrame([], "chat_id string, fact_id string, seq long, keyword string, fact string, domain string, enabled boolean, pinned boolean, deleted boolean")
    gone = spark.createDataFrame([("c", "방")], "chat_id string, keyword string")
    got = lambda plain: sorted(r.fact for r in memory.effective_facts(f, none, gone, plain=plain).collect())
    assert got(True) == ["", "he said \"yes\""] and got(False) == ["he said \"yes"]
