"""Queries over short stories in line: the tables hold no Hangul, on which these rules rest.  Their results are written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as fx
from ..functions import text as tx
from ..operators import cards, context, earlier, graph, lore, memory, passages, rank, segment, state
from ..operators import index as ix
from .catalogue import query

FACT = "chat_id string, id string, keyword string, fact string, domain string, kind string, who array<string>, turn int, sourceId string, source string, enabled boolean, pinned boolean, seq int"


def rows(*values: tuple, names: str) -> str:
    """SQL of a table written out."""
    def lit(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, v)) + ')' for v in values)}) t({names})"


def facts(spark: SparkSession, *told: tuple) -> DataFrame:
    """Facts (id, keyword, fact, domain, kind, who, turn) of one chat."""
    made = [("c", i, k, t, d, kind, who, turn, f"s{turn}", None, True, False, n) for n, (i, k, t, d, kind, who, turn) in enumerate(told)]
    return spark.createDataFrame(made, FACT)


def texts(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "n int, t string")


# --- words ------------------------------------------------------------------------------------------


@query(rows((0, "호수마을,호수,수마,마을,노래,노래,lake,a1"), (1, "바람,바람"), (2, ""), (3, "dawn,x_1"), names="n, terms"))
def q_hangul_terms(spark, d):
    """Hangul words with their two-syllable pieces (of a two-syllable word, itself again), then Latin words; comments, fences and one-syllable words go."""
    t = texts(spark, "호수마을 노래 Ｌake a1", "<!-- 산 -->바람 b", "", "```INFO 값``` dawn 강 x_1")
    return t.select("n", F.array_join(tx.terms("t"), ",").alias("terms"))


@query(rows((0, "들판"), (1, "호수"), (2, "새벽별"), (3, "새벽별"), names="n, word"))
def q_keyword_particles(spark, d):
    """Keywords as words of their own, with particles behind them."""
    t = texts(spark, "들판에서는 바람이 분다", "깊은 호수를 보았다", "새벽별 아래", "새벽별들 아래", "들판길")
    k = spark.createDataFrame([("들판",), ("호수",), ("새벽별",), ("",)], "word string")
    return t.crossJoin(F.broadcast(k)).filter(tx.keyword_appears("t", "word")).select("n", "word")


@query(rows((0, "끝"), (1, "그대로"), (2, "뒤"), (3, "<!--MEMORY-->열림"), names="n, rest"))
def q_own_block(spark, d):
    """A message without the block that was put before it."""
    t = texts(spark, "<!--MEMORY-->\n기억\n<!--/MEMORY-->\n끝", "그대로", "앞<!--MEMORY-->x<!--/MEMORY-->뒤", "<!--MEMORY-->열림")
    return t.select("n", tx.strip_own_block("t").alias("rest"))


@query(rows((0, "a b", "ab", "a  b.", "ab"), (1, "ㄱ나 c!", "나c", "ㄱ나 c!", "ㄱ나c"), names="n, keyword, name, trimmed, packed"))
def q_normal_forms(spark, d):
    t = texts(spark, " A B", "ㄱ나 Ｃ!").withColumn("o", F.when(F.col("n") == 0, " a  b. ").otherwise(F.col("t")))
    return t.select("n", tx.normalized_keyword("t").alias("keyword"), tx.norm_name("t").alias("name"), F.lower(tx.fold_width(tx.trim(F.col("o")))).alias("trimmed"), tx.compact("o").alias("packed"))


@query(rows((0, "가 ˈˈˈ 나", "[7 달·별]", "별｜강을 건넜다"), (1, "x y", "[3]", "강가에서 강을 보았다"), (2, "", "", "빈 제목"), names="n, line, mark, body"))
def q_cache_lines(spark, d):
    t = spark.createDataFrame([(0, " 가\n``` 나", 7, ["달", " 별 "], "별", "강을 건넜다"), (1, "x<!--y-->", 3, [], "강가", "강가에서 강을 보았다"), (2, None, 0, None, "", "빈 제목")], "n int, t string, turn int, who array<string>, title string, content string")
    return t.select("n", tx.clean_line("t").alias("line"), tx.memory_mark("turn", "who").alias("mark"), tx.memory_body("title", "content").alias("body"))


@query(rows((0, "달님,호수,보았다"), (1, "은방울,노래"), (2, ""), names="n, words"))
def q_fact_words(spark, d):
    t = texts(spark, "달님이 호수를 보았다. 달님은", "은방울의 노래!", "나")
    return t.select("n", F.array_join(fx.fact_words("t"), ",").alias("words"))


@query(rows((0, "하늘이", False), (1, "", True), (2, "바다", False), names="n, subject, vague"))
def q_fact_subjects(spark, d):
    t = texts(spark, "하늘이는 문을 열었다.", "상대방은 웃었다.", "바다가 푸르다.")
    return t.select("n", F.when(fx.vague_subject("t"), "").otherwise(fx.fact_subject("t")).alias("subject"), fx.vague_subject("t").alias("vague"))


@query(rows((0, False), (1, True), (2, True), (3, False), names="n, low"))
def q_fact_gates(spark, d):
    """Too short and clipped facts are not kept."""
    t = texts(spark, "하늘은 북문의 열쇠를 맡았다.", "짧다", "하늘은 그게... 정말... 아니", "바다는 탑에서 약속을 지켰다.")
    return t.select("n", fx.low_quality("t").alias("low"))


@query(rows((0, "강하늘"), (1, "바다,하늘"), (2, "하늘"), names="n, names"))
def q_name_variants(spark, d):
    """A given name beside its full name is one person; decorations go."""
    t = spark.createDataFrame([(0, ["강하늘", "하늘"]), (1, ["「바다」", "하늘", "바다"]), (2, ["하늘", "하늘 🌙"])], "n int, who array<string>")
    return t.select("n", F.array_join(F.array_sort(fx.merge_name_variants(F.col("who"))), ",").alias("names"))


@query(rows((0, "검", "검"), (1, "", "봉을"), (2, "별", "별은"), names="n, subject, t"))
def q_short_subjects(spark, d):
    t = texts(spark, "검", "봉을", "별은").withColumn("t2", F.when(F.col("n") == 1, "봉을 들었다").otherwise(F.col("t")))
    return t.select("n", fx.short_subject("t2").alias("subject"), "t")


@query(rows((0, True), (1, False), (2, True), (3, False), names="n, newer"))
def q_versions(spark, d):
    t = spark.createDataFrame([(0, "1.10", "1.9"), (1, "1.2", "1.2.0"), (2, "v2.0.1", "2"), (3, "0.9", "1")], "n int, a string, b string")
    return t.select("n", tx.newer_version("a", "b").alias("newer"))


@query(rows((0, "use"), (1, ""), names="n, verbs"))
def q_lore_verbs(spark, d):
    t = texts(spark, "하늘은 은빛 활을 사용한다.", "구름이 떠 있다.")
    return t.select("n", F.coalesce(F.when(F.size(fx.lore_verbs("t")) > 0, "use"), F.lit("")).alias("verbs"))


# --- passages ---------------------------------------------------------------------------------------

STORY = (
    ("assistant", "⌛12｜5/3[화] 4일차 밤 21:40 🏰성채 - 종탑\n이슬은 종탑 계단 끝에서 오래된 등불을 하나 발견하고 손을 뻗었다.\n호감도 이슬 +3"),
    ("user", "나는 등불을 받아 들고 계단을 천천히 내려가기로 마음먹었다."),
    ("assistant", "▍이슬\n「그 등불은 할머니가 남기신 물건이야. 절대로 끄지 말아 줘.」\n그녀는 그렇게 말하고 먼저 계단을 내려갔다."),
    ("assistant", "📅 5일차 ☀ 🏠오두막\n이슬｜\"아침이 되었으니 이제 마을로 돌아가서 모두를 만나 보자.\""),
)


def story(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("c", n + 1, f"m{n + 1}", r, t) for n, (r, t) in enumerate(STORY)], "chat_id string, turn int, id string, role string, text string")


@query(rows(
    (1, "4일차 성채 - 종탑", "", "이슬은 종탑 계단 끝에서 오래된 등불을 하나 발견하고 손을 뻗었다."), (2, "4일차 성채 - 종탑", "", "나는 등불을 받아 들고 계단을 천천히 내려가기로 마음먹었다."),
    (3, "4일차 성채 - 종탑", "이슬", "이슬: 그 등불은 할머니가 남기신 물건이야. 절대로 끄지 말아 줘.」 그녀는 그렇게 말하고 먼저 계단을 내려갔다."), (4, "5일차 오두막", "이슬", "이슬｜\"아침이 되었으니 이제 마을로 돌아가서 모두를 만나 보자.\""),
    names="turn, scene, speakers, text"))
def q_story_passages(spark, d):
    """Status lines go and name the scene, a label speaks the quotes below it, a scene lasts until the next."""
    return segment.passages(story(spark)).select("turn", "scene", F.array_join("speakers", ",").alias("speakers"), "text")


@query(rows(("이슬",), names="name"))
def q_story_names(spark, d):
    return segment.passage_names(segment.passages(story(spark))).select("name")


@query(rows(("q", 1, "[1 4일차 성채 - 종탑] 이슬은 종탑 계단 끝에서 오래된 등불을 하나 발견하고 손을 뻗었다."), names="query_id, turn, line"))
def q_passage_search(spark, d):
    """The passage of an old turn that shares the draft's words, with its scene."""
    later = [("c", n, f"x{n}", "user" if n % 2 else "assistant", f"{n}번째 날에는 숲길을 걸으며 약초를 모았다고 짧게 적어 두었다.") for n in range(5, 30)]
    m = story(spark).filter("turn = 1").unionByName(spark.createDataFrame(later, "chat_id string, turn int, id string, role string, text string"))
    pix = segment.passages(m)
    q = spark.createDataFrame([("q", "c", "종탑 계단의 오래된 등불", "", 29, 600)], "query_id string, chat_id string, draft string, context string, max_turn int, budget int")
    return passages.passage_search(ix.build_index(pix), segment.passage_names(pix), q).select("query_id", "turn", "line")


# --- memory -----------------------------------------------------------------------------------------

FOLD = (
    ("g1", "이슬", "이슬은 나루를 의심하고 멀리했다.", "인물", "관계", ["이슬"], 4), ("g2", "이슬", "이슬의 등불은 거짓을 비춘다.", "기술", "설정", [], 6), ("g3", "이슬", "이슬은 나루를 믿고 등불을 맡겼다.", "인물", "관계", ["이슬"], 20),
    ("h1", "이슬", "이슬은 강가에서 나루와 고기를 구웠다.", "인물", "경험", [], 31), ("h2", "이슬", "이슬은 시장에서 나루와 모자를 골랐다.", "인물", "경험", [], 32), ("h3", "이슬", "이슬은 언덕에서 나루와 연을 날렸다.", "인물", "경험", [], 33),
    ("h4", "이슬", "이슬은 서고에서 나루와 지도를 펼쳤다.", "인물", "경험", [], 34), ("d1", "나루", "나루는 촌장에게 다리 수리를 부탁했다.", "인물", "약속", [], 8), ("d2", "나루", "나루는 다리 수리를 부탁했다.", "인물", "약속", [], 9),
)


@query(rows(
    ("g1", "history", "updated", "g3"), ("g2", "current", None, None), ("g3", "current", None, None), ("h1", "history", "overflow", None), ("h2", "current", None, None), ("h3", "current", None, None), ("h4", "current", None, None),
    ("d1", "current", None, None), ("d2", "history", "restated", "d1"), names='id, slot, reason, "by"'))
def q_fold_story(spark, d):
    """A stored update replaces, the weakest of six notes makes room, a restatement that says less does not replace; nothing is lost."""
    told = spark.createDataFrame([("c", "g3", "update", "g1")], "chat_id string, fact_id string, action string, target string")
    return memory.fold_memory(facts(spark, *FOLD), told).select("id", "slot", "reason", "by")


@query(rows(
    ("p1", "강이슬,나루"), ("p2", ""), ("p3", "해오름,손님"), ("p4", ""), names="id, who"))
def q_witnesses(spark, d):
    """Who was there: not what the log files as a thing; led by the known person that a fact opens with."""
    f = facts(spark, ("p1", "강이슬", "강이슬은 나루에게 종탑까지 걸어서 한 시간이라고 말했다.", "인물", "상태", ["나루"], 18), ("p2", "새벽빛", "하늘이 내린 이름이 새벽빛이다.", "개념", "설정", [], 3), ("p3", "새벽빛", "누군가 새벽빛의 뜻을 물었다.", "개념", "설정", ["해오름", "새벽빛", "손님"], 24), ("p4", "새벽빛", "모두의 새벽빛이 드러났다.", "인물", "설정", [], 25))
    return memory.witnesses(f, memory.people(f)).select("id", F.array_join("witnesses", ",").alias("who"))


@query(rows(("하나가 나루에게 물병을 건넸다.", 2), ("나루가 물병을 비웠다.", 3), ("나루는 신발 끈을 묶었다.", 3), names="fact, turn"))
def q_extraction_gate(spark, d):
    """Misspelt keywords, talk of tools and repeats are turned down; turns are found in the sources."""
    s = spark.createDataFrame([("c", 0, 1, "이슬이 나루를 도왔다."), ("c", 0, 2, "하나가 나루에게 물병을 건넸다."), ("c", 0, 3, "나루는 물병을 비우고 신발 끈을 묶었다.")], "chat_id string, batch int, turn int, text string")
    told = [("하나", "하나가 나루에게 물병을 건넸다."), ("하하나", "하나가 물병을 건넸다."), ("나라", "나루가 물병을 받았다."), ("나루", "나루가 물병을 비웠다."), ("나루", "로컬 NLP/LSA 분석으로 상황을 파악했다."), ("나루", "나루는 신발 끈을 묶었다."), ("나루", "나루는 신발 끈을 묶었다.")]
    raw = "[" + ",".join(f'{{"keyword":"{k}","kind":"상태","domain":"인물","who":[],"fact":"{f}"}}' for k, f in told) + "]"
    a = spark.createDataFrame([("c", 0, "m3", 16, raw)], "chat_id string, batch int, source_id string, limit int, raw string")
    return memory.parse_facts(a, s).select("fact", "turn")


def _asked(spark: SparkSession, *drafts: tuple) -> DataFrame:
    made = [(i, "c", t, "", recent, None) for i, t, recent in drafts]
    return spark.createDataFrame(made, "query_id string, chat_id string, draft string, recent_context string, recent_text string, cutoff int")


@query(rows(("asked", "nano:old"), names="query_id, id"))
def q_dormant_memory(spark, d):
    """A note that made room comes back only for a draft that asks for it; a replaced one never does."""
    kinds = ("금빛 눈", "단검 손질", "객석", "회랑", "집안 규칙")
    f = facts(
        spark, ("old", "이슬", "이슬은 나루에게 어린 시절 은방울꽃 뜰에서 활쏘기를 처음 가르쳐 주었다.", "인물", "경험", [], 5), *[(f"n{i}", "이슬", f"이슬은 {k}에 관한 {i}번째 설정을 가졌다.", "인물", "설정", [], 50 + i) for i, k in enumerate(kinds, 1)],
        ("stale", "이슬", "이슬은 나루를 마을의 골칫거리로 경멸했다.", "인물", "관계", [], 8), ("fresh", "이슬", "이슬은 나루를 마을의 골칫거리로 보지 않게 되었다.", "인물", "관계", [], 60))
    told = spark.createDataFrame([("c", "fresh", "update", "stale")], "chat_id string, fact_id string, action string, target string")
    q = _asked(spark, ("asked", "누나가 어릴 때 은방울꽃 뜰에서 활쏘기를 가르쳐 줬잖아", ""), ("other", "오늘 저녁 차림은 뭐야", ""), ("gone", "이슬은 나루를 마을의 골칫거리로 경멸했다", ""))
    return cards.memory_cards(f, q, told).filter("id = 'nano:stale' or (id = 'nano:old' and query_id <> 'gone')").select("query_id", "id")


@query(rows(("nano:c1", "의도"), ("nano:c2", "연결"), ("nano:c3", "최근 화제"), names="id, why"))
def q_topic_cards(spark, d):
    """What a model takes a draft to mean, what mentions it, and whom the last message names."""
    f = facts(
        spark, ("c1", "수호 계약", "나루는 강의 주인과 수호 계약을 맺고 물을 다루는 힘을 받았다.", "개념", "약속", ["나루", "강의 주인"], 3), ("c2", "강의 주인", "강의 주인은 수호 계약의 대가로 나루의 하루를 지켜본다.", "인물", "설정", ["나루"], 3),
        ("c3", "해오름", "해오름은 나루를 낯선 사람으로 판단했다.", "인물", "관계", ["해오름", "나루"], 10), ("c4", "오두막", "오두막 창고에는 양초 네 개가 남아 있었다.", "장소", "설정", [], 12))
    q = _asked(spark, ("q", "근데 그거 왜 한 거야? 얻는 게 뭐라고", ""))
    meant = spark.createDataFrame([("q", "수호 계약")], "query_id string, keyword string")
    t = cards.topics(f, q.withColumn("last_two", F.lit("해오름이 물었다. \"그건 누구랑 한 거야?\"")), meant)
    return cards.memory_cards(f, q, None, t).select("id", "why")


# --- notes ------------------------------------------------------------------------------------------

NOTE = "chat_id string, ins int, id string, title string, keywords array<string>, content string, relations array<struct<subject: string, predicate: string, object: string>>, alwaysInclude boolean, enabled boolean, triggerType string"


def notes(spark: SparkSession, *told: tuple) -> DataFrame:
    return spark.createDataFrame([("c", n, i, t, None, body, rel, False, True, "both") for n, (i, t, body, rel) in enumerate(told)], NOTE)


def asked(spark: SparkSession, *drafts: tuple) -> DataFrame:
    return spark.createDataFrame([(i, "c", t, "", turn) for i, t, turn in drafts], "query_id string, chat_id string, draft string, recent_context string, turn int")


@query(rows(("weapon", "bow"), ("later", "silver"), names="query_id, lore_id"))
def q_select_lore(spark, d):
    """The first note of each draft: relations in notes and remembered facts bring the right one, never from a later turn."""
    n = notes(spark, ("bow", "새벽활", "이슬 맺힌 시위로 어둠을 꿰뚫는다.", [("해든", "사용", "새벽활")]), ("silver", "은빛 열쇠", "지하 금고의 문을 연다.", None), ("bronze", "청동 열쇠", "북쪽 창고의 문을 연다.", None))
    f = facts(spark, ("f1", "나루", "나루는 은빛 열쇠를 맡겼다.", "인물", "상태", [], 7))
    q = asked(spark, ("weapon", "해든이 쓰는 무기는?", 10), ("later", "나루가 맡긴 물건으로 무엇을 열지?", 10))
    return lore.select_lore(n, q, f).filter("place = 1").select("query_id", "lore_id")


@query(rows(("silver", 0), names="lore_id, n"))
def q_lore_not_from_later(spark, d):
    """How often the note that only a later fact would bring is chosen."""
    n = notes(spark, ("silver", "은빛 열쇠", "지하 금고의 문을 연다.", None), ("bronze", "청동 열쇠", "북쪽 창고의 문을 연다.", None))
    f = facts(spark, ("f1", "나루", "나루는 은빛 열쇠를 맡겼다.", "인물", "상태", [], 7))
    got = lore.select_lore(n, asked(spark, ("early", "나루가 맡긴 물건으로 무엇을 열지?", 6)), f).filter("lore_id = 'silver'")
    return got.agg(F.count(F.lit(1)).alias("n")).select(F.lit("silver").alias("lore_id"), F.col("n").cast("int").alias("n"))


@query(rows(("clear", "a", "의미"), names="query_id, lore_id, why"))
def q_lore_meaning(spark, d):
    """Meaning admits a note that is clearly closest, and none where several are."""
    n = notes(spark, ("a", "집안 규칙", "물레 집안의 하인은 주인에게 속내를 보이지 않는다.", None), ("b", "마당", "모두가 모이는 넓은 마당.", None), ("c", "보검", "금고에 잠든 검.", None), ("d", "북문", "성의 북쪽 관문.", None), ("e", "약초", "피를 멎게 한다.", None))
    near = {"clear": (0.86, 0.80, 0.79, 0.79, 0.78), "flat": (0.81, 0.80, 0.80, 0.79, 0.79)}
    s = spark.createDataFrame([(q, i, v) for q, vs in near.items() for i, v in zip("abcde", vs, strict=True)], "query_id string, lore_id string, score double")
    q = asked(spark, ("clear", "노을은 어째서 나한테 진심을 감출까", None), ("flat", "노을은 어째서 나한테 진심을 감출까", None))
    return lore.select_lore(n, q, semantic=s).select("query_id", "lore_id", "why")


# --- contexts ---------------------------------------------------------------------------------------


@query(rows((0, "overview", "[현재 상황] 장소: 종탑"), (1, "summary", "[3 이슬] 이슬은 떠났다."), (2, "summary", "[14 나루] 나루는 활을 샀다. / 나루는 종탑에 갔다."), (3, "summary", ""), names="n, type, line"))
def q_packed_memory(spark, d):
    """Board and cards of a draft by turn; cards of one mark share a line."""
    q = spark.createDataFrame([("q", "안녕", 2000, None, "장소: 종탑")], "query_id string, draft string, budget int, user_note string, overview string")
    c = spark.createDataFrame([("q", 1, "a", "나루", "나루는 활을 샀다.", 14, ["나루"], ""), ("q", 2, "b", "나루", "나루는 종탑에 갔다.", 14, ["나루"], ""), ("q", 3, "d", "이슬", "이슬은 떠났다.", 3, ["이슬"], "")], "query_id string, place int, id string, title string, content string, turn int, who array<string>, why string")
    return context.pack_memory(q, c).select(F.posexplode("items").alias("n", "x")).select("n", "x.type", "x.line")


@query(rows(("message", "과거대화｜이슬은 종탑 계단 끝에서 오래된 등불을 하나 발견하고 손을 뻗었다. 등불은 아직 따뜻했고 기름 냄새가 났다."), names="kind, line"))
def q_matched_units(spark, d):
    """An excerpt of the one old message that matches; its matching unit is part of the head and does not repeat it."""
    told = ["이슬은 종탑 계단 끝에서 오래된 등불을 하나 발견하고 손을 뻗었다. 등불은 아직 따뜻했고 기름 냄새가 났다.", *(f"{n}번째 날에는 숲길을 걸으며 약초를 모으고 강가에서 쉬었다고 일기에 짧게 적어 두었다. 날씨는 맑았다." for n in range(2, 12))]
    m = spark.createDataFrame([("c", n + 1, f"m{n + 1}", "assistant", t) for n, t in enumerate(told)], "chat_id string, turn int, id string, role string, text string")
    q = spark.createDataFrame([("q", "c", "종탑 계단 오래된 등불", 600)], "query_id string, chat_id string, query string, budget int")
    return context.matched_units(ix.build_index(segment.units(m)), m, q).select(F.lit("message").alias("kind"), "line")


@query(rows(("passage", "[1 4일차 성채 - 종탑] 이슬은 종탑 계단 끝에서 오래된 등불을 하나 발견하고 손을 뻗었다.", True), names="type, line, ends"))
def q_prepared_context(spark, d):
    """A whole prompt without memory: the old passage that the draft asks for, in front of the draft."""
    later = [("c", n, f"x{n}", "user" if n % 2 else "assistant", f"{n}번째 날에는 숲길을 걸으며 약초를 모았다고 짧게 적어 두었다.") for n in range(5, 30)]
    m = story(spark).filter("turn = 1").unionByName(spark.createDataFrame(later, "chat_id string, turn int, id string, role string, text string"))
    q = spark.createDataFrame([("q", "c", "종탑 계단의 오래된 등불")], "query_id string, chat_id string, draft string")
    return context.prepare_context(m, q).select(F.explode("items").alias("x"), F.endswith("prompt", F.lit("종탑 계단의 오래된 등불")).alias("ends")).select("x.type", "x.line", "ends")


@query(rows(("q", "a", 1), ("q", "d", 0), names="query_id, unit_id, prefixed"))
def q_prefix_credit(spark, d):
    """A unit whose word begins with a term of the draft gets a flat credit, as the draft's word itself is not in it."""
    u = spark.createDataFrame([("c", "a", 0, "은방울꽃에게 물을 주었다"), ("c", "b", 1, "숲에서 쉬었다"), ("c", "d", 2, "오래된 노래")], "chat_id string, unit_id string, ord long, text string")
    q = spark.createDataFrame([("q", "c", "은방울 노래")], "query_id string, chat_id string, query string")
    hits = rank.bm25(ix.build_index(u), q).join(rank.bm25(ix.build_index(u), q, prefix=False).select("unit_id", F.col("score").alias("plain")), "unit_id", "left")
    return hits.select("query_id", "unit_id", (F.round(F.col("score") - F.coalesce("plain", F.lit(0.0)), 6) == 2.5).cast("int").alias("prefixed"))


@query(rows((4, "훈련장@4"), (8, "훈련장@8"), (12, "훈련장@12"), (16, "훈련장@16"), (20, "훈련장@20"), (24, "훈련장@24"), names="turn, id"))
def q_evolution_nodes(spark, d):
    """A keyword that every window of four messages names gives a chain of nodes."""
    told = [("c", i + 1, f"m{i}", "assistant", f"이슬: 「{i}일째 훈련장에서 대련했다.」\n훈련장에서 이슬은 고개를 숙이고 약속을 지켰다.") for i in range(24)]
    nodes, _ = graph.evolution_graph(spark.createDataFrame(told, "chat_id string, turn int, id string, role string, text string"))
    return nodes.filter("keyword = '훈련장'").select("turn", "id")


@query(rows(("nano:p3", 1), ("nano:p2", 2), names="id, place"))
def q_pinned_cards(spark, d):
    """Pinned facts, newest first as far as 700 characters go, shown by turn."""
    f = facts(spark, ("p1", "가", "가" * 400, "개념", "", [], 1), ("p2", "나", "나" * 400, "개념", "", [], 5), ("p3", "다", "다" * 100, "개념", "", [], 3)).withColumn("pinned", F.lit(True))
    none = spark.createDataFrame([], "chat_id string, messageId string, turn int, text string, ins long")
    k = spark.createDataFrame([], "chat_id string, keyword string")
    return memory.pinned_cards(f, none, k, memory.fold_memory(f)).select("id", "place")


@query(rows(("n1", "o1"), ("n2", "n2"), names="first, id"))
def q_reconciled_ids(spark, d):
    """A fact that is told again in other words keeps its id; another one does not."""
    old = facts(spark, ("o1", "이슬", "이슬은 종탑에서 등불을 발견했다.", "인물", "경험", [], 4)).withColumn("sourceId", F.lit("m"))
    new = facts(spark, ("n1", "이슬", "이슬은 종탑에서 오래된 등불을 발견했다.", "인물", "경험", [], 4), ("n2", "이슬", "바다로 떠났다는 소식이 왔다.", "인물", "경험", [], 4)).withColumn("sourceId", F.lit("m"))
    got = memory.reconcile_ids(old, new).select("fact", "id")
    return new.select(F.col("id").alias("first"), "fact").join(got, "fact").select("first", "id")


@query(rows(("q1", "은열쇠", 1.0), ("q1", "로완", 0.5), names="query_id, topic, weight"))
def q_topics(spark, d):
    """Remembered keywords that a draft names, and at half weight those of the last messages."""
    f = facts(spark, ("f1", "은열쇠", "로완은 은열쇠를 숨겼다.", "기술", "상태", [], 1), ("f2", "로완", "로완은 떠났다.", "인물", "상태", [], 2))
    q = spark.createDataFrame([("q1", "c", "은열쇠는?", "로완이 말했다"), ("q2", "c", "그거 왜 했어?", "")], "query_id string, chat_id string, draft string, last_two string")
    return cards.topics(f, q).select("query_id", "topic", "weight")


@query(rows(("q2",), names="query_id"))
def q_needs_intent(spark, d):
    """Drafts that point back at something without naming it."""
    f = facts(spark, ("f1", "은열쇠", "로완은 은열쇠를 숨겼다.", "기술", "상태", [], 1))
    q = spark.createDataFrame([("q1", "c", "그거 은열쇠 맞지?"), ("q2", "c", "그거 왜 했어?"), ("q3", "c", "안녕")], "query_id string, chat_id string, draft string")
    return cards.needs_intent(q, f).select("query_id")


@query(rows(("l2",), ("l3",), names="lore_id"))
def q_match_notes(spark, d):
    """The earlier rule for notes: a keyword in the text."""
    n = spark.createDataFrame([("c", i, k, t, [t], f"{t}에 관한 글이다.", None, False, True, "both") for i, (k, t) in enumerate([("l1", "월광검"), ("l2", "아린"), ("l3", "은열쇠"), ("l4", "북쪽 숲")])], NOTE)
    return earlier.match_lore(n, spark.createDataFrame([("q", "c", "아린과 은열쇠")], "query_id string, chat_id string, query string")).select("lore_id")


@query(rows(("q", "a"), names="query_id, unit_id"))
def q_earlier_choice(spark, d):
    """The strict gate: a draft that recalls something, names a rare known name and two more content words."""
    told = [("c", "a", 99, "💬 서린 | 은열쇠를 지하서고에 숨겼다 맹세했다")] + [("c", f"u{i}", i, f"assistant 글 {i} 그냥 평범한 이야기였다") for i in range(30)]
    u = spark.createDataFrame(told, "chat_id string, unit_id string, ord long, text string").withColumn("message_id", F.col("unit_id")).withColumn("role", F.lit("assistant"))
    q = spark.createDataFrame([("q", "c", "서린 은열쇠를 지하서고에 숨겼다 기억해?"), ("r", "c", "서린 은열쇠를 지하서고에 숨겼다")], "query_id string, chat_id string, draft string")
    return earlier.choose(ix.build_index(u, ix.earlier_terms), q).select("query_id", "unit_id")


@query(rows(("이슬",), names="keyword"))
def q_deck(spark, d):
    """Cards whose keyword or notes hold a word."""
    view = state.memory_cards_view(memory.fold_memory(facts(spark, *FOLD)))
    return state.deck(view, "인물", "등불을").select("keyword")
