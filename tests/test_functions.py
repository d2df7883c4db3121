"""Column functions on small Korean and Latin texts."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from recallweave.functions import facts as fx
from recallweave.functions import text as tx
from recallweave.operators.index import anchor_words, earlier_terms


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values()) or ("",)], ", ".join(f"{k} string" for k in cols) or "x string").select(expr.alias("v")).first().v


def test_terms_count_two_syllable_words_twice(spark):
    assert one(spark, tx.terms("t"), t="마력 훈련장 Sword_1 a") == ["마력", "마력", "훈련장", "훈련", "련장", "sword_1"]


def test_terms_fold_full_width(spark):
    assert one(spark, tx.terms("t"), t="ＡＢＣ　１２") == ["abc", "12"]


def test_nfkc_of_every_code_point(spark):
    """Against Python, code points in short runs so that sequences are composed too; those that this Python does not know are left out."""
    known = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    d = spark.createDataFrame([("".join(known[i : i + 40]),) for i in range(0, len(known), 40)] + [("e\u0301 \u1112\u1161\u11ab \uff21",), ("plain",), ("",), (None,)], "t string")
    for r in d.select("t", tx.nfkc("t").alias("n")).collect():
        assert r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t)), r.t


def test_nfkc(spark):
    assert one(spark, tx.nfkc("t"), t="ﬁ①") == "fi1"


def test_search_text_drops_fences_images_status(spark):
    t = "앞 ```INFO 체력 10``` 중간 ![x](http://a/b) <!-- 숨김 -->\n[💼] 소지품 검\n뒤"
    assert one(spark, tx.search_text("t"), t=t) == "앞 중간 뒤"


def test_own_block_goes_with_what_is_before_it(spark):
    t = "앞<!--MEMORY-->\n기억\n<!--/MEMORY-->\n안녕"
    assert one(spark, tx.strip_own_block("t"), t=t) == "안녕"
    assert one(spark, tx.strip_own_block("t"), t="<!--MEMORY--> 끝 없음") == "<!--MEMORY--> 끝 없음"


@pytest.mark.parametrize(("text", "kw", "want"), [
    ("반지를 꺼냈다", "반지", True), ("반지갑을 샀다", "반지", False), ("크리에게로만 갔다", "크리", True), ("차갑다", "차", False), ("the Ring.", "ring", True), ("ringing", "ring", False),
    ("은 빛 검을 쥐었다", "은빛 검", False), ("은빛검이 울렸다", "은빛 검", True), ("아무거나", "", False), ("값은 a.b 다", "a.b", True), ("값은 axb 다", "a.b", False),
])
def test_keywords_stand_as_words(spark, text, kw, want):
    assert one(spark, tx.keyword_appears("t", "k"), t=text, k=kw) is want


def test_memory_lines(spark):
    who = F.array(F.lit("루카"), F.lit("서린"))
    assert one(spark, tx.memory_mark(F.lit(14), who)) == "[14 루카·서린]"
    assert one(spark, tx.memory_mark(F.lit(0), tx.no_strings())) == ""
    assert one(spark, tx.memory_body(F.lit("박하린"), F.lit("하린이 웃었다"))) == "하린이 웃었다"
    assert one(spark, tx.memory_body(F.lit("월광검"), F.lit("빛을 낸다"))) == "월광검｜빛을 낸다"


def test_fnv(spark):
    assert one(spark, tx.fnv1a(F.lit("ab"))) == "lekqmi"


def test_units_count_surrogates(spark):
    assert one(spark, tx.units("t"), t="a😀b") == 4


def test_versions(spark):
    assert one(spark, tx.newer_version("a", "b"), a="v1.10.0", b="1.9.9") is True
    assert one(spark, tx.newer_version("a", "b"), a="1.2", b="1.2.0") is False


def test_aliases(spark):
    assert one(spark, tx.aliases_for("a"), a="acme-opal-5-preview") == ["acmeopal5preview", "opal5preview", "acmeopal5", "opal5"]
    assert one(spark, tx.aliases_for("a"), a="acme-2.5-pro") == ["acme25pro"]


def test_overview(spark):
    raw = "**장소·동행**: 탑, 루카\n- 진행 중: 없음\n관계： 신뢰\n미해결: 약속"
    assert one(spark, tx.parse_overview("r"), r=raw) == "장소·동행: 탑, 루카\n관계: 신뢰\n미해결: 약속"


def test_snippet(spark):
    s = one(spark, tx.snippet(F.col("t"), F.lit(50), F.lit(3)), t="a" * 50 + "XYZ" + "b" * 100)
    assert (s.before, s.match, s.after) == ("…" + "a" * 40, "XYZ", "b" * 80 + "…")


@pytest.mark.parametrize(("fact", "low"), [
    ("로완은 루카에게 검을 맡겼다.", False), ("레오😠", True), ("걱정해서... 아버지가... 왔다.", True), ("확인되었어요!", True), ("유리팔이 내려오기 직전.", True), ("로완은 화가 난 모양이다.", True), ("그 일에 대한 정보가 없다.", True),
    ("로완은 시선을 던졌다.", True),
])
def test_low_quality_facts(spark, fact, low):
    assert one(spark, fx.low_quality("f"), f=fact) is low


def test_fact_words_and_subject(spark):
    assert one(spark, fx.fact_words("f"), f="박하린은 검을 검을 샀다.") == ["박하린", "샀다"]
    assert one(spark, fx.fact_subject("f"), f="박하린은 검을 샀다.") == "박하린"
    assert one(spark, fx.fact_subject("f"), f="검을 샀다") == ""


def test_names(spark):
    names = F.array(*map(F.lit, ("로완 리드", "로완", "도윤", "김도윤", "🌟서린")))
    assert one(spark, fx.merge_name_variants(names)) == ["로완", "김도윤", "서린"]
    assert one(spark, fx.same_name(F.lit("하린"), F.lit("박하린"))) is True
    assert one(spark, fx.looks_like_name(F.lit("유일"), F.lit("유일한 길. 유일하게 남았다."))) is False
    assert one(spark, fx.looks_like_name(F.lit("서린"), F.lit("서린은 웃었다."))) is True
    assert one(spark, fx.person_in_text(F.lit("박하린"), F.lit("하린이 웃었다."))) is True


def test_preamble(spark):
    assert one(spark, fx.strip_preamble("f"), f="사실: “로완은 떠났다.”") == "로완은 떠났다."
    assert one(spark, fx.strip_preamble("f"), f="누가 ~했다") == ""


def test_verbs_in_order(spark):
    assert one(spark, fx.lore_verbs("t"), t="상처에 쓰는 독") == ["wield", "heal", "poison"]


def test_short_subject(spark):
    assert one(spark, fx.short_subject("d"), d="검은?") == "검"
    assert one(spark, fx.short_subject("d"), d="검을 줘") == ""


def test_speakers(spark):
    assert one(spark, fx.clean_speaker("r"), r="⚠루카｜Lv.1") == "루카"
    assert one(spark, fx.clean_speaker("r"), r="목표") is None
    assert one(spark, fx.clean_speaker("r"), r="GM") is None


def test_earlier_terms(spark):
    assert one(spark, earlier_terms("t"), t="훈련장에서 ab abc") == ["훈련장에서", "훈련장", "훈련", "련장", "장에", "에서", "abc"]
    assert one(spark, anchor_words("t"), t="훈련장에서 훈련장에서 그리고 a") == ["훈련장"]


def test_clip(spark):
    out = one(spark, fx.clip_message(F.col("t"), F.lit(100)), t="가" * 200)
    assert out.startswith("가" * 62 + "\n[중간 생략]\n") and len(out) == 62 + 9 + 30
