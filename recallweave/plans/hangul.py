"""Queries of the Hangul rules over whole given tables: the letters of every conversation are written as syllables by one fixed map,
in Spark and in SQL alike, so that words, pieces, particles, subjects and prefixes are there to be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import facts as fx
from ..functions import text as tx
from ..operators import rank
from ..operators.index import build_index
from ..sources import messages as src
from . import retrieval
from .catalogue import MESSAGES, bm25, clean, query

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Syllables of these letters; particles are among them, so that words end in some.
SYLLABLES = "이별달다는풀가하을종강를만은에품칼로도고과불와샘의집"

STORY = f"{MESSAGES}, h AS (SELECT chat_id, id, turn, role, translate(lower(text), '{LETTERS}', '{SYLLABLES}') AS text FROM msg)"


def story(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.messages(spark, d).withColumn("text", F.translate(F.lower("text"), LETTERS, SYLLABLES))


def _terms(x: str) -> str:
    pieces = "list_concat([w], list_transform(range(1, greatest(length(w) - 1, 1) + 1), lambda i: substr(w, i, 2)))"
    return f"list_concat(flatten(list_transform(regexp_extract_all({clean(x)}, '[가-힣]{{2,}}'), lambda w: {pieces})), regexp_extract_all({clean(x)}, '[a-z0-9_]{{2,}}'))"


def _any(words) -> str:
    return "|".join(words)


@query(f"WITH {STORY}, t AS (SELECT chat_id, id, unnest({_terms('text')}) AS term FROM h) SELECT id AS unit_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL")
def q_story_terms(spark, d):
    """Hangul words of all messages with their two-syllable pieces."""
    return build_index(story(spark, d).withColumnRenamed("id", "unit_id"), whole=True).postings.select("unit_id", "term", "tf")


@query(f"""WITH {STORY}, t AS (SELECT chat_id, id, turn, role, {_terms('text')} AS w FROM h), each AS (SELECT chat_id, id, unnest(w) AS term FROM t), post AS (SELECT chat_id, id, term, count(*) AS tf FROM each GROUP BY ALL),
dfs AS (SELECT chat_id, term, count(*) AS df FROM post GROUP BY ALL), stat AS (SELECT chat_id, count(*) AS n, greatest(1.0, avg(len(w))) AS avg_length FROM t GROUP BY ALL), lens AS (SELECT chat_id, id, len(w) AS length FROM t),
q AS (SELECT chat_id, id AS query_id, unnest(list_distinct(list_slice(w, -120, -1))) AS term FROM t WHERE role = 'user'),
near AS (SELECT DISTINCT q.query_id, q.chat_id, p.id, q.term FROM q JOIN post p ON p.chat_id = q.chat_id AND starts_with(p.term, q.term) AND p.term <> q.term AND length(p.term) >= 3 WHERE regexp_full_match(q.term, '[가-힣]{{3,}}')),
gain AS (SELECT query_id, id, {bm25()} AS g FROM q JOIN post USING (chat_id, term) JOIN dfs USING (chat_id, term) JOIN stat USING (chat_id) JOIN lens USING (chat_id, id)
  UNION ALL SELECT query_id, id, {vocab.PREFIX_CREDIT} FROM near WHERE NOT EXISTS (SELECT 1 FROM post p WHERE p.chat_id = near.chat_id AND p.id = near.id AND p.term = near.term))
SELECT query_id, id AS unit_id, round(sum(g), 6)::DOUBLE AS score, count(*)::BIGINT AS n_matched FROM gain GROUP BY ALL""")
def q_story_ranking(spark, d):
    """Every user message asks its conversation: words, pieces, and credit for longer words with the same beginning."""
    m = story(spark, d)
    ix = build_index(m.withColumnRenamed("id", "unit_id").withColumn("ord", F.col("turn").cast("long")), whole=True)
    asked = m.filter("role = 'user'").select(F.col("id").alias("query_id"), "chat_id", F.col("text").alias("query"))
    return rank.bm25(ix, asked, words=False).select("query_id", "unit_id", F.round("score", 6).alias("score"), F.col("n_matched").cast("long").alias("n_matched"))


@query(f"""WITH {STORY}, k AS (SELECT DISTINCT chat_id, regexp_extract(text, '[가-힣]{{3,}}') AS kw FROM h)
SELECT DISTINCT id, kw FROM h JOIN k USING (chat_id) WHERE length(kw) > 0 AND regexp_matches(text, '(?:^|[^가-힣a-z0-9_])' || kw || '(?:{_any(vocab.KEYWORD_PARTICLES)}){{0,3}}(?:[^가-힣a-z0-9_]|$)')""")
def q_story_keywords(spark, d):
    """The first long word of every message as a keyword of its conversation, with particles behind it."""
    m = story(spark, d)
    k = m.select("chat_id", F.regexp_extract("text", "[가-힣]{3,}", 0).alias("kw")).filter("length(kw) > 0").distinct()
    return m.join(k, "chat_id").filter(tx.keyword_appears("text", "kw")).select("id", "kw").distinct()


@query(f"""WITH {STORY} SELECT id, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text ELSE '<!--MEMORY-->' || text END AS rest FROM h""")
def q_story_own_block(spark, d):
    """Messages behind a whole block, without one, and behind one that does not end."""
    k = F.col("turn") % 3
    with_block = F.when(k == 0, F.concat(F.lit("before<!--MEMORY-->\n"), "id", F.lit("\n<!--/MEMORY-->\n"), "text")).when(k == 1, F.col("text")).otherwise(F.concat(F.lit("<!--MEMORY-->"), "text"))
    return story(spark, d).select("id", tx.strip_own_block(with_block).alias("rest"))


@query(f"""WITH {STORY} SELECT id, lower(trim(text)) AS keyword, regexp_replace(lower(text), '[^a-z0-9가-힣]', '', 'g') AS name, regexp_replace(lower(text), '[\\s\\p{{P}}\\p{{S}}]+', '', 'g') AS packed FROM h""")
def q_story_normal_forms(spark, d):
    return story(spark, d).select("id", tx.normalized_keyword("text").alias("keyword"), tx.norm_name("text").alias("name"), tx.compact("text").alias("packed"))


_FACT_WORDS = f"list_sort(list_distinct(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: regexp_replace(regexp_replace(lower(w), '[\\s\\p{{P}}\\p{{S}}]+', '', 'g'), '(?:{_any(vocab.FACT_PARTICLES)})$', '')), lambda w: length(w) >= 2)))"


@query(f"WITH {STORY} SELECT id, array_to_string({_FACT_WORDS}, ',') AS words FROM h")
def q_story_fact_words(spark, d):
    """The words of each message as a fact: without punctuation and one particle."""
    return story(spark, d).select("id", F.array_join(F.array_sort(fx.fact_words("text")), ",").alias("words"))


@query(f"""WITH {STORY}, s AS (SELECT id, unnest(regexp_split_to_array(text, '[.!?]\\s+')) AS s FROM h), d AS (SELECT DISTINCT s FROM s)
SELECT s, lower(regexp_extract(trim(s), '^([가-힣]{{2,10}}?)(?:은|는|이|가)(?:\\s|$)', 1)) AS subject, regexp_matches(s, '{vocab.VAGUE_SUBJECT}') AS vague FROM d""")
def q_story_subjects(spark, d):
    """The subject of every sentence."""
    s = story(spark, d).select(F.explode(F.split("text", r"[.!?]\s+", -1)).alias("s")).distinct()
    return s.select("s", fx.fact_subject("s").alias("subject"), fx.vague_subject("s").alias("vague"))


#: Endings and openings that the gates of facts look for, one or none a message.
_ENDS = ("", " 문을 열었다.", " 알았습니다.", " 그렇더라.", " 정보가 없음.", " 다음과 같이 말했다.", " 미소를 지었다.", " 그게... 정말... 다", " 문을 엶")


def _gate(t: str) -> str:
    hit = " OR ".join(f"regexp_matches({t}, '{p}')" for p in (vocab.FOLLOWS, vocab.NO_INFORMATION, vocab.GLANCE, vocab.HEARSAY, vocab.SPEECH_END))
    return f"length(regexp_replace({t}, '[^가-힣]', '', 'g')) < 4 OR len(regexp_extract_all({t}, '\\.{{2,}}|…')) >= 2 OR {hit} OR NOT regexp_matches({t}, '{vocab.PREDICATE_END}')"


@query(f"""WITH {STORY}, e AS (SELECT id, trim(text || [{', '.join(repr(x) for x in _ENDS)}][(length(text) % {len(_ENDS)} + 1)::INT], ' ' || chr(9) || chr(10) || chr(13)) AS t FROM h) SELECT id, ({_gate('t')}) AS low FROM e""")
def q_story_fact_gates(spark, d):
    """Which messages, with one of several endings, are no facts worth keeping."""
    end = F.element_at(F.lit(list(_ENDS)), (F.length("text") % len(_ENDS) + 1).cast("int"))
    return story(spark, d).select("id", fx.low_quality(F.concat("text", end)).alias("low"))


_SHORT = "은|는|이|가|을|를|의|과|와|에|으로|로|도|만"


@query(f"""WITH {STORY}, w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS w FROM h)
SELECT w, regexp_extract(regexp_replace(w, '[?!.,。！？]+$', ''), '^([가-힣])(?:{_SHORT})?$', 1) AS subject FROM w""")
def q_story_short_subjects(spark, d):
    """Every word as a draft of its own: one syllable and its particle."""
    w = story(spark, d).select(F.explode(F.split("text", r"\s+", -1)).alias("w")).distinct()
    return w.select("w", fx.short_subject("w").alias("subject"))


@query(f"""WITH {STORY}, v AS (SELECT id, text || [{', '.join(repr(' ' + p.split('|')[0]) for _, p in vocab.VERB_CLASSES)}][turn % {len(vocab.VERB_CLASSES)} + 1] AS t FROM h)
SELECT id, array_to_string([x for x in [{', '.join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in vocab.VERB_CLASSES)}] if x IS NOT NULL], ',') AS verbs FROM v""")
def q_story_verbs(spark, d):
    """Classes of verbs that messages show; each gets one word of a class."""
    word = F.element_at(F.lit([" " + p.split("|")[0] for _, p in vocab.VERB_CLASSES]), (F.col("turn") % len(vocab.VERB_CLASSES) + 1).cast("int"))
    return story(spark, d).select("id", F.array_join(fx.lore_verbs(F.concat("text", word)), ",").alias("verbs"))


@query(f"""WITH {STORY}, l AS (SELECT chat_id, array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 1, 2), ' ') AS title FROM h WHERE turn = 1),
c AS (SELECT id, turn, role, title, trim(regexp_replace(replace(text, '```', 'ˈˈˈ'), '\\s+', ' ', 'g')) AS body FROM h JOIN l USING (chat_id))
SELECT id, '[' || turn || ' ' || role || ']' AS mark, CASE WHEN len(list_filter(string_split(title, ' '), lambda w: length(w) > 0)) > 0
  AND len(list_filter(string_split(title, ' '), lambda w: length(w) > 0 AND NOT (contains(body, w) OR contains(body, left(w, 2)) OR regexp_full_match(w, '[가-힣]{{3}}') AND contains(body, substr(w, 2, 2))))) > 0 THEN title || '｜' || body ELSE body END AS body FROM c""")
def q_story_lines(spark, d):
    """Each message as a line of memory under the first two words of its conversation."""
    m = story(spark, d)
    title = m.filter("turn = 1").select("chat_id", F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), " ").alias("title"))
    return m.join(title, "chat_id").select("id", tx.memory_mark("turn", F.array("role", F.lit(" "))).alias("mark"), tx.memory_body("title", "text").alias("body"))


@query("""SELECT l_orderkey, l_linenumber, (l_suppkey > l_partkey % 100 OR l_suppkey = l_partkey % 100 AND l_linenumber > 3) AS newer FROM lineitem""")
def q_line_versions(spark, d):
    """Dotted versions of whole lines: supplier and line number against part and 3."""
    li = src.read_table(spark, d, "lineitem")
    a = F.concat(F.lit("v"), F.concat_ws(".", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")))
    b = F.concat_ws(".", (F.col("l_partkey") % 100).cast("string"), F.lit("3"), F.lit("0"))
    return li.select("l_orderkey", "l_linenumber", tx.newer_version(a, b).alias("newer"))
