"""Tests and rewrites of facts, names and keywords as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import HANGUL, col, compact, escape, fold_width, let, no_strings, normalized_keyword, trim


def _text(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def drop_particle(word: Column, particles: list[str]) -> Column:
    """One trailing particle off a word, the longest that leaves something."""
    return F.regexp_replace(word, f"(?:{'|'.join(particles)})\\z", "")


def fact_words(fact: Column | str) -> Column:
    """Distinct words of a fact without punctuation and one trailing particle, two characters or more."""
    # punctuation goes from the whole text at once, and only texts with Hangul have particles: patterns a word cost several times as much
    plain = F.regexp_replace(F.lower(fold_width(_text(fact))), r"(?U)[\p{P}\p{S}]+", "")

    def words(plain: Column) -> Column:
        each = F.split(plain, r"(?U)\s+")
        return F.when(plain.rlike(f"[{HANGUL}]"), F.transform(each, lambda w: drop_particle(w, vocab.FACT_PARTICLES))).otherwise(each)

    return F.array_distinct(F.filter(let(plain, words), lambda w: F.length(w) >= 2))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays, 0 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def fact_subject(fact: Column | str) -> Column:
    """The first word without its subject particle, or an empty text."""
    return normalized_keyword(F.regexp_extract(trim(_text(fact)), f"^([{HANGUL}]{{2,10}}?)(?:은|는|이|가)(?=(?U)\\s|\\z)", 1))


def same_name(a: Column, b: Column) -> Column:
    """Equal, or one is the other less a leading surname syllable."""
    def given(x, y):
        return x.rlike(f"^[{HANGUL}]{{2,3}}\\z") & (F.length(y) == F.length(x) + 1) & F.endswith(y, x)

    return (a == b) | given(a, b) | given(b, a)


#: Java 17 has no pictograph class; these ranges hold the symbols that decorate names.
PICTOGRAPHS = r"[\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}\x{FE0F}]"


def clean_name(name: Column | str) -> Column:
    return trim(F.regexp_replace(_text(name), f"{PICTOGRAPHS}|[「」『』【】〔〕]", ""))


def merge_name_variants(names: Column) -> Column:
    """Distinct cleaned names, without "X Y" beside X and without a given name beside its full name."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(names, no_strings()), clean_name), lambda x: F.length(x) > 0))
    longer = lambda n, o: n.startswith(F.concat(o, F.lit(" "))) | (n.rlike(f"^[{HANGUL}]{{2,3}}\\z") & (F.length(o) == F.length(n) + 1) & F.endswith(o, n))
    return F.filter(clean, lambda n: ~F.exists(clean, lambda o: (o != n) & longer(n, o)))


def looks_like_name(name: Column, text: Column) -> Column:
    """Not bracketed; for a Hangul word, rarely an adjective stem and somewhere with a person's particle."""
    word = trim(_text(name))
    body = escape(word)
    every = F.regexp_count(text, body)
    stem = F.regexp_count(text, F.concat(body, F.lit(f"(?:{vocab.ADJECTIVAL})")))
    person = F.regexp_like(text, F.concat(body, F.lit(f"(?:{vocab.PERSON_PARTICLES})(?![{HANGUL}])")))
    return F.when(word.rlike("[\\[\\]{}()<>\"'`]"), False).when(~word.rlike(f"^[{HANGUL}]{{2,}}\\z") | (every == 0), True).when(stem / F.nullif(every, F.lit(0)) >= 0.6, False).otherwise(person)


def person_in_text(name: Column, text: Column) -> Column:
    """A name, or a three-syllable one by its last two."""
    word = trim(_text(name))
    return looks_like_name(word, text) | (word.rlike(f"^[{HANGUL}]{{3}}\\z") & looks_like_name(F.substring(word, 2, 2), text))


def short_subject(draft: Column | str) -> Column:
    """The syllable of a one-word draft, less its particle, or an empty text."""
    text = F.regexp_replace(trim(_text(draft)), "[?!.,。！？]+\\z", "")
    return F.regexp_extract(text, f"^([{HANGUL}])(?:은|는|이|가|을|를|의|과|와|에|으로|로|도|만)?\\z", 1)


def strip_preamble(fact: Column | str) -> Column:
    """Template openings and quotes off a fact, three times; a leftover template mark empties it."""
    out = trim(_text(fact))
    for _ in range(3):
        out = F.regexp_replace(out, r"(?U)^(?:누가\s*)?~?\s*(?:라고|이라고)\s*말했다\s*[:：]\s*", "")
        out = F.regexp_replace(out, r"(?iU)^(?:fact|사실|기억|내용|요약)\s*[:：]\s*", "")
        out = trim(F.regexp_replace(out, "^[\"'“‘「『]+|[\"'”’」』]+\\z", ""))
    return F.when(F.contains(out, F.lit("~")), "").otherwise(out)


def low_quality(fact: Column | str, rule_picked: Column | None = None) -> Column:
    """Facts not worth keeping: too short, clipped, copied speech, no predicate, empty, glances, hearsay."""
    text = trim(_text(fact))
    rule = F.lit(False) if rule_picked is None else F.coalesce(rule_picked, F.lit(False))
    return (
        (F.regexp_count(text, F.lit(f"[{HANGUL}]")) < 4) | (F.regexp_count(text, F.lit(r"\.{2,}|…")) >= 2)
        | (~rule & (text.rlike(vocab.SPEECH_END) | ~text.rlike(vocab.PREDICATE_END)))
        | text.rlike(vocab.FOLLOWS) | text.rlike(vocab.NO_INFORMATION) | text.rlike(vocab.GLANCE) | text.rlike(vocab.HEARSAY)
    )


def reaction(fact: Column | str) -> Column:
    return _text(fact).rlike(vocab.REACTION)


def vague_event(fact: Column | str) -> Column:
    return _text(fact).rlike(vocab.VAGUE_EVENT)


def vague_subject(text: Column | str) -> Column:
    return _text(text).rlike(vocab.VAGUE_SUBJECT)


def in_context(fact: Column | str, recent: Column) -> Column:
    """A fact of three words or more of which 80 % stand in the compacted recent text."""
    words = fact_words(fact)
    there = F.size(F.filter(words, lambda w: F.contains(recent, w)))
    return (F.length(recent) > 0) & (F.size(words) >= 3) & (there >= 0.8 * F.size(words))


def kind_weight(kind: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in vocab.KIND_WEIGHTS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(col(kind), F.lit(""))), F.lit(0.0))


def lore_verbs(text: Column | str) -> Column:
    """Verb classes that a text shows, in their fixed order."""
    return F.array_compact(F.array(*(F.when(_text(text).rlike(p), F.lit(name)) for name, p in vocab.VERB_CLASSES)))


def effective_keyword(keyword: Column, fact: Column, set_by_user: Column) -> Column:
    """A kind word written as the keyword gives way to the fact's subject, unless the user set it."""
    subject = fact_subject(fact)
    first = F.substr(trim(fact), F.lit(1), F.length(subject))
    return F.when(trim(keyword).isin(vocab.KIND_WORDS) & ~F.coalesce(set_by_user, F.lit(False)) & (F.length(subject) > 0), first).otherwise(keyword)


def points_back(draft: Column | str) -> Column:
    return _text(draft).rlike(vocab.POINTING)


def clean_sentence(text: Column | str) -> Column:
    """A sentence of a scene: speech marks as "name: …", no emphasis, edge quotes or leading conjunction."""
    out = F.regexp_replace(_text(text), r"(?U)^[▍▌│|]\s*([^\s「『\"“]{1,10})\s*[「『\"“]\s*", "$1: ")
    out = F.regexp_replace(out, r"〔(?U)\s*〕|\*{1,2}", " ")
    out = F.regexp_replace(out, "(?U)^[\"'「『“\\s─–—]+|[\"'」』”\\s─–—]+\\z", "")
    return trim(F.regexp_replace(F.regexp_replace(out, r"(?U)\s{2,}", " "), r"^(?:하지만|그런데|그리고|그러나|그렇지만)(?U)\s*", ""))


def clean_speaker(raw: Column | str, stopwords: list[str] = vocab.STOPWORDS) -> Column:
    """A speaker's name of 2 to 8 characters, or null for labels of the system."""
    name = trim(F.regexp_replace(F.get(F.split(_text(raw), "[｜|]"), F.lit(0)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", ""))

    def kept(s: Column) -> Column:
        label = s.rlike(f"^(?:{'|'.join(vocab.SYSTEM_LABELS)})") | s.rlike(r"(?i)^(?:T-\d+|Turn|턴|SYSTEM|INFO|STATUS|OOC|합계|계산|경험치)")
        latin = ~s.rlike(f"[{HANGUL}]") & s.rlike(r"^[A-Z0-9 _.\-]+\z")
        return F.when(F.length(s).between(2, 8) & ~s.rlike("[0-9]") & ~label & ~latin & ~s.isin(stopwords), s)

    return let(name, kept)


def clean_keyword(raw: Column | str, stopwords: list[str] = vocab.STOPWORDS) -> Column:
    s = drop_particle(trim(_text(raw)), vocab.CARD_PARTICLES)
    return F.when((F.length(s) >= 2) & ~s.isin(stopwords), s)


def clip_message(text: Column, limit: Column) -> Column:
    """A message within a limit: its head, a mark, and the last 30 %."""
    tail = F.floor(limit * 0.3).cast("int")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substr(text, F.lit(1), limit - tail - 8), F.lit("\n[중간 생략]\n"), F.right(text, tail)))
