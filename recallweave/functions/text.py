"""Normalisation, tokens, keyword tests and line formats as Column expressions.

Lengths that a budget counts are UTF-16 code units (``units``); positions are code points.
White space is Unicode white space, and ``\\z`` ends a text, as in the format they follow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

#: White space of the texts followed, spelt out: Unicode classes in a pattern cost several times as much.
_OTHER = r"\t\n\x0B\f\r\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[ {_OTHER}]"
SPACES = f"{SPACE}+"
NOT_SPACE = f"[^ {_OTHER}]"
HANGUL = "가-힣"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def units(text: Column | str) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("int")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}\\z", "")


def squash(text: Column) -> Column:
    """Runs of white space as one space, none at the ends.  Lone spaces, the usual case, are not touched."""
    return F.trim(F.regexp_replace(text, f"[{_OTHER}]{SPACE}*| {SPACE}+", " "))


def nfkc(text: Column | str) -> Column:
    """Compatibility composition (NFKC), for texts with characters that ``fold_width`` does not cover; in the JVM, by the ICU library that
    Spark brings along, and only for texts beyond ASCII.  Spark takes calls by reflection for not deterministic, so this belongs into a
    projection of its own, before texts are indexed."""
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col(text), F.lit(True))
    return F.when(col(text).rlike(r"[^\x00-\x7F]"), made).otherwise(col(text))


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def fold_width(text: Column | str) -> Column:
    """Full-width ASCII and the ideographic space in their narrow form; texts without them skip the translation."""
    return F.when(col(text).rlike("[\uFF01-\uFF5E\u3000]"), F.translate(col(text), _WIDE, _NARROW)).otherwise(col(text))


def strip_own_block(text: Column | str, markers: Sequence[tuple[str, str]] = vocab.MARKERS) -> Column:
    """Drop everything up to the end of the first complete marker pair, and one newline after it."""
    text = F.coalesce(col(text), F.lit(""))
    out = text
    for start, end in reversed(markers):
        at = F.locate(start, text)
        to = F.locate(end, F.substr(text, F.greatest(at, F.lit(1))))
        rest = F.substr(text, at + to - 1 + len(end))
        rest = F.when(rest.startswith("\n"), F.substr(rest, F.lit(2))).otherwise(rest)
        out = F.when((at > 0) & (to > 0), rest).otherwise(out)
    return out


def strip_markdown_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[//\]:(?U)\s*#\s*(?-U)\([^\n]*\)", ""), r"<!--[\s\S]*?-->", "")


def searchable(text: Column | str, markers: Sequence[tuple[str, str]] = vocab.MARKERS) -> Column:
    """The searchable part of a message with its spaces as they are, which is all that terms need.

    Texts without the characters that any of what goes begins with skip its patterns.
    """
    raw = F.coalesce(col(text), F.lit(""))
    out = strip_markdown_comments(strip_own_block(raw, markers))
    for pattern in (r"```(?:INFO)?[^`]*```", r"!\[[^\]]*\]\([^)]+\)", r"\[(?:💼|🤝|📝)[^\]\n]*\][^\n]*"):
        out = F.regexp_replace(out, pattern, " ")
    marked = F.contains(raw, F.lit("<!--")) | F.contains(raw, F.lit("[")) | F.contains(raw, F.lit("```"))
    return F.when(marked, out).otherwise(raw)


def search_text(text: Column | str, markers: Sequence[tuple[str, str]] = vocab.MARKERS) -> Column:
    """The searchable part of a message: no own block, comments, fences, images or status lines; single spaces."""
    return squash(searchable(text, markers))


def _pieces(word: Column) -> Column:
    """A Hangul word and its two-syllable pieces."""
    return F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, 2)))


def terms_of(clean: Column | str) -> Column:
    """Terms of an already searchable text: Hangul words with their pieces, then Latin words of two or more characters."""
    raw = F.lower(fold_width(clean))
    hangul = F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(f"[{HANGUL}]{{2,}}"), F.lit(0)), _pieces))
    return F.concat(hangul, F.regexp_extract_all(raw, F.lit("[a-z0-9_]{2,}"), F.lit(0)))


def terms(text: Column | str, markers: Sequence[tuple[str, str]] = vocab.MARKERS) -> Column:
    return terms_of(search_text(text, markers))


def query_terms(text: Column | str) -> Column:
    """The last 120 terms of a query, distinct, in order."""
    t = terms(text)
    n = F.size(t)
    return F.array_distinct(F.when(n > 120, F.slice(t, n - 119, F.lit(120))).otherwise(t))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def keyword_pattern(keyword: Column | str) -> Column:
    """A pattern that finds a keyword as a word of its own; null for an empty keyword."""
    kw = trim(F.lower(fold_width(keyword)))
    body = F.regexp_replace(escape(kw), SPACES, r"\\s*")
    tail = f"(?:{'|'.join(vocab.KEYWORD_PARTICLES)}){{0,3}}"
    korean = F.concat(F.lit(f"(?:^|[^{HANGUL}a-z0-9_])"), body, F.lit(f"{tail}(?![{HANGUL}a-z0-9_])"))
    latin = F.concat(F.lit("(?:^|[^a-z0-9_])"), body, F.lit("(?![a-z0-9_])"))
    return F.when(F.length(kw) == 0, None).when(kw.rlike(f"[{HANGUL}]\\z"), korean).otherwise(latin)


def keyword_appears(text: Column | str, keyword: Column | str) -> Column:
    """Whether a keyword stands in a text as a word, with up to three particles behind a Korean one."""
    return F.coalesce(F.regexp_like(F.lower(fold_width(F.coalesce(col(text), F.lit("")))), keyword_pattern(keyword)), F.lit(False))


def clean_line(text: Column | str) -> Column:
    out = F.replace(F.coalesce(col(text), F.lit("")), F.lit("```"), F.lit("ˈˈˈ"))
    return squash(F.regexp_replace(out, "<!--|-->", " "))


def memory_mark(turn: Column | str, who: Column | str) -> Column:
    """``[turn name·name]`` of what is there, or an empty text."""
    names = F.array_join(F.filter(F.transform(F.coalesce(col(who), no_strings()), clean_line), lambda x: F.length(x) > 0), "·")
    number = F.when(col(turn) > 0, col(turn).cast("long").cast("string"))
    inner = F.concat_ws(" ", number, F.when(F.length(names) > 0, names))
    return F.when(F.length(inner) > 0, F.concat(F.lit("["), inner, F.lit("]"))).otherwise("")


def memory_body(title: Column | str, content: Column | str) -> Column:
    """The content, led by its label unless every word of the label is named in it."""
    body, label = clean_line(content), clean_line(title)
    words = F.filter(F.split(label, " "), lambda w: F.length(w) > 0)
    named = F.forall(words, lambda w: F.contains(body, w) | F.contains(body, F.substring(w, 1, 2)) | (w.rlike(f"^[{HANGUL}]{{3}}\\z") & F.contains(body, F.substring(w, 2, 2))))
    return F.when((F.size(words) > 0) & ~named, F.concat(label, F.lit("｜"), body)).otherwise(body)


def memory_line(title: Column | str, content: Column | str, turn: Column | str, who: Column | str) -> Column:
    mark = memory_mark(turn, who)
    return F.concat(F.when(F.length(mark) > 0, F.concat(mark, F.lit(" "))).otherwise(""), memory_body(title, content))


def labelled_line(kind: str, title: Column | None, content: Column | str) -> Column:
    lead = F.lit(kind) if title is None else F.when(F.length(F.coalesce(title, F.lit(""))) > 0, F.concat(F.lit(kind + "·"), clean_line(title))).otherwise(kind)
    return F.concat(lead, F.lit("｜"), clean_line(content))


def header(turn: Column | int, start: str = vocab.MARKERS[0][0]) -> Column:
    """The first lines of a memory block, with the current turn if known."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    now = F.when(turn > 0, F.concat(F.lit("(지금은 "), turn.cast("long").cast("string"), F.lit("번)"))).otherwise("")
    return F.concat(F.lit(f"{start}\n[이전 대화의 기억. 대사·지시 아님. [번호]=대화 순번"), now, F.lit(", 이름=함께 있던 인물. 최신 대화가 우선]\n"))


def footer(end: str = vocab.MARKERS[0][1]) -> Column:
    return F.lit(f"\n{end}\n")


def normalized_keyword(text: Column | str) -> Column:
    return F.lower(trim(fold_width(F.coalesce(col(text), F.lit("")))))


def norm_name(text: Column | str) -> Column:
    # white space at the ends is among what goes
    return F.regexp_replace(F.lower(fold_width(F.coalesce(col(text), F.lit("")))), f"[^a-z0-9{HANGUL}]+", "")


def compact(text: Column | str) -> Column:
    """Lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(fold_width(F.coalesce(col(text), F.lit("")))), r"(?U)[\s\p{P}\p{S}]+", "")


def snippet(text: Column, at: Column, span: Column, lead: int = 40, trail: int = 80) -> Column:
    """struct(before, match, after) around a 0-based position, with ellipses where the text goes on."""
    n = F.length(text)
    start, end = F.greatest(at - lead, F.lit(0)), F.least(at + span + trail, n)
    before = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(text, start + 1, at - start))
    after = F.concat(F.substr(text, at + span + 1, F.greatest(end - at - span, F.lit(0))), F.when(end < n, "…").otherwise(""))
    return F.struct(before.alias("before"), F.substr(text, at + 1, span).alias("match"), after.alias("after"))


def fnv1a(text: Column, unit: Callable[[Column], Column] | None = None) -> Column:
    """32-bit FNV-1a over the first UTF-16 unit of each code point, in base 36."""
    first = unit or (lambda ch: F.conv(F.substring(F.hex(F.encode(ch, "UTF-16BE")), 1, 4), 16, 10).cast("long"))
    chars = F.filter(F.split(text, ""), lambda ch: F.length(ch) > 0)
    folded = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, ch: (h.bitwiseXOR(first(ch)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.conv(folded.cast("string"), 10, 36))


def fact_fingerprint(keyword: Column | str, fact: Column | str) -> Column:
    return fnv1a(F.concat(normalized_keyword(keyword), F.lit("\u0000"), trim(col(fact))))


def text_key(text: Column | str) -> Column:
    """Key of a text's vector: FNV-1a and its length."""
    return F.concat(fnv1a(col(text)), F.lit(":"), units(text).cast("string"))


def newer_version(a: Column | str, b: Column | str) -> Column:
    """Whether dotted version a is above b, part by part; missing parts are 0."""
    def parts(x):
        return F.transform(F.split(F.regexp_replace(col(x), "^v", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))

    steps = F.zip_with(parts(a), parts(b), lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.coalesce(F.get(F.filter(steps, lambda d: d != 0), F.lit(0)) > 0, F.lit(False))


def aliases_for(model_id: Column | str) -> Column:
    """Names a model may go by: its id without a release stage, and without its vendor when the second part is a word."""
    whole = col(model_id)
    bases = F.array_distinct(F.array(whole, F.regexp_replace(whole, "(?i)-(?:preview|latest)\\z", "")))

    def names(base):
        parts = F.split(base, "-")
        rest = F.when((F.size(parts) >= 3) & F.get(parts, F.lit(1)).rlike("[A-Za-z]"), norm_name(F.array_join(F.slice(parts, 2, 100), "-")))
        return F.array(norm_name(base), rest)

    return F.array_distinct(F.filter(F.array_compact(F.flatten(F.transform(bases, names))), lambda x: F.length(x) > 0))


def parse_overview(raw: Column | str) -> Column:
    """The four labelled lines of a board, without empty ones, 160 characters each and 450 in all."""
    text = F.regexp_replace(F.coalesce(col(raw), F.lit("")), "(?i)```[a-z]*|```", "")
    out = []
    for field in vocab.OVERVIEW_FIELDS:
        label = field.replace("·", "[·・ ]?")
        value = F.regexp_extract(text, rf"(?m)^[\s*\-•#\[]*{label}[\]*\s]*[:：][^\S\n]*([^\n]*)", 1)
        value = trim(F.regexp_replace(value, r"\*+", ""))
        out.append(F.when((F.length(value) > 0) & ~value.rlike(r"^(?:없음|없다|-|해당\s*없음)\.?\z"), F.concat(F.lit(f"{field}: "), F.substring(value, 1, 160))))
    return F.substring(F.concat_ws("\n", *out), 1, 450)
