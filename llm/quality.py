"""Quality rules as a short-circuit cascade.

Each rule looks at one document and rejects it or passes it on.  On a bounded,
deterministic sample every rule is run on every document, which gives its cost
(seconds a document) and its rejection rate among documents; rules then run in
descending order of rejection per cost, and a document leaves the cascade at the
first rule that rejects it.  The verdict is "no rule rejects", so it does not
depend on the order; only the work done does.

Defined cases: a null or empty text has no words, fails the base rules and is
rejected; repeated rows are judged one by one; a very long text is read whole; rules of
equal gain run in the order of their names; extra columns pass through ``quality_filter``
untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SAMPLE_ROWS = 400
SAMPLE_CHARS = 200_000

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


class Measured:
    """One text and what the rules share; each count is made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = _WORDS.findall(self.text)
        self._made: dict[str, int] = {}

    def __getattr__(self, name: str) -> int:
        made = getattr(type(self), "_" + name)(self)
        self.__dict__[name] = made
        return made

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return sum(map(len, self.words))

    def _n_symbols(self) -> int:
        return len(_SYMBOLS.findall(self.text))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORDS.search(x)]

    def _n_dup_lines(self) -> int:
        lines = self.lines
        return len(lines) - len(set(lines))

    def _n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        covered = bytearray(len(w))
        for i, x in enumerate(windows):
            if counts[x] > 1:
                covered[i : i + 3] = b"\1\1\1"
        return sum(covered)

    def _n_upper_words(self) -> int:
        return sum(map(str.isupper, self.words))

    def _n_shouts(self) -> int:
        return self.text.count("!")

    def _n_with_letter(self) -> int:
        return sum(any(map(str.isalpha, w)) for w in self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


#: All exact integer tests, so that SQL can state them too.
RULES = (
    Rule("few_words", lambda m: m.n_words < MIN_WORDS),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > MAX_REPEATED_PERCENT * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("dup_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    Rule("shouting", lambda m: 2 * m.n_upper_words > m.n_words or 5 * m.n_shouts > m.n_words),
    Rule("no_letters", lambda m: 10 * m.n_with_letter < 7 * m.n_words),
)
BASE = {"few_words", "repeated_words"}


def plan(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejection per cost, from about ``rows`` documents whose row hashes fall in a share of rows / count.

    Rows may be alike, so twice as many are the most taken, and none above SAMPLE_CHARS: the sample is bounded in rows and bytes.
    It only sets the order.
    """
    share = rows / max(1, docs.count())
    plain = [f"`{f.name}`" for f in docs.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))]
    hashed = F.pmod(F.xxhash64(*plain), F.lit(1 << 40))
    some = docs.filter((hashed < int(min(1.0, share) * (1 << 40))) & (F.coalesce(F.length(f"`{text}`"), F.lit(0)) <= SAMPLE_CHARS))
    texts = [r.t for r in some.select(F.col(f"`{text}`").alias("t")).limit(2 * rows).collect()]
    gain = {}
    for rule in RULES:
        fresh = [Measured(t) for t in texts]
        began = time.perf_counter()
        rejected = sum(rule.rejects(m) for m in fresh)
        gain[rule.name] = rejected / max(time.perf_counter() - began, 1e-9)
    return sorted(gain, key=lambda k: (-gain[k], k))


def judge(text: str | None, order: list[Rule], base: bool) -> tuple:
    """With base, the base counts are filled in for rejected documents too; else they stay null where the cascade never asked."""
    m = Measured(text)
    failed = next((r.name for r in order if r.rejects(m)), None)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    counts = [getattr(m, n) for n in names] if base else [m.__dict__.get(n) for n in names]
    base_failed = any(r.rejects(m) for r in RULES if r.name in BASE) if base else (failed in BASE if failed else False)
    return (*counts, base_failed, failed is None, failed)


def quality_rules(docs: DataFrame, text: str = "text", base: bool = True, order: list[str] | None = None) -> DataFrame:
    """docs with the columns of SCHEMA in struct ``quality`` (an input column of that name is replaced).

    One narrow pass: no shuffle, and memory for one Arrow batch.
    """
    by_name = {r.name: r for r in RULES}
    chosen = [by_name[n] for n in (order or plan(docs, text))]
    kind = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])
    names = [kind.field(i).name for i in range(kind.num_fields)]
    small_batches(docs)
    docs = docs.select(*(c for c in docs.columns if c != "quality"))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [dict(zip(names, judge(t.as_py(), chosen, base), strict=True)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*batch.schema.names, "quality"])

    schema = T.StructType([*docs.schema.fields, T.StructField("quality", T._parse_datatype_string(SCHEMA))])
    return docs.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns, whatever their names."""
    small_batches(docs)
    by_name = {r.name: r for r in RULES}
    chosen = [by_name[n] for n in plan(docs, text)]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py(), chosen, False)[6] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    judged = quality_rules(docs.select("doc_id", "text"), base=True)
    q = "quality."
    return judged.select("doc_id", q + "n_words", q + "word_chars", q + "n_symbols", q + "n_dup_lines", q + "n_repeat_words", q + "base_failed", q + "kept")


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_W} AS ws FROM documents),
t AS (SELECT *, len(ws) AS n_words,
        list_sum([length(x) FOR x IN ws]) AS chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls,
        [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] AS tri FROM w),
g AS (SELECT rid, unnest(tri) AS x, unnest(range(1, len(tri) + 1)) AS i FROM t),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT t.*, coalesce(c.n, 0) AS rep, len(ls) - len(list_distinct(ls)) AS dup,
        len([x FOR x IN ws IF x = upper(x) AND x <> lower(x)]) AS up,
        len([x FOR x IN ws IF regexp_matches(x, '\\pL')]) AS letters,
        length(text) - length(replace(text, '!', '')) AS shouts FROM t LEFT JOIN c USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * rep > {MAX_REPEATED_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * rep > {MAX_REPEATED_PERCENT} * n_words OR 10 * n_symbols > n_words
    OR 2 * dup > len(ls) OR chars < 2 * n_words OR chars > 20 * n_words
    OR 2 * up > n_words OR 5 * shouts > n_words OR 10 * letters < 7 * n_words) AS kept
FROM m
"""
