"""Fill-in-the-middle transformation by in-place block rotation.

A text of n code points is cut twice, at places that the sha256 of a seed and the document's id
give.  The text's bytes are scanned for the cuts, the sentinels go into a bytearray before their
parts, ``<P>prefix<M>middle<S>suffix``, and the parts change places where they are: two adjacent
blocks are exchanged by reversing each and then both together.  Prefix-suffix-middle rotates
the last two blocks; suffix-prefix-middle rotates the last block before the first two.
Rotating back and taking the sentinels out restores the text exactly.

Ids and seed give four numbers h1 to h4, the first 8-digit groups of hex sha256(seed:id).  The cuts are
h1 % (n + 1) and h2 % (n + 1), the smaller first; h3 % 100 below ``rate`` transforms a text, and
of these h4 % 100 below ``suffix_first`` puts the suffix first.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel already, stays
plain; a null doc_id is hashed as an empty one; repeated rows get equal results; a very long text is
rotated in the memory that it takes, with blocks of SWAP bytes beside it; cuts may fall together or on
an end, which gives empty parts; other columns pass through, one that has the name of the result is
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 1, 90, 20
SWAP = 1 << 16


class Sentinels:
    """The marks of prefix, suffix and middle.  Their first character stands nowhere else in them, so that no mark can arise where
    a text meets one."""

    def __init__(self, prefix: str = PREFIX, suffix: str = SUFFIX, middle: str = MIDDLE):
        marks = (prefix, suffix, middle)
        if len(set(marks)) < 3 or any(not m or m[0] in x[1:] for m in marks for x in marks):
            raise ValueError("sentinels have to differ, and their first characters may not stand inside them")
        if any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("no sentinel may begin with another")
        self.texts = marks
        self.prefix, self.suffix, self.middle = (m.encode() for m in marks)


def reverse(part: np.ndarray) -> None:
    """Reverses bytes in place, a block from each end at a time."""
    n = len(part)
    for at in range(0, n // 2, SWAP):
        width = min(SWAP, n // 2 - at)
        head, tail = part[at : at + width], part[n - at - width : n - at]
        kept = head[::-1].copy()
        head[:] = tail[::-1]
        tail[:] = kept


def rotate(data: bytearray, begin: int, border: int, end: int) -> None:
    """Exchanges the blocks [begin, border) and [border, end) by three reversals."""
    view = np.frombuffer(data, np.uint8)
    reverse(view[begin:border])
    reverse(view[border:end])
    reverse(view[begin:end])


def cut_bytes(raw: bytes, first: int, second: int) -> tuple[int, int]:
    """Byte offsets of two cuts given in code points."""
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    at = lambda k: int(starts[k]) if k < len(starts) else len(raw)
    return at(first), at(second)


def arrange(raw: bytes, form: str, first: int, second: int, s: Sentinels) -> bytearray:
    """The text with sentinels, its parts in the order of the form."""
    data = bytearray(raw)
    if form == "plain":
        return data
    a, b = cut_bytes(raw, first, second)
    data[b:b] = s.suffix
    data[a:a] = s.middle
    data[0:0] = s.prefix
    a += len(s.prefix)
    b += len(s.prefix) + len(s.middle)
    rotate(data, a if form == "psm" else 0, b, len(data))
    return data


def restore(raw: bytes, form: str, s: Sentinels) -> bytearray:
    """The text that ``arrange`` was given, from its result alone."""
    data = bytearray(raw)
    if form == "plain":
        return data
    if form == "psm":
        border, last = data.find(s.suffix), data.find(s.middle)
        rotate(data, border, last, len(data))
        a, b = border, border + len(data) - last
    else:
        border = data.find(s.prefix)
        a, b = data.find(s.middle) - border, len(data) - border
        rotate(data, 0, border, len(data))
    del data[b : b + len(s.suffix)]
    del data[a : a + len(s.middle)]
    del data[: len(s.prefix)]
    return data


def _strings(rows: list[bytearray]) -> pa.Array:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(b"".join(rows))).cast(pa.string())


def _raw(texts: pa.Array) -> list[bytes]:
    return texts.fill_null("").cast(pa.binary()).to_pylist()


def hash_group(seed: int, doc_id: Column, k: int) -> Column:
    """The k-th 8-digit group of hex sha256(seed:id) as a number."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(h, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", into: str = "fim", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: Sentinels | None = None) -> DataFrame:
    """docs with a struct of n, form (plain, psm, spm), prefix_chars, middle_chars (null where plain) and the output text."""
    s = sentinels or Sentinels()
    small_batches(docs)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n = F.length(whole).cast("long")
    h = [hash_group(seed, F.col(f"`{doc_id}`"), k) for k in (1, 2, 3, 4)]
    first, second = F.least(h[0] % (n + 1), h[1] % (n + 1)), F.greatest(h[0] % (n + 1), h[1] % (n + 1))
    holds = F.contains(whole, F.lit(s.texts[0])) | F.contains(whole, F.lit(s.texts[1])) | F.contains(whole, F.lit(s.texts[2]))
    form = F.when((n == 0) | holds | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    out = F.arrow_udf(lambda t, f, a, b: _strings([arrange(x, *k, s) for x, *k in zip(_raw(t), f.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True)]), "string")
    cut = docs.withColumn(into, F.struct(n.alias("n"), form.alias("form"), first.alias("first"), second.alias("second")))
    of = lambda k: F.col(f"`{into}`.{k}")
    moved = cut.withColumn(into, F.struct(*[of(k) for k in ("n", "form", "first", "second")], out(F.col(f"`{text}`"), of("form"), of("first"), of("second")).alias("output")))
    transformed = of("form") != "plain"
    return moved.withColumn(into, F.struct(of("n"), of("form"), F.when(transformed, of("first")).alias("prefix_chars"), F.when(transformed, of("second") - of("first")).alias("middle_chars"), of("output")))


def restored(done: DataFrame, of: str = "fim", into: str = "restored", sentinels: Sentinels | None = None) -> DataFrame:
    """The texts behind ``transform``'s outputs, from output and form alone."""
    s = sentinels or Sentinels()
    small_batches(done)
    back = F.arrow_udf(lambda o, f: _strings([restore(x, k, s) for x, k in zip(_raw(o), f.to_pylist(), strict=True)]), "string")
    return done.withColumn(into, back(F.col(f"`{of}`.output"), F.col(f"`{of}`.form")))


def query(docs: DataFrame) -> DataFrame:
    """Forms, lengths and digests of outputs and restored texts, for every document."""
    done = restored(transform(docs.select("doc_id", "text")))
    digest = lambda c: F.sha2(F.encode(F.col(c), "UTF-8"), 256)
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest("fim.output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
