"""Line dedup by deletion neighbourhoods, in DataFrame functions only.

A line with a word is dropped if an equal line or a line within one edit of a code point
stands earlier: smaller doc_id, or the same document further up.  Lines without a word are
layout and stay.  Lines are judged on the input, whatever their length; a caller may ask for
near copies only from ``min_chars`` code points on.

1. Equal lines meet in classes by 128 hash bits; a class keeps its earliest place.
2. Two lines within one edit share their first half or their last half, halves taken at
   the shorter length.  Classes that share neither with another class are done: no
   neighbour is lost, and most lines emit nothing more.
3. The others are cut into SEGMENTS pieces; an edit lies in one, so neighbours agree on
   everything but that piece.
4. Only there are all one-deletion variants emitted as hashed keys: with the place of
   the deletion for a replaced code point, without it for an inserted one.  Lines that
   meet in a key are neighbours; the earliest of a key is taken by a minimum, never by
   pairing its members, then verified with levenshtein.

Hot lines: a class with more than 1 / HOT of all lines is one of at most HOT, so these
are broadcast; what is left to shuffle has no key above that share.

Defined cases: null and empty texts have no lines; rows without doc_id stand last, at one
place per line number, and rows that repeat a doc_id stand at the same place, so neither
removes its like (``query`` gives one row for each doc_id and text); of lines that tie in
place the class is one; a very long line is hashed and compared whole; extra columns pass
through ``dedup_lines``; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SEGMENTS = 8
HOT = 1000
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _a(line: Column) -> Column:
    return F.xxhash64(F.lit(1), line)


def _b(line: Column) -> Column:
    return F.xxhash64(F.lit(2), line)


def _lines(docs: DataFrame, doc_id: str, text: str, keep_text: bool) -> DataFrame:
    """late (no doc_id), doc (0 then), row (hash of the whole text), i, a, b and, if asked, line; lines with a word only."""
    base = docs.select(F.col(doc_id).isNull().alias("late"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    base = base.filter(F.col("line").rlike(_HAS_WORD))
    made = base.select("late", "doc", "row", "i", _a(F.col("line")).alias("a"), _b(F.col("line")).alias("b"), "line")
    return made if keep_text else made.drop("line")


def _halves(line: Column, n: Column) -> Column:
    """Keys of the halves at length n and n - 1."""
    def left(k):
        return F.xxhash64(F.lit("l"), k, F.substring(line, 1, k))

    def right(k):
        return F.xxhash64(F.lit("r"), k, F.right(line, k))

    h, g = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array_distinct(F.array(left(h), left(g), right(n - h), right(n - 1 - g)))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that two different classes hold."""
    return rows.groupBy(key).agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.max("at").alias("at")).filter("lo <> hi and at >= 0").select(key)


def _segments(n: Column) -> Column:
    """(m, j, from, to): at lengths m = n and n - 1, piece j is code points from .. to of the shorter line."""
    def at(m):
        return F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda j: F.struct(m.alias("m"), j.alias("j"), F.floor(j * m / SEGMENTS).cast("int").alias("f"), F.floor((j + 1) * m / SEGMENTS).cast("int").alias("t")))

    return F.concat(at(n), at(n - 1))


def _near(classes: DataFrame, min_chars: int) -> DataFrame:
    """(a, b): classes with an earlier neighbour within one edit."""
    line = F.col("line")
    # All uses need the same columns (hence ``at``), so that they share one exchange of the lines.
    long = classes.filter(F.length("line") >= min_chars).select("a", "b", "first", F.col("first.i").alias("at"), "line", F.length("line").alias("n"))
    halves = long.select("a", "b", "at", F.explode(_halves(line, F.col("n"))).alias("half"))
    some = halves.join(_shared(halves, "half"), "half").groupBy("a", "b").agg(F.max("at").alias("top"))
    some = some.withColumnsRenamed({"a": "sa", "b": "sb"})
    # Joined on the classes' own partitioning, the lines do not move again.
    left = written(long.join(some, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")) & (F.col("top") >= F.col("at")), "left_semi"), "lines-left")

    pieces = left.select("a", "b", "first", "line", "n", F.explode(_segments(F.col("n"))).alias("p")).select("*", "p.*").drop("p")
    rest = F.xxhash64(F.lit("p"), "m", "j", F.substring(line, 1, F.col("f")), F.right(line, F.col("m") - F.col("t")))
    middle = F.substring(line, F.col("f") + 1, F.col("n") - F.col("f") - (F.col("m") - F.col("t")))
    pieces = pieces.select("a", "b", "first", "n", "m", rest.alias("rest"), middle.alias("mid"))
    keys = pieces.select("a", "rest", F.col("first.i").alias("at"))
    pieces = pieces.join(_shared(keys, "rest"), "rest")

    mid, same = F.col("mid"), F.col("n") == F.col("m")
    each = F.sequence(F.lit(0), F.greatest(F.length(mid) - 1, F.lit(0)))
    without = lambda i: F.concat(F.substring(mid, F.lit(1), i), F.substring(mid, i + 2, F.length(mid)))
    replaced = F.transform(each, lambda i: F.xxhash64(F.lit("s"), "rest", i, without(i)))
    shorter = F.array_distinct(F.transform(each, lambda i: F.xxhash64(F.lit("d"), "rest", without(i))))
    whole = F.array(F.xxhash64(F.lit("d"), "rest", mid))
    none = F.array().cast("array<bigint>")
    variants = pieces.select("a", "b", "first", F.explode(F.concat(
        F.transform(F.when(same & (F.length(mid) > 0), replaced).otherwise(none), lambda k: F.struct(F.lit(0).alias("side"), k.alias("key"))),
        F.transform(F.when(same, whole).otherwise(none), lambda k: F.struct(F.lit(1).alias("side"), k.alias("key"))),
        F.transform(F.when(~same, shorter).otherwise(none), lambda k: F.struct(F.lit(2).alias("side"), k.alias("key"))),
    )).alias("v")).select("a", "b", "first", "v.side", "v.key")
    # side 0 meets side 0; side 1 (the whole shorter line) meets side 2 (the longer one less a code point).
    who = F.struct("first", "a", "b")
    met = variants.groupBy("key").agg(
        F.min(F.when(F.col("side") == 0, who)).alias("s0"), F.min(F.when(F.col("side") == 1, who)).alias("s1"), F.min(F.when(F.col("side") == 2, who)).alias("s2"),
        F.count(F.lit(1)).alias("c"),
    ).filter("c > 1")
    mate = F.when(F.col("side") == 0, F.col("s0")).when(F.col("side") == 1, F.col("s2")).otherwise(F.col("s1"))
    pairs = variants.join(met, "key").withColumn("mate", mate).filter(F.col("mate.first") < F.col("first")).select("a", "b", F.col("mate.a").alias("ma"), F.col("mate.b").alias("mb")).distinct()
    text = left.select("a", "b", "line")
    mates = left.select(F.col("a").alias("ma"), F.col("b").alias("mb"), F.col("line").alias("mate_line"))
    checked = pairs.join(text, ["a", "b"]).join(mates, ["ma", "mb"]).filter(F.levenshtein("line", "mate_line", 1) == 1)
    return checked.select("a", "b").distinct()


def line_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: bool = True, min_chars: int = 0) -> DataFrame:
    """late (no doc_id), doc (0 then), row (hash of the text), i (line number from 0), gone: one row a line with a word."""
    lines = _lines(docs, doc_id, text, True)
    place = F.struct("late", "doc", "i")
    classes = lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"), F.first("line").alias("line"))
    small = classes.select("a", "b", "first", "c")
    if near:
        close = _near(classes, min_chars).withColumn("near", F.lit(True))
        small = small.join(close, ["a", "b"], "left")
    else:
        small = small.withColumn("near", F.lit(None).cast("boolean"))
    verdict = written(small.filter("c > 1 or near").select("a", "b", "first", "c", F.coalesce("near", F.lit(False)).alias("near")), "lines-verdict")
    total = verdict.agg(F.sum("c")).first()[0] or 0
    hot = verdict.filter(F.col("c") > max(1, total // HOT)).select(F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("first").alias("hot_first"), F.col("near").alias("hot_near"))
    cold = verdict.filter(F.col("c") <= max(1, total // HOT)).select("a", "b", "first", "near")
    at = _lines(docs, doc_id, text, False).join(F.broadcast(hot), (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")), "left")
    # A hot line has its answer already; it is spread by its place and meets nothing.
    at = at.withColumn("a", F.when(F.col("ha").isNull(), F.col("a")).otherwise(F.xxhash64("doc", "row", "i"))).select("late", "doc", "row", "i", "a", "b", "hot_first", "hot_near")
    joined = at.join(cold, ["a", "b"], "left")
    first, close = F.coalesce("hot_first", "first"), F.coalesce("hot_near", "near", F.lit(False))
    return joined.select("late", "doc", "row", "i", (close | F.coalesce(first < place, F.lit(False))).alias("gone"))


def _by_document(verdicts: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_set(F.struct("i", "gone")))
    return verdicts.groupBy("late", "doc", "row").agg(lines.alias("lines"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 0) -> DataFrame:
    """docs with the dropped lines taken out of text; all other columns as they are."""
    gone = line_verdicts(docs, doc_id, text, min_chars=min_chars).filter("gone").groupBy("late", "doc", "row").agg(F.array_sort(F.collect_set("i")).alias("gone"))
    own = docs.columns
    d = docs.alias("d")
    late, doc = F.col(f"d.`{doc_id}`").isNull(), F.coalesce(F.col(f"d.`{doc_id}`").cast("long"), F.lit(0).cast("long"))
    g = gone.select(F.col("late").alias("_late"), F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("gone").alias("_gone")).alias("g")
    joined = d.join(g, (late == F.col("g._late")) & (doc == F.col("g._doc")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("g._row")), "left")
    split = F.split(F.col(f"d.`{text}`"), "\n", -1)
    fresh = F.when(F.col("g._gone").isNull(), F.col(f"d.`{text}`")).otherwise(F.array_join(_without(split), "\n"))
    return joined.select(*(fresh.alias(c) if c == text else F.col(f"d.`{c}`").alias(c) for c in own))


def _without(split: Column) -> Column:
    """The lines between the dropped ones, slice by slice."""
    gone = F.col("g._gone")
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(split)))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(gone) + 1), lambda k: F.slice(split, F.get(edges, k - 1) + 2, F.get(edges, k) - F.get(edges, k - 1) - 1)))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, removed (line numbers), for every document (doc_id and text) that has such lines."""
    by = _by_document(line_verdicts(docs))
    gone = F.transform(F.filter("lines", lambda x: x["gone"]), lambda x: x["i"])
    return by.select(F.when(~F.col("late"), F.col("doc")).alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


ORACLE = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT line, min((doc_id IS NULL, coalesce(doc_id, 0), i)) AS first, length(line) AS n FROM w GROUP BY line),
h AS (SELECT *, unnest(list_distinct(['l' || (n // 2) || ':' || left(line, n // 2), 'l' || ((n - 1) // 2) || ':' || left(line, (n - 1) // 2),
    'r' || (n - n // 2) || ':' || right(line, n - n // 2), 'r' || (n - 1 - (n - 1) // 2) || ':' || right(line, n - 1 - (n - 1) // 2)])) AS k FROM c),
p AS (SELECT DISTINCT x.line AS x, y.line AS y FROM h x JOIN h y ON x.k = y.k AND y.first < x.first AND abs(x.n - y.n) <= 1),
q AS (SELECT DISTINCT x FROM p WHERE len(list_filter(range(greatest(length(x), length(y))), lambda i: left(x, i) = left(y, i)
    AND substr(x, i + CASE WHEN length(x) >= length(y) THEN 2 ELSE 1 END) = substr(y, i + CASE WHEN length(y) >= length(x) THEN 2 ELSE 1 END))) > 0),
v AS (SELECT w.doc_id, w.text, w.i, (c.first < (w.doc_id IS NULL, coalesce(w.doc_id, 0), w.i) OR q.x IS NOT NULL) AS gone FROM w JOIN c USING (line) LEFT JOIN q ON q.x = w.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (gone), '') AS removed FROM v GROUP BY doc_id, text
"""
