"""Filter interaction audit over a sparse document-term matrix.

Which of five filters removes a document depends on the order in which they run.  For every
order, step and part of the corpus the audit counts what a filter keeps and removes, what it
would have removed had another not come first, and what it costs in labelled documents.

Words are dictionary-encoded over the whole table and documents become rows of CSR shards.  A
task bundles about SHARD_BYTES of text into a shard, whose words have local numbers; the words
of all shards meet in buckets by hash, where the rank of a word in its bucket gives its global
number; a shard reads its numbers back, one row for each of its distinct words, so a
word that all documents hold is one row a shard and no key is hot.  Row sums of the matrix
are a document's words, counts of nonzero entries its distinct words: they decide the first two filters.

Filters: A under MIN_WORDS words; B 100 * distinct < MIN_DISTINCT * words; C more than MAX_CAPITALS % of
the characters are A-Z; D a symbol of ``#$%&*|``; E the text of a smaller doc_id, removed or not.  Texts are
compared by sha256.  Documents become one row for each part and set of failed filters; all orders are
read off the numbers that no filter of a set removes.

Defined cases: a null text is empty (fails A alone, and E where a smaller doc_id is empty too);
a null doc_id is in no order (never E, never a reason for E) and has no labels; rows that repeat doc_id and
text are each counted, neither is E because of the other; a null source is the part ''; labels that
are null are 0, of two labels for a doc_id the higher is taken; a very long text is a shard of
its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .common import small_batches, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SYMBOLS = b"#$%&*|"
SHARD_BYTES = 10_000_000
#: Words of shards that meet in one bucket, about.
BUCKET_WORDS = 500_000

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Numbers of a shard's rows travel as bytes: places of rows, gaps between the word numbers of a row, counts.
_LOCAL = "shard long, doc_id array<long>, part array<string>, digest array<binary>, others array<byte>, indptr binary, gaps binary, counts binary, words array<string>"
_GLOBAL = "shard long, doc_id array<long>, part array<string>, digest array<binary>, others array<byte>, indptr array<int>, indices array<long>, counts array<int>"
_ROWS = "doc_id long, part string, digest binary, n_words long, n_distinct long, others byte"


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each stretch."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def csr(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(indptr, indices, counts, words) of a slice of texts; a word is its place in words."""
    solid = ~tk._SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    each = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(data[solid])).dictionary_encode()
    codes = each.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(each.dictionary))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(begins, offsets)))
    entry, counts = np.unique(doc * width + codes, return_counts=True)
    indptr = np.searchsorted(entry, np.arange(len(offsets)) * width)
    return indptr, entry % width, counts, each.dictionary.cast(pa.string())


def _packed(indptr: np.ndarray, indices: np.ndarray, counts: np.ndarray) -> list[bytes]:
    gaps = np.diff(indices, prepend=0)
    first = indptr[:-1][np.diff(indptr) > 0]
    gaps[first] = indices[first]
    return [indptr.astype("<i4").tobytes(), gaps.astype("<i4").tobytes(), counts.astype("<u4" if counts.size and counts.max() > 255 else "u1").tobytes()]


def _unpacked(indptr: bytes, gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places, steps = np.frombuffer(indptr, "<i4"), np.frombuffer(gaps, "<i4").astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(steps)])
    return places, sums[1:] - np.repeat(sums[places[:-1]], np.diff(places)), np.frombuffer(counts, "u1" if len(counts) == len(steps) else "<u4").astype(np.int64)


def _bundled(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """A shard of each run of rows that stays within shard_bytes; a longer text is one alone."""
    number = TaskContext.get().partitionId() << 33

    def shard(rows: pa.Table) -> pa.RecordBatch:
        nonlocal number
        number += 1
        _, _, data, offsets = next(tk.slices(tk.column(rows, "text"), 1 << 62))
        indptr, indices, counts, words = csr(data, offsets)
        chars = _sums((data & 0xC0) != 0x80, offsets)
        others = 4 * (100 * _sums(_CAPITAL[data], offsets) > MAX_CAPITALS * chars) + 8 * (_sums(_SYMBOL[data], offsets) > 0)
        whole = lambda c: rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0)
        columns = [pa.array([number], pa.int64()), *(_one(whole(c)) for c in ("doc_id", "part", "digest")), _one(pa.array(others.astype(np.int8)))]
        columns += [pa.array([x], pa.binary()) for x in _packed(indptr, indices, counts)] + [_one(words)]
        return pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "part", "digest", "others", "indptr", "gaps", "counts", "words"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        for to, bytes_ in [(b, len(d)) for _, b, d, _ in tk.slices(tk.column(batch, "text"), max(1, shard_bytes // 4))]:
            if held and size + bytes_ > shard_bytes:
                yield shard(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(at, to - at))
            size += bytes_
            at = to
    if held:
        yield shard(pa.Table.from_batches(held))


def local_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """CSR shards of doc_id, text and source with local word numbers, stored."""
    small_batches(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return written(rows.mapInArrow(lambda batches: _bundled(batches, shard_bytes), _LOCAL), "audit-shards")


def dictionary(shards: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Every shard's words with their global numbers: shard, pos, word, word_id."""
    words = shards.select("shard", F.posexplode("words").alias("pos", "word"))
    total = shards.agg(F.sum(F.size("words"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_words))
    in_bucket = Window.partitionBy("bucket").orderBy("word")
    rank = F.dense_rank().over(in_bucket).cast("long")
    return words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets))).select("shard", "pos", "word", ((rank - 1) * buckets + F.col("bucket")).alias("word_id"))


def _numbered(shards: DataFrame, bucket_words: int) -> DataFrame:
    """Each shard beside the global numbers of its words (pos and word_id, side by side in any order)."""
    numbers = dictionary(shards, bucket_words).groupBy("shard").agg(F.collect_list("pos").alias("pos"), F.collect_list("word_id").alias("word_id"))
    return shards.drop("words").join(numbers, "shard", "left")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, indptr, indices, counts) of each shard of ``_numbered``, words by their global numbers."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            indptr, local, counts = _unpacked(*(row.column(c)[0].as_py() for c in ("indptr", "gaps", "counts")))
            pos, number = row.column("pos").flatten().to_numpy(), row.column("word_id").flatten().to_numpy()
            ids = np.zeros(len(pos), np.int64)
            ids[pos] = number
            yield row, indptr, ids[local], counts


def term_matrix(shards: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """The shards with global word numbers: shard, doc_id, part, digest, others, indptr, indices (ascending in a row), counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, indptr, ids, counts in _matrices(batches):
            order = np.lexsort((ids, np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))))
            columns = [*(row.column(c).flatten() for c in ("doc_id", "part", "digest", "others")), pa.array(indptr, pa.int32()), pa.array(ids[order], pa.int64()), pa.array(counts[order], pa.int32())]
            yield pa.RecordBatch.from_arrays([row.column("shard"), *map(_one, columns)], ["shard", "doc_id", "part", "digest", "others", "indptr", "indices", "counts"])

    return _numbered(shards, bucket_words).mapInArrow(run, _GLOBAL)


def document_rows(shards: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """One row a document of the matrix: its row's sum and number of nonzero entries, and what its shard carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, indptr, ids, counts in _matrices(batches):
            # entries of a row are nonzero and, as numbers are one to one with words, of different words
            if len(np.unique(ids)) != len(row.column("pos").flatten()):
                raise ValueError("two words of a shard have one number")
            total = np.diff(np.concatenate([[0], np.cumsum(counts)])[indptr])
            one = lambda c: row.column(c).flatten()  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([one("doc_id"), one("part"), one("digest"), pa.array(total, pa.int64()), pa.array(np.diff(indptr), pa.int64()), one("others")], ["doc_id", "part", "digest", "n_words", "n_distinct", "others"])

    return _numbered(shards, bucket_words).mapInArrow(run, _ROWS)


def failed_filters(docs: DataFrame, shard_bytes: int = SHARD_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Documents by doc_id, part, digest of the text and ``mask`` (bit k: fails filter k of A to E), with their number n."""
    rows = document_rows(local_shards(docs, shard_bytes), bucket_words)
    a = (F.col("n_words") < MIN_WORDS).cast("int")
    b = (100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words")).cast("int")
    alike = written(rows.withColumn("mask", a + 2 * b + F.col("others")).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "audit-rows")
    first = alike.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    d, f = alike.alias("d"), first.alias("f")
    # on both keys: however often a text is repeated, one of its documents meets the row of the first
    marked = d.join(f, (F.col("d.digest") == F.col("f.digest")) & (F.col("d.doc_id") == F.col("f.first_id")), "left")
    copy = F.col("d.doc_id").isNotNull() & F.col("f.first_id").isNull()
    return marked.select("d.doc_id", "d.part", "d.digest", (F.col("mask") + 16 * copy.cast("int")).alias("mask"), "n")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good (quality 1) and toxic (toxic 1)."""
    own = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("known", F.lit(True))
    # rows without an id go where their text does: no task holds them all
    keyed = rows.withColumns({"known": F.col("doc_id").isNotNull(), "key": F.coalesce("doc_id", F.xxhash64("digest"))})
    joined = keyed.join(own, ["known", "key"], "left")
    return joined.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}).drop("known", "key")


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters, step by step, for each part: rows hold part, mask, n, good and toxic."""
    k = len(filters)
    sums = rows.groupBy("part", "mask").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    # at most 2**k rows a part
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "all", "good", "toxic")).alias("sets"))
    total = lambda keep, what: F.aggregate("sets", F.lit(0).cast("long"), lambda s, r: s + F.when(keep(r["mask"]), r[what]).otherwise(0))
    left = lambda what: F.transform(F.sequence(F.lit(0), F.lit(2**k - 1)), lambda s: total(lambda m: m.bitwiseAND(s) == 0, what))
    single = lambda keep: F.array(*[total(keep(2**i), "all") for i in range(k)])
    counted = parts.select("part", left("all").alias("all"), left("good").alias("good"), left("toxic").alias("toxic"), single(lambda b: lambda m: m.bitwiseAND(b) > 0).alias("fails"), single(lambda b: lambda m: m == b).alias("only"))
    # of all k! orders, those in which exactly the filters of a set come before one that is not in it
    fact = [1]
    for i in range(1, k + 1):
        fact.append(fact[-1] * i)
    before = [[(s, fact[bin(s).count("1")] * fact[k - 1 - bin(s).count("1")]) for s in range(2**k) if not s >> i & 1] for i in range(k)]
    shapley = F.array(*[sum((F.lit(w) * (F.col("all")[s] - F.col("all")[s | 1 << i]) for s, w in before[i]), F.lit(0)) for i in range(k)])
    orders = F.lit(["".join(p) for p in permutations(filters)])
    at = counted.withColumn("shapley", shapley).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    number = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda x: F.instr(F.lit(filters), F.substring(F.col("filter_order"), x, F.lit(1))) - 1)
    steps = at.withColumn("numbers", number).withColumn("i", F.col("numbers")[F.col("step") - 1])
    steps = steps.withColumn("earlier", F.aggregate(F.slice("numbers", F.lit(1), F.col("step") - 1), F.lit(0), lambda s, x: s + F.pow(F.lit(2), x).cast("int")))
    steps = steps.withColumn("after", F.col("earlier") + F.pow(F.lit(2), F.col("i")).cast("int"))
    gone = lambda what: F.col(what)[F.col("earlier")] - F.col(what)[F.col("after")]
    return steps.select(
        "part", "filter_order", "step", F.col("all")[F.col("after")].alias("kept"), gone("all").alias("removed"), (F.col("fails")[F.col("i")] - gone("all")).alias("redundant"),
        F.col("only")[F.col("i")].alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.col("shapley")[F.col("i")].alias("shapley"),
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(with_labels(failed_filters(docs), labels))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(k, b)),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b <> b.b AND a.b <> c.b AND a.b <> d.b AND a.b <> e.b AND b.b <> c.b AND b.b <> d.b AND b.b <> e.b AND c.b <> d.b AND c.b <> e.b AND d.b <> e.b),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, CAST(list_sum(bits[1:i]) AS INTEGER) - bits[i] AS earlier FROM o, range(1, 6) AS r(i)),
r AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
