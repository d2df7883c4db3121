"""Many names at once: an Aho-Corasick automaton over a table of names, run over texts in batches.

The names of a table, cut by hash into parts of at most PART_BYTES, are sent to the tasks one part at a time; a task builds the
part's automaton once and reports every place where a name stands, overlapping ones too.  Work is linear in the text
and its places, whatever the number of names; only more parts mean more passes over the texts.  Which of the
places count (the longest, the leftmost, those of the text's own conversation) is decided on the rows.

Defined cases: empty and null names stand nowhere; a null or empty text holds none; names that repeat are one; places are
code points from 0; rows of the texts that repeat are reported each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_BYTES = 8_000_000
_BUILT: dict[str, object] = {}
_BEST = pa.struct([("n", pa.int32()), ("tie", pa.string()), ("model", pa.string())])
DIGITS = tuple("0123456789")


def _automaton(part: str, names: list[str]):
    """The automaton of a part, once a worker."""
    if part not in _BUILT:
        import ahocorasick

        made = ahocorasick.Automaton()
        for n in names:
            made.add_word(n, n)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[part] = made
    return _BUILT[part]


def places(texts: DataFrame, names: DataFrame, text: str = "text", name: str = "name", part_bytes: int = PART_BYTES) -> DataFrame:
    """texts without the text, one row for each place (from, to) of each ``name`` of names in it."""
    spark = texts.sparkSession
    each = names.select(F.col(name).alias("name")).filter(F.length("name") > 0).distinct()
    size = each.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    keys = [c for c in texts.columns if c != text]
    schema = T.StructType([*(texts.schema[c] for c in keys), T.StructField("name", T.StringType()), T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    out = None
    for p in range(parts):
        # a part is a hash of the names: at most about part_bytes of them reach the driver at a time
        some = [r.name for r in each.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == p).collect()]
        sent, part = spark.sparkContext.broadcast(some), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, part=part) -> Iterator[pa.RecordBatch]:
            if not sent.value:
                return
            made = _automaton(part, sent.value)
            for b in batches:
                rows, found, begins, ends = [], [], [], []
                for i, t in enumerate(b.column(len(keys)).to_pylist()):
                    for end, n in made.iter(t) if t else ():
                        rows.append(i)
                        found.append(n)
                        begins.append(end + 1 - len(n))
                        ends.append(end + 1)
                taken = pa.array(rows, pa.int64())
                columns = [b.column(k).take(taken) for k in range(len(keys))] + [pa.array(found, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        done = texts.select(*keys, text).mapInArrow(run, schema)
        out = done if out is None else out.unionByName(done)
    return out


def _best_of(sent, part: str, no_digit: bool):
    """For each text the least of what ``sent`` says of the names that stand in it."""

    def run(texts: pa.Array) -> pa.Array:
        told = sent.value
        if not told:
            return pa.nulls(len(texts), _BEST)
        made = _automaton(part, list(told))

        def best(t: str | None):
            held = {n for end, n in made.iter(t) if not (no_digit and t[end + 1 : end + 2] in DIGITS)} if t else ()
            return min((told[n] for n in held), default=None)

        return pa.array([x and dict(zip(("n", "tie", "model"), x, strict=True)) for x in map(best, texts.to_pylist())], _BEST)

    return run


def longest_inside(text: Column, names: DataFrame, no_digit: bool = False, part_bytes: int = PART_BYTES) -> Column:
    """struct(n, tie, model) of the longest name (names: name, tie, model) in a text, n being less its length, the least by tie and model; null
    where none stands.  no_digit: a name before a digit does not count.  Cut into parts like those of ``places``."""
    spark = names.sparkSession
    each = names.filter(F.length("name") > 0).groupBy("name").agg(F.min(F.struct("tie", "model")).alias("best"))
    size = each.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    found = []
    for p in range(parts):
        some = {r.name: (-len(r.name), r.best.tie, r.best.model) for r in each.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == p).collect()}
        sent, part = spark.sparkContext.broadcast(some), uuid.uuid4().hex
        # not deterministic for Spark, so that a filter on what was found does not look for it a second time
        found.append(F.arrow_udf(_best_of(sent, part, no_digit), "n int, tie string, model string").asNondeterministic()(text))
    return F.array_min(F.array(*found))


def leftmost_longest(found: Column) -> Column:
    """Of an array of structs (from, to, ...) the ones that a reader from the left takes: the longest at the first place, then on
    behind it."""
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["from"].alias("a"), (-x["to"]).alias("b"), x.alias("x"))))
    none = F.slice(order, 1, 0)
    start = F.struct(F.lit(0).cast("long").alias("end"), none.alias("kept"))
    step = lambda s, x: F.when(x["a"] >= s["end"], F.struct(x["x"]["to"].alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    return F.transform(F.aggregate(order, start, step)["kept"], lambda x: x["x"])
