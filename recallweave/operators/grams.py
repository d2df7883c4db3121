"""Substring search by positional grams: texts and phrases meet on the phrase's rarest grams, in line, and are then compared.

A phrase of three or more code points is looked for by its trigrams, a shorter one by itself.  Grams of the texts that no
phrase asks for go at once; those asked for are counted (map-side, so a gram of all texts is one row a task), and each
phrase keeps its RARE rarest.  A text is a candidate where these stand at one distance from the phrase's start, and the
phrase itself is compared there: the result is exact.  The work is linear in the texts and in the places of rare grams;
no text meets a phrase that it has nothing of.

Where no chat asks for more than FEW phrases, each text is searched for the phrases of its own chat: one join by chat, no grams.  The
side of the phrases is sent to all tasks while it is small, so that the grams of the texts are sifted where they are made.

Defined cases: an empty phrase is found nowhere; a null text holds nothing; repeated rows of a unit give equal places; a
phrase longer than the text is not found; the first place counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .lineage import cut

#: Grams of a phrase that texts are looked up by.
RARE = 2
WIDTH = 3
#: Phrases of one chat that its texts are searched for one by one.
FEW = 4
#: Bytes of phrases, or of places to compare, that are sent to all tasks; more are joined by shuffle.
SENT = 8_000_000
#: Characters whose grams are made at once, at least one text.
STRETCH = 1_000_000


def _placed(rows: DataFrame, text: str, keys: list[str], widths: list[int], known: np.ndarray | None = None, counted: bool = False) -> DataFrame:
    """keys, width, gram, pos of every gram, or of the known ones (ascending); counted: their number in a stretch instead of each pos, by the first key alone.
    A gram is its code points side by side in one number."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("width", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("pos", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            texts = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in b.column(len(keys)).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRETCH, "right")))
                codes = np.concatenate(texts[lo:hi]).astype(np.int64)
                size = np.array([len(t) for t in texts[lo:hi]])
                row, first = np.repeat(np.arange(hi - lo), size), np.repeat(np.cumsum(size) - size, size)
                for w in widths:
                    n = max(0, len(codes) - w + 1)
                    gram = np.zeros(n, np.int64)
                    for k in range(w):
                        gram |= codes[k : n + k] << (21 * k)
                    has = row[:n] == row[len(codes) - n :]
                    if known is not None and len(known):
                        has &= known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram
                    elif known is not None:
                        has[:] = False
                    at = np.flatnonzero(has)
                    if counted and len(at):
                        # rows of one chat stand for each other
                        chat = b.column(0).slice(lo, hi - lo).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                        lead = np.unique(chat, return_index=True)[1]
                        pair = chat[row[at]].astype(np.int64) * len(known) + np.searchsorted(known, gram[at])
                        pair, n = np.unique(pair, return_counts=True)
                        took = pa.array(lead[pair // len(known)] + lo)
                        made = [np.full(len(n), w, np.int32), known[pair % len(known)], n.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(took), *map(pa.array, made)], schema=arrow)
                        continue
                    for f in range(0, len(at), STRETCH // 10):
                        some = at[f : f + STRETCH // 10]
                        took = pa.array(row[some] + lo)
                        made = [np.full(len(some), w, np.int32), gram[some], (some - first[some]).astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([*(b.column(i).take(took) for i in range(len(keys))), *map(pa.array, made)], schema=arrow)
                lo = hi

    return rows.select(*keys, text).mapInArrow(run, schema)


def find_phrases(texts: DataFrame, asked: DataFrame, text: str = "text", unit: str = "unit_id", phrase: str = "phrase") -> DataFrame:
    """(query_id, chat_id, unit, at): the units of a chat that hold a phrase of it, and the first place (from 0)."""
    asked = asked.filter(F.length(phrase) > 0).select("query_id", "chat_id", F.col(phrase).alias("phrase")).withColumn("width", F.least(F.length("phrase"), F.lit(WIDTH)))
    each = asked.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("phrase")).alias("size"), F.collect_set("width").alias("widths"))
    # at most WIDTH widths
    known = each.agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("widths")))).alias("widths")).first()
    n, size = known.n or 0, known.size or 0
    sent = F.broadcast if size + 64 * n <= SENT else lambda df: df
    if (known.most or 0) <= FEW:
        held = texts.select("chat_id", unit, F.col(text).alias("_t")).join(sent(asked.drop("width")), "chat_id").withColumn("at", F.position("phrase", "_t") - 1)
        return held.filter("at >= 0").groupBy("query_id", "chat_id", unit).agg(F.min("at").alias("at"))
    widths = known.widths
    own = _placed(asked.withColumnRenamed("width", "own"), "phrase", ["query_id", "chat_id", "own"], widths).filter("own = width")
    own = cut(own.groupBy("query_id", "chat_id", "gram").agg(F.min("pos").alias("off")))
    grams_of = lambda df: np.sort(df.select("gram").distinct().toPandas().gram.to_numpy(np.int64))
    # a phrase has at most a gram a byte
    small = 64 * size <= 4 * SENT
    if small:
        counts = _placed(texts, text, ["chat_id"], widths, grams_of(own), counted=True).groupBy("chat_id", "gram").agg(F.sum("pos").alias("n"))
    else:
        held = _placed(texts, text, ["chat_id", unit], widths).drop("width")
        counts = held.join(own.select("chat_id", "gram").distinct(), ["chat_id", "gram"], "left_semi").groupBy("chat_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = W.partitionBy("query_id", "chat_id").orderBy(F.coalesce("n", F.lit(0)), "off")
    kept = cut(own.join(counts, ["chat_id", "gram"], "left").withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= RARE).select("query_id", "chat_id", "gram", "off"))
    if small:
        held = _placed(texts, text, ["chat_id", unit], widths, grams_of(kept)).drop("width")
    wanted = kept.groupBy("query_id", "chat_id").agg(F.count(F.lit(1)).alias("need"))
    starts = held.join(F.broadcast(kept) if small else kept, ["chat_id", "gram"]).withColumn("at", F.col("pos") - F.col("off")).filter("at >= 0")
    lined = starts.groupBy("query_id", "chat_id", unit, "at").agg(F.count_distinct("gram").alias("have")).join(wanted, ["query_id", "chat_id"]).filter("have = need")
    places = cut(lined.join(asked.select("query_id", "chat_id", "phrase"), ["query_id", "chat_id"]).select("query_id", "chat_id", unit, "at", "phrase"))
    bulk = places.agg(F.sum(F.octet_length("phrase") + 64)).first()[0] or 0
    whole = texts.select("chat_id", unit, F.col(text).alias("_t")).join(F.broadcast(places) if bulk <= SENT else places, ["chat_id", unit])
    right = whole.filter(F.substr("_t", F.col("at") + 1, F.length("phrase")) == F.col("phrase"))
    return right.groupBy("query_id", "chat_id", unit).agg(F.min("at").alias("at"))
