"""A word index as tables: postings, document lengths, document frequencies, corpus statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from .lineage import fresh_folder, kept_table


def earlier_terms(text: Column | str) -> Column:
    """Terms of the earlier index: no stop words, Latin of three or more, long Hangul words also by stem and pieces."""
    words = F.regexp_extract_all(F.lower(tx.fold_width(text)), F.lit(f"[a-z0-9_]+|[{tx.HANGUL}]+"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(vocab.EARLIER_STOP) & ~(w.rlike("^[a-z0-9_]+\\z") & (F.length(w) < 3)))

    def more(w: Column) -> Column:
        stem = _stem(w)
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, 2))
        long = F.concat(F.array(w), F.when(stem != w, F.array(stem)).otherwise(tx.no_strings()), parts)
        return F.when(w.rlike(f"^[{tx.HANGUL}]{{3,}}\\z"), long).otherwise(F.array(w))

    return F.flatten(F.transform(words, more))


def _stem(word: Column) -> Column:
    """Less the first listed particle that leaves two characters."""
    out = word
    for p in reversed(vocab.EARLIER_PARTICLES):
        out = F.when(F.endswith(word, F.lit(p)) & (F.length(word) - len(p) >= 2), F.substr(word, F.lit(1), F.length(word) - len(p))).otherwise(out)
    return out


def stemmed_terms(text: Column | str) -> Column:
    """Terms for a baseline index: whole words only, Hangul ones less one particle."""
    words = F.regexp_extract_all(F.lower(tx.fold_width(tx.search_text(text))), F.lit(f"[a-z0-9_]{{2,}}|[{tx.HANGUL}]{{2,}}"), F.lit(0))
    return F.transform(words, lambda w: F.when(w.rlike(f"^[{tx.HANGUL}]"), _stem(w)).otherwise(w))


def anchor_words(text: Column | str) -> Column:
    words = F.regexp_extract_all(F.lower(tx.fold_width(F.coalesce(tx.col(text), F.lit("")))), F.lit(f"[a-z0-9_]+|[{tx.HANGUL}]+"), F.lit(0))
    stop = vocab.EARLIER_STOP + vocab.EARLIER_ANCHOR_STOP
    return F.array_distinct(F.filter(F.transform(words, _stem), lambda w: (F.length(w) >= 2) & ~w.isin(stop)))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, length: Column, avg: Column) -> Column:
    k1, b = vocab.BM25_K1, vocab.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


@dataclass(frozen=True)
class Index:
    units: DataFrame
    postings: DataFrame
    docs: DataFrame
    df: DataFrame
    stats: DataFrame
    #: (chat_id, unit_id, term, ord, gain): what a term adds to a unit's BM25 score, where it is stored.
    impacts: DataFrame | None = None

    def persist(self) -> Index:
        return Index(self.units, self.postings.persist(), self.docs.persist(), self.df.persist(), self.stats.persist())

    def stored(self, name: str = "index") -> Index:
        """The index as tables in the shared folder: the corpus is read and cut into words once, whatever asks afterwards."""
        base = fresh_folder(self.units.sparkSession, name)
        postings = kept_table(self.postings, f"{base}/postings")
        lengths = self.units.select("chat_id", "unit_id").join(postings.groupBy("chat_id", "unit_id").agg(F.sum("tf").alias("length")), ["chat_id", "unit_id"], "left").fillna(0, ["length"])
        docs = kept_table(lengths, f"{base}/docs")
        stats = docs.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.avg("length")).alias("avg_length"))
        df = kept_table(postings.groupBy("chat_id", "term").agg(F.count(F.lit(1)).alias("df")), f"{base}/df")
        stats = kept_table(stats, f"{base}/stats")
        if "ord" not in self.units.columns:
            return Index(self.units, postings, docs, df, stats)
        gain = tf_norm(F.col("tf"), F.col("length"), F.col("avg_length")) * idf(F.col("n"), F.col("df"))
        placed = docs.join(self.units.select("chat_id", "unit_id", "ord"), ["chat_id", "unit_id"]).join(stats, "chat_id")
        impacts = postings.join(placed, ["chat_id", "unit_id"]).join(df, ["chat_id", "term"]).select("chat_id", "unit_id", "term", "ord", gain.alias("gain"))
        return Index(self.units, postings, docs, df, stats, kept_table(impacts, f"{base}/impacts"))

    @property
    def entities(self) -> DataFrame:
        """(chat_id, name): names before a bar behind a speech bubble."""
        found = F.regexp_extract_all("text", F.lit(r"💬\s*([가-힣]{2,8})\s*\|"), F.lit(1))
        return self.units.select("chat_id", F.explode(found).alias("name")).distinct()


def counted(terms: Column) -> Column:
    """(term, tf) of an array of terms, by sorting it."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return tx.let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).cast("long").alias("tf"))))

    return F.when(F.size(terms) > 0, tx.let(F.sort_array(terms), runs))


def build_index(units: DataFrame, terms: Callable[[str], Column] | None = None, whole: bool = False) -> Index:
    """An index of units (chat_id, unit_id, text, ...), each chat_id a corpus of its own.

    Terms are counted map-side, then by (corpus, unit, term); frequencies and lengths follow from those counts.
    whole: each unit is one row, as messages are; its terms are then counted inside of it, and no unit is grouped.
    """
    # Cleaning, then folding, then splitting, each in a projection of its own, so that none is computed twice.
    text = units.select("chat_id", "unit_id", F.lower(tx.search_text("text")).alias("clean") if terms is None else F.col("text").alias("clean"))
    split = (terms or tx.terms_of)("clean")
    if whole:
        listed = text.select("chat_id", "unit_id", split.alias("terms"))
        postings = listed.select("chat_id", "unit_id", F.explode(counted(F.col("terms"))).alias("x")).select("chat_id", "unit_id", "x.term", "x.tf")
        lengths = listed.select("chat_id", "unit_id", F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("length"))
    else:
        postings = text.select("chat_id", "unit_id", F.explode(split).alias("term")).groupBy("chat_id", "unit_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        summed = postings.groupBy("chat_id", "unit_id").agg(F.sum("tf").alias("length"))
        lengths = units.select("chat_id", "unit_id").join(summed, ["chat_id", "unit_id"], "left").fillna(0, ["length"])
    stats = lengths.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.avg("length")).alias("avg_length"))
    return Index(units, postings, lengths, postings.groupBy("chat_id", "term").agg(F.count(F.lit(1)).alias("df")), stats)


def _listed(units: DataFrame) -> DataFrame | None:
    """(chat_id, term list) of units, one row each, or None if a unit has several rows.  Only ids are read to tell."""
    if units.groupBy("chat_id", "unit_id").count().filter("count > 1").limit(1).count():
        return None
    # a projection of its own for cleaning, as in build_index
    return units.select("chat_id", F.lower(tx.search_text("text")).alias("clean")).select("chat_id", tx.terms_of("clean").alias("terms"))


def document_frequencies(units: DataFrame) -> DataFrame:
    """The df table of build_index(units) without its postings: a unit's terms are made distinct inside its row, so only words are shuffled."""
    each = _listed(units)
    if each is None:
        return build_index(units).df
    return each.select("chat_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("chat_id", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_statistics(units: DataFrame) -> DataFrame:
    """The stats table of build_index(units) without its postings: units and their average length, one row a corpus and task shuffled."""
    each = _listed(units)
    if each is None:
        return build_index(units).stats
    return each.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.avg(F.coalesce(F.size("terms"), F.lit(0)))).alias("avg_length"))


def lasting_words(postings: DataFrame) -> DataFrame:
    """Hangul terms of three syllables or more, keyed by their first three for prefix joins."""
    return postings.filter(F.col("term").rlike(f"^[{tx.HANGUL}]{{3,}}\\z")).select("chat_id", "unit_id", F.col("term").alias("word"), F.substring("term", 1, 3).alias("p3"))
