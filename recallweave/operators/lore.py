"""Reference notes (lore): relations read from text, relation vectors, and the selector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import facts as fx
from ..functions import text as tx
from . import rank
from .index import build_index
from .lineage import cut
from .names import leftmost_longest, places
from .pack import first_fit
from .segment import sentences


def enabled(lore: DataFrame) -> DataFrame:
    """Notes with content that are not switched off; keywords as an array; ``ins`` keeps their order."""
    kws = F.filter(F.transform(F.coalesce("keywords", tx.no_strings()), lambda k: tx.trim(k)), lambda k: F.length(k) > 0)
    return lore.filter(F.coalesce("enabled", F.lit(True)) & (F.length(F.coalesce("content", F.lit(""))) > 0)).withColumn("keywords", kws)


def corpus_text() -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join("keywords", " "), "content")


def aliases(lore: DataFrame) -> DataFrame:
    """(chat_id, alias, title, ins): titles and keywords of two characters or more."""
    names = F.concat(F.array("title"), "keywords")
    return lore.select("chat_id", "title", "ins", F.explode(names).alias("name")).select("chat_id", tx.normalized_keyword("name").alias("alias"), tx.trim(F.col("title")).alias("title"), "ins").filter(F.length("alias") >= 2)


def text_relations(lore: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(chat_id, lore_id, subject, predicate, object) both ways, for each sentence of a note that names another note (or a
    remembered name): one pair for each verb class in the sentence, or ``mention`` without one."""
    w = W.partitionBy("chat_id", "alias").orderBy("ins", "title")
    known = aliases(lore)
    if names is not None:
        known = known.unionByName(names.select("chat_id", tx.normalized_keyword("name").alias("alias"), tx.trim(F.col("name")).alias("title"), F.lit(1 << 30).alias("ins")).filter(F.length("alias") >= 2))
    known = known.withColumn("r", F.row_number().over(w)).filter("r = 1").select("chat_id", "alias", F.col("title").alias("other"))
    parts = sentences(lore.select("chat_id", F.col("id").alias("lore_id"), "title", "content"), "content")
    verbs = fx.lore_verbs("sentence")
    parts = parts.select("chat_id", "lore_id", "title", tx.normalized_keyword("sentence").alias("folded"), F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.lit("mention"))).alias("verbs"))
    own = tx.normalized_keyword("title")
    met = parts.join(known, "chat_id").filter(F.contains("folded", "alias") & (tx.normalized_keyword("other") != own))
    met = met.select("chat_id", "lore_id", "title", "other", "folded", F.explode("verbs").alias("predicate")).distinct()
    ways = F.explode(F.array(F.struct(F.col("other").alias("subject"), F.col("title").alias("object")), F.struct(F.col("title").alias("subject"), F.col("other").alias("object"))))
    return met.select("chat_id", "lore_id", "predicate", ways.alias("t")).select("chat_id", "lore_id", "t.subject", "predicate", "t.object")


def _canonical(predicate: Column) -> Column:
    """The first verb class of a written predicate, or itself."""
    return F.coalesce(F.get(fx.lore_verbs(predicate), F.lit(0)), predicate)


def written_relations(lore: DataFrame) -> DataFrame:
    r = lore.select("chat_id", F.col("id").alias("lore_id"), F.explode("relations").alias("t"))
    return r.select("chat_id", "lore_id", tx.trim(F.col("t.subject")).alias("subject"), _canonical(tx.trim(F.col("t.predicate"))).alias("predicate"), tx.trim(F.col("t.object")).alias("object")).filter((F.length("subject") > 0) & (F.length("predicate") > 0) & (F.length("object") > 0))


def fact_edges(lore: DataFrame, facts: DataFrame) -> DataFrame:
    """(chat_id, subject, predicate, object, turn): a fact with a verb class ties its keyword to each note whose alias it names.

    The aliases of all conversations are looked for in one reading of a fact; of those of its own conversation the leftmost and longest
    count, and only the first verb class.
    """
    alias = aliases(lore).select("chat_id", "alias", "title").distinct()
    own = alias.select("chat_id", F.col("alias").alias("name")).distinct()
    f = facts.select("chat_id", tx.trim(F.coalesce("keyword", F.lit(""))).alias("subject"), F.get(fx.lore_verbs("fact"), F.lit(0)).alias("predicate"), tx.normalized_keyword("fact").alias("folded"), F.coalesce("turn", F.lit(0)).alias("turn"))
    f = f.filter((F.length("subject") > 0) & F.col("predicate").isNotNull()).distinct()
    held = places(f.withColumn("text", F.col("folded")), own).join(own, ["chat_id", "name"])
    held = held.groupBy("chat_id", "subject", "predicate", "folded", "turn").agg(leftmost_longest(F.collect_set(F.struct("from", "to", "name"))).alias("found"))
    named = held.select("chat_id", "subject", "predicate", "turn", F.explode(F.array_distinct(F.transform("found", lambda x: x["name"]))).alias("alias"))
    hit = named.join(alias, ["chat_id", "alias"]).filter(tx.normalized_keyword("subject") != tx.normalized_keyword("title"))
    return hit.select("chat_id", "subject", "predicate", F.col("title").alias("object"), "turn").distinct()


def _unit(long: DataFrame, keys: list[str]) -> DataFrame:
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys)))
    return long.withColumn("w", F.col("w") / F.when(size > 0, size).otherwise(1.0))


def relation_vectors(lore: DataFrame, triples: DataFrame) -> DataFrame:
    """(chat_id, lore_id, key, w): each note as a unit vector over entities, verbs and subject-verb pairs."""
    own = lore.select("chat_id", F.col("id").alias("lore_id"), F.concat(F.lit("e:"), tx.normalized_keyword("title")).alias("key"), F.lit(2.0).alias("w"))
    s, o = tx.normalized_keyword("subject"), tx.normalized_keyword("object")
    keys = F.explode(F.array(*(F.struct(k.alias("key"), F.lit(v).alias("w")) for k, v in (
        (F.concat(F.lit("e:"), s), 0.5), (F.concat(F.lit("e:"), o), 0.5), (F.concat(F.lit("p:"), F.col("predicate")), 0.5), (F.concat_ws(":", F.lit("sp"), s, "predicate"), 1.5)))))
    long = own.unionByName(triples.select("chat_id", "lore_id", keys.alias("k")).select("chat_id", "lore_id", "k.key", "k.w"))
    return _unit(long.groupBy("chat_id", "lore_id", "key").agg(F.sum("w").alias("w")), ["chat_id", "lore_id"])


def edges(lore: DataFrame, triples: DataFrame, facts: DataFrame | None) -> DataFrame:
    written = triples.select("chat_id", "subject", "predicate", "object", F.lit(0).alias("turn"))
    return written if facts is None else written.unionByName(fact_edges(lore, facts))


def query_vectors(lore: DataFrame, every_edge: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chat_id, key, w) of drafts: named entities, recent ones, verbs, pairs, and what named subjects point to
    by a verb of the draft, weighing edges of facts by age.  Edges after the draft's turn do not exist for it."""
    q = queries.select("query_id", "chat_id", "draft", F.coalesce("recent_context", F.lit("")).alias("recent"), "turn")
    asof = q.select("query_id", "chat_id", "turn").join(every_edge.withColumnRenamed("turn", "edge_turn"), "chat_id").filter(F.col("turn").isNull() | (F.col("edge_turn") <= F.col("turn")))
    names = q.join(lore.select("chat_id", F.col("title").alias("name")), "chat_id").select("query_id", "name").unionByName(asof.select("query_id", F.explode(F.array("subject", "object")).alias("name"))).distinct().filter(F.length("name") >= 2)
    said = names.join(q, "query_id").withColumn("direct", tx.keyword_appears("draft", "name")).withColumn("lately", tx.keyword_appears("recent", "name")).filter("direct or lately")
    said = said.select("query_id", "chat_id", "name", "direct", "lately")
    verbs = q.select("query_id", "chat_id", F.explode(fx.lore_verbs("draft")).alias("verb"))
    e = F.concat(F.lit("e:"), tx.normalized_keyword("name"))
    age = F.greatest(F.lit(0), F.col("turn") - F.col("edge_turn"))
    weight = F.when(F.col("edge_turn") == 0, 1.0).otherwise(F.exp(-F.coalesce(age, F.lit(0)) / 50))
    targets = asof.join(said.filter("direct").select("query_id", F.col("name").alias("subject")), ["query_id", "subject"], "left_semi").join(verbs.select("query_id", F.col("verb").alias("predicate")), ["query_id", "predicate"], "left_semi")
    targets = targets.groupBy("query_id", "chat_id", tx.normalized_keyword("object").alias("o")).agg(F.max(weight).alias("m"))
    long = said.filter("direct").select("query_id", "chat_id", e.alias("key"), F.lit(1.0).alias("w"))
    long = long.unionByName(said.filter("lately").select("query_id", "chat_id", e.alias("key"), F.lit(0.45).alias("w")))
    long = long.unionByName(verbs.select("query_id", "chat_id", F.concat(F.lit("p:"), "verb").alias("key"), F.lit(0.6).alias("w")))
    pair = said.filter("direct").join(verbs.select("query_id", "verb"), "query_id")
    long = long.unionByName(pair.select("query_id", "chat_id", F.concat_ws(":", F.lit("sp"), tx.normalized_keyword("name"), "verb").alias("key"), F.lit(1.2).alias("w")))
    long = long.unionByName(targets.select("query_id", "chat_id", F.concat(F.lit("e:"), "o").alias("key"), (F.col("m") * 1.8).alias("w")))
    return _unit(long.groupBy("query_id", "chat_id", "key").agg(F.sum("w").alias("w")), ["query_id"])


def relation_scores(lore: DataFrame, queries: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(query_id, chat_id, lore_id, score): cosine of drafts and notes over relations, as a join on vector keys."""
    names = None if facts is None else facts.select("chat_id", F.col("keyword").alias("name")).distinct()
    triples = written_relations(lore).unionByName(text_relations(lore, names))
    q = query_vectors(lore, edges(lore, triples, facts), queries)
    v = relation_vectors(lore, triples).withColumnRenamed("w", "v")
    return q.join(v, ["chat_id", "key"]).groupBy("query_id", "chat_id", "lore_id").agg(F.sum(F.col("w") * F.col("v")).alias("score"))


def lookup_scores(lore: DataFrame, queries: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """A baseline: notes that an edge of a named subject and a verb of the draft points to, newest edge first."""
    n = enabled(lore)
    e = edges(n, written_relations(n).unionByName(text_relations(n)), facts).withColumnRenamed("turn", "edge_turn")
    q = queries.select("query_id", "chat_id", "draft", "turn", F.explode(fx.lore_verbs("draft")).alias("predicate"))
    hit = q.join(e, ["chat_id", "predicate"]).filter((F.col("turn").isNull() | (F.col("edge_turn") <= F.col("turn"))) & tx.keyword_appears("draft", "subject"))
    titles = n.select("chat_id", F.col("id").alias("lore_id"), tx.normalized_keyword("title").alias("t"))
    return hit.join(titles, (hit["chat_id"] == titles["chat_id"]) & (tx.normalized_keyword("object") == F.col("t"))).groupBy("query_id", hit["chat_id"], "lore_id").agg((1.0 + F.max("edge_turn")).alias("score"))


def bm25_scores(lore: DataFrame, queries: DataFrame, text: str = "full") -> DataFrame:
    units = lore.select("chat_id", F.col("id").alias("unit_id"), F.col("ins").cast("long").alias("ord"), corpus_text().alias("text"))
    return rank.bm25(build_index(units), queries.select("query_id", "chat_id", F.col(text).alias("query"))).select("query_id", "chat_id", F.col("unit_id").alias("lore_id"), "score")


def candidates(lore: DataFrame, queries: DataFrame, facts: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """Every note of every draft (query_id, chat_id, draft, recent_context, turn) with its evidence, standing and fused rank.

    forced: always on, or a keyword in the draft, or a keyword in the context of a keyword-only note.  The others need a
    word score above 5, a relation score above 0.15 or a keyword in the context; with semantic (query_id, lore_id, score)
    the closest searchable one too, if it stands out.  Fusion runs over the rankings of all that are in.
    """
    lore = enabled(lore)
    q = queries.withColumn("full", F.concat_ws(" ", "draft", F.coalesce("recent_context", F.lit(""))))
    both = q.select("query_id", "chat_id", "draft", "full").join(lore.select("chat_id", F.col("id").alias("lore_id"), "ins", "title", "content", "keywords", "alwaysInclude", "triggerType"), "chat_id")
    in_draft = F.filter("keywords", lambda k: tx.keyword_appears("draft", k))
    in_full = F.filter("keywords", lambda k: tx.keyword_appears("full", k))
    always = F.coalesce("alwaysInclude", F.lit(False))
    only = F.coalesce(F.col("triggerType") == "keyword", F.lit(False))
    both = both.withColumn("in_draft", in_draft).withColumn("in_full", in_full)
    both = both.withColumn("always", always).withColumn("forced", always | (F.size("in_draft") > 0) | (only & (F.size("in_full") > 0))).withColumn("searchable", ~F.col("forced") & ~only)
    b, r = cut(bm25_scores(lore, q)), cut(relation_scores(lore, q, facts))
    both = both.join(b.select("query_id", "lore_id", F.col("score").alias("bm25")), ["query_id", "lore_id"], "left").join(r.select("query_id", "lore_id", F.col("score").alias("relation")), ["query_id", "lore_id"], "left")
    both = both.fillna(0.0, ["bm25", "relation"])
    by_words, by_tie = F.col("searchable") & (F.col("bm25") > 5), F.col("searchable") & (F.col("relation") > 0.15)
    both = both.withColumn("context_hit", ~F.col("forced") & (F.size("in_full") > 0)).withColumn("by_words", by_words).withColumn("by_tie", by_tie)
    both = both.withColumn("admitted", F.col("by_words") | F.col("by_tie") | F.col("context_hit"))
    if semantic is not None:
        both = both.join(semantic.select("query_id", "lore_id", F.col("score").alias("cosine")), ["query_id", "lore_id"], "left")
        has = F.count("cosine").over(W.partitionBy("query_id")) > 0
        both = both.withColumn("cosine", F.when(has & F.col("searchable"), F.coalesce("cosine", F.lit(-1.0))))
        w = W.partitionBy("query_id", F.col("cosine").isNotNull())
        order = w.orderBy(F.desc("cosine"), "ins")
        both = both.withColumn("c_rank", F.when(F.col("cosine").isNotNull(), F.row_number().over(order) - 1)).withColumn("c_n", F.count("cosine").over(w))
        mid = F.max(F.when(F.col("c_rank") == F.floor(F.col("c_n") / 2), F.col("cosine"))).over(W.partitionBy("query_id"))
        both = both.withColumn("closest", (F.col("c_rank") == 0) & (F.col("cosine") - mid > 0.04))
        # The two word rankings are over what was in before meaning admits one more.
        both = both.withColumn("pooled", (F.col("forced") & ~F.col("always")) | F.col("admitted")).withColumn("admitted", F.col("admitted") | F.coalesce("closest", F.lit(False)))
    else:
        both = both.withColumn("pooled", (F.col("forced") & ~F.col("always")) | F.col("admitted")).withColumn("c_rank", F.lit(None).cast("int"))
    fused = F.lit(0.0)
    # First come wins ties: forced notes in their order, then by words, by relations (best first), then context hits.
    group = F.when(F.col("forced"), 0).when(F.col("by_words"), 1).when(F.col("by_tie"), 2).otherwise(3)
    within = F.when(group == 1, -F.col("bm25")).when(group == 2, -F.col("relation")).otherwise(0.0)
    pool_order = F.struct(group.alias("group"), within.alias("within"))
    for name in ("bm25", "relation"):
        ranked = F.col("pooled") & (F.col(name) > 0)
        place = F.row_number().over(W.partitionBy("query_id", ranked).orderBy(F.desc(F.round(name, 12)), pool_order, "ins")) - 1
        both = both.withColumn(f"{name}_rank", F.when(ranked, place))
        fused = fused + F.coalesce(1.0 / (vocab.RRF_BASE + F.col(f"{name}_rank")), F.lit(0.0))
    fused = fused + F.coalesce(1.0 / (vocab.RRF_BASE + F.col("c_rank")), F.lit(0.0))
    in_ = F.col("forced") | F.col("admitted")
    why = (
        F.when(F.col("always"), "상시").when(F.size("in_draft") > 0, F.concat(F.lit("키워드: "), F.array_join("in_draft", ", ")))
        .when(F.col("forced"), F.concat(F.lit("키워드: "), F.array_join("in_full", ", "))).when(F.col("context_hit"), F.concat(F.lit("키워드(직전 장면): "), F.array_join("in_full", ", ")))
        .otherwise(F.concat_ws("·", F.when(F.col("by_words"), "내용"), F.when(F.col("by_tie"), "관계"), F.when(F.col("c_rank").isNotNull(), "의미")))
    )
    return both.withColumn("fused", F.when(in_, fused)).withColumn("why", F.when(in_, why)).withColumn("pool_order", pool_order)


def select_lore(lore: DataFrame, queries: DataFrame, facts: DataFrame | None = None, semantic: DataFrame | None = None, budget: Column | int = 650) -> DataFrame:
    """(query_id, place, lore_id, title, line, why, units): notes that fit, forced ones first for the budget, shown by fused rank.

    A draft's notes are one array: the notes of one conversation, a bounded list.
    """
    c = candidates(lore, queries, facts, semantic).filter("forced or admitted")
    title = F.when(F.length(tx.trim(F.coalesce("title", F.lit("")))) > 0, tx.trim(F.col("title"))).otherwise("로어")
    line = tx.labelled_line("설정", title, tx.trim(F.col("content")))
    shown = (F.when(F.col("always"), 0).otherwise(1), F.desc("fused"), "pool_order", "ins")
    c = c.withColumn("line", line).withColumn("name", title)
    c = c.withColumn("shown", F.row_number().over(W.partitionBy("query_id").orderBy(*shown)))
    c = c.withColumn("turn_in", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("forced"), *shown)))
    if not isinstance(budget, int):
        c = c.withColumn("_budget", budget)
    item = F.struct("turn_in", "shown", "lore_id", F.col("name").alias("title"), "line", "why", tx.units("line").alias("units"))
    g = c.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("all"), *([] if isinstance(budget, int) else [F.first("_budget").alias("_budget")]))
    took = first_fit(F.col("all"), lambda x: x["units"], budget if isinstance(budget, int) else F.col("_budget"), separator=1)
    out = g.select("query_id", F.explode(took).alias("x")).select("query_id", "x.*")
    return out.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("shown"))).drop("turn_in", "shown")


def import_lore(texts: DataFrame) -> DataFrame:
    """Notes of JSON arrays (chat_id, text): rows without content go, ids, titles and switches get defaults, keywords may be a list in one text."""
    item = "id string, title string, keywords string, content string, relations array<array<string>>, alwaysInclude boolean, enabled boolean, triggerType string"
    rows = texts.select("chat_id", F.posexplode(F.from_json("text", f"array<struct<{', '.join(f'{a}: {b}' for a, b in (x.strip().split(' ', 1) for x in item.split(',')))}>>")).alias("ins", "x")).select("chat_id", "ins", "x.*")
    listed = F.from_json("keywords", "array<string>")
    kws = F.coalesce(listed, F.transform(F.split(F.coalesce("keywords", F.lit("")), ","), lambda k: tx.trim(k)))
    triples = F.transform(F.filter(F.coalesce("relations", F.array().cast("array<array<string>>")), lambda t: F.size(t) == 3), lambda t: F.struct(t[0].alias("subject"), t[1].alias("predicate"), t[2].alias("object")))
    return rows.filter(F.length(F.coalesce("content", F.lit(""))) > 0).select(
        "chat_id", "ins", F.coalesce("id", F.concat(F.lit("lore-"), F.col("ins").cast("string"))).alias("id"), F.coalesce("title", F.lit("로어")).alias("title"), kws.alias("keywords"), "content",
        triples.alias("relations"), F.coalesce("alwaysInclude", F.lit(False)).alias("alwaysInclude"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("triggerType", F.lit("both")).alias("triggerType"))


def export_lore(lore: DataFrame) -> DataFrame:
    own = [c for c in lore.columns if c != "chat_id"]
    return lore.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct(*sorted(own, key=lambda c: c != "ins")))).alias("x")).select("chat_id", F.to_json("x").alias("text"))


def parse_relation_lines(lines: Column) -> Column:
    """Relations written as ``subject > verb > object``, one a line; other lines are no relation."""
    parts = F.transform(F.split(lines, "\n"), lambda x: F.transform(F.split(x, ">"), lambda y: tx.trim(y)))
    good = F.filter(parts, lambda p: (F.size(p) == 3) & F.forall(p, lambda y: F.length(y) > 0))
    return F.transform(good, lambda p: F.struct(p[0].alias("subject"), p[1].alias("predicate"), p[2].alias("object")))
