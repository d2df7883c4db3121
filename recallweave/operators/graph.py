"""Temporal keyword graphs over message windows, cards from them, and sliding-window memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import facts as fx
from ..functions import text as tx
from .ordered import fold_groups
from .pack import first_fit

#: Information blocks, the two forms of speaker labels, and beginnings of words that are never salient.
_INFO = r"(?i)```(?:INFO|STATUS|STAT|SYSTEM)[\s\S]*?```|\[\s*#[\s\S]*?\]|└?\[\s*(?:호감도|성향|체력|마력|능력치|스탯|스킬|레벨|경험치|아이템|소지품|골드|골|퀘스트|위치|현재\s*상태|버프|디버프|HP|MP|EXP|Lv)[\s\S]*?\]"
_SPEAKER = r"^\*{0,2}([^*|｜:(\[{]{2,15})\*{0,2}\s*[|:｜]"
_WEAK = "^(?:턴|대화|상태|진행|이전|현재|유저|기억|했다|된다|있다|없다|한다|향하|입고|데려|보였|바라|마친|있었)"
_MARKED = "^[▍▌]\\s*([^\\s「『\"“]{2,10})\\s*[「『\"“]"


def windows_of(messages: DataFrame, size: int = 4) -> DataFrame:
    """messages with win, first and last: tumbling windows of ``size`` messages."""
    n = F.count(F.lit(1)).over(W.partitionBy("chat_id"))
    return messages.withColumn("win", F.floor((F.col("turn") - 1) / size).cast("int")).withColumn("first", (F.col("win") * size + 1).cast("int")).withColumn("last", F.least(n, F.col("win") * size + size).cast("int"))


def reply_windows(messages: DataFrame, replies: int = 2) -> DataFrame:
    """messages with win: a new window after every ``replies`` assistant messages."""
    before = W.partitionBy("chat_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return messages.withColumn("win", F.floor(F.coalesce(F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(before), F.lit(0)) / replies).cast("int"))


def sliding(messages: DataFrame, size: int = 4) -> DataFrame:
    """(chat_id, turn, texts): the last ``size`` messages at each message."""
    w = W.partitionBy("chat_id").orderBy("turn").rowsBetween(-(size - 1), 0)
    return messages.select("chat_id", "turn", F.collect_list("text").over(w).alias("texts"))


def _plain(text: Column | str) -> Column:
    """A message without its own block and information blocks; texts without the characters that these begin with skip the pattern."""
    return tx.let(tx.strip_own_block(text), lambda t: F.when(F.contains(t, F.lit("```")) | F.contains(t, F.lit("[")), F.regexp_replace(t, _INFO, " ")).otherwise(t))


def _story(text: Column) -> Column:
    return tx.let(text, _unlabelled)


def _unlabelled(text: Column) -> Column:
    out = text
    for p in (r"!\[[^\]]*\]\([^)]*\)", r"(?i)>\s*T-\d+"):
        out = F.regexp_replace(out, p, " ")
    out = F.when(text.rlike("[|:｜]"), F.regexp_replace(out, r"\*{0,2}[^*|｜:(\[{\n]{2,15}\*{0,2}\s*[|:｜]", " ")).otherwise(out)
    for p in (r"[👤💬⚔☀🌤🟡😊💡🕒📝💼🤝️]", r"(?:[*\-─—=_]\s*){2,}"):
        out = F.regexp_replace(out, p, " ")
    return out


def _weight(s: Column) -> Column:
    score = F.when(s.rlike(vocab.GESTURES), 4.5).otherwise(0.0) + F.when(s.rlike(vocab.UNDERCURRENTS), 4.0).otherwise(0.0) + F.when(s.rlike(vocab.TURNS), 3.5).otherwise(0.0)
    return score + F.when(F.length(s).between(18, 110), 2.0).otherwise(0.0)


def speakers(messages: DataFrame, stopwords: list[str] = vocab.STOPWORDS) -> DataFrame:
    """(chat_id, win, name): who speaks in each window, by labels at line starts."""
    plain = _plain("text")

    def name(line: Column) -> Column:
        told = lambda x: tx.let(F.regexp_extract(x, _SPEAKER, 1), lambda a: fx.clean_speaker(F.when(F.length(a) > 0, a).otherwise(F.regexp_extract(x, _MARKED, 1)), stopwords))
        return tx.let(tx.trim(line), told)

    # inside the row, where no filter is pushed down that would clean each line anew
    found = F.filter(F.transform(F.split(plain, "\n"), lambda x, n: F.struct(n.alias("n"), name(x).alias("name"))), lambda x: x["name"].isNotNull())
    named = messages.select("chat_id", "win", "turn", F.explode_outer(found).alias("x")).filter("x is not null").select("chat_id", "win", "turn", "x.n", "x.name")
    return named.groupBy("chat_id", "win", "name").agg(F.min(F.struct("turn", "n")).alias("at"))


def _windows_text(messages: DataFrame) -> DataFrame:
    plain = _plain("text")
    g = messages.select("chat_id", "win", "first", "last", "turn", plain.alias("t")).groupBy("chat_id", "win", "first", "last").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("m"))
    return g.select("chat_id", "win", "first", "last", _story(F.concat(F.lit(" "), F.array_join(F.transform("m", lambda x: x["t"]), " "))).alias("story"))


def salient_words(windows: DataFrame, k: int = 8, stopwords: list[str] = vocab.STOPWORDS, taken: DataFrame | None = None) -> DataFrame:
    """(chat_id, win, word, c, place): the k most frequent Hangul words of each window less two particles, first seen first on ties."""
    words = windows.select("chat_id", "win", F.posexplode(F.regexp_extract_all("story", F.lit(f"[{tx.HANGUL}]{{2,8}}"), F.lit(0))).alias("at", "w"))
    words = words.withColumn("word", fx.drop_particle(fx.drop_particle(F.col("w"), vocab.SALIENT_PARTICLES), vocab.SALIENT_PARTICLES))
    words = words.filter((F.length("word") >= 2) & ~F.col("word").isin(stopwords) & ~F.col("word").rlike(_WEAK)).groupBy("chat_id", "win", "word").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("at"))
    if taken is not None:
        words = words.join(taken, ["chat_id", "win", "word"], "left_anti")
    return words.withColumn("place", F.row_number().over(W.partitionBy("chat_id", "win").orderBy(F.desc("c"), "at"))).filter(F.col("place") <= k)


def evolution_graph(messages: DataFrame, size: int = 4, dropped: DataFrame | None = None, stopwords: list[str] = vocab.STOPWORDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges).  A node is a keyword in a window with its best sentence; edges tie a keyword to its previous node
    (evolves_to) and the nodes of a window to each other (co_occurs).

    Node ids are (keyword, window end), so they stay unique when old nodes are pruned.
    """
    m = windows_of(messages, size)
    w = _windows_text(m)
    who = speakers(m, stopwords).select("chat_id", "win", F.col("name").alias("word"), F.lit(0).alias("g"), (F.col("at.turn") * 100000 + F.col("at.n")).cast("long").alias("o"), F.lit("speaker").alias("role"))
    fixed = F.array(*(F.struct(F.lit(x).alias("word"), F.lit(g).alias("g"), F.lit(i).cast("long").alias("o")) for g, xs in ((1, vocab.LOCATIONS), (2, vocab.STATES)) for i, x in enumerate(xs)))
    seen = w.select("chat_id", "win", F.explode(F.filter(fixed, lambda x: F.contains(F.col("story"), x["word"]))).alias("x")).select("chat_id", "win", "x.*").withColumn("role", F.lit("concept"))
    known = who.unionByName(seen)
    more = salient_words(w, stopwords=stopwords, taken=known.select("chat_id", "win", "word")).select("chat_id", "win", "word", F.lit(3).alias("g"), F.col("place").cast("long").alias("o"), F.lit("concept").alias("role"))
    first = W.partitionBy("chat_id", "win", "word").orderBy("g", "o")
    keys = known.unionByName(more).withColumn("r", F.row_number().over(first)).filter((F.col("r") == 1) & (F.length("word") >= 2)).drop("r")
    if dropped is not None:
        keys = keys.join(dropped.select("chat_id", F.col("keyword").alias("word")).distinct(), ["chat_id", "word"], "left_anti")
    sents = w.select("chat_id", "win", F.posexplode(F.split("story", r"(?<=[.!?])(?U)\s+|\n+")).alias("n", "s")).withColumn("s", fx.clean_sentence("s")).filter(F.length("s") >= 8)
    inner = F.col("s").rlike(vocab.INNER)
    sents = sents.withColumn("weight", F.when(inner, -1.0).otherwise(_weight(F.col("s"))))
    hit = keys.join(sents, ["chat_id", "win"]).filter(F.contains("s", "word"))
    best = hit.groupBy("chat_id", "win", "word", "g", "o", "role").agg(F.max_by("s", F.struct("weight", (-F.col("n")).alias("n"))).alias("s"))
    nodes = best.join(w.select("chat_id", "win", "first", "last"), ["chat_id", "win"])
    nodes = nodes.select("chat_id", F.concat_ws("@", "word", F.col("last").cast("string")).alias("id"), F.col("word").alias("keyword"), "first", F.col("last").alias("turn"), F.substring("s", 1, 95).alias("summary"), "role",
                         F.row_number().over(W.partitionBy("chat_id").orderBy("win", "g", "o", "word")).alias("ord"))
    return nodes, graph_edges(nodes)


def graph_edges(nodes: DataFrame) -> DataFrame:
    """(chat_id, source, target, type) of nodes (chat_id, id, keyword, turn, ord)."""
    chain = nodes.withColumn("source", F.lag("id").over(W.partitionBy("chat_id", "keyword").orderBy("ord"))).filter("source is not null").select("chat_id", "source", F.col("id").alias("target"), F.lit("evolves_to").alias("type"))
    a, b = nodes.select("chat_id", "turn", F.col("id").alias("source"), F.col("ord").alias("i")), nodes.select("chat_id", "turn", F.col("id").alias("target"), F.col("ord").alias("j"))
    # A window holds a bounded number of keywords: its speakers, fixed words and eight more.
    pairs = a.join(b, ["chat_id", "turn"]).filter("i < j").select("chat_id", "source", "target", F.lit("co_occurs").alias("type"))
    return chain.unionByName(pairs)


def drop_keywords(nodes: DataFrame, edges: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without dropped keywords (chat_id, keyword), and the edges between the rest."""
    kept = nodes.join(dropped.select("chat_id", tx.trim(F.col("keyword")).alias("keyword")).distinct(), ["chat_id", "keyword"], "left_anti")
    return kept, edges_between(edges, kept)


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("chat_id", "id")
    return edges.join(ids.withColumnRenamed("id", "source"), ["chat_id", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["chat_id", "target"], "left_semi")


def compact_graph(nodes: DataFrame, edges: DataFrame, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """Graphs above ``most`` nodes keep the root, the middle and the last two of chains above four."""
    chat, chain = W.partitionBy("chat_id"), W.partitionBy("chat_id", "keyword")
    n = nodes.withColumn("total", F.count(F.lit(1)).over(chat)).withColumn("len", F.count(F.lit(1)).over(chain)).withColumn("at", F.row_number().over(chain.orderBy("ord")) - 1)
    keep = (F.col("total") <= most) | (F.col("len") <= 4) | (F.col("at") == 0) | (F.col("at") == F.floor(F.col("len") / 2)) | (F.col("at") >= F.col("len") - 2)
    kept = n.filter(keep).select(nodes.columns)
    return kept, edges_between(edges, kept)


def domain_of(keyword: Column, speaks: Column, n: Column, stopwords: list[str] = vocab.STOPWORDS) -> Column:
    """The domain of a card by rules; null for concepts that are grammar remnants or come back less than three times."""
    some = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(keyword, p))
    loose = (n < 3) | keyword.isin(stopwords) | keyword.rlike("(?:다|고|며|서|면|지|라|게|야|든)\\z")
    return F.when(speaks & (fx.clean_speaker(keyword, stopwords) == keyword), "인물").when(keyword.isin(vocab.LOCATIONS), "장소").when(some(vocab.SKILL_PARTS), "기술").when(some(vocab.EVENT_PARTS), "사건/약조").when(~loose, "개념")


def evolution_cards(nodes: DataFrame, most: int = 16, stopwords: list[str] = vocab.STOPWORDS) -> DataFrame:
    """One card a keyword: domain, current state, history (root, middle and last of long chains), standing, by weight of domain."""
    n = nodes.withColumn("card", fx.clean_keyword("keyword", stopwords)).filter("card is not null")
    n = n.withColumn("last_turn", F.max("turn").over(W.partitionBy("chat_id")))
    item = F.struct("ord", "first", "turn", "summary")
    g = n.groupBy("chat_id", F.col("card").alias("keyword"), "last_turn").agg(F.array_sort(F.collect_list(item)).alias("chain"), F.max(F.when(F.col("role") == "speaker", True).otherwise(False)).alias("speaks"))
    size = F.size("chain")
    g = g.withColumn("node_count", size).withColumn("domain", domain_of(F.col("keyword"), F.col("speaks"), size, stopwords)).filter("domain is not null")
    range_ = lambda x: F.concat(x["first"].cast("string"), F.lit("~"), x["turn"].cast("string"))
    told = lambda lead, x: F.concat(F.lit(f"[{lead}턴 "), range_(x), F.lit("] "), x["summary"])
    root, mid, last = F.get("chain", F.lit(0)), F.get("chain", F.floor(size / 2).cast("int")), F.get("chain", size - 1)
    history = F.when(size <= 3, F.transform("chain", lambda x: told("", x))).otherwise(F.array(told("발단: ", root), told("전개: ", mid), told("최근: ", last)))
    weight = F.create_map(*(F.lit(x) for kv in vocab.DOMAIN_ORDER.items() for x in kv))[F.col("domain")]
    g = g.select("chat_id", "keyword", "domain", last["summary"].alias("current"), history.alias("history"), "node_count", last["turn"].alias("turn"), root["first"].alias("first"), root["summary"].alias("root"), range_(root).alias("root_range"), range_(last).alias("last_range"),
                 F.when(F.col("last_turn") - last["turn"] <= 4, "active").otherwise("dormant").alias("status"), F.when(F.col("domain") == "인물", 1.0).when(F.col("domain") == "사건/약조", 0.85).otherwise(0.7).alias("importance"),
                 (weight * 10 + F.least(size, F.lit(20))).alias("w"), root["ord"].alias("o"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("w"), "o", "keyword"))).filter(F.col("place") <= most).drop("w", "o")


def query_graph(cards: DataFrame, queries: DataFrame, budget: int = 500) -> DataFrame:
    """(query_id, text): current states of active cards and, for dormant ones that the draft names, their way to now."""
    c = cards.join(queries.select("query_id", "chat_id", tx.terms("draft").alias("t")), "chat_id")
    asked = F.exists("t", lambda x: F.contains(F.col("keyword"), x))
    active = F.col("status") == "active"
    line = F.when(active, F.concat(F.lit("• ["), "keyword", F.lit("] 현재 상태: "), "current")).when(F.col("node_count") > 1, F.concat(F.lit("• ["), "keyword", F.lit("] (발단: 턴 "), "root_range", F.lit(") "), "root", F.lit(" ──> (현재: 턴 "), "last_range", F.lit(") "), "current")).otherwise(F.concat(F.lit("• ["), "keyword", F.lit("] (턴 "), "last_range", F.lit(") "), "current"))
    priority = F.when(active, 10.0 + F.when(asked, 5.0).otherwise(0.0)).otherwise(8.0) + F.col("importance") * 2
    c = c.filter(active | asked).select("query_id", (-priority).alias("p"), "place", line.alias("line"), tx.units(line).alias("n"))
    g = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("p", "place", "line", "n"))).alias("all"))
    # A line may end at the budget; the break after it then does not count.
    took = first_fit(F.col("all"), lambda x: x["n"], budget, separator=1)
    return g.select("query_id", F.array_join(F.transform(took, lambda x: x["line"]), "\n").alias("text"))


# --- sliding-window memory ----------------------------------------------------------------------------


def window_details(messages: DataFrame, stopwords: list[str] = vocab.STOPWORDS) -> DataFrame:
    """(chat_id, win, first, last, speakers, location, states, fact): what each window (messages with win) shows, its best sentence or two."""
    m = messages.withColumn("first", F.min("turn").over(W.partitionBy("chat_id", "win"))).withColumn("last", F.max("turn").over(W.partitionBy("chat_id", "win")))
    plain = _plain("text")
    t = m.select("chat_id", "win", "first", "last", "turn", plain.alias("plain"))
    who = speakers(m, stopwords).groupBy("chat_id", "win").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("speakers"))
    places = F.array(*map(F.lit, vocab.LOCATIONS))
    held = F.array(*map(F.lit, vocab.STATES))
    # texts are cleaned once: each look at one, and each sentence of one, is inside the row's own expression
    shows = tx.let(F.col("plain"), lambda t: F.struct(F.get(F.reverse(F.filter(places, lambda p: F.contains(t, p))), F.lit(0)).alias("at"), F.filter(held, lambda s: F.contains(t, s)).alias("states")))
    at, states = F.col("shows.at"), F.array_distinct(F.flatten(F.collect_list("shows.states")))
    seen = t.select("chat_id", "win", "first", "last", "turn", shows.alias("shows")).groupBy("chat_id", "win", "first", "last").agg(F.max_by(at, F.when(at.isNotNull(), F.col("turn"))).alias("location"), F.array_sort(states).alias("states"))
    parts = F.transform(F.split(_story(F.col("plain")), r"(?<=[.!?])(?U)\s+|\n+"), lambda x, n: F.struct(n.alias("n"), fx.clean_sentence(x).alias("s")))
    outer = F.filter(parts, lambda x: (F.length(x["s"]) >= 8) & ~x["s"].rlike(vocab.INNER))
    strong = F.filter(F.transform(outer, lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s"), _weight(x["s"]).alias("w"))), lambda x: x["w"] >= 3.0)
    s = t.select("chat_id", "win", "turn", F.explode_outer(strong).alias("x")).filter("x is not null").select("chat_id", "win", "turn", "x.*")
    ranked = s.groupBy("chat_id", "win").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "turn", "n", "s"))).alias("a"))
    best = F.get("a", F.lit(0))
    second = F.get(F.filter("a", lambda x: (x["s"] != best["s"]) & (F.abs(F.length(x["s"]) - F.length(best["s"])) > 5)), F.lit(0))
    both = second.isNotNull() & (second["w"] <= -5.0) & (F.length(best["s"]) + F.length(second["s"]) < 110)
    fact = ranked.select("chat_id", "win", F.when(both, F.concat_ws(" ", best["s"], second["s"])).otherwise(best["s"]).alias("fact"))
    return seen.join(who, ["chat_id", "win"], "left").join(fact, ["chat_id", "win"], "left").select("chat_id", "win", "first", "last", F.coalesce("speakers", tx.no_strings()).alias("speakers"), "location", "states", F.coalesce("fact", F.lit(vocab.NO_FACT)).alias("fact"))


def sliding_memory(details: DataFrame) -> DataFrame:
    """(chat_id, characters, location, states, timeline, recent, prompt): the state after all windows.

    The last two windows stay in detail; older ones are lines, or above four two epochs with their longest fact.
    """
    def build(rows: list[dict]) -> list[tuple]:
        names: dict[str, int] = {}
        states: list[str] = []
        for r in rows:
            for n in r["speakers"]:
                names[n] = names.get(n, 0) + 1
            states = list(dict.fromkeys([*r["states"], *states]))
        old, recent = rows[:-2], rows[-2:]
        if len(old) <= 4:
            line = [("전개", r["first"], r["last"], r["fact"]) for r in old]
        else:
            half = len(old) // 2
            line = [(name, part[0]["first"], part[-1]["last"], max((r["fact"] for r in part), key=len)) for name, part in (("발단", old[:half]), ("전개", old[half:]))]
        place = next((r["location"] for r in reversed(rows) if isinstance(r["location"], str)), None)
        text = [f"[기억 진화 연대기 (턴 1 ~ {rows[-1]['last']})]"]
        text += [f"• 중심 인물: {', '.join(list(names)[:6])}"] * bool(names) + [f"• 현재 장소: {place}"] * bool(place) + [f"• 지속 상태: {', '.join(states[:6])}"] * bool(states)
        text += ["[누적 서사 흐름]", *([f"• [{n} (턴 {a}~{b})] {f}" for n, a, b, f in line] or ["• [서사 발단] 사건 및 수련의 기초 단계 진행"])]
        text += ["[최근 세부 상호작용 (직전 2회 응답 디테일)]", *(f"• [턴 {r['first']}~{r['last']}] {r['fact']}" for r in recent), "[당면 상황]", f"• {recent[-1]['fact']}"]
        made = (rows[0]["chat_id"], [{"name": n, "windows": c} for n, c in names.items()], place, states, [f"{n} {a}~{b}: {f}" for n, a, b, f in line], [r["fact"] for r in recent], "\n".join(text))
        return [made]

    return fold_groups(details, ["chat_id"], ["win"], build, "chat_id string, characters array<struct<name: string, windows: int>>, location string, states array<string>, timeline array<string>, recent array<string>, prompt string")


def window_hints(messages: DataFrame, stopwords: list[str] = vocab.STOPWORDS, most: int = 12) -> DataFrame:
    """(chat_id, hints, domains): what a batch (one chat_id) seems to be about, for an extraction prompt."""
    from . import rank
    from .index import build_index
    from .segment import units

    n = F.count(F.lit(1)).over(W.partitionBy("chat_id"))
    m = messages.withColumn("win", F.lit(0)).withColumn("first", F.lit(1)).withColumn("last", n.cast("int"))
    nodes, _ = evolution_graph(m.select("chat_id", "turn", "id", "role", "text"), size=1 << 20, stopwords=stopwords)
    cards = evolution_cards(nodes, stopwords=stopwords)
    ix = build_index(units(m, 30, 180))
    asked = cards.select(F.concat_ws("\u0001", "chat_id", "keyword").alias("query_id"), "chat_id", F.col("keyword").alias("query"))
    own = rank.bm25(ix, asked).groupBy("query_id").agg(F.max("score").alias("own"))
    c = cards.withColumn("query_id", F.concat_ws("\u0001", "chat_id", "keyword")).join(own, "query_id", "left").withColumn("score", F.coalesce("own", F.lit(0.0)) + F.col("importance"))
    c = c.withColumn("r", F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("score"), "place"))).filter(F.col("r") <= most)
    g = c.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("r", "keyword", "domain"))).alias("a"))
    return g.select("chat_id", F.array_join(F.transform("a", lambda x: F.concat(x["keyword"], F.lit("("), x["domain"], F.lit(")"))), ", ").alias("hints"), F.transform("a", lambda x: F.struct(x["keyword"].alias("name"), x["domain"].alias("domain"))).alias("domains"))
