"""Searches that read less than everything, against plain loops: blocks, phrases, names, as-of, middle cosine, stored tables."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallweave.operators import asof, blocks, evaluate, grams, index, lineage, names, pack, rank, scored, state
from recallweave.operators.index import build_index


def corpus(spark, r, n=1500, vocabulary=600):
    """Units whose words follow a steep law, some near each other."""
    words = [f"w{i:03d}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    texts = [" ".join(r.choices(words, weights, k=r.randrange(5, 60))) for _ in range(n)] + ["", " "]
    return spark.createDataFrame([("c", f"u{i}", i, t) for i, t in enumerate(texts)], "chat_id string, unit_id string, ord long, text string"), words, weights


def best(df):
    return sorted((x.query_id, x.rank, x.unit_id, round(x.score, 5), x.n_matched) for x in df.collect())


def plain_best(ix, q, k):
    hits = rank.bm25(ix, q, words=False).withColumn("score", F.round("score", 6))
    return best(rank.top(hits, k).select("query_id", "rank", "unit_id", "score", F.col("n_matched").cast("long").alias("n_matched")))


def test_best_by_blocks_is_the_whole_ranking_s_beginning(spark):
    r = random.Random(1)
    units, words, weights = corpus(spark, r)
    ix = build_index(units).stored("t")
    bx = blocks.build_blocks(ix, block=16)
    asked = [(f"q{i}", "c", " ".join(r.choices(words, weights, k=2) + r.choices(words, k=2)), r.choice([None, 300, 1200])) for i in range(30)] + [("none", "c", "nothing known", None), ("empty", "c", "", None), ("other", "x", "w000 w001", None), ("long", "c", " ".join(words), None)]
    q = spark.createDataFrame(asked, "query_id string, chat_id string, query string, max_ord long")
    assert best(blocks.top_bm25(bx, q, 5, digits=6)) == plain_best(ix, q, 5)


def test_blocks_sum_less_than_a_third(spark):
    r = random.Random(2)
    units, words, weights = corpus(spark, r, n=4000)
    ix = build_index(units).stored("t")
    bx = blocks.build_blocks(ix)
    # a frequent word or two beside telling ones
    q = spark.createDataFrame([(f"q{i}", "c", " ".join(r.choices(words[:8], k=2) + r.choices(words[150:], k=2))) for i in range(40)], "query_id string, chat_id string, query string")
    t = blocks.TopSearch(bx, q, 3)
    summed = t.seeds.count() + t.tried.count() + t.summed.count() + sum(x.count() for x in t.looked_up)
    every = rank.query_rows(q).join(ix.postings, ["chat_id", "term"]).count()
    assert best(t.hits(6)) == plain_best(ix, q, 3)
    assert summed < every / 3, (summed, every)


def test_blocks_hold_every_posting_once_and_stay_small(spark):
    units, *_ = corpus(spark, random.Random(3))
    ix = build_index(units).stored("t")
    bx = blocks.build_blocks(ix, block=8)
    assert bx.blocks.agg(F.sum("n")).first()[0] == ix.postings.count() == bx.impacts.count()
    assert bx.blocks.filter("n <> size(entries) or top <> array_max(transform(entries, e -> e.gain))").isEmpty()
    assert bx.blocks.agg(F.max("n")).first()[0] <= 8 * 4 * 3
    assert build_index(units.limit(0)).stored("t").impacts.count() == 0 and blocks.build_blocks(build_index(units.limit(0))).terms.count() == 0


def test_prefix_credit_counts_in_the_best(spark):
    rows = [("c", f"u{i}", i, t) for i, t in enumerate(["고양이는 집에", "고양이들 많다", "강아지 집에", "고양이 고양이"])]
    ix = build_index(spark.createDataFrame(rows, "chat_id string, unit_id string, ord long, text string")).stored("t")
    q = spark.createDataFrame([("q", "c", "고양이 집에")], "query_id string, chat_id string, query string")
    assert best(blocks.top_bm25(blocks.build_blocks(ix), q, 2, digits=6)) == plain_best(ix, q, 2)


def test_phrases_are_found_where_they_stand_first(spark):
    r = random.Random(4)
    texts = [("c" if i % 3 else "d", f"u{i}", "".join(r.choices("ab é한😀", k=r.randrange(0, 60)))) for i in range(120)] + [("c", "null", None), ("c", "long", "x" * 100_000 + "ab é")]
    asked = [(f"q{i}", r.choice("cd"), "".join(r.choices("ab é한😀", k=k))) for i, k in enumerate([1, 2, 3, 4, 5, 6, 7] * 6)] + [("e", "c", ""), ("n", "c", None), ("z", "c", "nowhere at all"), ("x", "c", "xxxxxab")]
    got = {(x.query_id, x.unit_id): x.at for x in grams.find_phrases(spark.createDataFrame(texts, "chat_id string, unit_id string, text string"), spark.createDataFrame(asked, "query_id string, chat_id string, phrase string")).collect()}
    assert got == {(q, u): t.find(p) for q, c, p in asked for d, u, t in texts if c == d and p and t and p in t} and len(got) > 50
    none = grams.find_phrases(spark.createDataFrame(texts, "chat_id string, unit_id string, text string"), spark.createDataFrame([], "query_id string, chat_id string, phrase string"))
    assert none.count() == 0


def test_phrases_by_chat_and_by_grams_agree(spark, monkeypatch):
    """Few phrases a chat are looked for in its texts at once; many, and many bytes of them, by grams; the result is the same."""
    r = random.Random(6)
    texts = [(f"c{i % 7}", f"u{i}", "".join(r.choices("ab é한😀", k=r.randrange(0, 60)))) for i in range(150)] + [("c1", "null", None), ("c1", "u1", "ab é")]
    asked = [(f"q{i}", f"c{i % 7}", "".join(r.choices("ab é한😀", k=1 + i % 5))) for i in range(14)]
    t, q = spark.createDataFrame(texts, "chat_id string, unit_id string, text string"), spark.createDataFrame(asked, "query_id string, chat_id string, phrase string")
    found = lambda: sorted(map(tuple, grams.find_phrases(t, q).collect()))
    first = found()
    plan = grams.find_phrases(t, q)._jdf.queryExecution().executedPlan().toString()
    assert len(first) > 20 and "InArrow" not in plan and "NestedLoop" not in plan
    monkeypatch.setattr(grams, "FEW", 0)
    assert found() == first
    # the grams of the texts are sifted where they are made and meet those asked for without a shuffle
    assert "SortMergeJoin" not in grams.find_phrases(t, q)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(grams, "SENT", 0)
    assert found() == first


def test_no_text_meets_a_phrase_that_it_has_nothing_of(spark):
    """The plan has no join on the conversation alone, and candidates are few."""
    texts = spark.createDataFrame([("c", f"u{i}", f"text number {i} of many") for i in range(300)], "chat_id string, unit_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", "c", f"number {i} of") for i in range(300)], "query_id string, chat_id string, phrase string")
    found = grams.find_phrases(texts, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() == 300
    assert evaluate.gold_from_evidence(texts, asked.withColumnRenamed("phrase", "contains")).count() == 300


def test_names_of_many_parts(spark):
    r = random.Random(5)
    every = ["".join(r.choices("abé한", k=r.randrange(1, 5))) for _ in range(80)] + ["", None]
    texts = [(i, "".join(r.choices("abé한 ", k=r.randrange(0, 50)))) for i in range(60)] + [(60, None), (61, ""), (0, "abab")]
    t = spark.createDataFrame(texts, "id long, text string")
    n = spark.createDataFrame([(x,) for x in every + every], "name string")
    want = sorted((i, x, p, p + len(x)) for i, s in texts if s for x in {x for x in every if x} for p in range(len(s)) if s.startswith(x, p))
    for part in (names.PART_BYTES, 40):
        assert sorted(tuple(x) for x in names.places(t, n, part_bytes=part).collect()) == want
    assert names.places(t, n.limit(0)).count() == 0


def test_leftmost_longest_is_the_alternation_s_choice(spark):
    r = random.Random(6)
    every = sorted({"".join(r.choices("ab", k=r.randrange(1, 5))) for _ in range(9)}, key=lambda x: (-len(x), x))
    texts = ["".join(r.choices("abc", k=30)) for _ in range(40)]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = names.places(t, spark.createDataFrame([(x,) for x in every], "name string")).groupBy("id").agg(names.leftmost_longest(F.collect_list(F.struct("from", "to", "name"))).alias("f"))
    got = {x.id: [y.name for y in x.f] for x in found.collect()}
    assert got == {i: m for i, s in enumerate(texts) if (m := re.findall("|".join(every), s))}


def test_model_names_not_followed_by_a_digit(spark):
    models = spark.createDataFrame([("vendor-sonata-3",), ("vendor-sonata-35",), ("other-flute-preview",)], "id string")
    texts = spark.createDataFrame([(1, "sonata 3 sings"), (2, "Sonata-35!"), (3, "sonata 351 and sonata 3"), (4, "a flute"), (5, None), (6, "sonata 37")], "k long, text string")
    got = {x.k: x.model for x in state.model_for_text(texts, models).collect()}
    assert got == {1: "vendor-sonata-3", 2: "vendor-sonata-35", 3: "vendor-sonata-3", 4: "other-flute-preview" if got[4] else None, 5: None, 6: None}


def test_last_before_with_a_hot_key(spark):
    r = random.Random(7)
    left = [(i, r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, *range(300)]), f"x{i}") for i in range(900)]
    right = [(r.choice(["hot"] * 6 + ["a", "z", None]), r.choice([None, *range(300)]), i) for i in range(400)]
    rows = spark.createDataFrame(left, "id long, k string, t int, extra string")
    told = spark.createDataFrame(right, "k string, t int, v long")
    for equal in (False, True):
        got = {x.id: x.v for x in asof.last_before(rows, told, "k", "t", ["v"], tie="v", equal=equal, stretches=13).collect()}
        want = {}
        for i, k, t, _ in left:
            seen = [(s, v) for j, s, v in right if k is not None and t is not None and j == k and s is not None and (s <= t if equal else s < t)]
            want[i] = max(seen)[1] if seen else None
        assert got == want
    assert asof.last_before(rows, told.limit(0), "k", "t", ["v"]).filter("v is not null").count() == 0
    assert asof.last_before(rows.limit(0), told, "k", "t", ["v"]).count() == 0


def test_middle_gap_is_that_of_all_cosines(spark):
    r = np.random.default_rng(8)
    v = [(f"u{i}", [float(x) for x in r.normal(size=6)]) for i in range(301)] + [("zero", [0.0] * 6), ("same", None)]
    v[-1] = ("same", v[0][1])
    vectors = spark.createDataFrame(v, "unit_id string, vec array<double>")
    queries = vectors.limit(12).unionByName(vectors.filter("unit_id = 'zero'")).withColumnRenamed("unit_id", "query_id")
    for gap in (0.04, 0.9, 1.1):
        want = {(x.query_id, x.unit_id, round(x.gap, 6)) for x in rank.stands_out(rank.cosines(vectors, queries).filter("score is not null"), gap).collect()}
        assert {(x.query_id, x.unit_id, round(x.gap, 6)) for x in rank.middle_gap(vectors, queries, gap).collect()} == want
    assert "NestedLoop" not in rank.middle_gap(vectors, queries)._jdf.queryExecution().executedPlan().toString()


def test_stored_once_until_the_files_change(spark, tmp_path):
    made = []
    make = lambda: made.append(lineage.kept_table(spark.range(3), lineage.fresh_folder(spark, "once"))) or made[-1]
    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    for _ in range(2):
        assert lineage.derived_once(spark, "x", str(tmp_path / "t.parquet"), make).count() == 3
    assert len(made) == 1
    spark.range(6).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    lineage.derived_once(spark, "x", str(tmp_path / "t.parquet"), make)
    assert len(made) == 2
    folder = made[-1].inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert os.path.isdir(folder) and lineage.clear_stored(spark) >= 2 and not os.path.isdir(folder)
    lineage.derived_once(spark, "x", str(tmp_path / "t.parquet"), make)
    assert len(made) == 3


def test_large_groups_are_packed_in_rounds(spark):
    r = random.Random(9)
    rows = [(g, i, r.choice([0, 1, 2, 5, 9, 30, 70, 400])) for g in ("a", "b", None) for i in range({"a": 700, "b": 90, None: 300}[g])]
    d = spark.createDataFrame(rows, "g string, i int, c int")
    for budget, separator in ((100, 0), (1000, 1), (7, 2), (100_000, 0), (0, 0)):
        want = {}
        for g in ("a", "b", None):
            left, n = budget + separator, 0
            for _, i, c in (x for x in rows if x[0] == g):
                if c + separator <= left:
                    left, n = left - c - separator, n + 1
                    want[g, i] = n
        for task_rows in (pack.TASK_ROWS, 20):
            got = {(x.g, x.i): x.pack_rank for x in pack.pack_groups(d.repartition(7), ["g"], [F.asc("i")], F.col("c"), budget, separator, task_rows).collect()}
            assert got == want, (budget, separator, task_rows)
    whole = sorted(map(str, pack.stop_at_overflow(d, ["g"], [F.asc("i")], F.col("c"), 500).collect()))
    assert sorted(map(str, pack.stop_at_overflow(d, ["g"], [F.asc("i")], F.col("c"), 500, spread=True).collect())) == whole and len(whole) > 5


def test_cosines_in_small_passes_and_slices_agree(spark, monkeypatch):
    """A pass has few queries and a task few cosines at once, however many queries there are."""
    import pyarrow as pa

    r = random.Random(9)
    v = spark.createDataFrame([(f"v{i}", [r.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [("zero", [0.0] * 6)], "unit_id string, vec array<double>")
    q = v.limit(20).withColumnRenamed("unit_id", "query_id")
    found = lambda: (sorted(map(tuple, rank.cosine_top(v, q, 5).collect())), sorted(map(tuple, rank.middle_gap(v, q).collect())))
    first = found()
    assert len(first[0]) == 100 and len(first[1]) == 20
    monkeypatch.setattr(rank, "PASS_QUERIES", 7)
    assert rank._passes(20, 6) == 3 and found() == first
    batch = pa.RecordBatch.from_pydict({"x": list(range(10_000))})
    cut = list(rank._slices([batch], 60_000))
    assert sum(b.num_rows for b in cut) == 10_000 and max(b.num_rows for b in cut) * 60_000 <= rank.BLOCK_CELLS


def test_frequencies_and_statistics_without_postings(spark):
    """Equal to the index's tables, also where a unit has two rows; the plans count terms in rows and shuffle no (unit, term)."""
    rows = [("c", f"u{i}", i, t) for i, t in enumerate(["one two two", "", None, "Two three one"])] + [("d", "u0", 0, "two")]
    schema = "chat_id string, unit_id string, ord long, text string"
    for made in (rows, [*rows, ("c", "u0", 0, "one four")]):
        u = spark.createDataFrame(made, schema)
        ix = build_index(u)
        same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        assert same(index.document_frequencies(u), ix.df) and same(index.corpus_statistics(u), ix.stats)
    plan = index.document_frequencies(spark.createDataFrame(rows, schema))._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" in plan and "unit_id" not in plan.split("Project")[0]


def test_sets_that_may_share_enough_are_counted_block_by_block(spark, monkeypatch):
    """Of all pairs only near ones leave a task, none is missed, and the order of blocks and chunks does not matter."""
    from recallweave.operators import near

    r = random.Random(12)
    words, weights = [f"w{i}" for i in range(400)], [1 / (i + 3) for i in range(400)]
    sets = [sorted(set(r.choices(words, weights, k=r.randrange(1, 90)))) for _ in range(150)]
    sets += [sorted({*r.sample(s, max(1, int(len(s) * r.uniform(0.5, 1)))), *r.sample(words, 3)}) for s in sets]
    rows = [(r.choice("ab"), i, len(s), s) for i, s in enumerate(sets)]
    d = spark.createDataFrame(rows, "card string, place long, n int, set array<string>")
    share = lambda s, t: len(set(s) & set(t)) / len(set(s) | set(t))
    want = {(c, i, j) for c, i, _, s in rows for e, j, _, t in rows if c == e and j < i and share(s, t) >= 0.45}
    for words_, cells in ((near.BLOCK_WORDS, near.CELLS), (300, 50)):
        monkeypatch.setattr(near, "BLOCK_WORDS", words_)
        monkeypatch.setattr(near, "CELLS", cells)
        found = [tuple(x) for x in near.meeting(d, 0.45).collect()]
        assert len(found) == len(set(found)) and set(found) >= want and len(found) <= len(want) + 5 and len(want) > 40
    assert near.meeting(d.limit(0), 0.45).count() == 0


def test_signs_tell_most_pairs_apart_before_words_are_counted(monkeypatch):
    """Of unrelated sets hardly a pair is counted word by word, near ones of any size are found, and their possible share is no less than theirs."""
    import pyarrow as pa

    from recallweave.operators import near

    r, counted = np.random.default_rng(5), []
    by_row = near._by_row
    monkeypatch.setattr(near, "_by_row", lambda x, y: counted.append(len(x)) or by_row(x, y))
    sets = [r.choice(60_000, r.integers(2, 700), replace=False) for _ in range(500)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], r.choice(60_000, len(s) // 4)])) for s in sets[:200]]
    table = lambda some: pa.table({"n": pa.array([len(s) for s in some], pa.int32()), "marks": pa.array([s.astype(np.uint16).tobytes() for s in some], pa.binary())})
    share = lambda s, t: len(c := set(s.tolist()) & set(t.tolist())) / (len(s) + len(t) - len(c))
    want = {(i, 500 + i): share(s, sets[500 + i]) for i, s in enumerate(sets[:200]) if share(s, sets[500 + i]) >= 0.45}
    pairs = [*near._near(near._Side(table(sets)), None, 0.45)]
    got = {(min(i, j), max(i, j)): m for x, y, most in pairs for i, j, m in zip(x.tolist(), y.tolist(), most, strict=True)}
    assert want.keys() <= got.keys() and len(want) > 150 and all(got[k] >= o for k, o in want.items()) and len(got) < len(want) + 20
    assert sum(counted) < 1500 < 500 * 200  # of 245,000 pairs
    left, right = near._Side(table(sets[:500])), near._Side(table(sets[500:]))
    assert {(i, 500 + j) for x, y, _ in near._near(left, right, 0.45) for i, j in zip(x.tolist(), y.tolist(), strict=True)} >= want.keys()


def test_nearest_notes_count_a_pair_once_and_only_likely_ones(spark):
    from recallweave.operators import memory

    words = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([("c", f"i{i}", i, "상태", words[: 40 - i % 20] + [f"x{i}"]) for i in range(60)], "card string, id string, place int, kind string, words array<string>")
    found = memory.nearest_notes(d)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1
    share = lambda s, t: len(set(s) & set(t)) / len(set(s) | set(t))
    rows = {x.place: x for x in d.collect()}
    want = {x.id: max((share(x.words, rows[p].words), -p) for p in range(x.place)) for x in rows.values() if x.place}
    assert {x.id: (x.share, x.target) for x in found.collect()} == {k: (o, f"i{-p}") for k, (o, p) in want.items()}


def test_scores_made_where_units_are_read_are_those_of_the_index(spark, monkeypatch):
    """Best k and all hits against the index: bounds, ties, longer Hangul words, empty and unknown queries, small blocks and passes; nothing but kept rows is shuffled."""
    from recallweave.operators import scored

    r = random.Random(13)
    units, words, weights = corpus(spark, r, n=400, vocabulary=120)
    more = [("d", f"h{i}", i, t) for i, t in enumerate(["고양이는 집에", "고양이들 많다 고양이들", "강아지 집에", "고양이 고양이", None])] + [("c", f"same{i}", 5000 + i, "w000 w001 w002") for i in range(30)]
    units = units.unionByName(spark.createDataFrame(more, "chat_id string, unit_id string, ord long, text string"))
    asked = [(f"q{i}", "c", " ".join(r.choices(words, weights, k=r.randrange(1, 150))), r.choice([None, 100, 300])) for i in range(25)]
    asked += [("none", "c", "nothing known", None), ("empty", "c", "", None), ("other", "x", "w000 w001", None), ("h", "d", "고양이 집에", None), ("same", "c", "w001 w002", None)]
    q = spark.createDataFrame(asked, "query_id string, chat_id string, query string, max_ord long")
    plain = rank.bm25(build_index(units), q, words=False).withColumn("score", F.round("score", 6)).withColumn("n_matched", F.col("n_matched").cast("long"))
    every = sorted((x.query_id, x.unit_id, x.score, x.n_matched) for x in plain.collect())
    first = sorted((x.query_id, x["rank"], x.unit_id) for x in rank.top(plain, 4).collect())
    for block, cells, terms in ((scored.BLOCK_UNITS, scored.CELLS, scored.PASS_TERMS), (37, 200, 300)):
        for name, value in (("BLOCK_UNITS", block), ("CELLS", cells), ("PASS_TERMS", terms)):
            monkeypatch.setattr(scored, name, value)
        assert sorted((x.query_id, x.unit_id, x.score, x.n_matched) for x in scored.best_bm25(units, q, None).collect()) == every and len(every) > 3000
        found = scored.best_bm25(units, q, 4)
        assert sorted((x.query_id, x["rank"], x.unit_id) for x in found.collect()) == first
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    twice = units.unionByName(units.limit(3))
    again = rank.top(rank.bm25(build_index(twice), q, words=False).withColumn("score", F.round("score", 6)), 4)
    assert sorted((x.query_id, x["rank"], x.unit_id) for x in scored.best_bm25(twice, q, 4).collect()) == sorted((x.query_id, x["rank"], x.unit_id) for x in again.collect())


def test_windows_clean_a_text_once(spark):
    """No filter below the windows cleans or cuts a text again."""
    from recallweave.operators import segment

    m = spark.createDataFrame([("c", "a", "user", 1, "word " * 100)], "chat_id string, id string, role string, turn int, text string")
    plan = segment.units(m.repartition(2)).select("message_id", "pos", "text")._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if x.strip(" :+-").startswith("Filter")]
    assert filters and not any("regexp_replace" in x for x in filters), filters


@pytest.mark.parametrize("part_keys", [4_000_000, 20])
def test_tfidf_cosines_where_units_are_read_are_those_of_the_index(spark, monkeypatch, part_keys):
    r = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    rows = [(c, f"{c}{i}", i, " ".join(r.choices(words, k=r.randint(0, 25)) + [f"lone{c}{i}"] * (i % 3))) for c in "cd" for i in range(30)]
    u = spark.createDataFrame(rows, "chat_id string, unit_id string, ord long, text string")
    q = spark.createDataFrame([(f"q{c}{i}", c, " ".join(r.choices(words, k=6) + ["lonec4", "nowhere", "nowhere"][: i % 4])) for c in "cde" for i in range(6)] + [("empty", "c", "")], "query_id string, chat_id string, query string")
    monkeypatch.setattr(scored, "PART_KEYS", part_keys)
    monkeypatch.setattr(scored, "CELLS", 100)
    got = {(x.query_id, x.unit_id): x.score for x in scored.tfidf_cosine(u, q).collect()}
    want = {(x.query_id, x.unit_id): x.score for x in rank.tfidf_cosine(build_index(u), q).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sentences_by_rarity_in_their_chat(spark):
    """A table of messages in any order: counts are those of the whole chat, also of messages before the last ones; other chats do not count."""
    told = [("a", 1, "u", "The river froze. Old bridge gone."), ("a", 2, "u", "The river <!-- no --> thawed."), ("a", 3, "u", "The bridge stands. !!!!!!!!!"), ("b", 1, "u", "The river again and again.")]
    m = spark.createDataFrame(told[::-1], "chat_id string, turn int, role string, text string").repartition(3)
    got = {(r.chat_id, r.turn, r.place): (r.s, round(r["info"], 6)) for r in rank.sentence_information(m, lambda x: F.split(x, r"(?<=[.!?])\s+"), last=2).collect()}
    ln = math.log
    assert got == {
        ("a", 2, 0): ("The river thawed.", round((ln(4 / 4) + ln(4 / 3) + ln(4 / 2)) / math.sqrt(3), 6)),
        ("a", 3, 0): ("The bridge stands.", round((ln(4 / 4) + ln(4 / 3) + ln(4 / 2)) / math.sqrt(3), 6)),
        ("b", 1, 0): ("The river again and again.", round(4 * ln(2 / 2) / 2, 6)),
    }
    assert {r.chat_id: r.scene for r in rank.recent_scene(m, max_chars=20, last=2).collect()} == {"a": "The bridge stands."}


def test_sentences_shuffle_no_words(spark):
    m = spark.createDataFrame([("a", i, "u", f"Some words of number {i}.") for i in range(9)], "chat_id string, turn int, role string, text string")
    plan = rank.sentence_information(m, lambda x: F.split(x, r"\s\s"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_models_named_in_texts_of_rows_that_repeat(spark):
    """Each row is told on its own, once and without a shuffle, by parts of names as by all of them."""
    n = spark.createDataFrame([("ab", "x", "m2"), ("ab", "x", "m1"), ("abc", "y", "m3"), ("cde", "x", "m4"), ("", "x", "m5")], "name string, tie string, model string")
    t = spark.createDataFrame([(1, "zabz"), (1, "zabz"), (2, "abc9"), (3, "abcde"), (4, None), (5, "")], "k int, text string")
    for part in (4, 1000):
        got = t.select("k", names.longest_inside(F.col("text"), n, True, part_bytes=part)["model"].alias("m"))
        assert sorted((r.k, r.m or "") for r in got.collect()) == [(1, "m1"), (1, "m1"), (2, "m1"), (3, "m4"), (4, ""), (5, "")]
    models = spark.createDataFrame([("acme-opal-5",)], "id string")
    plan = state.model_for_text(t, models).filter("model is not null").select("k", "model")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_terms_counted_inside_of_whole_units(spark):
    u = spark.createDataFrame([("a", "1", "Bee bee 가나다 가나다라 x bee ant"), ("a", "2", ""), ("a", "3", None), ("b", "1", "ant"), (None, "9", "zz ant zz")], "chat_id string, unit_id string, text string")
    one, two = build_index(u), build_index(u, whole=True)
    rows = lambda df: sorted(map(str, df.collect()))
    for part in ("postings", "df"):
        assert rows(getattr(one, part)) == rows(getattr(two, part)) and getattr(one, part).dtypes == getattr(two, part).dtypes
    assert rows(one.docs.filter("chat_id is not null")) == rows(two.docs.filter("chat_id is not null"))
    assert rows(one.stats.filter("chat_id is not null")) == rows(two.stats.filter("chat_id is not null"))
    plan = two.postings._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
