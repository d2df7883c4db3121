"""Brute-force twins of whole queries, and each operator on nulls, repeated rows, very long texts, empty tables and clashing names."""

import json
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import decontaminate, html_extract, quality, secrets, toxicity
from llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- decontamination -----------------------------------------------------------------------------


def plain_score(item, words):
    """Best local alignment by the full table, as a share of the item's own score."""
    h = np.zeros((len(item) + 1, len(words) + 1))
    for i, a in enumerate(item):
        for j, b in enumerate(words):
            h[i + 1, j + 1] = max(0, h[i, j] + (1.0 if a == b else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
    return h.max() / len(item)


def test_leaks_by_alignment_of_all_pairs(spark, docs):
    """The query against an alignment of every item with every document, items of one to forty words, many near the threshold."""
    r = random.Random(21)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=n))) for i, n in enumerate([1, 2, 3, 5, 8, 13, 21, 40])]
    rows = []
    for i, t in items:
        for share in (0.0, 0.15, 0.25, 0.4):
            w = [x if r.random() >= share else f"e{r.randrange(99)}" for x in t.split()]
            rows.append((len(rows), " ".join(r.choices(words, k=12) + w + r.choices(words, k=12))))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in rows for i, x in items if (plain_score(x.split(), t.split()) >= decontaminate.THRESHOLD - 1e-9 if len(x.split()) > 2 else f" {x} " in f" {t} ")}
    assert {(x.doc_id, x.item_id) for x in decontaminate.query(docs(*rows), b).collect()} == want and len(want) > 10


def test_leaks_defined_cases(spark, docs):
    item = " ".join(f"q{i}" for i in range(12))
    long = "filler " * 60_000 + item + " filler" * 60_000
    d = docs((1, item), (1, item), (None, f"x {item} y"), (2, long), (3, None), (4, ""))
    b = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None), (9, "")], "item_id long, text string")
    got = Counter((x.doc_id, x.item_id) for x in decontaminate.query(d, b).collect())
    assert set(got) == {(i, k) for i in (1, None, 2) for k in (7, None)} and got[1, 7] == 4 and got[2, 7] == 2
    where = decontaminate.query(d.filter("doc_id = 2"), b).first()
    assert (where.from_word, where.to_word) == (60_000, 60_012)
    assert sorted(x.doc_id for x in decontaminate.decontaminate(d, b).collect()) == [3, 4]
    assert decontaminate.query(docs().limit(0), b).count() == 0 and decontaminate.decontaminate(docs().limit(0), b).count() == 0


# --- toxicity --------------------------------------------------------------------------------------


def plain_ftrl(rows, order, alpha=toxicity.ALPHA, beta=toxicity.BETA, l1=toxicity.L1, l2=toxicity.L2):
    """FTRL-proximal by dictionaries; rows: (set of slots, label)."""
    z, n = Counter(), Counter()

    def weight(i):
        free = 0.0 if i == "b" else l1
        return 0.0 if abs(z[i]) <= free else -(z[i] - np.sign(z[i]) * free) / ((beta + n[i] ** 0.5) / alpha + l2)

    for k in order:
        x, y = rows[k]
        w = {i: weight(i) for i in [*x, "b"]}
        p = 1 / (1 + np.exp(-np.clip(sum(w.values()), -30, 30)))
        for i, wi in w.items():
            g = p - y
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
            z[i] += g - s * wi
            n[i] += g * g
    return weight, {i for i in z}


def test_ftrl_against_a_plain_version():
    r = np.random.default_rng(5)
    rows = [(set(r.choice(300, 12, replace=False).tolist()), int(r.integers(2))) for _ in range(200)]
    model, order = toxicity.Ftrl(), r.permutation(200)
    for k in order:
        model.learn(np.array(sorted(rows[k][0])), rows[k][1])
    weight, seen = plain_ftrl(rows, order)
    dense = model.dense()
    assert all(abs(dense[1 << toxicity.BITS if i == "b" else i] - weight(i)) < 1e-5 for i in seen) and 0 < np.count_nonzero(dense[:-1]) < len(seen)


def test_slots_are_words_pairs_and_skips():
    a, b = ("one two three", "one xxx three")
    made = [set(toxicity.slots(*decontaminate._flat([t]))[1].tolist()) for t in (a, b)]
    # shared: two words, their skip-gram, and their beginnings of four bytes
    assert len(made[0] & made[1]) == 2 + 1 + 1 and len(made[0]) == 3 + 2 + 1 + 1


def test_toxicity_defined_cases(spark, docs):
    bad, good = "vile words here", "kind words here"
    rows = [(i, bad if i % 2 else good) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(*rows, (1000, (good + " ") * 50_000), (1001, None), (1001, ""), (None, bad)).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(3))
    got = toxicity.query(d, labels).collect()
    assert len(got) == 404 and all(0 <= x.score <= 1 for x in got) and len({x.score for x in got if x.doc_id == 1001}) == 1
    assert next(x for x in got if x.doc_id == 1000).predicted == 0 and next(x for x in got if x.doc_id is None).predicted == 1
    assert toxicity.query(docs().limit(0), labels).count() == 0


def test_training_rows_are_bounded_by_ids_and_bytes(spark, docs, monkeypatch):
    """One repeated id and very long texts do not reach the driver beyond the bounds."""
    rows = [(3, f"vile {i}") for i in range(3000)] + [(i, "kind " * 40) for i in range(10, 200)]
    labels = spark.createDataFrame([(3, 1, 1)] + [(i, 1, i % 2) for i in range(10, 200)], "doc_id long, quality int, toxic int")
    taken = []
    inner = toxicity.slots
    monkeypatch.setattr(toxicity, "slots", lambda data, offsets, used=None: (taken.append((len(offsets) - 1, len(data))), inner(data, offsets, used))[1])
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 6000)
    assert toxicity.fit(docs(*rows), labels) is not None
    assert sum(n for n, _ in taken) <= 31 and sum(b for _, b in taken) <= 6000


# --- quality ------------------------------------------------------------------------------------------


def test_the_sample_of_the_cascade_is_bounded(docs, monkeypatch):
    asked = []
    inner = quality.Measured
    monkeypatch.setattr(quality, "Measured", lambda t: (asked.append(t), inner(t))[1])
    d = docs((1, None)).select("doc_id", "text").union(docs((1, "w " * 300_000)).select("doc_id", "text")).crossJoin(docs((1, "x")).sparkSession.range(100_000).select())
    order = quality.plan(d, rows=50)
    assert sorted(order) == sorted(r.name for r in quality.RULES) and len(asked) <= 100 * len(quality.RULES) and not any(asked)


def test_quality_defined_cases(docs):
    fine = " ".join(f"word{i}" for i in range(60))
    d = docs((1, fine), (1, fine), (2, None), (3, " ".join(f"w{i}" for i in range(200_000))), (None, fine))
    got = Counter((x.doc_id, x.kept, x.n_words) for x in quality.query(d).collect())
    assert got == {(1, True, 60): 2, (2, False, 0): 1, (3, True, 200_000): 1, (None, True, 60): 1}
    assert Counter(x.doc_id for x in quality.quality_filter(d).collect()) == {1: 2, 3: 1, None: 1}


# --- pipeline -----------------------------------------------------------------------------------------


def brute_lines(rows):
    """Texts without lines that stand earlier, equal or within one edit."""
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    seen, out = [], []
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            if WORD.search(line):
                if not any(line == s or near(s, line) for s in seen):
                    kept.append(line)
                seen.append(line)
            else:
                kept.append(line)
        out.append((i, "\n".join(kept)))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(17)
    words = [f"word{i}" for i in range(2500)]
    line = lambda: " ".join(r.sample(words, 14))
    text = lambda n=8: "\n".join(line() for _ in range(n))
    shared, item, base = line(), " ".join(r.sample(words, 30)), r.sample(words, 150)
    rows = [(i, text(), f"s{i % 3}") for i in range(40)]
    rows += [(50, text(4) + "\n" + shared + "\n" + text(4), "s0"), (51, text(4) + "\n" + shared[:-1] + "\n" + text(4), "s1"), (52, text(4) + "\n" + item + "\n" + text(4), "s2"), (53, "too short", "s0"), (54, "same same same " * 40, "s1")]
    rows += [(60, " ".join(base), "s0"), (61, " ".join([*base[:70], "other", *base[71:]]), "s1")]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t, s) for i, t, s in rows if i not in (53, 54)]
    cut = dict(brute_lines([(i, t) for i, t, _ in kept]))
    left = [(i, cut[i], s) for i, _, s in kept if WORD.search(cut[i])]
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t, _ in left for w in [WORD.findall(t.lower())]}
    ids = sorted(shingles)
    gone = {b for x, a in enumerate(ids) for b in ids[x + 1 :] if (n := len(shingles[a] & shingles[b])) and 100 * n >= 80 * (len(shingles[a]) + len(shingles[b]) - n)}
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    want = {i: t for i, t, _ in left if i not in gone and plain_score(split(item), split(t)) < decontaminate.THRESHOLD}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {i: len(WORD.findall(t)) for i, t in want.items()}
    assert {x.doc_id for x in out} <= set(want) and all(x.text == want[x.doc_id] and x.n_chars == len(x.text) and x["size"] == sizes[x.doc_id] for x in out)
    assert gone == {61} and 52 not in want and max(Counter(x.doc_id for x in out).values()) <= 2
    by = Counter()
    for x in out:
        by[x.source] += x["size"]
    from llm.mixing import targets

    have = Counter()
    for i, _, s in left:
        have[s] += sizes.get(i, 0)
    goal = dict(zip(sorted(have), targets([have[s] for s in sorted(have)], [5, 2, 1], 1.5, 2), strict=True))
    assert all(abs(by[s] - goal[s]) <= max(sizes.values()) for s in goal)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, out))


def test_pipeline_of_an_empty_table_and_with_more_columns(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, mix string, quality int, gone long, size int, shard string, chunk string"
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)), "en", None, 5, "m", 1, 2, 3, "s", "c"), (None, None, None, None, None, None, None, None, None, None, None)], kinds)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == [c.split()[0] for c in kinds.split(", ")]
    assert [(x.doc_id, x.mix, x.gone) for x in d.collect()] == [(1, "m", 2)]


# --- html ------------------------------------------------------------------------------------------------


def brute_labels(logit, edges):
    """Labels of a minimum cut over all labellings."""
    best = None
    for mask in range(1 << len(logit)):
        side = [bool(mask >> i & 1) for i in range(len(logit))]
        cost = sum(max(v, 0) if not s else max(-v, 0) for v, s in zip(logit, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])
        if best is None or cost < best[0] - 1e-9:
            best = (cost, side)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_text_of_small_pages_is_that_of_the_best_labelling(seed):
    m = html_extract.model()
    page = next(p for p in html_extract.training_pages(60, seed=1000 + seed) if 3 <= len(html_extract.blocks(p)) <= 11).replace("¤", "")
    bs = html_extract.blocks(page)
    x = np.array([html_extract.features(b, bs[i - 1] if i else None, bs[i + 1] if i + 1 < len(bs) else None) for i, b in enumerate(bs)])
    logit = (m.scale * html_extract.logits(x, m.weights)).tolist()
    edges = html_extract.smoothness(bs, m.adjacent, m.sibling)
    cost, side = brute_labels(logit, edges)
    got, _ = html_extract.labels(bs, m)
    mine = sum(max(v, 0) if not s else max(-v, 0) for v, s in zip(logit, got, strict=True)) + sum(w for i, j, w in edges if got[i] != got[j])
    assert abs(mine - cost) < 5e-3
    if got == side:
        assert html_extract.main_text(page, m) == "\n\n".join(b.text for b, s in zip(bs, side, strict=True) if s)


def test_written_tables_can_be_cleared(spark, docs):
    from llm import common, mixing

    common.clear_written(spark)
    got = mixing.query(docs(*[(i, "a b c", "s") for i in range(30)])).collect()
    assert len(got) == 30
    n = common.clear_written(spark)
    assert n >= 2 and common.clear_written(spark) == 0


def test_the_driver_s_allocators_are_left_alone():
    import pyarrow as pa

    assert pa.default_memory_pool().backend_name != "system"


#: Queries without SQL and the test that holds each against a plain version, or measures it on rows that it has not seen.
TWINS = {
    "op2_html_extraction": ("test_defined_cases", "test_text_of_small_pages_is_that_of_the_best_labelling"), "op3_benchmark_decontamination": ("test_defined_cases", "test_leaks_by_alignment_of_all_pairs"),
    "op4_toxicity": ("test_defined_cases", "test_ftrl_against_a_plain_version"), "op6_ngram_jaccard_join": ("test_dedup", "test_components"), "op7_personal_data": ("test_models", "test_personal_data_defined_cases"),
    "op8_source_mixing": ("test_models", "test_mix_against_brute_force"), "op9_secret_scan": ("test_models", "test_findings_the_forest_has_not_seen"),  # held-out accuracy
    "op10_substring_dedup": ("test_dedup", "test_substrings"), "op13_sentencepiece": ("test_fim_audit_pieces", "test_pieces_query"),
}


def test_registered_queries_have_sql_or_a_twin():
    import importlib

    from llm import queries

    assert set(queries.queries()) == set(queries.oracle_sql()) | set(TWINS) and not set(queries.oracle_sql()) & set(TWINS) and len(queries.queries()) == 13
    for module, name in TWINS.values():
        assert callable(getattr(importlib.import_module(module), name))
