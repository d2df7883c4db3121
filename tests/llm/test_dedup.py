"""Substring dedup, line dedup and the Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from llm import line_dedup, ngram_join, probes, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def story(seed, n=40):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = " ".join(base)
        elif kind == 1:
            t = " ".join(x if r.random() > 0.02 else f"n{r.randrange(99)}" for x in base)
        elif kind == 2:
            t = " ".join([f"u{i}-{k}" for k in range(30)] + base[20:60] + [f"v{i}"])
        elif kind == 3:
            t = " ".join(base[:25]) + "\n" + " ".join(base[:25]) + "\n" + " ".join(base[:24])
        elif kind == 4:
            t = ["", " ", "a", "a b", None, "A B"][r.randrange(6)]
        else:
            t = "The quick brown fox " * r.randrange(1, 9) + f"end {r.randrange(3)}"
        rows.append((i, t))
    return rows


def brute_substrings(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone = bytearray(len(w))
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = b"\1" * 20
            seen.add(x)
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.fixture()
def small_chunks(monkeypatch):
    monkeypatch.setattr(probes, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(probes, "RANGE_ENTRIES", 300)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(docs, small_chunks, seed):
    rows = story(seed)
    got = sorted(map(tuple, substring_dedup.query(docs(*rows)).collect()))
    assert got == brute_substrings(rows)


def test_substrings_defined_cases(docs, spark):
    t = " ".join(f"x{i}" for i in range(30))
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(docs((None, t), (-5, t), (3, t), (3, t))).collect()}
    assert got == {(None, 0), (-5, 0), (3, 30)}
    assert substring_dedup.query(docs().limit(0)).count() == 0
    runs = substring_dedup.substring_dedup(docs((1, t), (2, "a " + t + " b"))).filter("doc_id = 2").first()
    assert [(r["from"], r["to"]) for r in runs.removed] == [(1, 31)] and runs.text == "a b"


def brute_components(rows, percent=90, n=3):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("seed", "region"), [(1, 1000), (2, 3)])
def test_components(docs, small_chunks, monkeypatch, seed, region):
    monkeypatch.setattr(ngram_join, "REGION_CLASSES", region)
    rows = story(seed)
    assert sorted(map(tuple, ngram_join.jaccard_join(docs(*rows)).collect())) == brute_components(rows)


def test_components_defined_cases(docs):
    got = sorted((tuple(r) for r in ngram_join.jaccard_join(docs((None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "A B"), (9, "a b"), (7, None))).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, 4), (4, 2, 4), (2, 1, 2), (9, 1, 2), (7, 0, 7)], key=str)
    assert ngram_join.jaccard_join(docs().limit(0)).count() == 0


def shaken(n, groups, seed, share=0.05, size=80):
    """n sets around a few bases, each with some of its members replaced."""
    r = np.random.default_rng(seed)
    base = [r.integers(0, 1 << 62, size).astype(np.uint64) for _ in range(groups)]
    sets = []
    for i in range(n):
        b = base[i % groups].copy()
        k = r.random(size) < share
        b[k] = r.integers(0, 1 << 62, int(k.sum())).astype(np.uint64)
        sets.append(np.unique(b))
    return sets


def brute_links(sets, percent=90):
    links = ngram_join._Links(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                links.join(a, b)
    return [links.find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "groups", "share"), [(200, 12, 0.05), (3, 1, 0.05), (2, 1, 0.0), (60, 30, 0.03), (120, 1, 0.09), (120, 2, 0.3)])
def test_voronoi_join_is_exact(n, groups, share):
    sets = shaken(n, groups, 3, share)
    assert ngram_join.voronoi_join(sets, 90) == brute_links(sets)


def test_pivots_spare_most_comparisons():
    sets, compared = shaken(600, 60, 4, 0.03), []
    ngram_join.voronoi_join(sets, 90, compared)
    assert len(compared) > 20 and sum(compared) < 600 * 599 / 2 / 4


def test_a_region_above_2000_classes(docs):
    """2,100 sets of 40 out of 90 words: every shingle is frequent, so all are one region, divided by pivots over many blocks."""
    r = random.Random(9)
    words = [f"b{i}" for i in range(90)]
    rows, size = [], []
    for g in range(1050):  # pairs that differ in one word (39 of 41 shared)
        own = r.sample(words, 40)
        other = own[:-1] + [r.choice([w for w in words if w not in own])]
        rows += [(2 * g, " ".join(own)), (2 * g + 1, " ".join(other))]
    inner = ngram_join._divide

    def seen(members, percent):
        size.append(members.groupBy("region").count().agg({"count": "max"}).first()[0])
        return inner(members, percent)

    ngram_join._divide = seen
    try:
        got = {x.doc_id: x.component_id for x in ngram_join.jaccard_join(docs(*rows), n=1, percent=90).collect()}
    finally:
        ngram_join._divide = inner
    bits = [sum(1 << int(w[1:]) for w in t.split()) for _, t in rows]
    links = ngram_join._Links(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * (i := (bits[a] & bits[b]).bit_count()) >= 90 * (80 - i):
                links.join(a, b)
    assert size[0] > 2000 and got == {i: links.find(i) for i in range(len(rows))}


def test_a_dense_region_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "REGION_CLASSES", 12)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    r = random.Random(4)
    rows = []
    for i in range(90):
        base = [f"c{i % 3}w{k}" for k in range(40)]
        for _ in range(r.randrange(6)):
            base[r.randrange(40)] = f"x{r.randrange(60)}"
        rows.append((i, " ".join(base)))
    assert sorted(map(tuple, ngram_join.jaccard_join(docs(*rows), n=1, percent=85).collect())) == brute_components(rows, 85, 1)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def test_lines(docs):
    r = random.Random(5)
    base = ["the quick brown fox jumps over it", "éé über straße and more of it here", "short", "ab", "x", "0123456789abcdef", "x" * 17]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randrange(6)):
            t = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2])):
                k = r.randrange(len(t) + 1)
                t[k : k + r.choice([0, 1])] = r.choice([[], ["q"], ["z"]])
            lines.append("".join(t))
        rows.append((i, "\n".join(lines) if i % 7 else None))
    want, seen = {}, []
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            if WORD.search(line):
                want[i, n] = any(near(x, line) for x in seen)
                seen.append(line)
    got = {(x.doc, x.i): x.gone for x in line_dedup.line_verdicts(docs(*rows)).collect()}
    assert got == want and any(want.values())


def test_lines_leave_layout_and_other_columns(docs):
    d = docs((1, "a line of some length\n\n  \nkeep"), (2, "b\n\na line of some lengtj\nkeep"), (3, None), (None, "keep\nnew"))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert out[1].text == "a line of some length\n\n  \nkeep" and out[2].text == "b\n" and out[3].text is None and out[None].text == "new" and out[2].chunk == "x"
    assert line_dedup.query(docs().limit(0)).count() == 0


def test_lines_with_odd_ids_and_long_lines(docs):
    top = 9223372036854775807
    long = "word " * 40_000
    d = docs((top, "the same line\nyes"), (None, "the same line\nown of none"), (5, long + "\nno"), (6, long + "\nnot"), (7, "a b\nc"), (7, "a b\nc"), (7, "other text of seven"))
    got = sorted(((x.doc_id, x.n_lines, x.removed) for x in line_dedup.query(d).collect()), key=str)
    assert got == sorted([(top, 2, ""), (None, 2, "0"), (5, 2, ""), (6, 2, "0,1"), (7, 2, ""), (7, 1, "")], key=str)
    assert {(x.doc_id, x.removed) for x in line_dedup.query(d).collect()} >= {(6, "0,1")}
    kept = line_dedup.dedup_lines(docs((1, "yes\nno"), (2, "yet\nmaybe")), min_chars=16).collect()
    assert [x.text for x in sorted(kept)] == ["yes\nno", "yet\nmaybe"]


def test_very_long_and_repeated_texts(docs):
    r = random.Random(3)
    long = " ".join(f"v{r.randrange(10**6)}" for _ in range(60_000))
    d = docs((1, long), (2, long + " and more"), (3, "short one"), (3, "short one"), (None, long))
    got = sorted(((x.doc_id, x.component_id) for x in ngram_join.jaccard_join(d).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, None)], key=str)
    cut = sorted(((x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.query(d).collect()), key=str)
    assert cut == sorted([(1, 60_000, 0), (2, 60_002, 60_000), (3, 2, 0), (3, 2, 0), (None, 60_000, 0)], key=str)


def test_sending_takes_work_by_entries_not_by_ranges():
    f = np.sort(np.random.default_rng(2).integers(0, 1 << 62, 500).astype(np.uint64))
    sent = probes.send(4, f, np.ones(500, np.uint64), 62, 30)  # 2**30 ranges
    assert sent.num_rows <= 500 and np.array_equal(np.concatenate([probes.unpack_sorted(w, k) for w, k in zip(sent.column("width").to_pylist(), sent.column("keys").to_pylist(), strict=True)]), f)
