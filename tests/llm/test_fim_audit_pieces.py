"""Fill-in-the-middle against slices, the filter audit against plain counting, and pieces against the library."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import fill_in_middle as fim
from llm import filter_audit, pieces

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

# --- fill in the middle ----------------------------------------------------------------------------


def plain_fim(doc_id, text):
    """(form, cuts, output) by slices of code points."""
    t = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, t
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aé한😀 <PSM>\n\x00", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm", "plain"]))
def test_rotations_arrange_and_restore(text, a, b, form):
    s = fim.Sentinels()
    if any(x in text for x in s.texts):
        return
    a, b = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    out = fim.arrange(text.encode(), form, a, b, s)
    p, m, t = text[:a], text[a:b], text[b:]
    assert out.decode() == {"plain": text, "psm": f"<P>{p}<S>{t}<M>{m}", "spm": f"<S>{t}<P>{p}<M>{m}"}[form]
    assert fim.restore(bytes(out), form, s).decode() == text


def test_reversal_beyond_a_block(monkeypatch):
    monkeypatch.setattr(fim, "SWAP", 7)
    for n in (0, 1, 13, 14, 15, 28, 100):
        data = bytearray(range(n))
        fim.rotate(data, 0, n // 3, n)
        assert data == bytearray([*range(n // 3, n), *range(n // 3)])


def test_sentinels_that_could_arise_from_texts_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("", "<S>", "<M>"), ("P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*marks)
    fim.Sentinels("[P]", "(S)", "{M}")


def test_fim_query(docs):
    rows = [(i, f"text {i} é한😀 " * (i % 7)) for i in range(300)] + [(None, "no id at all"), (4000, "has <M> inside"), (4001, None), (4002, ""), (5, "again"), (5, "again"), (6000, "x😀" * 400_000)]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in fim.query(docs(*rows)).collect()), key=str)
    want = []
    for i, t in rows:
        form, p, m, out = plain_fim(i, t)
        want.append((i, len(t or ""), form, p, m, sha(out), sha(t or "")))
    assert got == sorted(want, key=str) and {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fim.query(docs().limit(0)).count() == 0


def test_fim_keeps_other_columns_and_takes_parameters(docs):
    d = docs((1, "some words to cut"), (2, "other words to cut")).withColumnRenamed("mix", "fim")
    out = fim.transform(d, seed=9, rate=100, suffix_first=100, sentinels=fim.Sentinels("[P]", "(S)", "{M}"))
    assert out.columns == d.columns
    for r in out.collect():
        assert r.fim.form == "spm" and r.fim.output.startswith("(S)")
    back = fim.restored(out, sentinels=fim.Sentinels("[P]", "(S)", "{M}")).collect()
    assert all(r.restored == r.text for r in back)


# --- filter audit ------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """Every order run over the documents, one by one: rows are (doc_id, text, source)."""
    fails = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append({k for k, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), e), strict=True) if x})
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(f, *labels.get(i, (0, 0))) for f, (i, _, s) in zip(fails, rows, strict=True) if (s or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[0]]
                left = [m for m in left if x not in m[0]]
                fail = sum(x in f for f, *_ in mine)
                out[part, "".join(order), step] = [len(left), len(gone), fail - len(gone), sum(f == {x} for f, *_ in mine), sum(g == 1 for _, g, _ in gone), sum(t == 1 for *_, t in gone), x]
                shapley[x] += len(gone)
        for k in [k for k in out if k[0] == part]:
            out[k][6] = shapley[out[k][6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_running_every_order(spark, docs):
    r = random.Random(5)
    texts = ["", None, "a b c", "A B # c"] + [" ".join(r.choices([f"w{k}é" for k in range(v)], k=n)) + end for n, v in ((150, 20), (260, 40), (300, 290), (220, 400)) for end in ("", " # x", " " + "ABC " * 9, "\t\x0bend|")]
    rows = [(r.choice([None, *range(90)]), r.choice(texts), r.choice(["s1", "s2", None, ""])) for _ in range(150)] + [(7, texts[6], "s1")] * 3 + [(200, "word " * 30_000, "s2")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 90, 2)]
    frame = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    want = plain_audit(rows, {i: (g, t) for i, g, t in labels})
    many = filter_audit.failed_filters(docs(*rows), shard_bytes=4000, bucket_words=50)  # many shards and buckets
    for out in (filter_audit.query(docs(*rows), frame), filter_audit.audit(filter_audit.with_labels(many, frame))):
        got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in out.collect()}
        assert got == want and len(got) == 3 * 600


def test_matrix_numbers_words_over_all_shards(docs):
    rows = [(1, "b a b"), (2, "c\ta"), (3, ""), (4, "é b B b b"), (5, None), (6, "a")]
    shards = filter_audit.local_shards(docs(*rows).coalesce(1), shard_bytes=8)
    words = {(r.word, r.word_id) for r in filter_audit.dictionary(shards, 2).collect()}
    number = dict(words)
    assert len(words) == len(number) == len(set(number.values())) == 5 and shards.count() > 1
    seen = {}
    for s in filter_audit.term_matrix(shards, 2).collect():
        for k, i in enumerate(s.doc_id):
            seen[i] = list(zip(s.indices[s.indptr[k] : s.indptr[k + 1]], s.counts[s.indptr[k] : s.indptr[k + 1]], strict=True))
    assert seen == {i: sorted((number[w], c) for w, c in Counter((t or "").split()).items()) for i, t in rows}


def test_audit_of_nothing_and_of_repeated_labels(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.query(docs().limit(0), labels).count() == 0
    first = filter_audit.query(docs((1, "x")), labels).filter("filter_order = 'ABCDE' and step = 1").first()
    assert (first.part, first.kept, first.removed, first.good_lost, first.toxic_lost, first.shapley) == ("s", 0, 1, 1, 1, 120)


# --- pieces ---------------------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary(MODEL)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab é\n\t 한😀\x0b.▁  1234theoningЖд中文́\x00�<>s/0xA", max_size=60)), max_size=5))
def test_ids_are_the_library_s(library, vocabulary, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = pieces.encode_texts(vocabulary, pa.array(texts, pa.string()), True).to_pylist()
    assert got == [library.encode(t, add_eos=True) for t in texts]
    assert pieces.decode_ids(vocabulary, pa.array(got, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) if x else "" for x in got]


def test_texts_made_of_pieces(library, vocabulary):
    r = random.Random(2)
    normal = [p for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True) if k == "n"]
    texts = ["".join(r.choices(normal, k=r.randrange(1, 7))).replace("▁", " ") for _ in range(4000)] + [" " * k for k in range(70)] + ["a" * 5000, "ab" * 3000 + " " * 999, "the" * 2000]
    assert pieces.encode_texts(vocabulary, pa.array(texts), False).to_pylist() == [library.encode(t) for t in texts]


def test_any_ids_decode_as_in_the_library(library, vocabulary):
    r = random.Random(3)
    for _ in range(6000):
        ids = [r.choice([r.randrange(32000), r.randrange(262), r.randrange(3, 259)]) for _ in range(r.randrange(1, 9))]
        assert pieces.decode_ids(vocabulary, pa.array([ids])).to_pylist()[0] == library.decode(ids), ids


def test_a_failed_position_is_left_for_good():
    """A vocabulary in which the longest pieces lead astray, against plain merging."""
    v = ["<unk>", "</s>", *[f"<0x{i:02X}>" for i in range(256)], "a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bcab", "aa", "aab"]
    scores = [0.0] * 258 + [0, 0, 0, -3, -1, -9, -2, -8, -5, -4, -7]
    e = pieces.Encoder(pieces.Vocabulary(v, scores, "uc" + "b" * 256 + "n" * 11, "?", 1, False))

    def merged(text):
        s = list(text)
        while True:
            best = max(((e.score[s[i] + s[i + 1]], -i) for i in range(len(s) - 1) if s[i] + s[i + 1] in e.score), default=None)
            if best is None:
                return s
            s[-best[1] : 2 - best[1]] = [s[-best[1]] + s[1 - best[1]]]

    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choices("abc", k=r.randrange(1, 25)))
        assert e.split(t) == merged(t), t


def test_pieces_query(library, docs):
    rows = [(1, "Some words é 한 12345\n\n  end "), (1, "Some words é 한 12345\n\n  end "), (None, "x"), (2, None), (3, ""), (4, "word " * 200_000), (5, "▁▁ a")]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.query(docs(*rows), MODEL).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert got == want
    assert pieces.query(docs().limit(0), MODEL).count() == 0


def test_pieces_keep_other_columns(library, vocabulary, docs):
    d = docs((1, "Some words")).withColumnRenamed("mix", "piece_ids")
    out = pieces.with_text(pieces.with_ids(d, vocabulary, end=False), vocabulary, into="quality")
    assert out.columns == d.columns and out.first().piece_ids == library.encode("Some words") and out.first().quality == "Some words"


def test_worker_caches_start_anew(library, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_RUNS", 3)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 2)
    monkeypatch.setattr(pieces, "SLICE_BYTES", 10)
    e = pieces.Encoder(vocabulary)
    monkeypatch.setattr(pieces, "_ENCODERS", {vocabulary.key: e})
    texts = ["unbelievable circumstances of tokenization", "", "of circumstances", "éèê한글"] * 3
    assert pieces.encode_texts(vocabulary, pa.array(texts), False).to_pylist() == [library.encode(t) for t in texts]
    assert len(e._runs) <= 3 and e._kept <= 2
