import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import probes as pr
from llm import textkit as tk

TEXT = st.text(alphabet="ab é\n\t 한😀\x0b.", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_the_pattern_s_words(texts):
    w = tk.words(texts)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    got = [[w.word(i) for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
    assert got == want
    flat = [x for t in want for x in t]
    assert len(set(w.hash.tolist())) == len(set(flat))


def test_grams_stay_inside_a_text():
    w = tk.words(["a b c", "b c", "", None, "a b c"])
    at, h = w.grams(2)
    assert at.tolist() == [0, 1, 3, 5, 6] and h[1] == h[2] == h[4] and h[0] == h[3]


def test_slices_cover_all_and_take_long_texts_whole():
    col = pa.array(["x" * 10, "", "y" * 1000, "z"], pa.large_string())
    parts = list(tk.slices(col, 50))
    assert [(a, b) for a, b, *_ in parts] == [(0, 2), (2, 3), (3, 4)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.lists(st.integers(0, 300), min_size=1, max_size=9))
def test_packing_round_trips(keys, small):
    k = np.unique(np.array(keys, np.uint64))
    assert (pr.unpack_sorted(*pr.pack_sorted(k)) == k).all()
    v = np.array(small, np.uint64)
    assert (pr.unpack_extra(*pr.pack_extra(v), len(v)) == v).all()
