"""Word splitting and rolling hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import tokens

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é  \t\n\x0b\x1c.", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words(texts):
    buf, offsets = tokens.utf8(pa.array(texts, pa.string()))
    h, starts, ends, first = tokens.words(buf, offsets, lower=False)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    raw = buf.tobytes()
    assert [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)] == want
    seen = {}
    for w, x in zip([w for t in want for w in t], h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 23))
def test_rolling(items, k):
    h = tokens.mix(np.array(items, np.uint64))
    got = tokens.rolling(h, k)
    windows = [tuple(items[i : i + k]) for i in range(len(items) - k + 1)]
    assert len(got) == len(windows)
    by = {}
    for w, x in zip(windows, got.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_sliced_arrays():
    a = pa.array(["zz", "one two", None, "", "three"]).slice(1)
    buf, offsets = tokens.utf8(a)
    assert tokens.words(buf, offsets, True)[3].tolist() == [0, 2, 2, 2, 3]
    assert list(tokens.blocks(np.array([0, 10, 10, 500, 501]), 100)) == [(0, 2), (2, 3), (3, 4)]


def test_no_structural_collisions():
    a, b = "a", "b"
    words = []
    for _ in range(13):
        a, b = a + b, b + a
        words += [a, b]
    words += ["a\0", "a", "\0a", "\0" * 7, "\0" * 8, "\0" * 9, "x" * 16, "x" * 17, "y" * 8 + "x" * 8, "x" * 8 + "y" * 8]
    buf, offsets = tokens.utf8(pa.array(words))
    h = tokens.words(buf, offsets, False)[0]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
