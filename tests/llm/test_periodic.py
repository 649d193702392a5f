"""Runs against brute force; Lyndon arrays against sorted suffixes; time on repetitive texts; whole rows against plain Python."""

import hashlib
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import periodic, queries, tokens
from lectern.llm.periodic import find_runs, lyndon, runs


def brute_runs(s, least=24, periods=3):
    n, out = len(s), set()
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q) and all(any(s[k] != s[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.add((i, j + q - i, q))
            i = j
    return sorted(out)


def brute_row(doc_id, text, change=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if change and doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


SHAPES = {
    "one symbol": lambda n: [3] * n,
    "pairs": lambda n: [1, 2] * (n // 2),
    "fibonacci": fibonacci,
    "thue-morse": lambda n: [bin(i).count("1") & 1 for i in range(n)],
    "blocks": lambda n: ([0] * 40 + [1] + [0] * 40 + [2]) * (n // 82),
    "growing blocks": lambda n: [x for k in range(int((2 * n) ** 0.5)) for x in [0] * k + [1]],
    "nested": lambda n: (([0, 1] * 9 + [2]) * 7 + [3]) * (n // 134),
    "rising": lambda n: list(range(n)),
    "falling": lambda n: list(range(n, 0, -1)),
    "half blocks": lambda n: [0] * (n // 2 - 1) + [1] + [0] * (n // 2 - 1) + [2],
    "random": lambda n: np.random.default_rng(1).integers(0, 2, n).tolist(),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("n", [60, 420])
def test_shapes(shape, n):
    s = SHAPES[shape](n)
    assert runs(np.array(s, np.int64)) == brute_runs(s)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 4), st.integers(0, 30))
def test_runs(s, times, more):
    s = s * times + s[:more]
    assert runs(np.array(s, np.int64), least=3) == brute_runs(s, least=3)
    assert runs(np.array(s, np.int64)) == brute_runs(s)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 3))
def test_lyndon_array(s, times):
    s = s * times
    after, reach = lyndon(np.array(s, np.int64))
    n = len(s)
    for i in range(n):
        j = next((j for j in range(i + 1, n) if s[j:] < s[i:]), n)
        assert after[i] == j
        assert j == n or reach[i] == next((k for k in range(n - j) if s[i + k] != s[j + k]), n - j)


@pytest.mark.parametrize("shape", SHAPES)
def test_time_in_proportion(shape):
    took = []
    for n in (20_000, 160_000):
        s = np.array(SHAPES[shape](n), np.int64)
        began = time.process_time()
        lyndon(s)
        lyndon(-s)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \x00é", max_size=40), max_size=8))
def test_ranks(texts):
    buf, offsets = tokens.utf8(pa.array(texts, pa.string()))
    starts, ends, first = periodic.word_bounds(buf, offsets)
    words = [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in t.encode().split()]
    r = periodic.ranks(buf, starts, ends).tolist()
    assert len(set(zip(r, words, strict=True))) == len(set(r)) == len(set(words))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=90), max_size=4), st.integers(1, 4))
def test_barred(texts, times):
    """Words that stand too rarely part a text, and no run is lost by it."""
    texts = [t * times for t in texts]
    first = np.cumsum([0] + [len(t) for t in texts])
    codes = np.array([x for t in texts for x in t], np.int64)
    got = sorted((i, s + b - first[i], n, q) for i, b, e in periodic.barred(codes, first) for s, n, q in runs(codes[b:e]))
    assert got == sorted((i, *r) for i, t in enumerate(texts) for r in brute_runs(t))


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op11_word_runs(spark, sf_dir).collect()
    assert len(got) == len(docs) and sum(r.n_runs for r in got) > 10
    for r in got:
        assert tuple(r[n] for n in NAMES) == brute_row(r.doc_id, docs[r.doc_id])


def test_odd_empty_and_long(spark, frame, odd, empty):
    want = sorted((brute_row(r.doc_id, r.text, False) for r in odd.where("length(text) < 5000 or text is null").collect()), key=repr)
    assert sorted((tuple(r[n] for n in NAMES) for r in find_runs(odd.where("length(text) < 5000 or text is null")).collect()), key=repr) == want
    assert find_runs(empty).collect() == []
    long = "x " * 400_000 + "y" * 1_000_000 + " " + "a b c " * 100_000
    r = find_runs(frame([(1, long)])).first()
    assert [tuple(x) for x in r.runs] == [(0, 400_000, 1), (400_001, 300_000, 3)]
    assert r.collapsed == "x " + "y" * 1_000_000 + " a b c" and (r.start, r.exponent_milli) == (0, 400_000_000)
