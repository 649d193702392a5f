"""Substring dedup against a plain version."""

import random
import re

import pytest

from lectern.llm import substring
from lectern.llm.substring import dedup_substrings


def brute(rows, width):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: (x[0] is not None, x[0] or 0)):
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), (i, s))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (i, s):
                gone |= set(range(s, s + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def result(df, width):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(df, width).collect()), key=repr)


@pytest.mark.parametrize("chunk", [50, 2_000_000])
def test_brute_force(frame, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK_WORDS", chunk)
    rng = random.Random(3)
    passages = [[rng.choice("abcde") + str(rng.randrange(4)) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            w += rng.choice(passages)[: rng.randrange(3, 13)] + [str(rng.randrange(99)) for _ in range(rng.randrange(3))]
        rows.append((i * 7 % 61, " ".join(w)))
    assert result(frame(rows).repartition(5), 5) == sorted(brute(rows, 5), key=repr)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(odd, 20) == sorted(brute(rows, 20), key=repr)


def test_overlaps_inside_a_text(frame):
    rows = [(1, "a a a a a a a")]
    assert result(frame(rows), 3) == [(1, 7, 6, "a")]


def test_spans_are_maximal(frame):
    w = " ".join(map(str, range(30)))
    rows = frame([(1, w), (2, "x " + w + " y")])
    spans = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in dedup_substrings(rows, 10).collect()}
    assert spans == {1: [], 2: [(1, 31)]}


def test_empty(empty):
    assert dedup_substrings(empty, 20).collect() == []


def thue_morse(n, a="a", b="b"):
    w, v = a, b
    while len(w) < n:
        w, v = w + v, v + w
    return w, v


def test_long_words_and_one_id_of_two_texts(frame):
    one, two = thue_morse(2048)
    filler = [f"f{i}" for i in range(19)]
    rows = [(1, " ".join([one, *filler])), (2, " ".join([two, *filler])), (3, "z" * 100_000 + " " + " ".join(filler))]
    assert [r[2] for r in result(frame(rows), 20)] == [0, 0, 0]
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = result(frame([(1, a), (2, a), (2, b), (None, b + " x"), (None, "y " + a)]).repartition(3), 20)
    gone = {(i, kept.split(" ")[0] if kept else ""): n for i, _, n, kept in got}
    # null ids come first, so their texts stay (as different documents) and all others go
    assert gone == {(None, "b0"): 0, (None, "y"): 0, (1, ""): 30, (2, ""): 30} and len(got) == 5


def test_unique_text_of_a_repeated_id_stays(frame):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    assert sorted(r[2] for r in result(frame([(1, a), (2, a), (2, b)]), 20)) == [0, 0, 30]


def test_finer_ranges(frame, monkeypatch):
    """Ranges that are dealt out twice give the same result."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))) for i in range(80)]
    want = sorted(brute(rows, 4), key=repr)
    monkeypatch.setattr(substring, "MOST_BUCKETS", 4)
    monkeypatch.setattr(substring, "SPLIT", 4)
    assert result(frame(rows).repartition(6), 4) == want


def test_bytes_sent_follow_the_words():
    """A window takes about the same bytes for few ranges of hashes and for many."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    vocab = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(rng.choice(vocab, int(rng.integers(50, 700)))) for _ in range(5600)]
    n = sum(max(0, t.count(" ") + 2 - 20) for t in texts)
    batch = pa.RecordBatch.from_arrays([pa.array(np.sort(rng.choice(10**7, len(texts), replace=False))), pa.array(np.zeros(len(texts), np.int64)), pa.array(texts)], names=["id", "sub", "text"])
    each = []
    for buckets in (32, 1024, 16384):
        own = list(substring._sender(20, buckets)(iter([batch])))
        assert sum(len(substring.unpack_windows(p)[0]) for b in own for p in b.column(1).to_pylist() if p) == n
        each.append(sum(len(p) + 24 for b in own for p in b.column(1).to_pylist() if p) / n)
    assert max(each) < 16 and max(each) < 1.5 * each[0], each
