"""Decontamination: banded alignment against full dynamic programming, planted passages, clean texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import decontaminate as dc
from lectern.llm import tokens

ITEM = "The quick brown fox jumps over the lazy dog while seventeen grumpy wizards quietly brew a potent elixir of youth."


def edits(a, b):
    """Least edits of a against any part of b."""
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j - 1] + (x != y), prev[j] + 1, now[-1] + 1))
        prev = now
    return min(prev)


def spoil(s, n, rng):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice(["", "#", s[k] + "#"])
    return "".join(s)


def test_distance():
    rng = random.Random(1)
    for n in range(8):
        for _ in range(10):
            lead = "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))
            text = lead + spoil(ITEM, n, rng) + lead
            a, b = (np.frombuffer(x.encode(), np.uint8) for x in (ITEM, text))
            got, end = dc.distance(a, b, len(lead) - 20, len(lead) + 20)
            assert got == edits(ITEM, text) and abs(end - (len(lead) + len(text) - 2 * len(lead))) <= n + 1


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "short", 0), (4, "Another passage, of quite some length, which is spread over two lines.\nIt is here to be found.", 0)], "item_id long, text string, doc_id int")


def test_planted(frame, bench):
    rng = random.Random(2)
    fill = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(0, fill(50) + " " + ITEM + " " + fill(50)), (1, ITEM.upper().replace(" ", "  \n")), (2, fill(30) + "é " + spoil(ITEM, 5, rng) + fill(3)), (3, fill(400)), (4, spoil(ITEM, 40, rng)), (5, ITEM[:50]), (6, None), (7, ""), (8, fill(9) + " another passage, of quite some length, which is spread over two lines. it is here to be found. " + ITEM)]
    got = dc.find_leaks(frame(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (1, 1), (2, 1), (8, 4), (8, 1)}
    for r in got:
        part = dict(rows)[r.doc_id][r.begin : r.end]
        want = ITEM if r.item_id == 1 else "another passage"
        assert edits(want.lower()[:20], " ".join(part.lower().split())) <= 5
        if r.edits == 0 and r.item_id == 1:
            assert " ".join(part.lower().split()) == ITEM.lower()


def test_lemma_bound_holds():
    rng = random.Random(3)
    index = dc.Index([1], [ITEM])
    for _ in range(60):
        text = "x" * rng.randrange(40) + spoil(ITEM, int(index.edits[0]), rng) + "y" * 30
        b = text.encode()
        found = list(index.search(np.frombuffer(b, np.uint8), np.array([0, len(b)])))
        assert found or edits(ITEM.lower(), " ".join(text.lower().split())) > index.edits[0]


def test_search_against_all_pairs(spark, frame):
    """Found are exactly the pairs that full dynamic programming over every document and passage finds, within the budget."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [line(rng.randrange(3, 18)) for _ in range(12)]
    items += [items[5], "ab " * 20, "abab abab abab abab"]  # one twice, two that repeat themselves
    docs = [line(30) for _ in range(6)]
    for _ in range(24):
        own = rng.choice(items)
        docs.append(line(rng.randrange(9)) + rng.choice([" ", "  \n", ""]) + spoil(own, rng.randrange(len(own) // 9 + 2), rng).upper() + " " + line(rng.randrange(9)))
    norm = lambda x: " ".join(x.lower().split())
    budget = lambda x: min(int(dc.RATE * len(x)), (len(x) - dc.Q) // dc.Q)
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(map(norm, items)) if len(x) >= dc.Q and edits(x, norm(t)) <= budget(x)}
    found = dc.find_leaks(frame(list(enumerate(docs))), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 10
    for r in found:
        x = norm(items[r.item_id])
        assert edits(x, norm(docs[r.doc_id])) <= r.edits <= budget(x)


def test_odd_rows(odd, empty, bench):
    assert dc.find_leaks(odd, bench).collect() == [] and dc.find_leaks(empty, bench).collect() == []
    assert dc.find_leaks(odd, bench.limit(0)).collect() == []


def test_repetitive_text_takes_bounded_memory():
    import tracemalloc

    index = dc.Index([1], [("abcdefgh ijk " * 80)[:900]])
    buf, offsets = tokens.utf8(pa.array([("abcdefgh ijk " * 20_000)[: 240 << 10]]))
    tracemalloc.start()
    found = list(index.search(buf, offsets))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and most < 150e6
