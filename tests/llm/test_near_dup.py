"""Near-dedup against all pairs, with the block path forced, and the Bayesian floors."""

import random
import re

import pytest

from lectern.llm import near_dup
from lectern.llm.common import components
from lectern.llm.near_dup import near_duplicates


def brute(rows, k, num=4, den=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((find(ids[x]), find(ids[y])))
                root[q] = p
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def family(seed=1, n=70):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 5, 6, 7, 8, 20])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    rows += [(n + i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 40)))) for i in range(30)]
    return rows + [(n + 30, "one"), (n + 31, "one"), (n + 32, None), (n + 33, "")]


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("block", [5, 800])
def test_brute_force(frame, monkeypatch, k, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = family()
    got = near_duplicates(frame(rows), k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(odd, 5).collect()), key=repr)
    assert len(got) == odd.count()
    by = {i: (n, c) for i, n, c in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[5] == (1, 5)
    assert by[None][1] is None and by[4] == (56, None) and by[8] == (56, None)  # a null id sorts first


def test_one_id_two_texts(frame):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    got = near_duplicates(frame([(1, a), (2, a), (2, b), (3, b), (4, "other words here")]), 2).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == 5 and by[4] == 4 and ((by[2], by[3]) == (1, 3) or (by[1], by[2], by[3]) == (1, 2, 2))


def test_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_floors_rise_and_keep_true_pairs():
    f = near_dup.floors(4, 5)
    assert len(f) == 4 and all(a < b for a, b in zip(f, f[1:], strict=False))
    assert f[-1] < 0.8 * near_dup.COMPARED


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_long_words_are_told_apart(frame):
    one, two = "a", "b"
    for _ in range(11):
        one, two = one + two, two + one
    assert {r.doc_id: r.component_id for r in near_duplicates(frame([(1, one), (2, two), (3, one)]), 2).collect()} == {1: 1, 2: 2, 3: 1}
