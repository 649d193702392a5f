"""Raking meets its marginals; the Spark and the driver path agree; samples follow the probabilities."""

import numpy as np
import pytest

from lectern.llm import mixing


def test_rake_meets_targets():
    rng = np.random.default_rng(0)
    cells = np.stack([g.ravel() for g in np.meshgrid(range(4), range(3), range(2), indexing="ij")], 1)
    mass = rng.random(24) + 0.1
    targets = [rng.dirichlet(np.ones(n) * 5) for n in (4, 3, 2)]
    w = mixing.rake(cells, mass, targets)
    for d, t in enumerate(targets):
        assert np.allclose(np.bincount(cells[:, d], w * mass) / mass.sum(), t, atol=1e-6)
    c = mixing.calibrate(w, mass, 0.5)
    assert (np.minimum(1, c * w) * mass).sum() == pytest.approx(0.5 * mass.sum())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_expected_shares(docs):
    goal = {"lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}}
    rows = mixing.mix(docs, goal, budget=0.2).join(docs, "doc_id").collect()
    total = sum(r.weight * r.tokens for r in rows)
    for lang, share in goal["lang"].items():
        assert sum(r.weight * r.tokens for r in rows if r.lang == lang) / total == pytest.approx(share, abs=0.02)
    assert sum(r.prob * r.tokens for r in rows) / sum(r.tokens for r in rows) == pytest.approx(0.2, abs=0.01)
    assert all(r.tokens == len(r.text.split()) for r in rows)


def test_two_paths_agree(docs, monkeypatch):
    a = {r.doc_id: (round(r.weight, 3), round(r.prob, 3)) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    monkeypatch.setattr(mixing, "SWEEPS", 20)
    b = {r.doc_id: (round(r.weight, 3), round(r.prob, 3)) for r in mixing.mix(docs).collect()}
    off = [i for i in a if abs(a[i][0] - b[i][0]) > 0.02 * max(1, a[i][0])]
    assert not off


def test_paths_equal_where_raking_is_slow(spark):
    rows = [("a", "x", 0, 100.0), ("a", "y", 0, 1.0), ("b", "x", 1, 2.0), ("b", "y", 1, 90.0), ("b", "y", 0, 9.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, mass double")
    goal = {"source": {"a": 0.55, "b": 0.45}, "lang": {"x": 0.45, "y": 0.55}, "topic": {0: 0.6, 1: 0.4}}
    a, b = ({(r.source, r.lang, r.topic): (r.weight, r.prob) for r in f(cells, goal, 0.6).collect()} for f in (mixing._rake_on_driver, mixing._rake_in_spark))
    assert len(a) == len(b) == 5
    for cell, both in a.items():
        assert b[cell] == pytest.approx(both, rel=1e-9)


def test_repeatable_and_odd(odd, empty):
    a, b = (sorted(((r.doc_id, r.selected, r.row.tokens) for r in mixing.mix(odd, keep=True).collect()), key=repr) for _ in range(2))
    assert a == b and len(a) == odd.count()
    assert mixing.mix(empty).collect() == []


def test_topics_are_learned(frame):
    rng = np.random.default_rng(6)
    themes = [[f"theme{t}word{i}" for i in range(60)] for t in range(3)]
    texts = [" ".join(rng.choice(themes[i % 3], 40)) + " the of and" for i in range(240)]
    rows = frame([*enumerate(texts), (900, "a b c"), (901, None)])
    got = {r.doc_id: r.topic for r in mixing.mix(rows).collect()}
    by = [{got[i] for i in range(240) if i % 3 == t} for t in range(3)]
    most = [max(b, key=lambda k, t=t: sum(got[i] == k for i in range(t, 240, 3))) for t, b in enumerate(by)]
    assert len(set(most)) == 3 and np.mean([got[i] == most[i % 3] for i in range(240)]) > 0.7
    assert got[900] == got[901] == -1
    again = {r.doc_id: r.topic for r in mixing.mix(rows.repartition(7)).collect()}
    assert again == got


def test_whole_query_against_plain(frame):
    """Tokens, raking and probabilities, worked out row by row."""
    rng = np.random.default_rng(8)
    rows = frame([(i, " ".join(f"word{rng.integers(200)}" for _ in range(rng.integers(0, 60)))) for i in range(300)])
    got = {r.doc_id: r for r in mixing.mix(rows, targets={"lang": {"en": 0.8, "fr": 0.2}}).collect()}
    docs = {r.doc_id: r for r in rows.collect()}
    assert set(got) == set(docs) and all(got[i].tokens == len(docs[i].text.split()) for i in docs)
    cells = {}
    for i, r in docs.items():
        if got[i].tokens:
            cells[r.source, r.lang, got[i].topic] = cells.get((r.source, r.lang, got[i].topic), 0) + got[i].tokens
    total = sum(cells.values())
    weight = dict.fromkeys(cells, 1.0)
    want = [None, {"en": 0.8, "fr": 0.2}, None]
    for dim, name in enumerate(("source", "lang", "topic")):
        if want[dim] is None:
            mass = {}
            for c, m in cells.items():
                mass[c[dim]] = mass.get(c[dim], 0) + m
            share = {k: v ** mixing.POWERS[name] for k, v in mass.items()}
            want[dim] = {k: v / sum(share.values()) for k, v in share.items()}
    for _ in range(400):
        for dim in range(3):
            now = {}
            for c, m in cells.items():
                now[c[dim]] = now.get(c[dim], 0) + weight[c] * m / total
            for c in cells:
                weight[c] *= want[dim][c[dim]] / now[c[dim]]
    for i, r in docs.items():
        if got[i].tokens:
            assert got[i].weight == pytest.approx(weight[r.source, r.lang, got[i].topic], rel=1e-5)
            assert got[i].selected in (True, False) and (got[i].selected or got[i].prob < 1)
    assert sum(got[i].prob * got[i].tokens for i in docs) == pytest.approx(mixing.BUDGET * total, rel=1e-6)
