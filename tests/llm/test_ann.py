"""Multiprobe search against brute force."""

import numpy as np
import pytest

from lectern.llm import ann


def brute(ids, x, queries, k=5):
    out = {}
    for q in queries:
        i = ids.index(q)
        s = [(-(x[i] @ x[j]) / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])), ids[j]) for j in range(len(ids)) if ids[j] != q]
        out[q] = [(v, -c) for c, v in sorted((round(c, 9), v) for c, v in s)[:k]]
    return out


def search(df, **kw):
    out = {}
    for r in ann.nearest(df, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want, got = brute(ids, x, [i for i in ids if i % 50 == 0]), search(df)
    found = sum(len({v for v, _ in want[q]} & {v for v, _ in got.get(q, [])}) for q in want)
    assert found >= 0.9 * 5 * len(want)
    for q in got:
        for v, s in got[q]:
            a, b = x[ids.index(q)], x[ids.index(v)]
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    hot = rng.standard_normal(8).astype("float32").tolist()
    rows = [(i, hot) for i in range(0, 120)] + [(200 + i, rng.standard_normal(8).astype("float32").tolist()) for i in range(30)]
    bad = [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] + [0.0] * 7), (1200, [None] + [1.0] * 7), (None, hot), (1250, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, rank int, score string")
    got = search(df)
    assert sorted(got) == [0, 50, 100, 200]
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(s == pytest.approx(1) for _, s in got[0])


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [v for v, _ in search(df)[0]] == [1]
    assert search(df.where("vec_id > 5")) == {}


def test_probe_order():
    sets = ann.perturbations(ann.Params(probes=50))
    assert sets[0] == [] and sets[1] == [1] and len(sets) == 50 and len({tuple(s) for s in sets}) == 50
    unit = np.eye(4)[:1]
    p = ann.Params(tables=3, hashes=4, probes=10)
    assert (ann.probe_codes(unit, p)[:, :, 0] == ann.codes(unit, p)).all()


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7])
def test_all_candidates_if_fewer(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 6))
    x[-1] = -x[0] if n > 1 else x[0]  # as far as can be
    df = spark.createDataFrame([(i * 50, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute([i * 50 for i in range(n)], x, [i * 50 for i in range(n)]) if n > 1 else {}
    assert {q: [v for v, _ in r] for q, r in search(df).items()} == {q: [v for v, _ in r] for q, r in want.items()}


def test_extreme_components_and_lengths(spark):
    rows = [(0, [1e200, 0.0, 0.0]), (1, [1e200, 1e200, 0.0]), (2, [1e-200, 0.0, 1e-200]), (3, [-1e-310, 0.0, 0.0]), (4, [5.0]), (50, [3.0])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [v for v, _ in got[0]] == [1, 2, 3] and [s for _, s in got[0]] == pytest.approx([0.5**0.5, 0.5**0.5, -1])
    assert got[50] == [(4, 1.0)]


def test_only_probed_rows_are_scored():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    x = ann.scaled(np.repeat(centres, 50, axis=0) + 0.15 * rng.standard_normal((2000, 32)))
    p = ann.Params(probes=20)
    code, unit = ann.codes(ann._unit(x), p), ann._unit(x[:40])
    probes = ann.probe_codes(unit, p)
    hit = ann.reached(probes, code)
    assert hit.mean() < 0.5  # of rows that cluster, most are never scored
    at, of, _ = ann.rerank((np.arange(40), x[:40], unit, probes), x, code, 5)
    assert hit[at, of].all()
    best = np.argsort(-(unit @ ann._unit(x).T), axis=1)[:, :6]
    assert np.mean([np.isin(best[i], of[at == i]).mean() for i in range(40)]) > 0.95


def test_scans_one_after_the_other(spark, monkeypatch):
    """Many scans of few queries find what one scan of all does, and the driver keeps no query once its scan is over."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((12, 16))[rng.integers(0, 12, 1500)] + 0.3 * rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = search(df)
    made, gone = [], []
    sc = type(spark.sparkContext)
    real = sc.broadcast

    def broadcast(self, value):
        out = real(self, value)
        made.append(out)
        destroy = out.destroy
        out.destroy = lambda *a: (gone.append(len(made)), destroy(*a))
        return out

    monkeypatch.setattr(sc, "broadcast", broadcast)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    monkeypatch.setattr(ann, "SCAN_BLOCKS", 1)
    assert search(df) == whole
    assert len(made) > 2 and len(gone) == len(made) and gone == sorted(gone) and gone[0] == 1
