"""The string kernel against its definition, the decision against kernels, and held-out accuracy, also on disguised words."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import queries, toxicity
from lectern.llm.toxicity import DECAY, FLOOR, decide_documents, features, kernel, pieces, rate, svm, train

WORDS = ["idiot", "id.iot", "mississippi", "aaaa", "ab", "größe", "", "x-y-z-w", "scum"]


def plain_features(t):
    out = defaultdict(float)
    for k, most in ((3, 5), (4, 6)):
        for at in itertools.combinations(range(len(t)), k):
            if at[-1] - at[0] < most and all(t[i].isalnum() for i in at):
                out["".join(t[i] for i in at)] += DECAY ** (at[-1] - at[0] + 1)
    return out


def plain_kernel(a, b):
    x, y = plain_features(a), plain_features(b)
    norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0


def test_kernel():
    want = [[plain_kernel(a, b) for b in WORDS] for a in WORDS]
    assert np.allclose(kernel(WORDS, WORDS), want)
    assert kernel(["idiot"], ["id.iot"])[0, 0] > 0.7 > kernel(["idiot"], ["idea"])[0, 0] and features([])[0].size == 0


def test_pieces():
    assert pieces(["I", "d", "i", "o", "t.", "(You)", "--", "é", "x"]) == ["i", "d", "i", "o", "t", "idiot", "you", "é", "x"]
    assert "".join(p[:12] for p in pieces(["ab" * 30])[:-1]) + pieces(["ab" * 30])[-1] == "ab" * 30


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 5))
    y = np.sign(x[:, 0] - 0.3)
    x[:, 0] += 0.2 * y
    w = svm(x, y, np.full(300, 10.0))
    assert ((x @ w[:-1] + w[-1]) * y > 0).all()


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    parts = "the an er th on re he in ed nd ha at en es of or nt ea ti to io le is ou ar as de rt ve".split()
    word = lambda: "".join(rng.choice(parts, int(rng.integers(1, 4))))
    bad = ["grobik", "vlonk", "stumpard", "zwattle"]

    def text(toxic, n=None):
        w = [word() + ("." if rng.random() < 0.1 else "") for _ in range(n or int(rng.integers(20, 120)))]
        for _ in range(2 + int(rng.integers(4)) if toxic else 0):
            w.insert(int(rng.integers(len(w) + 1)), bad[int(rng.integers(4))] + ("!" if rng.random() < 0.2 else ""))
        return " ".join(w)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "no", 0.5) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, train(docs, labels), text


def test_held_out(world):
    rows, docs, _, model, _ = world
    got = {r.doc_id: r.score for r in rate(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(s >= 0.7 for s, y in held if y) >= 0.97 * sum(y for _, y in held)
    assert sum(s >= 0.7 for s, y in held if not y) <= 0.01 * len(held)


def test_disguised_words(world, spark):
    *_, model, text = world
    hidden = ["g r o b i k", "vl*onk", "z-w-a-t-t-l-e", "stumxpard", "VLONNK", "Grob.ik", "s t u m p a r d", "zwat_tle"]
    docs = [(i, text(False) + f" {w} " + text(False, 3) + " " + w) for i, w in enumerate(hidden)] + [(100 + i, text(False)) for i in range(100)]
    got = {r.doc_id: r.score for r in rate(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert sum(got[i] >= 0.7 for i in range(len(hidden))) >= 7 and sum(got[100 + i] >= 0.7 for i in range(100)) == 0


def test_decisions_are_kernels(world):
    """The weights of subsequences sum up to the landmarks' kernels: a copy within a text changes no piece's decision."""
    rows, *_, model, _ = world
    one = decide_documents(model, [rows[0][1], "", None, rows[0][1] * 2])
    assert (one[1] == FLOOR).all() and (one[2] == FLOOR).all() and one[0, 0] == one[3, 0] > 0
    longest = decide_documents(model, ["so " * 300_000 + "vlonk " + "y" * 1_200_000 + " vlonk"])
    assert longest[0, 0] == longest[0, 1] > 0 == (longest[0, 2] > 0)


def test_odd_and_unlearnable(world, spark, odd, empty):
    *_, labels, model, _ = world
    got = rate(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and rate(empty, model).collect() == []
    none = labels.where("toxic > 5")
    assert train(odd, none) is None and train(empty, labels) is None and train(odd, labels.where("toxic = 0")) is None
    assert {r.score for r in rate(odd, None).collect()} == {0.0}
    strange = labels.limit(3).unionByName(spark.createDataFrame([(None, 1), (4, None), (4, 1), (4, 0), (5, 0), (5, 0)], "doc_id long, toxic int"))
    assert train(odd.unionByName(odd), strange, held_out=False) is None


def test_query(spark, sf_dir):
    out = queries.op13_subsequence_svm(spark, sf_dir)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.collect())
