"""The CRF: forward-backward against enumeration, held-out accuracy, code-switching."""

import itertools

import numpy as np
import pytest

from lectern.llm import langid


def test_posteriors_by_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.standard_normal((9, 3)), rng.standard_normal((3, 3))
    first = np.array([0, 4, 4, 9])
    pairs = np.zeros((3, 3))
    got = langid.posteriors(emit, first, trans, pairs)
    want, want_pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 9)):
        paths = list(itertools.product(range(3), repeat=b - a))
        w = np.exp([sum(emit[a + t, y] for t, y in enumerate(p)) + sum(trans[p[t], p[t + 1]] for t in range(len(p) - 1)) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w, strict=True):
            for t, y in enumerate(p):
                want[a + t, y] += x
                if t:
                    want_pairs[p[t - 1], y] += x
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, langid.train(docs)


def test_held_out_accuracy(trained):
    docs, model = trained
    from pyspark.sql import functions as F

    held = docs.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1)
    rows = langid.identify(held, model).join(held, "doc_id").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 40 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_code_switching(trained):
    docs, model = trained
    text = {lang: next(r.text for r in docs.where(f"lang = '{lang}'").orderBy("doc_id").limit(1).collect()) for lang in ("en", "de")}
    a, b = text["en"].split()[:30], text["de"].split()[:30]
    labels = langid.label_words(model, " ".join(a + b))
    right = sum(lang == "en" for _, lang, _ in labels[:30]) + sum(lang == "de" for _, lang, _ in labels[30:])
    assert right >= 52


def test_odd_rows(trained, odd, empty, spark):
    _, model = trained
    got = langid.identify(odd, model, keep=True).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert got[0].row.row == "x" and {r.doc_id: r.lang_pred for r in got}[6] == "und"
    assert langid.identify(empty, model).collect() == []
    assert langid.train(empty) is None and langid.train(odd) is not None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
