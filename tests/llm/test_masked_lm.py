"""The masked model: gradients, normalised probabilities, learning, whole texts."""

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import masked_lm as lm


def test_probabilities_sum_to_one():
    p = lm.start(np.ones(lm.VOCAB))
    first = np.array([0, 5])
    base = np.array([3, 9, 0, 70, 200])
    total = 0.0
    for w in range(lm.VOCAB):
        ids = base.copy()
        ids[2] = w
        total += float(np.exp(lm.log_probs(p, ids, first)[2])) if w % 64 == 0 else 0.0
    ids = np.tile(base, (lm.VOCAB, 1))
    ids[:, 2] = np.arange(lm.VOCAB)
    lp = lm.log_probs(p, ids.ravel(), np.arange(0, ids.size + 1, 5))[2::5]
    assert np.exp(lp).sum() == pytest.approx(1, abs=1e-3)


def test_gradient_step_lowers_loss():
    rng = np.random.default_rng(0)
    ids = np.tile([5, 80, 700, 5, 80, 700], 400)
    first = np.array([0, len(ids)])
    t = lm.Trainer(lm.pack(lm.start(np.ones(lm.VOCAB))))
    before = lm.log_probs(t.p, ids, first).mean()
    doc = np.zeros(len(ids), int)
    for _ in range(30):
        at = rng.permutation(len(ids))
        t.batch(lm.contexts(ids, first, at, doc), ids[at])
    after = lm.log_probs(t.p, ids, first).mean()
    assert after > before + 3


def test_edges_of_texts():
    ids, first = np.array([1, 2, 3]), np.array([0, 1, 3])
    ctx = lm.contexts(ids, first, np.array([0, 1, 2]), np.array([0, 1, 1]))
    v = lm.VOCAB
    assert ctx.tolist() == [[v, v, v, v], [v, v, 3, v], [v, 2, v, v]]


def test_pack_round_trip():
    p = lm.start(np.ones(lm.VOCAB))
    q = lm.unpack(lm.pack(p))
    assert all((p[k] == q[k]).all() for k in p)


def test_prose_beats_noise(spark, sf_dir, frame):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.train(docs.select("text"))
    r = docs.where("lang = 'en'").orderBy("doc_id").first()
    words = r.text.split()[:200]
    rng = np.random.default_rng(1)
    known = frame([(1, " ".join(words)), (2, " ".join(rng.permutation(["zq%d" % i for i in range(200)])))])
    s = {x.doc_id: x.mean_log_prob for x in lm.score(known, model).collect()}
    assert s[1] > s[2]
    whole = lm.score(docs, model).collect()
    assert sorted((x.doc_id, x.n_words) for x in whole) == sorted((x.doc_id, len(x.text.split())) for x in docs.collect())
    assert all(x.log_likelihood < 0 for x in whole if x.n_words)


def test_odd_rows(odd, empty):
    got = lm.score(odd).collect()
    assert len(got) == odd.count()
    assert all((r.n_words, r.log_likelihood, r.mean_log_prob) == (0, 0.0, None) for r in got if r.doc_id in (1, 2, 3))
    assert lm.score(empty).collect() == []


def test_every_word_is_a_target_once(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(lo, lo + n)) for lo, n in ((0, 90_001), (90_001, 1), (90_002, 5), (90_007, 40_000))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    h = np.concatenate([x for _, _, x, _ in lm._texts(batch, 0)])
    known, rank = np.sort(h), np.argsort(h)  # every word has an id of its own: its place
    seen = []

    def record(self, ctx, y):
        seen.append(y)
        self.seen += len(y)

    monkeypatch.setattr(lm.Trainer, "batch", record)
    flat = lm.pack(lm.start(np.ones(lm.VOCAB)))
    for turn in range(lm.ROUNDS):
        lm._fit([batch, batch.slice(0, 0)], known, rank, flat, turn, lm.ROUNDS)
    assert (np.sort(np.concatenate(seen)) == np.arange(len(h))).all()
    assert all(len(y) <= lm.MOST for y in seen)


def test_spellings_against_plain():
    texts = ["Ab cé a", "", "zz\tab"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    counts = np.random.default_rng(0).integers(0, 9, lm.PLACES * 256).astype(float)
    table = lm.letter_table(counts)
    assert np.exp(table.reshape(lm.PLACES, 256)).sum(axis=1) == pytest.approx(1, abs=1e-4)
    (_, _, h, _, buf, starts, ends) = next(lm._words(batch, 0))
    want = []
    for word in " ".join(texts).lower().split():
        b = [0, 0, *word.encode(), lm.END]
        want.append(sum(float(table[lm.PLACE[b[i - 2] * 256 + b[i - 1]] * 256 + b[i]]) for i in range(2, len(b))))
    assert lm.spellings(table, buf, starts, ends, h) == pytest.approx(want)
    rare = np.zeros(lm.PLACES * 256)
    lm._count_letters(rare, buf, starts, ends, h)
    assert rare.sum() == sum(len(w.encode()) + 1 for t in texts for w in t.split())


def test_rare_words_differ(frame):
    rng = np.random.default_rng(2)
    corpus = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(2000)) for _ in range(8)]
    model = lm.train(frame(list(enumerate(corpus))).select("text"))
    words = sorted(set(" ".join(corpus).split()))
    h = next(lm._texts(pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], names=["text"]), 0))[2]
    ids = lm._ids(model[0], model[1], h)
    one, other = np.flatnonzero(ids == lm.VOCAB - lm.RARE)[:2]  # of the same rare id
    s = {r.doc_id: r.log_likelihood for r in lm.score(frame([(1, words[one]), (2, words[other]), (3, "zqxj9")]), model).collect()}
    assert s[1] != s[2] and s[3] < min(s[1], s[2]) and max(s[1], s[2]) < 0


def test_gradients_against_differences(monkeypatch):
    rng = np.random.default_rng(3)
    flat = lm.pack(lm.start(rng.integers(1, 50, lm.VOCAB).astype(float)))
    ids = rng.integers(0, lm.VOCAB - lm.WITHIN, 40)
    first, at, doc = np.array([0, 40]), np.arange(40), np.zeros(40, int)
    grads = {}

    def keep(self, k, grad, rows=slice(None)):
        whole = grads.setdefault(k, np.zeros(self.p[k].shape))
        whole[rows] += grad

    monkeypatch.setattr(lm.Trainer, "_step", keep)
    lm.Trainer(flat).batch(lm.contexts(ids, first, at, doc), ids)

    def loss(p):
        return -lm.log_probs(p, ids, first).mean()

    for k in ("embed", "mixer", "bias", "class_w", "class_b", "word_w", "word_b"):
        place = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        up, down = ({n: v.astype(np.float64) for n, v in lm.unpack(flat).items()} for _ in range(2))
        up[k][place] += 1e-4
        down[k][place] -= 1e-4
        assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(grads[k][place], rel=2e-2), k


def test_scores_against_plain():
    """One word at a time, over the whole softmax."""
    rng = np.random.default_rng(5)
    p = {k: v.astype(np.float64) for k, v in lm.unpack(lm.pack(lm.start(rng.integers(1, 50, lm.VOCAB).astype(float)))).items()}
    ids, first = rng.integers(0, lm.VOCAB, 30), np.array([0, 12, 12, 30])
    got = lm.log_probs(p, ids, first)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        for i in range(lo, hi):
            x = np.concatenate([p["embed"][ids[j] if lo <= j < hi else lm.VOCAB] for j in (i - 2, i - 1, i + 1, i + 2)])
            h = np.tanh(x @ p["mixer"] + p["bias"])
            k = ids[i] // lm.WITHIN
            c = h @ p["class_w"] + p["class_b"]
            w = p["word_w"][k * lm.WITHIN : (k + 1) * lm.WITHIN] @ h + p["word_b"][k * lm.WITHIN : (k + 1) * lm.WITHIN]
            want = c[k] - np.log(np.exp(c).sum()) + w[ids[i] % lm.WITHIN] - np.log(np.exp(w).sum())
            assert got[i] == pytest.approx(want, abs=1e-9)
