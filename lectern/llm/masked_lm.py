"""LM scoring by masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import bounded, stage, unstage

#: Words predicted as themselves; all others, the last class, are spelled byte by byte. As context, and in training, they
#: fall into RARE ids by their hash. Together CLASSES * WITHIN.
CLASSES, WITHIN, RARE = 64, 64, 64
VOCAB = CLASSES * WITHIN
WINDOW, DIM, HIDDEN = 2, 16, 32
#: Rounds of local training and averaging; over all of them, every word of every document is a training target once.
ROUNDS, BATCH, RATE = 2, 2048, 0.16
#: Targets of a batch at most, and words that are scored at a time.
MOST, STEP = 4096, 8192
#: Targets that are gathered and mixed before they are trained on.
GROUP = 16 * BATCH
#: Models that one task averages.
FAN_IN = 32
#: Contexts of a byte of a rare word (the two bytes before it, hashed), and the symbol that ends a word.
PLACES, END = 4096, 0x20
PLACE = (tokens.mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PLACES)).astype(np.int32)
SLICES = 8


def _shapes() -> dict[str, tuple[int, ...]]:
    return {"embed": (VOCAB + 1, DIM), "mixer": (2 * WINDOW * DIM, HIDDEN), "bias": (HIDDEN,), "class_w": (HIDDEN, CLASSES), "class_b": (CLASSES,), "word_w": (VOCAB, HIDDEN), "word_b": (VOCAB,)}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _shapes()]).astype(np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in _shapes().items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def start(count: np.ndarray, seed: int = 9) -> dict[str, np.ndarray]:
    """Small random weights; the output biases are the corpus's log frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in _shapes().items()}
    c = count.reshape(CLASSES, WITHIN) + 1.0
    p["class_b"] = np.log(c.sum(axis=1) / c.sum()).astype(np.float32)
    p["word_b"] = np.log(c / c.sum(axis=1, keepdims=True)).ravel().astype(np.float32)
    p["bias"][:] = 0
    p["word_w"] *= 0.1
    p["class_w"] *= 0.1
    return p


def contexts(ids: np.ndarray, first: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(targets, 2 * WINDOW) ids on both sides; VOCAB stands past either end of a text."""
    out = np.full((len(at), 2 * WINDOW), VOCAB, np.int64)
    for c, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        j = at + step
        ok = (j >= first[doc]) & (j < first[doc + 1])
        out[ok, c] = ids[j[ok]]
    return out


def _lower(x: np.ndarray) -> np.ndarray:
    """Takes a maximum off x, in place: that of all where no row can underflow by it, else each row's."""
    if x.size:
        top = x.max()
        x -= top if top - x.min() < 80 else x.max(axis=1, keepdims=True)
    return x


def _picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of column at[i] of each row i; x is overwritten."""
    own = _lower(x)[np.arange(len(x)), at]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], x.dtype))


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(_lower(x), out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _groups(k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes before the last, put together by about equal numbers of words: the classes, (classes, most) rows of their
    words and which of these are real."""
    by = np.argsort(k.astype(np.int16), kind="stable")
    cut = np.searchsorted(k[by], np.arange(CLASSES))
    many = np.diff(cut)
    level = np.ceil(np.log2(np.maximum(many, 1))).astype(np.int64)
    for x in np.unique(level[many > 0]):
        own = np.flatnonzero((level == x) & (many > 0))
        step = np.arange(many[own].max())
        real = step < many[own][:, None]
        yield own, by[np.where(real, cut[own][:, None] + step, 0)], real


def log_probs(p: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray, spelled: np.ndarray | None = None) -> np.ndarray:
    """ln p(word | both sides) for each word: that of its class, plus that of the word within it; for words of the last
    class the latter is their entry in spelled, if that is given."""
    table = [p["embed"] @ p["mixer"][c * DIM : (c + 1) * DIM] for c in range(2 * WINDOW)]
    out = np.empty(len(ids))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for lo in range(0, len(ids), STEP):
        at = np.arange(lo, min(lo + STEP, len(ids)))
        ctx = contexts(ids, first, at, doc[at])
        h = table[0][ctx[:, 0]]
        for c in range(1, 2 * WINDOW):
            h += table[c][ctx[:, c]]
        h += p["bias"]
        np.tanh(h, out=h)
        y = ids[at]
        k = y // WITHIN
        got = _picked(h @ p["class_w"] + p["class_b"], k).astype(np.float64)
        for own, rows, real in _groups(k):
            x = h[rows] @ p["word_w"].reshape(CLASSES, WITHIN, -1)[own].transpose(0, 2, 1) + p["word_b"].reshape(CLASSES, 1, WITHIN)[own]
            more = _picked(x.reshape(-1, WITHIN), (y[rows] % WITHIN).ravel()).reshape(rows.shape)
            got[rows[real]] += more[real]
        rows = np.flatnonzero(k == CLASSES - 1)
        if spelled is not None:
            got[rows] += spelled[at[rows]]
        elif len(rows):
            own = slice((CLASSES - 1) * WITHIN, CLASSES * WITHIN)
            got[rows] += _picked(h[rows] @ p["word_w"][own].T + p["word_b"][own], y[rows] % WITHIN)
        out[at] = got
    return out


class Trainer:
    """Adagrad over batches of targets."""

    def __init__(self, flat: np.ndarray):
        self.p = unpack(flat)
        self.sq = {k: np.full(v.shape, 1e-4, np.float32) for k, v in self.p.items()}
        self.seen = 0

    def _step(self, k: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        sq = self.sq[k][rows] + grad * grad
        self.sq[k][rows] = sq
        self.p[k][rows] -= RATE * grad / np.sqrt(sq)

    def batch(self, ctx: np.ndarray, y: np.ndarray) -> None:
        p, n = self.p, len(y)
        x = p["embed"][ctx].reshape(n, -1)
        h = np.tanh(x @ p["mixer"] + p["bias"])
        k = y // WITHIN
        d_class = _softmax(h @ p["class_w"] + p["class_b"])
        d_class[np.arange(n), k] -= 1
        d_class /= n
        d_h = d_class @ p["class_w"].T
        word_w, word_b = p["word_w"].reshape(CLASSES, WITHIN, -1), p["word_b"].reshape(CLASSES, 1, WITHIN)
        g_w, g_b = np.zeros_like(word_w), np.zeros((CLASSES, WITHIN), np.float32)
        for own, rows, real in _groups(k):  # words of the last class are spelled, not told apart by it
            mine, w = h[rows], word_w[own]
            d = _softmax((mine @ w.transpose(0, 2, 1) + word_b[own]).reshape(-1, WITHIN))
            d[np.arange(len(d)), (y[rows] % WITHIN).ravel()] -= 1
            d = (d * (real.ravel()[:, None] / np.float32(n))).reshape(*rows.shape, WITHIN)
            d_h[rows[real]] += (d @ w)[real]
            g_w[own], g_b[own] = d.transpose(0, 2, 1) @ mine, d.sum(axis=1)
        d_z = d_h * (1 - h * h)
        d_x = (d_z @ p["mixer"].T).reshape(-1, DIM)
        flat = ctx.ravel().astype(np.int16)  # sorted by radix
        by = np.argsort(flat, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(flat[by]) != 0])
        d_embed = np.add.reduceat(d_x[by], cut, axis=0)
        self._step("class_w", h.T @ d_class)
        self._step("class_b", d_class.sum(axis=0))
        self._step("mixer", x.T @ d_z)
        self._step("bias", d_z.sum(axis=0))
        self._step("embed", d_embed, flat[by[cut]].astype(np.int64))
        self._step("word_w", g_w.reshape(p["word_w"].shape))
        self._step("word_b", g_b.ravel())
        self.seen += n

    def size(self) -> int:
        """Targets of the next batch: few at first, more as the model settles."""
        return int(min(MOST, max(BATCH, self.seen // 16 // BATCH * BATCH)))


def _ids(known: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(known):
        return VOCAB - RARE + (h % np.uint64(RARE)).astype(np.int64)
    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[k] == h, rank[k], VOCAB - RARE + (h % np.uint64(RARE)).astype(np.int64))


def _words(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    buf, offsets = tokens.utf8(batch.column(column))
    for lo, hi in tokens.blocks(offsets):
        part = offsets[lo : hi + 1]
        own = buf[part[0] : part[-1]]
        h, starts, ends, first = tokens.words(own, part - part[0], lower=True)
        yield lo, hi, h, first, tokens.LOWER[own], starts, ends


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, h, first, *_ in _words(batch, column):
        yield lo, hi, h, first


def _letters(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context and byte) of the bytes of each word and of its end, and where each word's begin."""
    lens = ends - starts + 1
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) + np.repeat(starts - at, lens)
    b = buf[np.minimum(place, len(buf) - 1)].astype(np.int32)
    b[at + lens - 1] = END
    one, two = np.zeros(len(b), np.int32), np.zeros(len(b), np.int32)
    one[1:], two[2:] = b[:-1], b[:-2]
    one[at] = two[at] = two[at + 1] = 0
    return PLACE[two * 256 + one] * 256 + b, at


def spellings(table: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """ln p of each word's bytes and of its end, by a table of PLACES * 256 logarithms; equal words (hashes h) are worked out once."""
    if not len(starts):
        return np.zeros(0)
    _, some, of = np.unique(h, return_index=True, return_inverse=True)
    keys, at = _letters(buf, starts[some], ends[some])
    return np.add.reduceat(table[keys], at, dtype=np.float64)[of]


def _spelled(table: np.ndarray, ids: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """spellings() of the words outside the vocabulary, 0 for the others."""
    out, rare = np.zeros(len(ids)), np.flatnonzero(ids >= VOCAB - RARE)
    out[rare] = spellings(table, buf, starts[rare], ends[rare], h[rare])
    return out


def letter_table(counts: np.ndarray) -> np.ndarray:
    """ln p(byte | two bytes before it) from counts by key; the shares of all contexts together weigh as one count."""
    n = counts.reshape(PLACES, 256)
    every = (n.sum(axis=0) + 1.0) / (n.sum() + 256.0)
    return np.log((n + every) / (n.sum(axis=1, keepdims=True) + 1.0)).astype(np.float32).ravel()


def _count_letters(counts: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
    """Adds the keys of all of these words."""
    if len(h):
        _, some, many = np.unique(h, return_index=True, return_counts=True)
        keys, at = _letters(buf, starts[some], ends[some])
        counts += np.bincount(keys, np.repeat(many, np.diff(np.append(at, len(keys)))), len(counts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        h, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(of, np.concatenate([c for _, c in held])).astype(np.int64)

    def out() -> pa.RecordBatch:
        h, c = summed()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["word", "n"])

    for batch in batches:
        for _, _, h, _ in _texts(batch, 0):
            held.append(np.unique(h, return_counts=True))
            if len(held) == 16:
                held = [summed()]
                if len(held[0][0]) > 2_000_000:
                    yield out()
                    held = []
    if held:
        yield out()


def vocabulary(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of all words of all texts; the most frequent ones (sorted hashes, their ranks), and of each id the count."""
    counts = stage(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCAB - RARE).collect()
    rare = counts.groupBy(F.expr(f"cast(pmod(pmod(word, {RARE}) + {RARE}, {RARE}) as int)").alias("class")).agg(F.sum("n").alias("n")).collect()
    count = np.zeros(VOCAB)
    for r in rare:
        count[VOCAB - RARE + r["class"]] += r["n"]
    h = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    for i, r in enumerate(top):
        count[i] = r["n"]
        count[VOCAB - RARE + int(h[i] % np.uint64(RARE))] -= r["n"]
    by = np.argsort(h)
    return h[by], by, np.maximum(count, 0)


def _average(rows: DataFrame, tasks: int) -> np.ndarray:
    """The mean of the tasks' models, weighted by the words they saw; level by level, FAN_IN at a time."""

    def mean(key, pdf):
        import pandas as pd

        w = pdf["seen"].to_numpy(float)
        both = sum(np.frombuffer(m, np.float32) * x for m, x in zip(pdf["model"], w, strict=True)) / max(w.sum(), 1)
        return pd.DataFrame({"task": [key[0]], "slice": [key[1]], "seen": [w.sum()], "model": [both.astype(np.float32).tobytes()]})

    while tasks > 1:
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("long"))
        rows = stage(rows.groupBy("task", "slice").applyInPandas(mean, "task long, slice int, seen double, model binary"), "average")
        tasks = -(-tasks // FAN_IN)
    return np.concatenate([np.frombuffer(r["model"], np.float32) for r in sorted(rows.collect(), key=lambda r: r["slice"])])


def _fit(batches: Iterator[pa.RecordBatch], known: np.ndarray, rank: np.ndarray, flat: np.ndarray, turn: int, rounds: int, letters: np.ndarray | None = None) -> Trainer:
    """Trains on the words of the batches whose place in their text is `turn` modulo `rounds`: on all of them, once. letters:
    gets the counts of all words that are spelled."""
    trainer = Trainer(flat)
    ctx, y, size = [], [], 0

    def learn(least: int) -> None:
        nonlocal ctx, y, size
        c, t = np.concatenate(ctx), np.concatenate(y)
        by = np.random.default_rng(trainer.seen).permutation(len(t)) if least else np.arange(len(t))
        lo = 0
        while len(t) - lo > (least and trainer.size() - 1):
            own = by[lo : lo + trainer.size()]
            trainer.batch(c[own], t[own])
            lo += len(own)
        ctx, y, size = [c[by[lo:]]], [t[by[lo:]]], len(t) - lo  # goes into the next group

    for batch in batches:
        for _, _, h, first, buf, starts, ends in _words(batch, 0):
            ids = _ids(known, rank, h)
            if letters is not None:
                rare = np.flatnonzero(ids >= VOCAB - RARE)
                _count_letters(letters, buf, starts[rare], ends[rare], h[rare])
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            at = np.arange(len(h))
            at = at[(at - first[doc]) % rounds == turn]
            for lo in range(0, len(at), GROUP):
                own = at[lo : lo + GROUP]
                ctx.append(contexts(ids, first, own, doc[own]))
                y.append(ids[own])
                size += len(own)
                if size >= GROUP:
                    learn(1)
    if size:
        learn(0)
    return trainer


def train(texts: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Known words (sorted hashes), their ids, the flat model, and the letter table of all others. Words are counted over all texts; in each of n rounds
    every task trains from the common model on every n-th word of each of its texts, one place further in each round, and the models are averaged.
    The first round also counts the letters of all words outside the vocabulary (PLACES * 256 counts come to the driver, as Arrow)."""
    known, rank, count = vocabulary(texts)
    flat, letters = pack(start(count)), np.zeros(PLACES * 256)
    for turn in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast((known, rank, flat))  # at most VOCAB words, one model

        def fit(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            counts = None if turn else np.zeros(PLACES * 256)
            trainer = _fit(batches, *shared.value, turn, rounds, counts)
            task, names = TaskContext.get().partitionId(), ["task", "slice", "seen", "model", "key", "n"]
            if trainer.seen:
                parts, none = np.array_split(pack(trainer.p), SLICES), pa.nulls(SLICES, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([task] * SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([float(trainer.seen)] * SLICES), pa.array([x.tobytes() for x in parts], pa.binary()), none, none], names=names)
            if counts is not None and len(some := np.flatnonzero(counts)):
                none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.int32(), pa.float64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int64()), pa.array(counts[some].astype(np.int64))], names=names)

        rows = stage(texts.mapInArrow(fit, "task long, slice int, seen double, model binary, key long, n long"), "models")
        if not turn:
            counted = rows.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
            letters[counted["key"].to_numpy()] = counted["n"].to_numpy()
        models = rows.where("task is not null").select("task", "slice", "seen", "model")
        tasks = models.agg(F.max("task")).first()[0]
        if tasks is None:
            continue  # texts of one word have no target in later rounds, empty ones in none
        flat = _average(models, max(2, tasks + 1))
        unstage(rows)
    return known, rank, flat, letter_table(letters)


def score(docs: DataFrame, model: tuple | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pseudo-likelihood of every whole text: the sum of ln p(word | two words on either side) over all of its words.
    A word outside the vocabulary has the probability of the class of such words between its neighbours, times that of its
    spelling: each byte, and the end of the word, given the two bytes before, as counted over all such words of the corpus.

    Returns doc_id, n_words, log_likelihood, mean_log_prob (null without words) and perplexity (exp of its negative).
    Null and empty texts have 0 words and log_likelihood 0. Trained on docs unless a model is given: each task trains on the
    rows of its partition and the models are averaged, so scores also depend (by a percent or two) on how docs is partitioned. Rows that repeat an
    id are scored each; no documents, no rows. Other columns are not read.
    """
    docs = bounded(docs)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or train(source.select("text")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, flat, letters = shared.value
        p = unpack(flat)
        for batch in batches:
            n, total = [], []
            for _, _, h, first, buf, starts, ends in _words(batch, 1):
                ids = _ids(known, rank, h)
                lp = np.r_[0.0, np.cumsum(log_probs(p, ids, first, _spelled(letters, ids, buf, starts, ends, h)))]
                n += np.diff(first).tolist()
                total += (lp[first[1:]] - lp[first[:-1]]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_words", "log_likelihood"])

    out = source.mapInArrow(apply, "doc_id long, n_words long, log_likelihood double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))).withColumn("perplexity", F.exp(-F.col("mean_log_prob")))
