"""Language ID: a linear-chain CRF over words; affix, n-gram and lexicon features, forward-backward."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import tokens
from lectern.llm.common import bounded, whole_rows

#: The training sample: at most so many labelled rows, and of each so many characters from a place its id's hash chooses.
TRAIN_ROWS, TRAIN_CHARS = 1200, 4000
SLOTS = 1 << 18
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # (SLOTS, languages); slot 0 stays 0
    trans: np.ndarray  # log potentials, from row to column


def _slot(code: np.ndarray, kind: int) -> np.ndarray:
    return (tokens.mix(code * np.uint64(8) + np.uint64(kind)) % np.uint64(SLOTS - 1)).astype(np.int32) + 1


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots of words: by place (places x 2: bigram and trigram of the framed word), the first place of each word, and (words x 3): affixes and the word."""
    lens = ends - starts
    frame = np.cumsum(lens + 2) - (lens + 2)
    within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    text = np.zeros(int((lens + 2).sum()) + 3, np.uint64)
    text[np.repeat(frame + 1, lens) + within] = tokens.LOWER[buf[np.repeat(starts, lens) + within]]
    n = len(text) - 3
    two = text[:n] << np.uint64(8) | text[1 : n + 1]
    three = two << np.uint64(8) | text[2 : n + 2]
    four = three << np.uint64(8) | text[3 : n + 3]
    slots = np.stack([_slot(two, 0), _slot(three, 1)], 1)
    last = frame + lens + 1
    slots[last, :] = 0
    slots[last - 1, 1] = 0
    suffix = np.maximum(last - 3, frame)
    return slots, frame, np.stack([_slot(four[frame], 2), _slot(four[suffix], 3), _slot(h, 4)], 1)


def emissions(model_weights: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(words, languages) scores; equal words are worked out once, a few thousand at a time to bound memory."""
    _, at, of = np.unique(h, return_index=True, return_inverse=True)
    score = np.empty((len(at), model_weights.shape[1]), np.float32)
    for lo in range(0, len(at), 8192):
        some = at[lo : lo + 8192]
        grams, frame, own = features(buf, starts[some], ends[some], h[some])
        score[lo : lo + 8192] = np.add.reduceat(model_weights[grams[:, 0]] + model_weights[grams[:, 1]], frame, axis=0) + model_weights[own].sum(axis=1)
    return score[of]


def posteriors(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over all texts at once: the posterior of each word's language. pairs: gets the expected transitions.

    Texts stand in falling length, so step t works on the first of them that have a word t.
    """
    n, k = emit.shape
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    lens, head = lens[order], first[:-1][order]
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    t_pot = np.exp(trans - trans.max()).astype(e.dtype)
    alpha = np.empty_like(e)
    longest = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(longest), "left")  # texts of more than t words
    state = None
    for t in range(longest):
        a = active[t]
        at = head[:a] + t
        now = e[at] if state is None else (state[:a] @ t_pot) * e[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = state = now
    out = np.empty_like(e)
    beta = np.ones((len(lens), k), e.dtype)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = head[:a] + t
        post = alpha[at] * beta[:a]
        post /= post.sum(axis=1, keepdims=True)
        out[at] = post
        if t:
            back = e[at] * beta[:a]
            if pairs is not None:
                joint = alpha[at - 1][:, :, None] * t_pot[None] * back[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = back @ t_pot.T
            beta[:a] = back / back.sum(axis=1, keepdims=True)
    return out


def fit(texts: list[str], labels: list[str], epochs: int = 30, seed: int = 5) -> Crf | None:
    """Trains on word chains that put segments of differently labelled texts one after the other, as code-switching does."""
    langs = sorted(set(labels))
    if not langs:
        return None
    buf, offsets = tokens.utf8(pa.array(texts, pa.string()))
    h, starts, ends, first = tokens.words(buf, offsets, lower=True)
    if not len(h):
        return Crf(langs, np.zeros((SLOTS, len(langs)), np.float32), np.zeros((len(langs), len(langs)), np.float32))
    rng = np.random.default_rng(seed)
    pieces = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        while a < b:
            n = int(rng.integers(5, 40))
            pieces.append((langs.index(labels[i]), a, min(b, a + n)))
            a += n
    rng.shuffle(pieces)
    at = np.concatenate([np.arange(a, b) for _, a, b in pieces])
    y = np.concatenate([np.full(b - a, lang) for lang, a, b in pieces])
    chain = np.arange(0, len(at) + 120, 120)
    chain = np.append(chain[chain < len(at)], len(at))
    _, word_at, word = np.unique(h, return_index=True, return_inverse=True)
    grams, frame, own = features(buf, starts[word_at], ends[word_at], h[word_at])
    per = np.diff(np.append(frame, len(grams)))
    slot_word = np.repeat(np.arange(len(word_at)), per)
    flat, flat_word = np.concatenate([grams[:, 0], grams[:, 1], *own.T]), np.concatenate([slot_word, slot_word, *[np.arange(len(word_at))] * 3])
    used, flat = np.unique(flat, return_inverse=True)
    k = len(langs)
    w, trans = np.zeros((len(used), k), np.float64), np.zeros((k, k))
    w_sq, t_sq = np.full_like(w, 1e-2), np.full_like(trans, 1e-2)
    inner = np.ones(len(at), bool)
    inner[chain[:-1]] = False
    real = np.zeros((k, k))
    np.add.at(real, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    word = word[at]
    for _ in range(epochs):
        score = np.stack([np.bincount(flat_word, w[flat, c], len(word_at)) for c in range(k)], 1)
        expected = np.zeros((k, k))
        p = posteriors(score[word], chain, trans, expected)
        p[np.arange(len(y)), y] -= 1
        by_word = np.stack([np.bincount(word, p[:, c], len(word_at)) for c in range(k)], 1)
        grad = np.stack([np.bincount(flat, by_word[flat_word, c], len(used)) for c in range(k)], 1) / len(y) * 100 + 1e-3 * w
        if used[0] == 0:
            grad[0] = 0
        w_sq += grad**2
        w -= 0.2 * grad / np.sqrt(w_sq)
        grad = (expected - real) / len(y) * 10
        t_sq += grad**2
        trans -= 0.2 * grad / np.sqrt(t_sq)
    weights = np.zeros((SLOTS, k), np.float32)
    weights[used] = w
    weights[0] = 0
    return Crf(langs, weights, trans.astype(np.float32))


def label_words(model: Crf, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) for each word of one text."""
    buf, offsets = tokens.utf8(pa.array([text]))
    h, starts, ends, first = tokens.words(buf, offsets, lower=True)
    if not len(h):
        return []
    post = posteriors(emissions(model.weights, buf, starts, ends, h), first, model.trans)
    raw = buf.tobytes()
    return [(raw[a:b].decode(), model.langs[p.argmax()], float(p.max())) for a, b, p in zip(starts, ends, post, strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: bool = True) -> Crf | None:
    """Fits the CRF on the bounded sample above of rows with a label (and, with held_out, crc32(id as text) mod 3 other than 1)."""
    text_id = F.col(id_col).cast("string")
    rows = docs.where(F.col(lang_col).isNotNull() & text_id.isNotNull())
    if held_out:
        rows = rows.where(F.crc32(F.encode(text_id, "UTF-8")) % 3 != 1)
    order = F.xxhash64(text_id, F.lit("train"))
    ids = rows.select(F.col(id_col).alias("__train_id"), order.alias("__order")).orderBy("__order", "__train_id").limit(TRAIN_ROWS).select("__train_id")
    spare = F.greatest(F.length(text_col) - TRAIN_CHARS, F.lit(0)) + 1
    cut = F.substring(F.col(text_col), F.pmod(order, spare).cast("int") + 1, F.lit(TRAIN_CHARS))
    own = rows.join(F.broadcast(ids), F.col(id_col) == F.col("__train_id"), "left_semi").select(text_id.alias("i"), F.col(lang_col).alias("l"), F.coalesce(cut, F.lit("")).alias("t"))
    sample = sorted(map(tuple, own.limit(2 * TRAIN_ROWS).collect()))
    return fit([t for _, _, t in sample], [x for _, x, _ in sample])


def _classify(shared):
    names = ["doc_id", "lang_pred", "score", "shares", "n_switches"]

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in tokens.regrouped(batches, 1, 3 << 20):
            buf, offsets = tokens.utf8(batch.column(1))
            pred, score, shares, switches = [], [], [], []
            for lo, hi in tokens.blocks(offsets, 3 << 20):
                part = offsets[lo : hi + 1]
                own, base = buf[part[0] : part[-1]], part - part[0]
                h, starts, ends, first = tokens.words(own, base, lower=True)
                k = len(crf.langs) if crf else 1
                mean, switch = np.zeros((hi - lo, k)), np.zeros(hi - lo, np.int64)
                if crf and len(h):
                    post = posteriors(emissions(crf.weights, own, starts, ends, h), first, crf.trans)
                    sums = np.vstack([np.zeros((1, k)), np.cumsum(post, axis=0, dtype=np.float64)])
                    mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
                    best = post.argmax(axis=1)
                    turn = np.r_[False, best[1:] != best[:-1]]
                    turn[first[:-1][first[:-1] < len(h)]] = False
                    switch = np.diff(np.r_[0, np.cumsum(turn)][first])
                ascii_letter = np.r_[0, np.cumsum((own | 32) - np.uint8(97) < 26)]
                letters = ascii_letter[base[1:]] > ascii_letter[base[:-1]]
                for i in np.flatnonzero(~letters & (base[1:] > base[:-1])):
                    letters[i] = bool(_LETTER.search(own[base[i] : base[i + 1]].tobytes().decode()))
                for i in range(hi - lo):
                    good = bool(letters[i]) and crf is not None
                    best = int(mean[i].argmax())
                    pred.append(crf.langs[best] if good else "und")
                    score.append(float(min(1.0, mean[i, best])) if good else 0.0)
                    shares.append([(x, float(v)) for x, v in zip(crf.langs, mean[i], strict=True)] if good else [])
                    switches.append(int(switch[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64())), pa.array(switches, pa.int64()), *batch.columns[2:]], names=names + batch.schema.names[2:])

    return classify


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Labels every word of every whole text by forward-backward and sums the posteriors.

    Returns the id (as doc_id), lang_pred (language of the largest mean posterior, ties to the first in order; `und` for a null text,
    one without a letter, or without a model), score (that mean), shares (of all languages), n_switches (changes of the
    best language between neighbouring words); with keep also row, a struct of all columns of docs, whatever their names.
    Rows that repeat an id are labelled each; no documents, no rows.
    """
    docs = bounded(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *whole_rows(docs, keep))
    schema = T.StructType.fromDDL("doc_id long, lang_pred string, score double, shares map<string, double>, n_switches long")
    return source.mapInArrow(_classify(shared), T.StructType(schema.fields + source.schema.fields[2:]))
