"""Toxicity: a support vector machine on a gapped-subsequence string kernel, by Nystroem landmarks, trained on labelled sentences."""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import bounded, stage

#: Labelled documents that are learned from, at most: toxic ones, others. They are the first by a hash of their ids.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 4000
#: Sentences, at most: of toxic documents, of others; words of a sentence.
TOXIC_SENTENCES, CLEAN_SENTENCES, SENTENCE_WORDS = 4000, 8000, 64
#: Landmarks of each kind, pieces that may bear the toxicity, and clean pieces added in each round.
LANDMARKS, SEEDS, HARD, ROUNDS = 160, 512, 4000, 3
#: Log-likelihood ratio from which a piece counts as one of toxic documents (chance of 1e-7 without a relation, as there are many pieces).
SIGNIFICANT = 28.0
#: Such a piece stands in toxic documents this many times as often as in others.
RATIO = 10
#: Share of the training documents that the scores of documents are calibrated on.
CALIBRATE = 4
#: Decay of the kernel with each character that a subsequence spans.
DECAY = 0.7
#: Subsequences of three and four characters: places after the first character, in a span of five and six characters.
PATTERNS = [(a, b) for a, b in itertools.combinations(range(1, 5), 2)] + list(itertools.combinations(range(1, 6), 3))
#: Longest piece; a longer word is looked at in windows that overlap by half.
PIECE = 24
#: Scores of pieces matter from here on.
FLOOR = -0.5
_GAP = "\0" * 5
#: By letters: the length of a text's weights if no subsequence stands in it twice, which is the least there is.
_LEAST_LENGTH = np.sqrt([sum(max(0, n - p[-1]) * DECAY ** (2 * p[-1] + 2) for p in PATTERNS) for n in range(2 * PIECE + 1)])
#: Words whose decisions a task keeps.
KNOWN_WORDS = 2_000_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")


@functools.cache
def _letters() -> np.ndarray:
    """By code unit: itself if a letter or digit, else 0 (a gap)."""
    return np.array([c if chr(c).isalnum() else 0 for c in range(1 << 16)], np.uint64)


def pieces_of(word: str) -> list[str]:
    """The word in lower case without signs at its edges, in windows if it is long."""
    w = word.lower()
    w = w if w.isalnum() else _EDGE.sub("", w)
    return [w] if len(w) <= PIECE else [w[k : k + PIECE] for k in range(0, len(w) - PIECE // 2, PIECE // 2)]


def pieces(words: list[str]) -> list[str]:
    """The pieces of words, and of what three or more words of one letter in a row spell."""
    out, run = [], []
    for w in [*words, ""]:
        own = pieces_of(w)
        if len(own[0]) == 1:
            run.append(own[0])
        else:
            if len(run) >= 3:
                out += pieces_of("".join(run))
            run = []
        out += own if own[0] else []
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each followed by a gap that no subsequence spans, and the text of each code."""
    points = np.frombuffer((_GAP.join(texts) + _GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 1 << 16, points, points % 0xFFFF + 1)  # characters beyond share codes with others
    return _letters()[points], np.repeat(np.arange(len(texts)), np.array([len(t) + len(_GAP) for t in texts]))


def _subsequences(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern: the places it starts at, the keys of the subsequences there, and their weight."""
    n = len(code) - len(_GAP)
    for pattern in PATTERNS:
        key, good = code[:n], code[:n] != 0
        for k in pattern:
            own = code[k : n + k]
            key = (key << np.uint64(16)) | own
            good = good & (own != 0)
        at = np.flatnonzero(good)
        yield at, key[at], DECAY ** (pattern[-1] + 1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, subsequence, weight) of every subsequence that a text holds; the weights of a text have length 1."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    code, own = _codes(texts)
    row, key, weight = (np.concatenate(x) for x in zip(*((own[at], key, np.full(len(at), w)) for at, key, w in _subsequences(code)), strict=True))
    if not len(row):
        return row, key, weight
    by = np.lexsort((key, row))
    row, key = row[by], key[by]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
    weight, row, key = np.add.reduceat(weight[by], first), row[first], key[first]
    return row, key, weight / np.sqrt(np.bincount(row, weight**2, len(texts)))[row]


def kernel(texts: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of each text with each landmark."""
    row, key, weight = features(texts)
    of, known, share = features(landmarks)
    out = np.zeros((len(texts), len(landmarks)))
    every = np.unique(known)
    if not len(every) or not len(row):
        return out
    at = np.minimum(np.searchsorted(every, key), len(every) - 1)
    hit = every[at] == key
    row, at, weight = row[hit], at[hit], weight[hit]
    for j in range(len(landmarks)):
        own = np.zeros(len(every))
        own[np.searchsorted(every, known[of == j])] = share[of == j]
        out[:, j] = np.bincount(row, weight * own[at], len(texts))
    return out


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Weights of the linear machine with squared hinge loss, by Newton steps; the last one is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    loss = lambda w: w @ keep @ w / 2 + (c * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(30):
        inside = y * (x @ w) < 1
        own = x[inside] * (2 * c[inside])[:, None]
        to = np.linalg.solve(keep + own.T @ x[inside], own.T @ y[inside]) - w
        step, now = 1.0, loss(w)
        while step > 1e-3 and loss(w + step * to) > now:
            step /= 2
        w = w + step * to
        if now - loss(w) < 1e-6 * now:
            break
    return w


@dataclass
class Model:
    """The weight of every subsequence of the landmarks, the bias, and the weights of a document's score."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    top: np.ndarray

    def __post_init__(self) -> None:
        self.known = np.zeros(1 << 18, bool)
        self.known[self._slot(self.keys)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)

    def decide(self, texts: list[str]) -> np.ndarray:
        """The machine's decision on each piece, FLOOR at least (a decision above 0 is for toxic)."""
        out = np.full(len(texts), FLOOR)
        if not texts or not len(self.keys):
            return out
        code, own = _codes(texts)
        total = np.zeros(len(texts))
        letters = np.bincount(own, code != 0, len(texts)).astype(int)
        whole = letters == np.array([len(t) for t in texts])
        for at, key, weight in _subsequences(code):
            hit = np.flatnonzero(self.known[self._slot(key)])
            place = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
            good = self.keys[place] == key[hit]
            total += np.bincount(own[at[hit[good]]], self.weights[place[good]] * weight, len(texts))
        # a text of letters alone has this length at least; what stays below FLOOR with it needs no exact length
        some = np.flatnonzero((total > 0) & (total > np.where(whole, (FLOOR - self.bias) * _LEAST_LENGTH[np.minimum(letters, 2 * PIECE)], 0)))
        if len(some):
            row, key, weight = features([texts[i] for i in some])
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            out[some] = np.maximum(FLOOR, np.bincount(row[hit], self.weights[place[hit]] * weight[hit], len(some)) + self.bias)
        return out

    def score(self, top: np.ndarray) -> np.ndarray:
        """Scores of documents, given the decisions on their three most toxic pieces."""
        x = (np.clip(top, FLOOR, 1.5) - FLOOR) / (1.5 - FLOOR)
        z = self.top[0] + x @ self.top[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_three(doc: np.ndarray, decision: np.ndarray, n: int) -> np.ndarray:
    """The three largest decisions of each document, FLOOR where there are fewer."""
    out = np.full((n, 3), FLOOR)
    by = np.lexsort((-decision, doc))
    doc, decision = doc[by], decision[by]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    near = place < 3
    out[doc[near], place[near]] = decision[near]
    return out


def decide_documents(model: Model, texts: list[str | None]) -> np.ndarray:
    """The three largest decisions of each text."""
    return _judge(model, pa.array(texts, pa.string()))


class Known:
    """Decisions on words, by their hashes; begins anew when there are KNOWN_WORDS."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hashes, self.decisions, self.single = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] != hashes

    def add(self, hashes: np.ndarray, decisions: np.ndarray, single: np.ndarray) -> None:
        own = (np.concatenate(x) for x in zip((self.hashes, self.decisions, self.single), (hashes, decisions, single), strict=True))
        h, d, s = own
        by = np.argsort(h, kind="stable")
        self.hashes, self.decisions, self.single = h[by], d[by], s[by]


def _judge(model: Model, column: pa.Array, seen: Known | None = None) -> np.ndarray:
    """The three largest decisions of each text; every different word is decided on once."""
    seen = seen or Known()
    buf, offsets = tokens.utf8(column)
    out = np.full((len(offsets) - 1, 3), FLOOR)
    for lo, hi in tokens.blocks(offsets, 4 << 20):
        part = offsets[lo : hi + 1]
        own, base = buf[part[0] : part[-1]], part - part[0]
        h, starts, ends, first = tokens.words(own, base, lower=True)
        if not len(h):
            continue
        raw = own.tobytes()
        if len(seen.hashes) > KNOWN_WORDS:
            seen.clear()
        unique, at, of = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(seen.missing(unique))
        if len(new):
            split = [pieces_of(raw[starts[i] : ends[i]].decode()) for i in at[new].tolist()]
            flat = [p for s in split for p in s]
            decision = np.maximum.reduceat(model.decide(flat), np.cumsum([0] + [len(s) for s in split[:-1]]))
            seen.add(unique[new], decision, np.array([len(s[0]) == 1 for s in split]))
        place = np.searchsorted(seen.hashes, unique)
        decision, single = seen.decisions[place], seen.single[place][of]
        text = np.repeat(np.arange(hi - lo), np.diff(first))
        # words of one letter in a row
        edge = np.diff(np.concatenate([[0], single.view(np.int8), [0]]))
        cut = np.flatnonzero(single[1:] & single[:-1] & (text[1:] != text[:-1])) + 1
        begin, end = np.sort(np.r_[np.flatnonzero(edge == 1), cut]), np.sort(np.r_[np.flatnonzero(edge == -1), cut])
        spelt, where = [], []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a >= 3:
                spelt += (more := pieces_of("".join(pieces_of(raw[starts[k] : ends[k]].decode())[0] for k in range(a, b))))
                where += [int(text[a])] * len(more)
        hit = np.flatnonzero(decision[of] > FLOOR)
        doc = np.concatenate([text[hit], np.array(where, np.int64)])
        out[lo:hi] = best_three(doc, np.concatenate([decision[of[hit]], model.decide(spelt)]), hi - lo)
    return out


def _varied(texts: list[str]) -> list[str]:
    """Each piece once more with a sign or letter put into it, spaced out, or with a letter doubled."""
    rng = np.random.default_rng(7)
    out = []
    for i, t in enumerate(texts):
        if len(t) >= 4:
            k = int(rng.integers(1, len(t)))
            out.append((t[:k] + "*.-_xq"[int(rng.integers(6))] + t[k:], "-".join(t), t[:k] + t[k - 1] + t[k:])[i % 3][: 2 * PIECE])
    return out


def _pieces_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = pa.array(sorted({p for p in pieces(_BLANKS.split(text or "")) if len(p) >= 3}), pa.string())
            yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(own), toxic))], names=["piece", "toxic"])


def _sentences(seeds: set[str]):
    """Sentences as lists of pieces: of toxic documents those with a seed, of others all."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for s in _SENTENCE.split(text or ""):
                    words = [w for w in _BLANKS.split(s) if w]
                    for k in range(0, len(words), SENTENCE_WORDS):
                        own = [p for p in pieces(words[k : k + SENTENCE_WORDS]) if len(p) >= 3]
                        if own and (not toxic or any(p in seeds for p in own)):
                            rows.append(own[: 4 * SENTENCE_WORDS])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), pa.array(np.full(len(rows), toxic))], names=["pieces", "toxic"])

    return cut


def _likelihood(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Twice the log-likelihood ratio of a piece's counts in toxic and other documents, 0 if others hold it more often."""
    n, k = float(n_pos + n_neg), pos + neg
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = term(pos, k * (n_pos / n)) + term(neg, k * (n_neg / n)) + term(n_pos - pos, (n - k) * (n_pos / n)) + term(n_neg - neg, (n - k) * (n_neg / n))
    return F.when(pos * n_neg > neg * n_pos, 2 * ratio).otherwise(0.0)


def fit(positive: list[list[str]], negative: list[list[str]], seeds: list[str], hard) -> Model | None:
    """The machine on sentences: a sentence counts as its most toxic piece, which the machine of the round before finds.

    seeds are in falling order of evidence. hard(model) gives clean pieces that the model takes for toxic ones; they are
    clean sentences of one piece from then on.
    """
    rank = {s: i for i, s in enumerate(seeds)}
    witness = Counter(min((p for p in s if p in rank), key=rank.__getitem__) for s in positive)
    plain = sorted({p for s in negative for p in s})
    if not witness or not plain:
        return None
    rng = np.random.default_rng(11)
    clean = [plain[i] for i in np.sort(rng.choice(len(plain), min(len(plain), 2 * HARD), replace=False))]
    landmarks = sorted(witness, key=rank.__getitem__)[:LANDMARKS]
    landmarks = sorted({*landmarks, *(clean[i] for i in rng.choice(len(clean), min(len(clean), LANDMARKS), replace=False))})
    value, vector = np.linalg.eigh(kernel(landmarks, landmarks))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    of, key, share = features(landmarks)
    keys, place = np.unique(key, return_inverse=True)
    model, added = None, []
    for turn in range(ROUNDS):
        if turn:
            witness = Counter(max(zip(model.decide(s), [-len(p) for p in s], s, strict=True))[2] for s in positive)
            added = sorted(set(added) | set(hard(model)))
        own = sorted(witness)
        yes, no = [*own, *_varied(own), *_varied(own[::-1])], [*clean, *added]
        no = [p for p in [*no, *_varied(no[: len(no) // 2])] if p not in rank]
        texts = yes + no
        x = np.vstack([kernel(texts[k : k + 4000], landmarks) @ root for k in range(0, len(texts), 4000)])
        y = np.r_[np.ones(len(yes)), -np.ones(len(no))]
        c = np.where(y > 0, 4 * min(5.0, max(1.0, len(no) / len(yes) / 4)), 4.0)
        c[: len(own)] *= [1 + np.log2(witness[p]) for p in own]  # for the sentences it stands for
        w = svm(x, y, c)
        weight = np.bincount(place, (root @ w[:-1])[of] * share, len(keys))
        model = Model(keys, weight, min(float(w[-1]), FLOOR), np.array([-5.0, 10.0, 0.0, 0.0]))
    return model


def _calibrated(model: Model, top: np.ndarray, y: np.ndarray) -> Model:
    """The logistic weights of a document's three decisions."""
    x = (np.clip(top, FLOOR, 1.5) - FLOOR) / (1.5 - FLOOR)
    x = np.column_stack([np.ones(len(x)), x])
    w, prior = np.array([-4.0, 8.0, 0.0, 0.0]), np.diag([1e-3, 0.02, 0.02, 0.02])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(prior + (x * (p * (1 - p) + 1e-9)[:, None]).T @ x, x.T @ (p - y) + prior @ w)
        w[1:] = np.maximum(w[1:], 0)  # a toxic piece never speaks for a document
    return Model(model.keys, model.weights, model.bias, w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: bool = True) -> Model | None:
    """Fits the machine on a bounded sample of labelled documents (with held_out: of those whose crc32(id as text) mod 3 is not 1).

    A document is toxic if any of its labels is above 0; ids and labels that are null take no part; an id with several texts
    stands for one of them. None without documents of both kinds or without a piece that toxic ones hold significantly
    more often. Counts of pieces, hard clean pieces and sentences come from Spark jobs over the sample's whole texts.
    """
    text_id = F.col(id_col).cast("string")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if held_out:
        known = known.where(F.crc32(F.encode(text_id, "UTF-8")) % 3 != 1)
    order = F.xxhash64("__id", F.lit("toxic"))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.max(label_col) > 0).alias("toxic")).withColumn("order", order)
    ids = known.where("toxic").orderBy("order", "__id").limit(TRAIN_TOXIC).unionByName(known.where("not toxic").orderBy("order", "__id").limit(TRAIN_CLEAN))
    ids = stage(ids.withColumn("fit", F.pmod(F.xxhash64("__id", F.lit("fit")), F.lit(CALIBRATE)) > 0), "labelled")
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "__id")
    sample = stage(own.groupBy("__id", "toxic", "fit").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    n = {(r.toxic, r.fit): r["count"] for r in sample.groupBy("toxic", "fit").count().collect()}
    pos, neg = n.get((True, True), 0), n.get((False, True), 0)
    if not pos or not neg:
        return None
    given = bounded(sample.where("fit").select("text", "toxic"))
    counted = given.mapInArrow(_pieces_by_document, "piece string, toxic boolean").groupBy("piece").agg(F.count_if("toxic").alias("pos"), F.count_if(~F.col("toxic")).alias("neg"))
    pool = stage(counted.withColumn("evidence", _likelihood(F.col("pos"), F.col("neg"), pos, neg)), "pieces")
    clear = F.col("pos") * neg >= RATIO * F.col("neg") * pos
    seeds = [r.piece for r in pool.where((F.col("evidence") >= SIGNIFICANT) & (F.col("pos") > 1) & clear).orderBy(F.desc("evidence"), "piece").limit(SEEDS).collect()]
    sentences = given.mapInArrow(_sentences(set(seeds)), "pieces array<string>, toxic boolean").withColumn("order", F.xxhash64("pieces"))
    first = lambda toxic, most: [r.pieces for r in sentences.where(F.col("toxic") == toxic).orderBy("order", "pieces").limit(most).collect()]
    clean = pool.where((F.col("neg") > 0) & ~(clear & (F.col("evidence") >= SIGNIFICANT))).select("piece")

    def hard(model: Model) -> list[str]:
        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decide(batch.column(0).to_pylist()))], names=["piece", "decision"])

        found = clean.mapInArrow(decide, "piece string, decision double").where(F.col("decision") > FLOOR)
        return [r.piece for r in found.orderBy(F.desc("decision"), "piece").limit(HARD).collect()]

    model = fit(first(True, TOXIC_SENTENCES), first(False, CLEAN_SENTENCES), seeds, hard) if seeds else None
    if model is None:
        return None
    both = n.get((True, False), 0) and n.get((False, False), 0)
    told = bounded(sample.where(~F.col("fit") if both else F.lit(True)).select("text", "toxic")).mapInArrow(_top_of(model), "toxic boolean, top array<double>").collect()  # a quarter of the sample
    return _calibrated(model, np.array([r.top for r in told]), np.array([float(r.toxic) for r in told]))


def _top_of(model: Model):
    def top_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Known()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(_judge(model, batch.column(0), seen).tolist(), pa.list_(pa.float64()))], names=["toxic", "top"])

    return top_of


def rate(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text.

    Returns the id (as doc_id), score (0 to 1; 0 without a model), n_toxic (0 to 3: pieces among the three most toxic that the
    machine takes for toxic ones) for each row. Null, empty and wordless texts have no piece and the lowest score; repeated rows are
    scored each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at most: LANDMARKS pieces and their subsequences

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Known()
        for batch in tokens.regrouped(batches, 1, 4 << 20):
            if shared.value is None:
                top, score = np.full((batch.num_rows, 3), FLOOR), np.zeros(batch.num_rows)
            else:
                top = _judge(shared.value, batch.column(1), seen)
                score = shared.value.score(top)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((top > 0).sum(axis=1))], names=["doc_id", "score", "n_toxic"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(source).mapInArrow(judge, "doc_id long, score double, n_toxic long")
