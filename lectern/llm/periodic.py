"""Periodic run detection: all runs of words from the Lyndon arrays of two opposite orders, after Ellert and Fischer."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import bounded

#: A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Bytes of text whose words are ranked together, about.
BLOCK = 1 << 20
_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def ranks(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only: words are sorted by length and then by one block of 8 bytes after
    the other, as far as they have any. The numbers order the alphabet."""
    lens = ends - starts
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), np.dtype("<u8"), padded, strides=(1,))
    mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    out = _pairs(lens.astype(np.uint64), eight[starts] & mask[np.minimum(lens, 8)])
    k, left = 1, np.flatnonzero(lens > 8)
    while len(left):
        block = eight[starts[left] + 8 * k] & mask[np.minimum(lens[left] - 8 * k, 8)]
        out[left] = _pairs(out[left].astype(np.uint64), block) + (int(out.max()) + 1)
        k += 1
        left = left[lens[left] > 8 * k]
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of each pair among the sorted different pairs."""
    by = np.lexsort((b, a))
    new = np.zeros(len(by), np.int64)
    new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def matching(s: list[int], a: np.ndarray, i: int, j: int, most: int) -> int:
    """How many symbols of s from i and from j on are equal, `most` at most (a is s as an array)."""
    k = 0
    while k < most and k < 16:
        if s[i + k] != s[j + k]:
            return k
        k += 1
    step = 64
    while k < most:
        n = min(step, most - k)
        differ = a[i + k : i + k + n] != a[j + k : j + k + n]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k += n
        step *= 4
    return most


def matching_before(s: list[int], a: np.ndarray, i: int, j: int, most: int) -> int:
    """How many symbols of s before i and before j are equal, `most` at most."""
    k = 0
    while k < most and k < 16:
        if s[i - 1 - k] != s[j - 1 - k]:
            return k
        k += 1
    step = 64
    while k < most:
        n = min(step, most - k)
        differ = (a[i - k - n : i - k] != a[j - k - n : j - k])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k += n
        step *= 4
    return most


def lyndon(a: np.ndarray) -> tuple[list[int], list[int]]:
    """For each position i the next position whose suffix is smaller (the end if none: i to there is the longest Lyndon word
    from i on), and how far the two suffixes match.

    Positions are taken from left to right; those that still wait for a smaller suffix form a chain. Matched extensions are
    used again in two ways, so that symbols are compared only from where nothing is known of them: two neighbours of the
    chain that match a given suffix to different lengths settle the next comparison by the shorter one; and inside the
    stretch that matched furthest to the right, a comparison has the outcome of that at its source, as far as the stretch goes.
    """
    s = a.tolist()
    n = len(s)
    after, reach = [n] * n, [0] * n
    before, held = [-1] * n, [0] * n  # the chain: the last smaller suffix, and how far it matches
    base = shift = right = 0  # s[base:right] equals s[base - shift:right - shift]
    for i in range(1, n):
        j, last, known = i - 1, -1, 0
        while j >= 0:
            exact = False
            if last >= 0:  # the match of i with the chain's element before this one, and of those two
                if known != held[last]:
                    exact, known = True, min(known, held[last])
            else:
                known = 0
            if not exact:
                if i < right and j >= base:
                    source, image = j - shift, i - shift
                    there = reach[source] if after[source] == image else held[image] if before[image] == source else -1
                    if there >= right - i:
                        known = max(known, right - i)
                    elif there >= 0:
                        exact, known = True, there
                if not exact:
                    known += matching(s, a, j + known, i + known, n - i - known)
                    if i + known > right:
                        base, shift, right = i, i - j, i + known
            if i + known < n and s[j + known] < s[i + known]:
                break
            after[j], reach[j] = i, known
            last, j = j, before[j]
        before[i], held[i] = j, known if j >= 0 else 0
    return after, reach


def runs(a: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least `least` symbols and `periods` (3 or more) periods, sorted.

    A run's period is the length of the longest Lyndon word that starts in its first period, by one of the two orders of the
    alphabet. So each Lyndon word and the word after it, matched to the right as the array has it and to the left within
    one period, give every run once an order.
    """
    n = len(a)
    found: set[tuple[int, int, int]] = set()
    if n < least:
        return []
    s = a.tolist()
    for order in (a, -a):
        after, reach = (np.array(x, np.int64) for x in lyndon(order))
        at = np.arange(n)
        p = after - at
        good = np.flatnonzero((after < n) & (reach >= (periods - 2) * p + 1) & (reach + 2 * p > least))
        for i in good.tolist():
            q, far = int(p[i]), int(reach[i])
            back = matching_before(s, a, i, i + q, min(i, q))
            length = back + q + far
            if back < q and length >= max(least, periods * q):
                found.add((i - back, length, q))
    return sorted(found)


def barred(codes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches (text, begin, end) of words that can hold a run: every word of a run stands there LEAST_PERIODS times at
    least, so rarer words part a text, and what lies between is looked at in the same way until nothing changes."""
    lo, hi = first[:-1].copy(), first[1:].copy()
    text = np.arange(len(lo))
    out: list[tuple[int, int, int]] = []
    while True:
        long = hi - lo >= LEAST_WORDS
        lo, hi, text = lo[long], hi[long], text[long]
        if not len(lo):
            break
        many = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))
        own = np.repeat(np.arange(len(lo)), many)
        pair = _pairs(own.astype(np.uint64), codes[at].astype(np.uint64))
        rare = np.bincount(pair)[pair] < LEAST_PERIODS
        whole = np.bincount(own, rare, len(lo)) == 0
        out += zip(text[whole].tolist(), lo[whole].tolist(), hi[whole].tolist(), strict=True)
        # what is left between rare words
        keep = ~rare & ~whole[own]
        edge = np.diff(np.r_[0, keep.view(np.int8), 0])
        b, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cut = np.flatnonzero(np.diff(own)) + 1  # a stretch ends where its segment does
        cut = cut[keep[cut] & keep[cut - 1]]
        b, e = np.sort(np.r_[b, cut]), np.sort(np.r_[e, cut])
        text, lo, hi = text[own[b]], at[b] if len(b) else b, (at[e - 1] + 1) if len(e) else e
    return sorted(out)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on the text repeats with period p; None for texts left as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def as_given(doc_id: int | None, n: int) -> None:
    return None


def _detect(change, texts: bool):
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tokens.utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            columns: list[list] = [[] for _ in range(10)]
            for lo, hi in tokens.blocks(offsets, BLOCK):
                part = offsets[lo : hi + 1]
                own, base = buf[part[0] : part[-1]], part - part[0]
                starts, ends, first = word_bounds(own, base)
                codes = ranks(own, starts, ends)
                word = np.arange(len(codes))
                for i in range(hi - lo):
                    if twist := change(ids[lo + i], int(first[i + 1] - first[i])):
                        a, p = twist
                        at = int(first[i]) + a
                        word[at : first[i + 1]] = at + np.arange(int(first[i + 1]) - at) % p
                codes = codes[word]
                found: dict[int, list] = {}
                for i, b, e in barred(codes, first):
                    found.setdefault(i, []).extend((s + b - int(first[i]), n, q) for s, n, q in runs(codes[b:e]))
                raw = own.tobytes()
                for i in range(hi - lo):
                    of = sorted(found.get(i, []))
                    m = int(first[i + 1] - first[i])
                    stay = np.ones(m, bool)
                    for s, n, q in of:
                        stay[s + q : s + n] = False
                    words = raw[base[i] : base[i + 1]].split()
                    if of or change(ids[lo + i], m):
                        words = [words[k] for k in (word[first[i] : first[i + 1]][stay] - first[i]).tolist()]
                    kept = b" ".join(words)
                    best = None
                    for r in of:  # greatest exact exponent; the first of equal ones starts first, then has the smaller period
                        if best is None or r[1] * best[2] > best[1] * r[2]:
                            best = r
                    s, n, q = best or (None, None, None)
                    row = (ids[lo + i], len(of), s, n, q, 1000 * n // q if best else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in of).encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in of], kept.decode() if texts else None)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            types = [pa.int64()] * 6 + [pa.string()] * 2 + [run, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")[:8]] + ["runs", "collapsed"])

    return detect


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (one entry more than texts)."""
    inside = ~tokens.BLANK[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def find_runs(docs: DataFrame, change=as_given, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of words of every text: stretches of at least 24 words and three periods that no neighbouring word extends.

    Returns doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest length / period (ties: smallest
    start, then period; nulls without a run); runs_sha256 and collapsed_sha256 (of the lines `start,length,period` and of the
    words that stay), runs (all, by start, then period) and, with texts, collapsed: the text without the words that a run holds
    after its first period, joined by one space. Words are `[^\\x20\\x09-\\x0D]+`, compared byte by byte. A null or blank
    text has no run and collapses to the empty text. change may give (a, p) for an id and a number of words, so that from word
    a on the text repeats its next p words. Each row is judged by itself, so repeated ids and null ids need no rule; other
    columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(source).mapInArrow(_detect(change, texts), _OUT)
