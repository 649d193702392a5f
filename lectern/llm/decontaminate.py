"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import tokens
from lectern.llm.common import bounded, whole_rows

#: Characters (UTF-8 code units of the normalised text) in a gram; one gram is one 64-bit number.
Q = 8
#: Edits allowed: this part of a passage's length.
RATE = 0.08
#: Bytes of passages that are broadcast at a time.
BLOCK_BYTES = 4 << 20
#: A gram with more places in the passages of a block is left out where the bound stays useful without it.
COMMON = 8
_BITS = 22
#: Places in passages that are looked at a time.
SLICE = 1 << 20


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lower-cased and each run of white space one space: bytes, offsets of the texts, and each byte's place in buf."""
    blank = tokens.BLANK[buf]
    after = np.zeros(len(buf), bool)
    after[1:] = blank[:-1]
    full = offsets[1:] > offsets[:-1]
    after[offsets[:-1][full]] = True  # white space at the start of a text goes
    keep = ~(blank & after)
    place = np.flatnonzero(keep)
    out = tokens.LOWER[buf[keep]]
    out[blank[keep]] = 32
    return out, np.searchsorted(place, offsets), place


def grams(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.uint64)
    for span in (1, 2, 4):
        x = x[:-span] | x[span:] << np.uint64(8 * span) if len(x) > span else x[:0]
    return x


def distance(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits between item and a part of text whose start lies in [low, high], within that band (plus the edits on
    either side that the caller has put in); and the end of that part."""
    w = high - low + 1
    cost, step = np.zeros(w, np.int64), np.arange(w)
    place = low + step
    best = len(item) + 1
    cost[(place < 0) | (place > len(text))] = best
    for i, c in enumerate(item):
        at = place + i
        ok = (at >= 0) & (at < len(text))
        sub = cost + np.where(ok, text[np.clip(at, 0, len(text) - 1)] != c, best)
        drop = np.append(cost[1:], best) + 1
        cost = np.minimum(sub, drop)
        cost = np.minimum.accumulate(cost - step) + step
        cost[place + i + 1 > len(text)] = best
    k = int(cost.argmin())
    return int(cost[k]), int(place[k]) + len(item)


class Index:
    """The grams of a block of passages: places, edit budgets and least counts."""

    def __init__(self, ids: list[int], texts: list[str]):
        buf, offsets = tokens.utf8(pa.array(texts, pa.string()))
        norm, at, _ = normalise(buf, offsets)
        items = [norm[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        items = [x[:-1] if len(x) and x[-1] == 32 else x for x in items]
        good = [i for i, x in enumerate(items) if len(x) >= Q]
        self.ids, self.items = [ids[i] for i in good], [items[i] for i in good]
        # e edits spoil at most Q * e grams; one gram at least must be left
        self.edits = np.array([min(int(RATE * len(x)), (len(x) - Q) // Q) for x in self.items], np.int64)
        g = [grams(x) for x in self.items]
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        pos = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        g = np.concatenate(g) if g else np.zeros(0, np.uint64)
        by = np.argsort(g, kind="stable")
        g, item, pos = g[by], item[by], pos[by]
        _, of, many = np.unique(g, return_inverse=True, return_counts=True)
        rare = many[of] <= COMMON
        left = np.bincount(item[rare], minlength=len(self.items)) - Q * self.edits
        keep = rare | (left < 1)[item]  # the bound holds for any subset of the grams, less those an edit can spoil
        self.item, self.pos = item[keep], pos[keep]
        self.least = np.maximum(np.bincount(self.item, minlength=len(self.items)) - Q * self.edits, 1)
        self.grams, self.first = np.unique(g[keep], return_index=True)
        self.many = np.diff(np.append(self.first, len(self.item)))
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.bucket(self.grams)] = True

    @staticmethod
    def bucket(g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)

    def search(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, passage, first byte, end, edits) for each verified region."""
        norm, at, place = normalise(buf, offsets)
        g = grams(norm)
        hit = np.flatnonzero(self.bits[self.bucket(g)])
        k = np.searchsorted(self.grams, g[hit])
        k[k == len(self.grams)] = 0
        same = self.grams[k] == g[hit] if len(self.grams) else np.zeros(0, bool)
        hit, k = hit[same], k[same]
        if not len(hit):
            return
        many = self.many[k]
        ends = np.cumsum(many)
        # each band has two widths of edits + 1 diagonals, and overlaps the next by one; the number of the first may be -1
        top = len(norm) + max(map(len, self.items)) + 3
        key, count, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while lo < len(hit):  # so many hits that their places in the passages stay under SLICE (or one hit)
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
            own = many[lo:hi]
            at_post = np.repeat(self.first[k[lo:hi]], own) + np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            item, diagonal = self.item[at_post], np.repeat(hit[lo:hi], own) - self.pos[at_post]
            band = np.floor_divide(diagonal, self.edits[item] + 1) + 1
            new, many_new = np.unique(item * (2 * top) + band + top, return_counts=True)
            key, of = np.unique(np.concatenate([key, new]), return_inverse=True)
            count = np.bincount(of, np.concatenate([count, many_new]), len(key)).astype(np.int64)
            lo = hi
        key, of = np.unique(np.concatenate([key, key - 1]), return_inverse=True)
        count = np.bincount(of, np.concatenate([count, count]), len(key)).astype(np.int64)
        item, band = key // (2 * top), key % (2 * top) - top - 1
        good = count >= self.least[item]
        item, band = item[good], band[good]
        if not len(item):
            return
        cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(band) > 1)) + 1
        for run in np.split(np.arange(len(item)), cut):
            i, e = int(item[run[0]]), int(self.edits[item[run[0]]])
            own = self.items[i]
            low, high = int(band[run[0]]) * (e + 1) - e, (int(band[run[-1]]) + 2) * (e + 1) + e
            # the texts that the diagonals pass through
            for d in range(max(0, int(np.searchsorted(at, low, "right")) - 1), len(at) - 1):
                a, b = int(at[d]), int(at[d + 1])
                if a > high + len(own):
                    break
                if b - a < len(own) - e:
                    continue
                text, lo, hi = norm[a:b], max(low - a, -e), min(high - a, b - a)
                if hi < lo:
                    continue
                whole = text[max(lo, 0) : hi + len(own) + e].tobytes().find(own.tobytes())
                if whole >= 0:
                    edits, end, begin = 0, max(lo, 0) + whole + len(own), max(lo, 0) + whole
                else:
                    edits, end = distance(own, text, lo - e, hi + e)
                    if edits > e:
                        continue
                    back, n = text[:end][::-1], len(own)
                    _, length = distance(own[::-1], back, -e, e)
                    begin = max(0, end - min(length, n + e))
                    edits = max(edits, 0)
                last = min(end, b - a) - 1
                yield d, self.ids[i], int(place[a + begin]), int(place[a + last]) + 1, edits


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator:
    """Broadcast indexes of about BLOCK_BYTES of passages each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // BLOCK_BYTES))
    for part in range(parts):
        block = sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()), key=lambda x: (x[0] is None, x))
        yield spark.sparkContext.broadcast(Index([i for i, _ in block], [t for _, t in block]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Finds the places in documents that match a benchmark passage up to 8 % edits (case and white space apart).

    Returns doc_id, item_id, begin, end (code points of the text), edits, one row for each verified region. Passages of
    fewer than 8 bytes can't be told from chance and are not searched; of 8 to 15 bytes they are searched as they are, since
    an edit can spoil all of their grams; null texts match nothing; an empty benchmark
    gives no rows. Rows that repeat an id are searched each. Passages are broadcast in blocks of about 4 MB, each held
    against all documents, whose texts are never shuffled. Other columns are not read.
    """
    docs = bounded(docs)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, begin long, end long, edits int"
    out = None
    for shared in _blocks(benchmark, item_col, item_text):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                buf, offsets = tokens.utf8(batch.column(1))
                rows: list[list] = [[], [], [], [], []]
                for lo, hi in tokens.blocks(offsets):
                    part = offsets[lo : hi + 1]
                    own = buf[part[0] : part[-1]]
                    for d, item, begin, end, edits in index.search(own, part - part[0]):
                        start = int(part[d] - part[0])
                        before = len(own[start:begin].tobytes().decode(errors="replace"))
                        length = len(own[begin:end].tobytes().decode(errors="replace"))
                        for column, x in zip(rows, (lo + d, item, before, before + length, edits), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int32())], names=["doc_id", "item_id", "begin", "end", "edits"])

        found = source.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all of their columns, whose text holds no passage in the sense of find_leaks.

    Each row is judged where it lies: no id is joined, so rows that repeat an id or have none are judged each by its own text.
    Null texts stay.
    """
    docs = bounded(docs)
    names = docs.columns
    for shared in _blocks(benchmark, item_col, item_text):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                buf, offsets = tokens.utf8(batch.column(0))
                good = np.ones(batch.num_rows, bool)
                for lo, hi in tokens.blocks(offsets):
                    part = offsets[lo : hi + 1]
                    for d, *_ in index.search(buf[part[0] : part[-1]], part - part[0]):
                        good[lo + d] = False
                yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(good))], names=["row"])

        source = docs.select(F.col(text_col).alias("text"), *whole_rows(docs, True))
        docs = source.mapInArrow(clean, T.StructType([source.schema["row"]])).select("row.*")
    return docs.toDF(*names)
