"""Words and word hashes of whole Arrow batches, by numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: \x20 and \x09-\x0D, which end a word.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: By number of bytes (8 at most): the mask that keeps them in a little-endian block.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def regrouped(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about `most` bytes of the text column."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends (bytes in buf) and, for each text, its first word (one entry more than texts)."""
    inside = ~BLANK[buf]
    n = len(buf)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U), starts, ends, first
    return hashes(LOWER[buf] if lower else buf, starts, ends), starts, ends, first


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: its blocks of 8 bytes are mixed each, with their place and the word's length, before they are
    summed; so no two different words share a hash but by chance (a polynomial modulo 2**64 would let some)."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), np.dtype("<u8"), padded, strides=(1,))  # the 8 bytes from each byte on
    lens = ends - starts
    out = mix((eight[starts] & _MASKS[np.minimum(lens, 8)]) ^ lens.astype(U) * U(_BASE))
    long = np.flatnonzero(lens > 8)
    if len(long):
        more = (lens[long] - 1) // 8
        at = np.cumsum(more) - more
        block = np.arange(int(more.sum())) - np.repeat(at, more) + 1
        left = np.repeat(lens[long], more) - 8 * block
        own = eight[np.repeat(starts[long], more) + 8 * block] & _MASKS[np.minimum(left, 8)]
        out[long] = mix(out[long] + np.add.reduceat(mix(own ^ block.astype(U) * U(0xD6E8FEB86659FD93)), at))
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive hashes, modulo 2**64 (empty if fewer)."""
    if len(h) < k:
        return np.zeros(0, U)
    out, width, step, span = np.zeros(len(h) - k + 1, U), 0, h, 1
    while True:  # by doubling: windows of 1, 2, 4, ... put together to k
        if k & span:
            part = step[width : width + len(out)]
            out = out * U(pow(_BASE, span, 1 << 64)) + part
            width += span
        if span * 2 > k:
            return mix(out)
        step = step[:-span] * U(pow(_BASE, span, 1 << 64)) + step[span:]
        span *= 2


def window_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of k words that stay in one text: their first words, their texts and their starts within the text."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + start, doc, start
