"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import NULL_ID, bounded, id_key, several_texts

CHUNK_WORDS = 2_000_000
#: Hash ranges that a task deals its windows to, at most: beyond, rows would hold few windows each. Where more are needed, each
#: range is dealt out again, to SPLIT finer ones.
MOST_BUCKETS, SPLIT = 1 << 14, 1 << 8
_SENT = "bucket int, payload binary, hits binary"
_HITS = pa.schema([("group", pa.int32()), ("hits", pa.binary())])


def pack(rising: np.ndarray) -> bytes:
    """A rising array as byte planes of its differences; planes of zeros at the top are left out."""
    rising = rising.astype(np.uint64)
    steps = np.diff(rising, prepend=np.zeros(1, np.uint64))
    return planes(steps)


def planes(values: np.ndarray) -> bytes:
    values = values.astype(np.uint64)
    n = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return len(values).to_bytes(4, "little") + bytes([n]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplanes(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    size, n = int.from_bytes(data[at : at + 4], "little"), data[at + 4]
    out = np.zeros((size, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8, size * n, at + 5).reshape(n, size).T
    return out.reshape(-1).view(np.uint64), at + 5 + size * n


def pack_docs(ids: np.ndarray, subs: np.ndarray) -> bytes:
    """Documents (id, sub) in the order of their ids."""
    return planes(np.diff(ids.astype(np.uint64), prepend=np.zeros(1, np.uint64))) + planes(subs)


def unpack_docs(data: memoryview, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    ids, at = unplanes(data, at)
    subs, at = unplanes(data, at)
    return np.cumsum(ids, dtype=np.uint64).astype(np.int64), subs, at


def changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def pack_hits(doc: np.ndarray, sub: np.ndarray, start: np.ndarray) -> bytes:
    """Places (document, start) in their order."""
    order = np.lexsort((start, sub, doc))
    doc, sub, start = doc[order], sub[order], start[order]
    first = np.flatnonzero(changes(doc, sub))
    return pack_docs(doc[first], sub[first]) + planes(np.diff(np.append(first, len(doc)))) + planes(start)


def unpack_hits(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, subs, at = unpack_docs(data, 0)
    count, at = unplanes(data, at)
    start, _ = unplanes(data, at)
    count = count.astype(np.int64)
    return np.repeat(ids, count), np.repeat(subs, count), start.astype(np.int64)


def repeats(h: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of windows in any order: those that stand later than the first place of the same hash."""
    by = np.argsort(h, kind="stable")
    same = h[by][1:] == h[by][:-1]
    by = by[np.r_[same, False] | np.r_[False, same]] if len(by) else by
    if not len(by):
        return by
    by = by[np.lexsort((start[by], sub[by], doc[by], h[by]))]
    new = changes(h[by])
    lead = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    return by[(doc[by] != doc[lead]) | (sub[by] != sub[lead]) | (start[by] != start[lead])]  # rows that repeat a document have the same place


def pack_windows(h: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray) -> bytes:
    """Windows in rising order of their hashes, and only the documents that they stand in."""
    by = np.lexsort((sub, doc))
    new = changes(doc[by], sub[by])
    number = np.empty(len(h), np.int64)
    number[by] = np.cumsum(new) - 1
    first = by[new]
    return pack(h) + planes(number) + planes(start) + pack_docs(doc[first], sub[first])


def unpack_windows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    steps, at = unplanes(data, 0)
    number, at = unplanes(data, at)
    start, at = unplanes(data, at)
    ids, subs, _ = unpack_docs(data, at)
    number = number.astype(np.int64)
    return np.cumsum(steps, dtype=np.uint64), ids[number], subs[number], start.astype(np.int64)


def _rows(h: np.ndarray, doc: np.ndarray, sub: np.ndarray, start: np.ndarray, buckets: int) -> pa.RecordBatch:
    """What a task sends of its windows: one row a hash range with the first place of each hash, and one with all other places."""
    later = repeats(h, doc, sub, start)
    by = np.lexsort((start, sub, doc, h))
    keep = by[changes(h[by])]
    bucket = (h[keep] >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(keep), np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    parts = np.split(keep, cut) if len(keep) else []
    rows = [[int(bucket[i]) for i in np.r_[0, cut]] if len(keep) else [], [pack_windows(h[x], doc[x], sub[x], start[x]) for x in parts], [None] * len(parts)]
    if len(later):
        for column, x in zip(rows, (int(doc[later[0]]) % buckets, None, pack_hits(doc[later], sub[later], start[later])), strict=True):
            column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["bucket", "payload", "hits"])


def _split(buckets: int):
    """Rows of one partition, sorted by hash range, go on in finer ranges: CHUNK_WORDS windows of a range at a time."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for bucket, payload, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if payload is None:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([None], pa.binary()), pa.array([hits], pa.binary())], names=["bucket", "payload", "hits"])
                    continue
                if held and (bucket != now or size >= CHUNK_WORDS):
                    yield _rows(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
                    held, size = [], 0
                now = bucket
                held.append(unpack_windows(payload))
                size += len(held[-1][0])
        if held:
            yield _rows(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)

    return split


def _sender(width: int, buckets: int):
    def flush(held: list) -> pa.RecordBatch:
        ids, subs, count, h = (np.concatenate([x[i] for x in held]) for i in range(4))
        start = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        return _rows(h, np.repeat(ids, count), np.repeat(subs, count), start, buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            buf, offsets = tokens.utf8(batch.column(2))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            subs = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi in tokens.blocks(offsets):
                part = offsets[lo : hi + 1]
                h, _, _, first = tokens.words(buf[part[0] : part[-1]], part - part[0], lower=False)
                rows, doc, _ = tokens.window_rows(first, width)
                count = np.bincount(doc, minlength=hi - lo)
                some = count > 0
                held.append((ids[lo:hi][some], subs[lo:hi][some], count[some], tokens.rolling(h, width)[rows]))
                size += len(rows)
                if size >= CHUNK_WORDS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return send


def _judge(groups: int):
    """Rows of one partition, sorted by bucket: all places of a window but the first are repeats. They go on by document
    group, packed, so that a document's places do not become a row for every bucket."""

    def judged(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, doc, sub, start = (np.concatenate(x) for x in zip(*map(unpack_windows, held), strict=True))
        later = repeats(h, doc, sub, start)
        return doc[later], sub[later], start[later]

    def out(found: list) -> pa.RecordBatch:
        doc, sub, start = (np.concatenate([x[i] for x in found]) for i in range(3))
        group = (tokens.mix(doc.view(np.uint64) ^ sub) % np.uint64(groups)).astype(np.int32)
        by = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.diff(group[by])) + 1
        parts = np.split(by, cut) if len(by) else []
        return pa.RecordBatch.from_arrays([pa.array([group[x[0]] for x in parts], pa.int32()), pa.array([pack_hits(doc[x], sub[x], start[x]) for x in parts], pa.binary())], schema=_HITS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, size = None, [], [], 0
        for batch in batches:
            for bucket, payload, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if payload is None:
                    found.append(unpack_hits(hits))
                    size += len(found[-1][0])
                else:
                    if bucket != now and held:
                        found.append(judged(held))
                        size += len(found[-1][0])
                        held = []
                    now = bucket
                    held.append(payload)
                if size >= CHUNK_WORDS:
                    yield out(found)
                    found, size = [], 0
        if held:
            found.append(judged(held))
        if found:
            yield out(found)

    return judge


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted by group: one row a document, with all of its places."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        doc, sub, start = (np.concatenate(x) for x in zip(*map(unpack_hits, held), strict=True))
        by = np.lexsort((sub, doc))
        doc, sub, start = doc[by], sub[by], start[by]
        first = np.flatnonzero(changes(doc, sub))
        parts = np.split(start, first[1:])
        return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), pa.array(sub[first].view(np.int64)), pa.array([planes(x) for x in parts], pa.binary())], names=["doc", "of", "starts"])

    for batch in batches:
        for group, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if group != now and held:
                yield out()
                held = []
            now = group
            held.append(hits)
    if held:
        yield out()


def _spans(starts: bytes, width: int, n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The words that stay, and the maximal intervals of those that go."""
    edge = np.zeros(n + 1, np.int32)
    s = unplanes(starts, 0)[0].astype(np.int64)
    s = np.unique(s[s + width <= n])
    np.add.at(edge, s, 1)
    np.add.at(edge, s + width, -1)
    gone = np.cumsum(edge)[:n] > 0
    step = np.diff(np.r_[0, gone.view(np.int8), 0])
    return ~gone, list(zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True))


def dedup_substrings(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes the words of every window of `width` words that also starts earlier (smaller id, or same id and smaller start).

    Returns doc_id, n_words, n_removed, spans (array of [begin, end) words removed, maximal) and kept_text (the words
    that stay, joined by one space) for every input row. A null text is an empty one; a text of fewer than `width`
    words loses nothing; a null id sorts first. Rows that repeat an id and its text are one document and get the same
    result; rows of one id with different texts are different documents, in the order of their texts' hashes. Columns
    other than the two named are not read.

    Each task hashes the windows of about 2 M words, keeps the first place of each hash and sends one packed row a hash
    range, with the documents of its own windows only (10 to 13 bytes a window, however many ranges there are); so a window that stands in a third of all documents arrives once a chunk, not once a document.
    """
    docs = bounded(docs)
    source = docs.select(id_key(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
    # texts are told apart by their hash where an id has several; a null id may have any number
    several = several_texts(source, "__id", "__hash")
    told = F.col("__id") == NULL_ID
    if several is not None:
        source = source.join(several, "__id", "left")
        told = told | F.col("__several").isNotNull()
    source = source.select("__id", F.when(told, F.col("__hash")).otherwise(F.lit(0)).cast("long").alias("__sub"), "__text")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = 1 << max(4, (size // (6 << 20)).bit_length())
    parts = max(1, min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    coarse = buckets if buckets <= MOST_BUCKETS else max(1, buckets // SPLIT)
    sent = source.mapInArrow(_sender(width, coarse), _SENT)
    if coarse < buckets:
        sent = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_split(buckets), _SENT)
    judged = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_judge(buckets), "group int, hits binary")
    hits = judged.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_gather, "doc long, of long, starts binary")
    joined = source.join(hits, (F.col("__id") == F.col("doc")) & (F.col("__sub") == F.col("of")), "left").select("__id", "__text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tokens.utf8(batch.column(1))
            whole = buf.tobytes()
            n, gone, spans, kept = [], [], [], []
            starts = batch.column(2)
            for i in range(batch.num_rows):
                own = whole[offsets[i] : offsets[i + 1]].split()
                n.append(len(own))
                places: list = []
                if starts[i].is_valid:
                    stay, places = _spans(starts[i].as_py(), width, len(own))
                    own = [own[k] for k in np.flatnonzero(stay)]
                gone.append(n[-1] - len(own))
                spans.append([{"begin": a, "end": b} for a, b in places])
                kept.append(b" ".join(own).decode())
            of = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, of), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    out = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<begin: long, end: long>>, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")))
