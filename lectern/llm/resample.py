"""Target-distribution importance resampling: hashed word features counted by a vectorised byte automaton."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import bounded, stage

#: Buckets of features.
BUCKETS = 10_000
#: Bytes of text that one step of the automaton takes, about.
BLOCK = 1 << 20
#: A word above this many bytes is summed by itself, so that one long word doesn't set the number of steps for all.
LONG_WORD = 64
#: By byte: whether it belongs to a word (0-9, A-Z, a-z, and all bytes of characters beyond ASCII).
WORD = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD[_a:_b] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in buf, and the first word of each text (one entry more than texts). A byte's class is
    looked up; words begin and end where the class differs from that of the byte before, or a text does."""
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[:-1] = WORD[buf]
    step = np.diff(inside, prepend=np.int8(0))
    full = offsets[1:] > offsets[:-1]
    edge = offsets[:-1][full]  # a text's first byte: a word there begins anew
    edge = edge[(edge > 0)]
    split = edge[(inside[edge] == 1) & (inside[edge - 1] == 1)]
    starts = np.sort(np.concatenate([np.flatnonzero(step == 1), split]))
    ends = np.sort(np.concatenate([np.flatnonzero(step == -1), split]))
    return starts, ends, np.searchsorted(starts, offsets)


def crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes: one table step for all stretches at a time, the ended ones dropping out."""
    lens = ends - starts
    by = np.argsort(-lens, kind="stable")
    long = int(np.searchsorted(-lens[by], -LONG_WORD, "left"))
    out = np.empty(len(starts), np.uint32)
    for i in by[:long]:
        out[i] = zlib.crc32(buf[starts[i] : ends[i]])
    by = by[long:]
    at, n = starts[by], lens[by]
    alive = np.searchsorted(-n, -np.arange(1, (int(n[0]) if len(n) else 0) + 1), "right")  # how many are at least so long
    state = np.full(len(by), 0xFFFFFFFF, np.uint32)
    for k, m in enumerate(alive):
        own = state[:m]
        state[:m] = CRC[(own ^ buf[at[:m] + k]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    out[by] = ~state
    return out


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of texts (lo, hi): the bucket of each word and the first word of each text."""
    buf, offsets = tokens.utf8(column)
    for lo, hi in tokens.blocks(offsets, BLOCK):
        part = offsets[lo : hi + 1]
        own = tokens.LOWER[buf[part[0] : part[-1]]]
        starts, ends, first = word_bounds(own, part - part[0])
        yield lo, hi, (crcs(own, starts, ends) % np.uint32(BUCKETS)).astype(np.int64), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket that the task has met."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, bucket, _ in _blocks(batch.column(0)):
            total += np.bincount(bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket's features stand in all texts."""
    found = bounded(texts).select(F.col(text_col).cast("string").alias("t")).mapInArrow(_count, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    s, t = float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s + BUCKETS) / ((source + 1.0) * (t + BUCKETS)))).astype(np.int64)


def _weigh(gain: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, bucket, first in _blocks(batch.column(1)):
                n[lo:hi] = np.diff(first)
                weight[lo:hi] = np.diff(np.concatenate([[0], np.cumsum(gain[bucket])])[first])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return weigh


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row in its partition, from 1."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(n + 1, n + 1 + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Draws floor(percent * N / 100) of the N documents of at least `least_words` words so that their words look like target's.

    Gumbel top-k over importance weights: a document's weight is the sum of its words' bucket gains, its score that weight
    plus Gumbel noise that only the seed and the id decide. Returns doc_id, n_features, weight, score and rank (1 for the
    highest score; null if not drawn) for every row. A null text has no words; a null id (its noise is that of `seed:`) comes
    after equal scores of others; rows that repeat an id take a rank each, longer ones first. An empty target has gains like
    any other; no documents, no rows. Columns other than those named are not read.

    The ranks come from one sort by ranges: each task numbers its rows, and the counts of the ranges before are added.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(counts(docs, text_col), counts(target, target_col))
    rows = bounded(source).mapInArrow(_weigh(gain), "doc_id long, n_features long, weight long")
    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = stage(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))), "weights")
    good = rows.where(F.col("n_features") >= least_words)
    draw = good.count() * percent // 100
    # the last key parts rows that repeat a document, so that no range has to hold them all
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight"), F.asc("salt")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = good.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = stage(sorted_rows.drop("salt").mapInArrow(_number, "doc_id long, n_features long, weight long, score long, part int, place long"), "numbered")
    before, skip = 0, []
    for r in numbered.groupBy("part").count().orderBy("part").collect():  # a row a partition
        skip.append((r["part"], before))
        before += r["count"]
    skipped = F.broadcast(docs.sparkSession.createDataFrame(skip, "part int, skip long"))
    rank = F.col("place") + F.col("skip")
    ranked = numbered.join(skipped, "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))
    return ranked.unionByName(rows.where(F.col("n_features") < least_words).withColumn("rank", F.lit(None).cast("long")))
