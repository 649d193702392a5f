"""Incremental work: file ingest, a response cache with expiry, threshold triggers, request-rate windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.chunking import Chunker, chunk_documents


def ingest_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, chunker: Chunker | None = None, embed: Callable | None = None):
    """Watches a folder of text files; every new file is chunked once and appended (exactly once a batch, by batch id)."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunk_documents(batch, chunker, "file_name")
        if embed:
            chunks = chunks.withColumn("embedding", embed(F.col("text")))
        chunks.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_outcomes(requests: DataFrame, ttl: int = 3600) -> DataFrame:
    """Whether each request (key, ts, event_id) finds its answer: an entry lives ttl seconds from the miss that made it.

    Per key a fold over time, since a hit does not renew the entry. Rows stream through each task in the order of key and
    time, so a key of any size takes the memory of a batch; from one miss to the next the fold goes by one search."""
    live = ttl * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = object(), None
        for pdf in batches:
            t, keys = pdf["ts"].to_numpy("datetime64[us]").astype("int64"), pdf["key"].to_numpy(object)
            hit = np.zeros(len(pdf), bool)
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(pdf) else np.zeros(0, int)
            for a, b in zip(cut, np.r_[cut[1:], len(pdf)], strict=False):
                if keys[a] != now:
                    now, made = keys[a], None
                at = a
                while at < b:
                    if made is None:  # the key's first request
                        made, at = t[at], at + 1
                        continue
                    end = max(at, a + int(np.searchsorted(t[a:b], made + live)))
                    hit[at:end] = True
                    if end < b:
                        made = t[end]
                    at = end + 1
            yield pdf.assign(hit=hit)

    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = requests.select("key", "ts", "event_id").repartition(n, "key").sortWithinPartitions("key", "ts", "event_id")
    return rows.mapInPandas(run, "key string, ts timestamp, event_id long, hit boolean")


def evictions(entries: DataFrame, most: int = 100) -> DataFrame:
    """Entries (key, made) that stay when the oldest-made over `most` are evicted."""
    return entries.orderBy(F.desc("made"), "key").limit(most)


def trigger_points(counts: DataFrame, every: int = 10, by: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events that complete a group of `every` for their key, and how many such groups there have been."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return counts.withColumn("seen", n).where(F.col("seen") % every == 0).withColumn("firing", (F.col("seen") / every).cast("long"))


def sliding_requests(events: DataFrame, by: str, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """For each request how many its key made in the `seconds` up to it, itself included."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("recent", F.count("*").over(w))


def rate_windows(events: DataFrame, width: str = "60 seconds", slide: str | None = None, limit: int = 96, watermark: str = "5 minutes") -> DataFrame:
    """Requests a window of event time, and whether they pass the limit; works on batches and on streams."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    return source.groupBy(F.window("ts", width, slide or width).alias("w")).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", (F.col("requests") > limit).alias("over"))


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    return source.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")

