"""Keyed state of streams by transformWithState: a response cache with expiry and a threshold counter, in event-time order."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt out to this many buckets, whose states are read and written as a whole; a checkpoint is bound to the number.
BUCKETS = 1024
#: Rows of a whole stream that a partition of its state is meant for.
PARTITION_ROWS = 100_000
#: Waiting rows that one element of a list state holds.
PIECE = 4096


class InOrder(StatefulProcessor):
    """Rows of a bucket of keys wait in a list state until the watermark has passed them, and each key's are then taken in the order
    of (ts, event_id): files may arrive in any order within the delay, and the outcome is that of a batch. One timer a bucket, for
    what is due first. A call of the state store costs much more than a row, so there are a few of them a bucket, not a key."""

    #: What is held of a key, as columns beside it.
    held: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key array<string>, ts array<long>, event_id array<long>")
        self.timer = handle.getValueState("timer", "at long")
        self.state = handle.getListState("held", f"key string, {self.held}")

    def fold(self, key: str | None, rows: list[tuple[int, int]], held: tuple | None, out: list) -> tuple | None:
        """Takes a key's rows (ts in microseconds, event_id) in their order, adds what they give to out; what is then held of the key."""
        raise NotImplementedError

    def due(self, held: tuple) -> int | None:
        """The watermark in milliseconds at which what is held of a key can go."""
        return None

    def _wait(self, at: int) -> None:
        """One timer, at `at` milliseconds or where an earlier one stands."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and old <= at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in rows:
            micros = pdf["ts"].to_numpy("datetime64[us]").astype("int64")
            named = pdf["key"].astype(object).where(pdf["key"].notna(), None)
            new = list(zip(named.tolist(), micros.tolist(), pdf["event_id"].tolist(), strict=True))
            self.waiting.appendList(_pieces(new))
            least = int(micros.min()) if least is None else min(least, int(micros.min()))
        if least is not None:
            self._wait(least // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        ready: dict[str | None, list[tuple[int, int]]] = {}
        later, least = [], None
        for piece in self.waiting.get():
            for name, ts, event in zip(*piece, strict=True):
                if ts // 1000 + 1 <= now:
                    ready.setdefault(name, []).append((ts, event))
                else:
                    later.append((name, ts, event))
                    least = ts // 1000 + 1 if least is None else min(least, ts // 1000 + 1)
        if later:
            self.waiting.put(_pieces(later))
        else:
            self.waiting.clear()
        held, out = {r[0]: tuple(r[1:]) for r in self.state.get()}, []
        for name, rows in ready.items():
            held[name] = self.fold(name, sorted(rows), held.get(name), out)
        gone = {name: self.due(x) for name, x in held.items() if x is not None}
        left = [(name, *held[name]) for name, at in gone.items() if at is None or at > now]
        if left:
            self.state.put(left)
        else:
            self.state.clear()
        least = min([at for at in gone.values() if at is not None and at > now] + [least] * (least is not None), default=None)
        if least is not None:
            self._wait(least)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in self.schema.split(", ")])

    def close(self) -> None:
        pass


def _pieces(rows: list[tuple]) -> list[tuple]:
    """Rows as elements of a list state: the columns of PIECE rows each."""
    return [tuple(map(list, zip(*rows[at : at + PIECE], strict=True))) for at in range(0, len(rows), PIECE)]


class ResponseCache(InOrder):
    """An entry lives ttl seconds from the miss that made it; a hit doesn't renew it. A timer drops it when it has expired."""

    schema = "key string, event_id long, hit boolean"
    held = "made long"

    def __init__(self, ttl: int) -> None:
        self.live = ttl * 1_000_000

    def fold(self, key: str | None, rows: list[tuple[int, int]], held: tuple | None, out: list) -> tuple | None:
        made = held[0] if held else None
        for ts, event in rows:
            hit = made is not None and ts - made < self.live
            made = made if hit else ts
            out.append((key, event, hit))
        return (made,)

    def due(self, held: tuple) -> int | None:
        return (held[0] + self.live) // 1000 + 1


class ThresholdCounter(InOrder):
    """Collects a key's events until there are `every`, gives the group with its number, and begins anew."""

    schema = "key string, event_id long, firing long, members array<long>"
    held = "fired long, members array<long>"

    def __init__(self, every: int) -> None:
        self.every = every

    def fold(self, key: str | None, rows: list[tuple[int, int]], held: tuple | None, out: list) -> tuple | None:
        firing, members = (held[0], list(held[1])) if held else (0, [])
        for _, event in rows:
            members.append(event)
            if len(members) == self.every:
                firing += 1
                out.append((key, event, firing, members))
                members = []
        return firing, members


def _keyed(events: DataFrame, processor: InOrder, delay: str) -> DataFrame:
    key = F.col("key").cast("string")
    rows = events.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), key.alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return rows.withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(processor, processor.schema, "Append", "EventTime")


def cache_stream(requests: DataFrame, ttl: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Whether each request (key, ts, event_id) of a stream finds its answer, as cache_outcomes() has it for a batch. Rows may come
    up to `delay` late; an outcome appears once the watermark has passed its request."""
    return _keyed(requests, ResponseCache(ttl), delay)


def threshold_stream(events: DataFrame, every: int = 10, delay: str = "1 hour") -> DataFrame:
    """The event (key, ts, event_id) of a stream that completes each group of `every` of its key, with the group's number and members."""
    return _keyed(events, ThresholdCounter(every), delay)


def partitions_for(rows: int, cores: int, most: int) -> int:
    """Partitions of keyed state for so many rows: one a core, or one for PARTITION_ROWS rows, `most` at most. Each opens and commits
    its state store in every batch, which takes longer than thousands of rows."""
    return max(1, min(most, max(cores, -(-rows // PARTITION_ROWS))))


def run_available(spark: SparkSession, source: Callable[[SparkSession], DataFrame], build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, partitions: int | None = None, idle: bool = True) -> None:
    """Streams what the source holds now through build() into Parquet files at out, and ends; called again with the same
    checkpoint it goes on where it stopped, with the state it had. partitions: of the state, the session's if not given; a checkpoint
    keeps its first number. Without idle, what the last rows make due waits for the next run."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    build(source(own)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def replay(table: DataFrame, build: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """A batch's events (key, ts, event_id) through a stream: `parts` folders by time, in which every 13th event comes half a day late,
    and one row of a far future that lets the watermark pass them all. Each is one batch and one run, which takes up the
    checkpoint of the run before."""
    spark = table.sparkSession
    at = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows = table.select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    lo, hi, many = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count("*")).first()
    if lo is None:
        return spark.createDataFrame([], build(rows).schema)
    late = F.when(F.col("event_id") % 13 == 0, 43_200_000_000).otherwise(0)
    part = F.least(F.lit(parts - 1), F.floor((F.unix_micros("ts") + late - lo) * parts / F.lit(hi - lo + 1))).cast("int")
    rows = rows.withColumn("part", part)
    schema = rows.drop("part").schema
    source = lambda s: s.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/in")
    partitions = partitions_for(many, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(parts):
        rows.where(F.col("part") == k).drop("part").write.parquet(f"{at}/in/{k}")
        run_available(spark, source, build, f"{at}/out", f"{at}/checkpoint", partitions, idle=False)
    end = rows.limit(1).select(F.col("key"), F.timestamp_micros(F.lit(hi + 10**15)).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    end.coalesce(1).write.parquet(f"{at}/in/{parts}")
    run_available(spark, source, build, f"{at}/out", f"{at}/checkpoint", partitions)
    return spark.read.parquet(f"{at}/out").where("event_id >= 0")


def autosaver(path: str, save: Callable[[DataFrame, int], None], every: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that calls save(batch, total) when the number of rows so far reaches another `every`.

    Each batch's count is written under its id at path, so a batch that is run again counts once, and a restarted stream goes
    on with the counts of the batches before."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.agg(F.count("*").alias("n")).withColumn("batch_id", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{number}")
        counts = spark.read.schema("n long, batch_id long").option("recursiveFileLookup", True).parquet(path)
        before, now = counts.agg(F.coalesce(F.sum(F.when(F.col("batch_id") < number, F.col("n"))), F.lit(0)), F.sum(F.when(F.col("batch_id") <= number, F.col("n")))).first()
        if now // every > before // every:
            save(df, now)

    return batch


def autosaved(table: DataFrame, part: str, parts: int, every: int = 100) -> DataFrame:
    """Streams a table in `parts` files, in the order of the expression `part`, through an autosaver; (total, rows) of each save."""
    spark = table.sparkSession
    at = f"{shared_folder(spark)}/autosave-{uuid.uuid4().hex}"
    for k in range(parts):
        table.where(f"({part}) = {k}").coalesce(1).write.parquet(f"{at}/in/{k}")

    def save(df: DataFrame, total: int) -> None:
        df.agg(F.lit(total).cast("long").alias("total"), F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{at}/saved/{total}")

    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{at}/in")
    stream.writeStream.foreachBatch(autosaver(f"{at}/counts", save, every)).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("total long, rows long").option("recursiveFileLookup", True).parquet(f"{at}/saved")
