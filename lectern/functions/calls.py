"""Bounded calls to a service: batches of texts, retries with back-off, and a limit of the calls a second for the whole job."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import shared_folder

#: Bytes of texts that a task is given at a time, about.
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Limits:
    """batch: texts a call; attempts: calls of a batch before it is given up; pause: seconds before the second attempt, doubled
    before each further one; rate: calls a second of all tasks together (None: as many as there can be); tasks: calls at a time."""

    batch: int = 100
    attempts: int = 3
    pause: float = 1.0
    rate: float | None = None
    tasks: int = 8


class Bucket:
    """Tokens that fill up with time, one at most: take() waits until there is one."""

    def __init__(self, rate: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.every, self.clock, self.sleep, self.next = 1 / rate if rate else 0.0, clock, sleep, 0.0

    def take(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.every


def attempt(call: Callable[[list], list], texts: list, limits: Limits, bucket: Bucket, sleep: Callable[[float], None] = time.sleep) -> tuple[list, int, str | None]:
    """(answers, attempts made, the last error): answers are null if every attempt failed or gave another number of answers."""
    error = None
    for n in range(1, limits.attempts + 1):
        bucket.take()
        try:
            answers = list(call(texts))
            if len(answers) == len(texts):
                return answers, n, None
            error = f"{len(answers)} answers to {len(texts)} texts"
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        if n < limits.attempts:
            sleep(limits.pause * 2 ** (n - 1))
    return [None] * len(texts), limits.attempts, error


def call_service(rows: DataFrame, text: str, call: Callable[[list], list], kind: str = "string", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """rows with answer (of type `kind`), attempts and error. Each of `tasks` tasks makes its share of the calls a second, so
    that all keep to the rate, and holds one batch at a time; null texts aren't sent and get null. A task that is run again asks again.

    Texts of more than TASK_BYTES a task are called for here, in rounds of `tasks` tasks one after another: the rows are dealt out
    to the rounds by one write, and each round's answers are written to the shared folder."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, answer {kind}, attempts int, error string"
    share = limits.rate / limits.tasks if limits.rate else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Bucket(share)
        for pdf in frames:
            for at in range(0, len(pdf), limits.batch):
                part = pdf.iloc[at : at + limits.batch]
                sent = part[text].notna().to_numpy()
                answers, tried, error = attempt(call, part[text][sent].tolist(), limits, bucket) if sent.any() else ([], 0, None)
                given = iter(answers)
                yield part.assign(answer=[next(given) if s else None for s in sent], attempts=[tried if s else 0 for s in sent], error=[error if s else None for s in sent])

    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rounds = -(-size // (TASK_BYTES * limits.tasks))
    if rounds <= 1:
        return rows.repartition(limits.tasks).mapInPandas(run, schema)
    spark, at = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/calls-{uuid.uuid4().hex}"
    rows.withColumn("__round", F.floor(F.rand(1) * rounds).cast("int")).write.partitionBy("__round").parquet(f"{at}/in")
    for k in range(rounds):
        part = spark.read.parquet(f"{at}/in").where(F.col("__round") == k).drop("__round")  # a folder a round
        part.repartition(limits.tasks).mapInPandas(run, schema).write.parquet(f"{at}/out/{k}")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/out")
