"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import tokens
from lectern.llm.common import bounded, small, stage, whole_rows

TOPICS = 8
#: Rounds in which topics are learned, places that long words are hashed to, and the count that each place starts with.
ROUNDS, PLACES, PRIOR = 3, 4096, 0.5
#: Words of fewer bytes say little of a topic.
LONG_WORD = 6
#: Cells of (source, language, topic) that are raked on the driver; more are raked by Spark.
DRIVER_CELLS = 1 << 17
#: Part of all tokens that the sample is to hold.
BUDGET = 0.6
#: Default targets: shares of tokens to these powers, normalised.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.5}
#: Stands for a null source or language.
NONE = "∅"
SWEEPS, TOLERANCE = 100, 1e-9


def _long_words(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks of texts: their number, words of each, and of the long words the text, the place and the hash."""
    buf, offsets = tokens.utf8(batch.column(column))
    for lo, hi in tokens.blocks(offsets):
        part = offsets[lo : hi + 1]
        h, starts, ends, first = tokens.words(buf[part[0] : part[-1]], part - part[0], lower=True)
        long = ends - starts >= LONG_WORD
        doc = np.repeat(np.arange(hi - lo), np.diff(first))[long]
        yield hi - lo, np.diff(first), doc, (h[long] % np.uint64(PLACES)).astype(np.int32), h[long]


def topic_of(model: np.ndarray | None, n: int, doc: np.ndarray, place: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The likeliest topic of each of n texts, -1 without long words. model: ln p(place | topic), and ln p(topic) in the last
    row; without a model, the one of TOPICS parts of all words (by hash) with most of the text's long words."""
    if model is None:
        score = np.bincount(doc * TOPICS + (h >> np.uint64(32)).astype(np.int64) % TOPICS, minlength=n * TOPICS).reshape(n, TOPICS).astype(float)
    else:
        score = np.tile(model[-1], (n, 1))
        some, at = np.unique(doc, return_index=True)
        if len(some):
            score[some] += np.add.reduceat(model[place], at, axis=0)
    return np.where(np.bincount(doc, minlength=n) > 0, score.argmax(axis=1), -1)


def _count(model: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((PLACES + 1, TOPICS), np.int64)
    for batch in batches:
        for n, _, doc, place, h in _long_words(batch, 0):
            topic = topic_of(model, n, doc, place, h)
            np.add.at(counts[-1], topic[topic >= 0], 1)
            counts[:-1] += np.bincount(place.astype(np.int64) * TOPICS + topic[doc], minlength=PLACES * TOPICS).reshape(PLACES, TOPICS)
    some = np.flatnonzero(counts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c) for c in counts[some].T)], names=["place", *(f"k{i}" for i in range(TOPICS))])


def learn_topics(texts: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """A mixture of unigrams over the long words of all texts, by classification EM: each round gives every text its likeliest
    topic and counts the words of each (integers, so the model doesn't depend on the partitioning). The counts, PLACES + 1
    rows, come to the driver. None if there are no long words."""
    names = [f"k{i}" for i in range(TOPICS)]
    model = None
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(model)
        rows = texts.mapInArrow(lambda batches, shared=shared: _count(shared.value, batches), "place int, " + ", ".join(f"{k} long" for k in names))
        rows = rows.groupBy("place").agg(*[F.sum(k).alias(k) for k in names]).toArrow()
        shared.destroy()
        if not rows.num_rows:
            return None
        counts = np.zeros((PLACES + 1, TOPICS))
        counts[rows["place"].to_numpy()] = np.stack([rows[k].to_numpy() for k in names], 1)
        words, docs = counts[:-1] + PRIOR, counts[-1] + 1
        model = np.vstack([np.log(words / words.sum(axis=0)), np.log(docs / docs.sum())])
    return model


def _topics(shared):
    def topics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, topic = [], []
            for n, words, doc, place, h in _long_words(batch, 1):
                count += words.tolist()
                topic += topic_of(shared.value, n, doc, place, h).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(topic, pa.int32()), *batch.columns[2:]], names=["__id", "tokens", "topic", *batch.schema.names[2:]])

    return topics


def rake(cells: np.ndarray, mass: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Weights of cells whose weighted mass meets each dimension's target shares (as near as empty cells let it)."""
    w, total = np.ones(len(mass)), mass.sum()
    for _ in range(SWEEPS):
        off = 0.0
        for dim, target in enumerate(targets):
            now = np.bincount(cells[:, dim], w * mass, len(target)) / total
            ratio = np.divide(target, now, out=np.ones_like(target), where=now > 0)
            off = max(off, float(np.abs(now - target)[now > 0].max(initial=0)))
            w *= ratio[cells[:, dim]]
        if off < TOLERANCE:
            break
    return w / ((w * mass).sum() / total)


def calibrate(weight: np.ndarray, mass: np.ndarray, budget: float) -> float:
    """The factor c for which the expected mass of probabilities min(1, c * weight) is budget of all."""
    goal, c = budget * mass.sum(), budget
    for _ in range(60):
        full = c * weight >= 1
        free = float((weight * mass)[~full].sum())
        if free <= 0:
            break
        new = (goal - float(mass[full].sum())) / free
        if abs(new - c) <= 1e-12 * c:
            break
        c = new
    return c


def _targets(names: list, mass: dict, power: float, given: dict | None) -> np.ndarray:
    share = np.array([given.get(x, 0.0) if given else mass[x] ** power for x in names], float)
    return share / share.sum() if share.sum() > 0 else np.full(len(names), 1 / max(1, len(names)))


def _rake_on_driver(cells: DataFrame, targets: dict, budget: float) -> DataFrame:
    rows = sorted(map(tuple, cells.collect()))  # at most DRIVER_CELLS
    mass = np.array([r[3] for r in rows], float)
    codes, goals = [], []
    for dim, name in enumerate(("source", "lang", "topic")):
        names = sorted({r[dim] for r in rows})
        at = {x: i for i, x in enumerate(names)}
        code = np.array([at[r[dim]] for r in rows])
        by = np.bincount(code, mass, len(names))
        codes.append(code)
        goals.append(_targets(names, dict(zip(names, by, strict=True)), POWERS[name], targets.get(name)))
    w = rake(np.stack(codes, 1), mass, goals)
    c = calibrate(w, mass, budget)
    out = [(r[0], r[1], r[2], float(x), float(min(1.0, c * x))) for r, x in zip(rows, w, strict=True)]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic int, weight double, prob double")


def _rake_in_spark(cells: DataFrame, targets: dict, budget: float) -> DataFrame:
    """As on the driver, with the same stop rules."""
    total = cells.agg(F.sum("mass")).first()[0]
    now = cells.withColumn("weight", F.lit(1.0))
    goals = {}
    for dim in ("source", "lang", "topic"):
        if targets.get(dim):
            given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[dim].items()], f"{dim} {cells.schema[dim].dataType.simpleString()}, want double")
            share = cells.select(dim).distinct().join(given, dim, "left").withColumn("want", F.coalesce("want", F.lit(0.0)))
        else:
            share = cells.groupBy(dim).agg(F.pow(F.sum("mass"), F.lit(POWERS[dim])).alias("want"))
        share = stage(share, "share")
        whole, n = share.agg(F.sum("want"), F.count("*")).first()
        goals[dim] = share.select(dim, (F.col("want") / whole if whole > 0 else F.lit(1 / n)).alias("want"))
    for _ in range(SWEEPS):
        now = now.withColumn("off", F.lit(0.0))
        for dim, goal in goals.items():
            have = now.groupBy(dim).agg((F.sum(F.col("weight") * F.col("mass")) / total).alias("have")).join(goal, dim)
            some = F.col("have") > 0
            ratio = have.select(dim, F.when(some, F.col("want") / F.nullif("have", F.lit(0.0))).otherwise(1.0).alias("ratio"), F.when(some, F.abs(F.col("have") - F.col("want"))).otherwise(0.0).alias("gap"))
            now = now.join(ratio, dim).select("source", "lang", "topic", "mass", (F.col("weight") * F.col("ratio")).alias("weight"), F.greatest("off", "gap").alias("off"))
        now = stage(now, "raked")
        if now.agg(F.max("off")).first()[0] < TOLERANCE:
            break
    whole = now.agg(F.sum(F.col("weight") * F.col("mass"))).first()[0]
    now = now.withColumn("weight", F.col("weight") * total / whole)
    c, goal = budget, budget * total
    for _ in range(60):
        full = F.col("weight") * c >= 1
        part = now.agg(F.sum(F.when(full, F.col("mass")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight") * F.col("mass")))).first()
        if part[1] <= 0:
            break
        new = (goal - part[0]) / part[1]
        if abs(new - c) <= 1e-12 * c:
            break
        c = new
    return now.select("source", "lang", "topic", "weight", F.least(F.lit(1.0), F.col("weight") * c).alias("prob"))


def uniform(*cols: Column | str, seed: int = 17) -> Column:
    """A number in [0, 1) that only the columns and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") / float(1 << 53)


def _marked(source: DataFrame) -> T.StructType:
    return T.StructType(T.StructType.fromDDL("__id long, tokens long, topic int").fields + source.schema.fields[2:])


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """Token weights raked to source, language and topic marginals, and a sample by calibrated probabilities.

    tokens are the words of the whole text; topic is the likeliest one of 8 in a mixture of unigrams learned over the words of
    6 bytes and more of all texts, ties to the first, -1 if it has none. targets gives shares of tokens by dimension;
    a dimension left out aims at its own shares to a power under 1. Returns the id (as doc_id), tokens, topic, weight,
    prob, selected (a hash of id and text falls under prob: the same in every run); with keep also row, a struct of
    all columns of docs, whatever their names. A null
    source or language is a category of its own; null and empty texts have 0 tokens and their cell's probability, a cell
    without tokens weight 1; rows that repeat id and text share their fate; no documents, no rows.
    """
    docs = bounded(docs)
    source = docs.select(
        F.col(id_col).cast("long").alias("__id"),
        F.col(text_col).alias("__text"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)).alias("__source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("__lang"),
        uniform(id_col, text_col).alias("__u"),
        *whole_rows(docs, keep),
    )
    shared = docs.sparkSession.sparkContext.broadcast(learn_topics(source.select("__text")))  # PLACES x TOPICS
    marked = source.mapInArrow(_topics(shared), _marked(source))
    if not keep:  # a few numbers a row: worked out once
        marked = plain = stage(marked, "marked")
    else:
        plain = source.select("__id", "__text", "__source", "__lang")
        plain = plain.mapInArrow(_topics(shared), _marked(plain))
    slim = stage(plain.groupBy("__source", "__lang", "topic").agg(F.sum("tokens").cast("double").alias("mass")), "cells")
    cells = slim.select(F.col("__source").alias("source"), F.col("__lang").alias("lang"), "topic", "mass").where("mass > 0")
    n = cells.count()
    weights = (_rake_on_driver if n <= DRIVER_CELLS else _rake_in_spark)(cells, targets or {}, budget) if n else cells.sparkSession.createDataFrame([], "source string, lang string, topic int, weight double, prob double")
    weights = small(weights.withColumnsRenamed({"source": "__source", "lang": "__lang"}), 100)
    out = marked.join(weights, ["__source", "__lang", "topic"], "left").withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "prob": F.coalesce("prob", F.lit(budget))})
    return out.select(F.col("__id").alias("doc_id"), "tokens", "topic", "weight", "prob", (F.col("__u") < F.col("prob")).alias("selected"), *(["row"] if keep else []))
