"""Approximate nearest neighbours: query-directed multiprobe over p-stable hash tables, exact reranking."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stage

#: Queries in a block, about; blocks that are broadcast for one scan of the index (some 40 MB of probes each).
QUERY_BLOCK, SCAN_BLOCKS = 1600, 2
#: Rows that are searched at a time.
ROWS = 4096


@dataclass(frozen=True)
class Params:
    tables: int = 32
    hashes: int = 12
    width: float = 2.0
    probes: int = 200
    seed: int = 3


def projections(dim: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return rng.standard_normal((p.tables * p.hashes, dim)), rng.random(p.tables * p.hashes) * p.width


def _codes(cells: np.ndarray, p: Params) -> np.ndarray:
    """One 32-bit code a table for (..., tables, hashes) cell numbers; cells that share one by chance only add candidates."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(p.hashes):
        h = (h ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32)


def codes(unit: np.ndarray, p: Params) -> np.ndarray:
    a, b = projections(unit.shape[1], p)
    return _codes(np.floor((unit @ a.T + b) / p.width).reshape(len(unit), p.tables, p.hashes), p)


def perturbations(p: Params) -> list[list[int]]:
    """Sets of ranks (1..2K, rank j and 2K+1-j exclude each other) in rising order of their expected score (Lv et al. 2007)."""
    k = p.hashes
    z = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, 2 * k + 1)]
    out: list[list[int]] = [[]]
    heap = [(z[0], [1])]
    while heap and len(out) < p.probes:
        score, s = heapq.heappop(heap)
        if not any(2 * k + 1 - j in s for j in s):
            out.append(s)
        if s[-1] < 2 * k:
            heapq.heappush(heap, (score - z[s[-1] - 1] + z[s[-1]], [*s[:-1], s[-1] + 1]))
            heapq.heappush(heap, (score + z[s[-1]], [*s, s[-1] + 1]))
    return out


def probe_codes(unit: np.ndarray, p: Params) -> np.ndarray:
    """(queries, tables, probes) codes: the own bucket and the perturbed ones in estimated success order."""
    a, b = projections(unit.shape[1], p)
    f = ((unit @ a.T + b) / p.width).reshape(len(unit), p.tables, p.hashes)
    cell = np.floor(f)
    gap = np.concatenate([f - cell, 1 - (f - cell)], axis=2)  # to the lower, to the upper boundary
    rank = np.argsort(gap, axis=2, kind="stable")
    out = []
    for s in perturbations(p):
        at = cell.copy()
        for j in s:
            i = rank[:, :, j - 1]
            np.put_along_axis(at, (i % p.hashes)[..., None], np.take_along_axis(at, (i % p.hashes)[..., None], 2) + np.where(i < p.hashes, -1, 1)[..., None], 2)
        out.append(_codes(at, p))
    return np.stack(out, axis=2)


def reached(query_probes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(queries, rows): whether a row's bucket is one of the query's in any table."""
    q, tables, probes = query_probes.shape
    hit = np.zeros((q, len(rows)), bool)
    for t in range(tables):
        of, at = np.unique(rows[:, t], return_inverse=True)
        own = query_probes[:, t, :].ravel()
        place = np.minimum(np.searchsorted(of, own), len(of) - 1)
        found = np.zeros((q, len(of)), bool)
        good = of[place] == own
        found[np.repeat(np.arange(q), probes)[good], place[good]] = True
        hit |= found[:, at]
    return hit


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which brings the largest component near 1: no digit changes, no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and one fixed order of summing, of scaled vectors."""
    return np.clip((q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1))), -1, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def rerank(block: tuple, x: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of each query's candidates among the rows that can be of its k + 1 best; only rows in a bucket that
    the query probes are scored (all rows, for a block without probes)."""
    _, q, unit, probes = block
    y = _unit(x)
    hit = None if probes is None else reached(probes, codes)
    at, of = [], []
    for i in range(len(q)):
        rows = np.arange(len(x)) if hit is None else np.flatnonzero(hit[i])
        if len(rows) > k + 1:
            near = y[rows] @ unit[i]
            # all within rounding of the last of the best
            rows = rows[near >= np.partition(near, len(near) - k - 1)[-k - 1] - 1e-12]
        at.append(np.full(len(rows), i))
        of.append(rows)
    at, of = np.concatenate(at), np.concatenate(of)
    return at, of, cosines(q[at], x[of])


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, params: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:  # noqa: B008
    """For each query row its k nearest found rows other than itself by largest cosine.

    Returns query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller vec_id. queries: rows of the same
    table, by default those whose id divides by 50. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, neither do rows of a null id. A vector is compared with those of its own length. Rows that
    repeat an id count once per different vector. Other columns are not read.

    Equal vectors are one class, of which the k + 1 smallest ids are kept (more can't be reported), so a vector that a
    third of all rows share is searched once. Every class is hashed into all tables. Each task joins the buckets of its rows
    to the buckets that the queries probe, merges the candidates of all tables, scores these only and returns each query's
    best of them; a scan of the index serves several thousand queries. A query that all probes together bring fewer than k
    rows is held against all rows, so fewer than k come back only where there are no more.
    """
    spark = vectors.sparkSession
    c = F.col(vec_col).cast("array<double>")
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(c, lambda x: x != 0)
    valid = lambda df: df.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.transform(c, lambda x: x + 0.0).alias("v")).distinct()
    rows = valid(vectors)
    asked = valid(vectors.where(F.col(id_col) % 50 == 0) if queries is None else queries)
    first = Window.partitionBy("v").orderBy("id")
    classes = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and scaled vectors of each length."""
        lens = column.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lens):
            own = np.flatnonzero(lens == dim)
            yield own, scaled(column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in by_length(batch.column(0)):
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes(_unit(x), params)], pa.binary())], names=["v", "ids", "codes"])

    indexed = stage(classes.mapInArrow(index, "v array<double>, ids array<long>, codes binary"), "index")
    # query classes, numbered in blocks; every query id keeps its own class's number
    groups = stage(asked.groupBy("v").agg(F.min("id").alias("qid")), "queries")

    def search(wanted: DataFrame, probing: bool) -> DataFrame:
        """The lists of the k + 1 best found rows of each wanted query class. The driver holds the probes of SCAN_BLOCKS blocks at a
        time: a scan's lists are written before the next one's queries come."""
        parts = max(1, math.ceil(wanted.count() / QUERY_BLOCK))
        lists = []
        for lo in range(0, parts, SCAN_BLOCKS):
            blocks: dict[int, list] = {}
            for part in range(lo, min(lo + SCAN_BLOCKS, parts)):
                by_dim: dict[int, list] = {}
                for r in wanted.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).select("qid", "v").collect():  # about QUERY_BLOCK rows
                    by_dim.setdefault(len(r.v), []).append(r)
                for dim, own in by_dim.items():
                    q = scaled(np.array([r.v for r in own], np.float64))
                    blocks.setdefault(dim, []).append(spark.sparkContext.broadcast((np.array([r.qid for r in own]), q, _unit(q), probe_codes(_unit(q), params) if probing else None)))
            lists.append(stage(best_lists(indexed.mapInArrow(scan(blocks), "qid long, score double, ids array<long>")), "lists"))
            for shared in itertools.chain.from_iterable(blocks.values()):
                shared.destroy()
        return spark.read.schema(lists[0].schema).parquet(*(x._staged_at for x in lists))

    def scan(blocks: dict[int, list]):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, x in by_length(batch.column(0)):
                    for at in range(0, len(own) if x.shape[1] in blocks else 0, ROWS):
                        sub = batch.take(pa.array(own[at : at + ROWS]))
                        code = np.frombuffer(b"".join(sub.column(2).to_pylist()), np.uint32).reshape(sub.num_rows, -1)
                        smallest = sub.column(1).flatten().to_numpy()[np.r_[0, np.cumsum(sub.column(1).value_lengths().to_numpy())[:-1]]]
                        for shared in blocks[x.shape[1]]:
                            block = shared.value
                            q, of, score = rerank(block, x[at : at + ROWS], code, k)
                            order = np.lexsort((smallest[of], -score, q))
                            q, of, score = q[order], of[order], score[order]
                            best = np.arange(len(q)) - np.searchsorted(q, q) <= k
                            q, of, score = q[best], of[best], score[best]
                            yield pa.RecordBatch.from_arrays([pa.array(block[0][q], pa.int64()), pa.array(score, pa.float64()), sub.column(1).take(pa.array(of, pa.int64()))], names=["qid", "score", "ids"])

        return task

    def best_lists(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0])
        top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("qid", "score", F.explode("ids").alias("vec_id"))
        ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        top = top.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).drop("n")
        return top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("list"))

    lists = search(groups, True)
    few = stage(groups.join(lists.where(F.size("list") > k).select("qid"), "qid", "left_anti"), "few")
    if not few.isEmpty():
        lists = lists.join(few.select("qid"), "qid", "left_anti").unionByName(search(few, False))
    every = asked.join(groups.select("v", "qid"), "v").select(F.col("id").alias("query_id"), "qid").join(lists, "qid")
    own = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return every.select("query_id", F.posexplode(own).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
