"""A partitioned vector index: coarse centroids learned in Spark, inverted lists on disk, searches that read the nearest lists only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.retrieval import ROWS_A_STEP, best_of, by_length, knn, query_blocks, top_k
from lectern.session import written

#: Rows that the first centroids are drawn from, and rounds of moving them.
SEEDS_A_LIST, ROUNDS = 8, 6


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + ROWS_A_STEP] @ centroids.T).argmax(axis=1) for i in range(0, len(x), ROWS_A_STEP)]) if len(x) else np.zeros(0, int)


def learn_centroids(vectors: DataFrame, lists: int, vector: str = "embedding", rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over all vectors of the most frequent length: a round is one scan that sends a sum for each list and task.

    It begins with rows drawn by a hash; a list that gets no row is taken from the largest list, moved a little. One row a list."""
    dim = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return np.zeros((0, 0))
    rows = vectors.where(F.size(vector) == dim.dim).select(vector)
    seeds = rows.orderBy(F.xxhash64(F.col(vector), F.lit(1))).limit(SEEDS_A_LIST * lists).toArrow().combine_chunks()
    units = np.concatenate([x for _, x in by_length(seeds.column(0).chunk(0))])
    if not len(units):
        return np.zeros((0, dim.dim))
    units = np.unique(units, axis=0)
    centroids = units[np.random.default_rng(1).permutation(len(units))[:lists]]
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(centroids)

        def move(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, many = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                for _, x in by_length(batch.column(0)):
                    own = _nearest(x, c)
                    many += np.bincount(own, minlength=len(c))
                    np.add.at(total, own, x)
            some = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(many[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["list", "many", "total"])

        sent = rows.mapInArrow(move, "list long, many long, total array<double>")
        place = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim.dim)]
        found = sent.groupBy("list").agg(F.sum("many").alias("many"), *place).collect()  # a row a list
        shared.destroy()
        moved = np.zeros_like(centroids)
        full = {r.list: r for r in found}
        largest = max(found, key=lambda r: (r.many, -r.list))
        for j in range(len(centroids)):
            r = full.get(j, largest)
            moved[j] = np.array(r[2:])
            if j not in full:
                moved[j] += np.random.default_rng(j).standard_normal(dim.dim) * np.abs(moved[j]).mean()
        length = np.sqrt((moved * moved).sum(axis=1))
        centroids = np.where(length[:, None] > 0, moved / np.where(length > 0, length, 1)[:, None], centroids)
    return centroids


@dataclass
class VectorIndex:
    """Lists (one folder each) of (id, vector) by nearest centroid; vectors of another length or without a direction are in no list."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    ident: str = "chunk_id"
    vector: str = "embedding"

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int, ident: str = "chunk_id", vector: str = "embedding") -> VectorIndex:
        out = cls(vectors.sparkSession, path, learn_centroids(vectors, lists, vector), ident, vector)
        out.insert(vectors, "overwrite")
        return out

    def insert(self, vectors: DataFrame, mode: str = "append") -> None:
        """Files of a list hold whole runs of rows: the write is clustered by list, a large list in several parts."""
        shared, names = self.spark.sparkContext.broadcast(self.centroids), [self.ident, self.vector, "list"]
        kind = vectors.schema[self.ident].dataType.simpleString()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, x in by_length(batch.column(1)):
                    if len(own) and len(shared.value) and x.shape[1] == shared.value.shape[1]:
                        part = batch.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_nearest(x, shared.value).astype(np.int32))], names=names)

        rows = vectors.select(self.ident, self.vector).mapInArrow(assign, f"`{self.ident}` {kind}, `{self.vector}` {vectors.schema[self.vector].dataType.simpleString()}, list int")
        rows.hint("rebalance", "list").write.mode(mode).partitionBy("list").parquet(self.path)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """The k best of the rows in the `probes` nearest lists of each query (query_id, vector): (query_id, id, score, rank)."""
        stored = self.spark.read.schema(f"`{self.ident}` long, `{self.vector}` array<double>, list int").parquet(self.path)
        out, names = None, ["query_id", self.ident, "score"]
        for block in query_blocks(queries.withColumnRenamed(self.vector, "__v"), "__v"):
            ids, q = block.get(self.centroids.shape[1], (np.zeros(0, np.int64), np.zeros((0, self.centroids.shape[1]))))
            near = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]
            asked = np.zeros((len(self.centroids), len(ids)), bool)
            asked[near.ravel(), np.repeat(np.arange(len(ids)), near.shape[1])] = True
            shared = self.spark.sparkContext.broadcast((ids, q, asked))

            def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q, asked = shared.value
                floor = np.full(len(ids), -np.inf)
                for batch in batches:
                    for lo in range(0, batch.num_rows, ROWS_A_STEP):
                        part = batch.slice(lo, ROWS_A_STEP)
                        of = part.column(2).to_numpy()
                        for own, x in by_length(part.column(1)):
                            for number in np.unique(of[own]):
                                rows, wants = np.flatnonzero(of[own] == number), np.flatnonzero(asked[number])
                                reached = floor[wants]
                                for d, j, score in best_of(x[rows], q[wants], k, reached):
                                    yield pa.RecordBatch.from_arrays([pa.array(ids[wants[j]]), part.column(0).take(pa.array(own[rows[d]])), pa.array(score)], names=names)
                                floor[wants] = reached

            wanted = stored.where(F.col("list").isin(np.flatnonzero(asked.any(axis=1)).tolist()))  # other lists' folders are not read
            found = wanted.mapInArrow(task, f"query_id long, `{self.ident}` long, score double")
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = self.spark.createDataFrame([], f"query_id long, `{self.ident}` long, score double")
        return top_k(out, k, self.ident)

    def exact(self, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
        """What the exact search finds, written once for any number of measurements."""
        return written(top_k(knn(queries, vectors, k, self.ident, self.vector).drop("rank"), k, self.ident).select("query_id", self.ident), "exact")

    def measure(self, queries: DataFrame, vectors: DataFrame, k: int, probes: int, exact: DataFrame | None = None) -> tuple[float, float]:
        """(recall of the k best, share of the rows that a query is held against), by exact search for the given queries."""
        exact = self.exact(queries, vectors, k) if exact is None else exact
        found = self.search(queries, k, probes).select("query_id", self.ident)
        total = exact.count()
        hit = exact.join(found, ["query_id", self.ident], "left_semi").count()
        sizes = dict(map(tuple, self.spark.read.parquet(self.path).groupBy("list").count().collect()))
        read = []
        for block in query_blocks(queries.withColumnRenamed(self.vector, "__v"), "__v"):
            for _, q in block.values():
                near = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]
                read += [sum(sizes.get(int(c), 0) for c in row) for row in near]
        return hit / total if total else 1.0, float(np.mean(read)) / max(1, sum(sizes.values())) if read else 0.0

    def probes_for(self, queries: DataFrame, vectors: DataFrame, k: int, recall: float = 0.9, exact: DataFrame | None = None) -> int:
        """The fewest probes, by doubling and halving, that reach the recall on the given sample of queries."""
        exact = self.exact(queries, vectors, k) if exact is None else exact
        lo, hi = 0, 1
        while hi < len(self.centroids) and self.measure(queries, vectors, k, hi, exact)[0] < recall:
            lo, hi = hi, hi * 2
        hi = min(hi, len(self.centroids))
        while hi - lo > max(1, hi // 8):
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.measure(queries, vectors, k, mid, exact)[0] >= recall else (mid, hi)
        return hi
