"""A maintained text index: postings on disk, document frequencies kept by deltas, inserts and deletes as committed batches."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.session import shared_folder

#: Deleted ids are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Postings that one task scores, about; queries that are scored as one matrix; chunks of a step.
TASK_POSTINGS, BLOCK_QUERIES, STEP = 4_000_000, 256, 512
#: Cells of a (chunk, term) matrix: with many terms a step has fewer chunks.
CELLS = 1 << 20
_COMMIT = "batch long, n_docs long, n_texts long, words long, kind string"


@dataclass
class TextIndex:
    """Folders below `path`: postings (chunk id, token, tf, dl; sorted by token within a file, so that a search reads the row groups
    of its tokens only), docs (chunk id, dl), freq (token, change of its document frequency), gone (deleted ids) and commits. A batch
    counts once its commit is written; what a broken run left is overwritten by the next."""

    spark: SparkSession
    path: str
    ident: str = "chunk_id"

    def commits(self) -> list:
        try:
            rows = self.spark.read.schema(_COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits").collect()  # one a batch
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted(rows, key=lambda r: r.batch)

    def _read(self, table: str, kinds: tuple[str, ...], commits: list) -> DataFrame | None:
        batches = [r.batch for r in commits if r.kind in kinds]
        out = None
        for b in batches:
            part = self.spark.read.parquet(f"{self.path}/{table}/{b}").withColumn("batch", F.lit(b))
            out = part if out is None else out.unionByName(part)
        return out

    def _commit(self, batch: int, sizes: tuple[int, int, int], kind: str) -> None:
        self.spark.createDataFrame([(batch, *sizes, kind)], _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")

    def _live(self, table: str, commits: list) -> DataFrame | None:
        """Rows of a table by chunk that no later batch has deleted."""
        rows = self._read(table, ("insert",), commits)
        gone = self._read("gone", ("delete",), commits)
        if rows is None or gone is None:
            return rows
        gone = gone.groupBy(self.ident).agg(F.max("batch").alias("until"))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
        return rows.join(gone, self.ident, "left").where(F.col("until").isNull() | (F.col("batch") > F.col("until"))).drop("until")

    def insert(self, chunks: DataFrame, text: str = "text") -> None:
        """Adds chunks (id, text). Their ids are taken as new: delete() those that are to be replaced first."""
        commits = self.commits()
        batch = commits[-1].batch + 1 if commits else 0
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        listed = chunks.select(self.ident, tx.bm25_tokens(text).alias("tokens"))
        postings, docs = f"{self.path}/postings/{batch}", f"{self.path}/docs/{batch}"
        if chunks.groupBy(self.ident).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():  # a chunk's words are counted where its row stands
            kind = chunks.schema[self.ident].dataType.simpleString()
            posted = listed.mapInArrow(_term_counts(self.ident), f"`{self.ident}` {kind}, token string, dl int, tf int")
            posted.sortWithinPartitions("token").write.mode("overwrite").parquet(postings)  # each text is split into words once
            own = self.spark.read.parquet(postings).select(F.col(self.ident).alias("own"), "dl").distinct()
            sizes = chunks.select(self.ident, F.col(text).isNotNull().alias("some")).join(own, F.col(self.ident).eqNullSafe(F.col("own")), "left")
            sizes.select(self.ident, F.when(F.col("some"), F.coalesce("dl", F.lit(0))).alias("dl")).write.mode("overwrite").parquet(docs)
        else:
            listed = listed.withColumn("dl", F.when(F.col("tokens").isNotNull(), F.size("tokens")))
            listed.select(self.ident, "dl").write.mode("overwrite").parquet(docs)
            one = listed.select(self.ident, "dl", F.explode("tokens").alias("token")).repartition(n, self.ident)  # grouped without another shuffle
            posted = one.groupBy(self.ident, "token", "dl").agg(F.count("*").cast("int").alias("tf"))
            posted.sortWithinPartitions("token").write.mode("overwrite").parquet(postings)
        self.spark.read.parquet(postings).groupBy("token").agg(F.count("*").alias("df")).sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.path}/freq/{batch}")
        self._commit(batch, self._sizes(self.spark.read.parquet(f"{self.path}/docs/{batch}")), "insert")

    def delete(self, ids: DataFrame) -> None:
        """Removes chunks by id; ids that the index does not hold change nothing."""
        commits = self.commits()
        docs = self._live("docs", commits)
        if docs is None:
            return
        batch = commits[-1].batch + 1
        wanted = ids.select(self.ident).distinct()
        docs.join(wanted, self.ident, "left_semi").select(self.ident, "dl").write.mode("overwrite").parquet(f"{self.path}/gone/{batch}")
        gone = self.spark.read.parquet(f"{self.path}/gone/{batch}")
        sizes = self._sizes(gone)
        own = F.broadcast(gone.select(self.ident).distinct()) if sizes[0] <= BROADCAST_IDS else gone.select(self.ident).distinct()
        self._live("postings", commits).join(own, self.ident, "left_semi").groupBy("token").agg((-F.count("*")).alias("df")).sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.path}/freq/{batch}")
        self._commit(batch, tuple(-x for x in sizes), "delete")

    @staticmethod
    def _sizes(docs: DataFrame) -> tuple[int, int, int]:
        """Chunks, those with a text, and their tokens."""
        return tuple(docs.agg(F.count("*"), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def stats(self) -> tuple[int, float]:
        """Number of chunks and the mean length of those with a text, from the commits alone."""
        n, texts, words = (sum(x) for x in zip(*((r.n_docs, r.n_texts, r.words) for r in self.commits()), strict=True)) if self.commits() else (0, 0, 0)
        return n, words / texts if texts else 0.0

    def frequencies(self) -> DataFrame | None:
        """(token, df) of tokens that some chunk holds."""
        deltas = self._read("freq", ("insert", "delete"), self.commits())
        return None if deltas is None else deltas.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def search(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, tolerance: float = 1e-6) -> DataFrame:
        """BM25 of a stated query set (query_id, text[, weight]): of each task the k best of each query, and all within `tolerance`
        of them. Only postings of the queries' tokens are read; each crosses the network once, however many queries ask for it."""
        spark, commits = self.spark, self.commits()
        postings, deltas = self._live("postings", commits), self.frequencies()
        if postings is None:
            return spark.createDataFrame([], f"query_id long, `{self.ident}` long, score double")
        kind = postings.schema[self.ident].dataType.simpleString()
        weight = F.col("weight") if "weight" in queries.columns else F.lit(1.0)
        q = queries.select("query_id", weight.cast("double").alias("w"), F.explode(tx.bm25_tokens("text")).alias("token")).groupBy("query_id", "token").agg(F.sum("w").alias("w"))
        many = queries.select("query_id").distinct().count()
        blocks = max(1, -(-many // BLOCK_QUERIES))
        n, avgdl = self.stats()
        raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        out = None
        for i in range(blocks):
            asked = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
            words = spark.createDataFrame([(t,) for t in sorted({r.token for r in asked})], "token string")
            found = deltas.join(F.broadcast(words.withColumn("asked", F.lit(True))), "token", "left").groupBy(F.when(F.col("asked"), F.col("token")).alias("token"), "df").agg(F.count("*").alias("many"), F.avg(raw).alias("idf")).collect()
            floor = epsilon * sum(r.idf * r.many for r in found) / max(1, sum(r.many for r in found))
            idf = {r.token: (r.idf if r.idf >= 0 else floor, r.df) for r in found if r.token is not None}
            names, ids = sorted(idf), sorted({r.query_id for r in asked if r.token in idf})
            if not names:
                continue
            at, row = {t: j for j, t in enumerate(names)}, {x: j for j, x in enumerate(ids)}
            matrix = np.zeros((len(names), len(ids)))
            for r in asked:
                if r.token in at:
                    matrix[at[r.token], row[r.query_id]] = r.w * idf[r.token][0]
            shared = spark.sparkContext.broadcast((np.array(ids), matrix))
            terms = F.broadcast(spark.createDataFrame(list(at.items()), "token string, term int"))
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sum(d for _, d in idf.values()) / TASK_POSTINGS))
            few = postings.where(F.col("token").isin(names)) if len(names) <= 400 else postings  # reaches the scan as a filter
            hits = few.join(terms, "token").select(self.ident, "dl", "term", "tf").repartition(parts, self.ident).sortWithinPartitions(self.ident)
            part = hits.mapInArrow(_scorer(shared, self.ident, k, k1, b, avgdl, tolerance), f"query_id long, `{self.ident}` {kind}, score double")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else spark.createDataFrame([], f"query_id long, `{self.ident}` {kind}, score double")

    def compact(self, target: str) -> TextIndex:
        """The live rows of all batches as one batch at another path."""
        commits = self.commits()
        out = TextIndex(self.spark, target, self.ident)
        for table in ("docs", "postings"):
            rows = self._live(table, commits).drop("batch")
            rows = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.ident)
            (rows.sortWithinPartitions("token") if table == "postings" else rows).write.mode("overwrite").parquet(f"{target}/{table}/0")
        self.frequencies().sortWithinPartitions("token").write.mode("overwrite").parquet(f"{target}/freq/0")
        out._commit(0, tuple(sum(x) for x in zip(*((r.n_docs, r.n_texts, r.words) for r in commits), strict=True)), "insert")
        return out


_built: dict[tuple, TextIndex] = {}


def index_of(table: DataFrame, ident: str, text: str = "text") -> TextIndex:
    """The index of a file table, built in the shared folder when it is first asked for in this application and read from then
    on; a table whose files have changed gets a new one."""
    spark = table.sparkSession
    files = table.select("_metadata.file_path", F.unix_micros("_metadata.file_modification_time").alias("at"), "_metadata.file_size").distinct().collect()  # a row a file
    key = (spark.sparkContext.applicationId, ident, text, *sorted(map(tuple, files)))
    if key not in _built:
        index = TextIndex(spark, f"{shared_folder(spark)}/textindex-{uuid.uuid4().hex}", ident)
        index.insert(table.select(ident, text), text)
        _built[key] = index
    return _built[key]


def _term_counts(ident: str):
    """(id, tokens) to (id, token, dl, tf): the words of some hundred rows at a time are numbered and counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                own, dl = part.column(0), pc.list_value_length(part.column(1)).cast(pa.int32())
                words = part.column(1).flatten().dictionary_encode()
                if not len(words):
                    continue
                doc = np.repeat(np.arange(part.num_rows), dl.fill_null(0).to_numpy())
                both, tf = np.unique(doc * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
                d, w = (pa.array(x) for x in np.divmod(both, len(words.dictionary)))
                yield pa.RecordBatch.from_arrays([own.take(d), words.dictionary.take(w), dl.take(d), pa.array(tf.astype(np.int32))], names=[ident, "token", "dl", "tf"])

    return count


def _scorer(shared, ident: str, k: int, k1: float, b: float, avgdl: float, tolerance: float):
    """Rows of a partition, sorted by chunk: steps of whole chunks as (chunk, term) matrices, times the queries' weights."""

    def best(ids: pa.Array, dl: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, so_far: list[np.ndarray]) -> pa.RecordBatch:
        """so_far: the k best scores of each query in the steps before; what lies below them all is not given."""
        queries, matrix = shared.value
        count = np.zeros((len(dl), len(matrix)))
        count[doc, term] = tf
        score = (count * (k1 + 1) / (count + (k1 * (1 - b + b * dl / (avgdl or 1.0)))[:, None])) @ matrix
        hit = (count > 0).astype(np.float32) @ (matrix != 0).astype(np.float32) > 0
        score[~hit] = -np.inf
        both = np.concatenate([*so_far, score])
        so_far[:] = [np.partition(both, len(both) - k, axis=0)[len(both) - k :] if len(both) > k else both]
        least = so_far[0].min(axis=0) if len(so_far[0]) == k else np.full(len(queries), -np.inf)
        d, j = np.nonzero((score >= least - tolerance) & hit)
        return pa.RecordBatch.from_arrays([pa.array(queries[j]) if len(j) else pa.array([], pa.int64()), ids.take(pa.array(d)), pa.array(score[d, j])], names=["query_id", ident, "score"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, so_far = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = yield from steps(table, False, so_far)
        if held is not None and held.num_rows:
            yield from steps(held, True, so_far)

    def steps(table: pa.Table, last: bool, so_far: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Scores all whole steps; the rest, whose last chunk may go on, is returned."""
        table = table.combine_chunks()
        column = table.column(ident).chunk(0) if table.num_rows else None
        if column is None:
            return table
        codes = column.dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        whole = len(first) if last else len(first) - 1
        dl, term, tf = (table.column(c).to_numpy() for c in ("dl", "term", "tf"))
        end = np.r_[first, len(codes)]
        at, step = 0, max(1, min(STEP, CELLS // max(1, len(shared.value[1]))))
        while at < whole and (last or whole - at >= step):
            to = min(at + step, whole)
            a, z = end[at], end[to]
            yield best(column.take(pa.array(first[at:to])), dl[first[at:to]].astype(float), np.repeat(np.arange(to - at), np.diff(end[at : to + 1])), term[a:z], tf[a:z], so_far)
            at = to
        return table.slice(int(end[at]))

    return score
