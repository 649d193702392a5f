"""Retrieval: BM25, exact cosine search, score fusion, quality grading and correction, reranking; for many queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx

#: Queries are broadcast up to this many bytes of text, and joined by shuffle beyond.
QUERY_BYTES = 16 << 20
#: A block of queries that is scored as one matrix: its queries and bytes bound the matrix (about 50 MB).
BLOCK_QUERIES, BLOCK_BYTES = 256, 128 << 10
#: Vectors of queries that are broadcast at a time; rows, and queries, that are multiplied at a time (a matrix of 4 MB).
QUERIES_A_BLOCK, ROWS_A_STEP, QUERIES_A_STEP = 4096, 1024, 512


def _small(df: DataFrame, text: str) -> DataFrame:
    size = df.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= QUERY_BYTES else df


def corpus_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs and avgdl (BM25 tokens a chunk)."""
    return chunks.agg(F.count("*").alias("n_docs"), F.avg(F.size(tx.bm25_tokens(text))).alias("avgdl"))


def postings(chunks: DataFrame, ident: str = "chunk_id", text: str = "text") -> DataFrame:
    """(token, chunk id, tf, dl): the inverted index; write it bucketed by token to reuse it."""
    t = chunks.select(ident, tx.bm25_tokens(text).alias("tokens")).select(ident, F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    return t.groupBy("token", ident, "dl").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, chunks: DataFrame, ident: str = "chunk_id", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25 of (query_id, text[, weight]) against chunks: (query_id, chunk id, score) for pairs that share a token.

    Query tokens are not de-duplicated; variants of a query sum with their weights. idf = ln(N - df + .5) - ln(df + .5);
    a negative one becomes epsilon times the mean idf of the vocabulary.
    """
    weight = F.col("weight") if "weight" in queries.columns else F.lit(1.0)
    q = queries.select("query_id", weight.cast("double").alias("weight"), F.explode(tx.bm25_tokens("text")).alias("token"))
    q = _small(q.groupBy("query_id", "token").agg(F.sum("weight").alias("qw")), "token")
    index = postings(chunks, ident)
    stats = corpus_stats(chunks)
    df = index.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = df.agg((F.avg("raw") * epsilon).alias("floor"))
    terms = df.join(q.select("token").distinct(), "token", "left_semi").crossJoin(F.broadcast(floor))
    terms = terms.select("token", "avgdl", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    hits = index.join(q, "token").join(terms, "token")
    part = F.col("qw") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", ident).agg(F.sum(part).alias("score"))


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int, ident: str = "chunk_id", text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, tolerance: float = 1e-6) -> DataFrame:
    """The same scores as bm25(), but in one scan and only the best k of each query (and all within `tolerance` of them)
    from each slice of chunks: for a stated query set, in blocks of 256 (BLOCK_BYTES of text), without a join row for each hit.

    Corpus size, mean length and document frequencies are one pre-aggregated count; a slice's term counts meet the block's weights as a matrix product."""
    spark = chunks.sparkSession
    weight = F.col("weight") if "weight" in queries.columns else F.lit(1.0)
    q = queries.select("query_id", weight.cast("double").alias("w"), F.explode(tx.bm25_tokens("text")).alias("token")).groupBy("query_id", "token").agg(F.sum("w").alias("w"))
    tokens = chunks.select(F.col(ident).alias("id"), tx.bm25_tokens(text).alias("tokens"))
    # each text also gives one null, whose row holds the counts of texts and of their words
    own = F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>"))
    marked = tokens.select(F.explode(F.array_append(own, F.lit(None).cast("string"))).alias("token"), F.size("tokens").alias("dl"))
    df = marked.groupBy("token").agg(F.count("*").alias("df"), F.count("dl").alias("texts"), F.sum("dl").alias("words"))
    size, many = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-size // BLOCK_BYTES), -(-many // BLOCK_QUERIES))
    out = None
    for i in range(blocks):
        asked = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        words = spark.createDataFrame([(t,) for t in sorted({r.token for r in asked})], "asked string")
        # one pass: the frequency of each asked token, and how many other tokens have each frequency
        counts = df.join(F.broadcast(words), F.col("token") == F.col("asked"), "left").groupBy("asked", "df", F.col("token").isNull().alias("all")).agg(F.count("*").alias("many"), F.sum(F.when(F.col("token").isNull(), F.col("texts"))).alias("texts"), F.sum(F.when(F.col("token").isNull(), F.col("words"))).alias("words")).collect()
        whole = next((r for r in counts if r["all"]), None)
        n, avgdl = (whole.df, whole.words / whole.texts if whole.texts else 0.0) if whole else (0, 0.0)
        counts = [r for r in counts if not r["all"]]
        raw = lambda c: math.log(n - c + 0.5) - math.log(c + 0.5)
        floor = epsilon * sum(raw(r.df) * r.many for r in counts) / max(1, sum(r.many for r in counts))
        idf = {r.asked: x if (x := raw(r.df)) >= 0 else floor for r in counts if r.asked is not None}
        rows = [(r.query_id, r.token, r.w * idf[r.token]) for r in asked if r.token in idf]
        names, ids = sorted({t for _, t, _ in rows}), sorted({x for x, _, _ in rows})
        at, row = {t: j for j, t in enumerate(names)}, {x: j for j, x in enumerate(ids)}
        matrix = np.zeros((len(names), len(ids)))
        for x, t, w in rows:
            matrix[at[t], row[x]] = w
        shared = spark.sparkContext.broadcast((pa.array(names, pa.string()), np.array(ids), matrix))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, ids, matrix = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    lists = part.column(1)
                    dl = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(float)
                    code = pc.index_in(lists.flatten(), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
                    doc = np.repeat(np.arange(len(dl)), dl.astype(int))[code >= 0]
                    tf = np.bincount(doc * len(names) + code[code >= 0], minlength=len(dl) * len(names)).reshape(len(dl), len(names)).astype(float) if len(names) else np.zeros((len(dl), 0))
                    score = (tf * (k1 + 1) / (tf + (k1 * (1 - b + b * dl / (avgdl or 1.0)))[:, None])) @ matrix
                    hit = (tf > 0).astype(np.float32) @ (matrix != 0).astype(np.float32) > 0
                    score[~hit] = -np.inf
                    top = min(k, len(dl))
                    least = np.partition(score, len(dl) - top, axis=0)[len(dl) - top] if top and len(ids) else np.zeros(len(ids))
                    d, j = np.nonzero((score >= least - tolerance) & hit)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j]) if len(j) else pa.array([], pa.int64()), part.column(0).take(pa.array(d)), pa.array(score[d, j])], names=["query_id", ident, "score"])

        kind = chunks.schema[ident].dataType.simpleString()
        found = tokens.mapInArrow(search, f"query_id long, `{ident}` {kind}, score double")
        out = found if out is None else out.unionByName(found)
    return out


def top_k(hits: DataFrame, k: int, ident: str = "chunk_id", score: str = "score", by: str = "query_id") -> DataFrame:
    """The k best of each query, ranked from 1; ties to the smaller id. The limit is applied before the shuffle too."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.col(ident))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20, ident: str = "chunk_id", text: str = "text") -> DataFrame:
    """The best k after texts that repeat among the first 2k are dropped (the best of each stays)."""
    first = top_k(bm25_search(queries, chunks, 2 * k, ident, text), 2 * k, ident)
    named = first.join(chunks.select(ident, text), ident)
    best = Window.partitionBy("query_id", F.xxhash64(text), text).orderBy("rank")
    once = named.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "rank")
    return top_k(once, k, ident)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors (in double precision) of each length; vectors that are null, zero or not finite are left out."""
    lens = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lens[lens > 0]):
        own = np.flatnonzero(lens == dim)
        x = column.take(pa.array(own)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(own), dim)  # a null component is not a number
        scale = np.abs(x).max(axis=1)
        good = np.isfinite(scale) & (scale > 0)
        x = x[good] / scale[good][:, None]
        yield own[good], x / np.sqrt((x * x).sum(axis=1))[:, None]


def best_of(x: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, tolerance: float = 1e-9) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, query, score) of each query's k best rows, and of all within `tolerance` of them, for some queries at a time.

    floor: scores that k rows of each query have reached so far; lower ones are left out, and it is raised here."""
    for at in range(0, len(q), QUERIES_A_STEP):
        score, own = x @ q[at : at + QUERIES_A_STEP].T, floor[at : at + QUERIES_A_STEP]
        if len(score) >= k:
            np.maximum(own, np.partition(score, len(score) - k, axis=0)[len(score) - k], out=own)
        d, j = np.nonzero(score >= own - tolerance)
        if len(d):
            yield d, at + j, np.clip(score[d, j], -1, 1)


def query_blocks(queries: DataFrame, vector: str) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of a stated query set: by the vectors' length, the ids and the unit vectors of QUERIES_A_BLOCK queries, about."""
    blocks = max(1, -(-queries.count() // QUERIES_A_BLOCK))
    for i in range(blocks):
        rows = queries.select("query_id", vector).where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if rows.num_rows:
            column = rows.column(1).chunk(0)
            ids = rows.column(0).to_numpy()
            yield {x.shape[1]: (ids[own], x) for own, x in by_length(column)}


def knn(queries: DataFrame, vectors: DataFrame, k: int, ident: str = "chunk_id", vector: str = "embedding", by: str | None = None) -> DataFrame:
    """Exact cosine search: every (query_id, vector) of a stated query set against all rows of its vector's length, in blocks.

    A block of queries is broadcast (some 4096 vectors) and the corpus stays where it is: each slice of rows is one matrix
    product, and only its best k a query go on to the one shuffle. Vectors that are null, zero or not finite take no part.
    by: a column of vectors; the k best are those of each of its values. For approximate search see vectorindex.
    """
    out = None
    groups = [by] if by else []
    kind = {c: vectors.schema[c].dataType.simpleString() for c in [ident, *groups]}
    schema = ", ".join(["query_id long", *(f"`{c}` {t}" for c, t in kind.items()), "score double"])
    spark = vectors.sparkSession
    for block in query_blocks(queries, vector):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            floors = {dim: np.full(len(ids), -np.inf) for dim, (ids, _) in shared.value.items()}
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS_A_STEP):
                    part = batch.slice(lo, ROWS_A_STEP)
                    for own, x in by_length(part.column(part.num_columns - 1)):
                        if x.shape[1] not in shared.value or not len(own):
                            continue
                        ids, q = shared.value[x.shape[1]]
                        code = part.column(1).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[own] if by else np.zeros(len(own), int)
                        for g in np.unique(code):
                            rows = np.flatnonzero(code == g)
                            floor = np.full(len(ids), -np.inf) if by else floors[x.shape[1]]
                            for d, j, score in best_of(x[rows], q, k, floor):
                                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), *(part.column(c).take(pa.array(own[rows[d]])) for c in range(part.num_columns - 1)), pa.array(score)], names=["query_id", *kind, "score"])

        found = vectors.select(ident, *groups, vector).mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id", *groups).orderBy(F.desc("score"), F.col(ident))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sides(vector_hits: DataFrame, text_hits: DataFrame, key: str) -> DataFrame:
    """One row a (query, key) with both sides' scores."""
    side = lambda df, c: df.select("query_id", key, F.col("score").cast("double").alias(c))
    return side(vector_hits, "v").join(side(text_hits, "b"), ["query_id", key], "full_outer")


def _share(c: str, w: Window) -> Column:
    """A score divided by the query's largest on that side, if that is positive."""
    top = F.max(c).over(w)
    return F.col(c) / F.when(top > 0, top).otherwise(1.0)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, alpha: float | Column = 0.5, key: str = "chunk_id") -> DataFrame:
    """Linear fusion of scores divided by the query's largest on either side, with a small term for the better rank.

    Each side is read once: one join, and all windows over the query behind one shuffle of the hits."""
    w = Window.partitionBy("query_id")
    rank = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(w.orderBy(F.desc_nulls_last(c), F.col(key)))).otherwise(F.count(c).over(w) + 1)
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    fused = a * F.coalesce("s_v", F.lit(0.0)) + (F.lit(1.0) - a) * F.coalesce("s_b", F.lit(0.0)) + F.lit(0.001) / (F.least("r_v", "r_b") + 5)
    both = _sides(vector_hits, text_hits, key).select("query_id", key, _share("v", w).alias("s_v"), _share("b", w).alias("s_b"), rank("v").alias("r_v"), rank("b").alias("r_b"))
    return top_k(both.select("query_id", key, fused.alias("score")), k, key)


def simple_fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """Half of each normalised score where both sides found it, else the score of the one that did."""
    w = Window.partitionBy("query_id")
    both = _sides(vector_hits, text_hits, key).select("query_id", key, _share("v", w).alias("v"), _share("b", w).alias("b"))
    return top_k(both.select("query_id", key, F.coalesce(F.col("v") * 0.5 + F.col("b") * 0.5, "v", "b").alias("score")), k, key)


def occurrence_fuse(rounds: DataFrame, k: int = 10, c: int = 60, key: str = "text") -> DataFrame:
    """Bag of the results of several rounds: score is the number of times found / (c + 1); keeps the best raw score."""
    return top_k(rounds.groupBy("query_id", key).agg((F.count("*") / F.lit(c + 1.0)).alias("score"), F.max("score").alias("best_raw")), k, key)


def reciprocal_rank_fuse(rounds: DataFrame, k: int = 10, c: int = 60, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion proper: the sum of 1 / (c + rank)."""
    return top_k(rounds.groupBy("query_id", key).agg(F.sum(1 / (F.lit(float(c)) + F.col("rank"))).alias("score")), k, key)


def terms(x: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != ""))


def grade(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Rule grading of (query_id, text) by hits (query_id, rank, text, score): score, level.

    s = .4 min(2 mean score, 1) + .4 mean coverage of the query's terms by the first three + .2 the first's coverage;
    halved where the first covers under .1 and the mean is under .3. high from .6, medium from .3. No hits: 0, low.
    """
    q = queries.select("query_id", terms("text").alias("q"))
    joined = hits.where("rank <= 3").select("query_id", "rank", F.col("text").alias("hit")).join(q, "query_id")
    cover = F.size(F.array_intersect("q", terms("hit"))) / F.greatest(F.size("q"), F.lit(1))
    covered = joined.groupBy("query_id").agg(F.avg(cover).alias("avg_cov"), F.max(F.when(F.col("rank") == 1, cover)).alias("cov1"))
    mean = hits.groupBy("query_id").agg(F.avg("score").alias("avg_score"))
    s = 0.4 * F.least(F.col("avg_score") * 2, F.lit(1.0)) + 0.4 * F.col("avg_cov") + 0.2 * F.col("cov1")
    s = F.least(F.when((F.col("cov1") < 0.1) & (F.col("avg_score") < 0.3), s * 0.5).otherwise(s), F.lit(1.0))
    out = q.select("query_id").join(covered.join(mean, "query_id").select("query_id", s.alias("score")), "query_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("level", F.when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.3, "medium").otherwise("low"))


def correct(verdicts: DataFrame, hits: DataFrame, medium_rounds: DataFrame, low_rounds: DataFrame, k: int = 10, key: str = "text") -> DataFrame:
    """By level: high keeps its hits; medium and low add the results of further rounds and fuse by occurrence."""
    cols = ["query_id", key, "score"]
    of = lambda df, level: df.join(verdicts.where(F.col("level") == level).select("query_id"), "query_id", "left_semi").select(cols)
    mixed = of(hits, "medium").unionByName(of(medium_rounds, "medium")).unionByName(of(hits, "low")).unionByName(of(low_rounds, "low"))
    return top_k(of(hits, "high"), k, key).select(*cols, "rank").unionByName(occurrence_fuse(mixed, k, key=key).select(*cols, "rank"))


def rerank_gate(hits: DataFrame, least: int = 3, variance: float = 0.1, always_over: int | None = None) -> DataFrame:
    """(query_id, rerank): at least 3 hits and a population variance of the scores under 0.1."""
    g = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.var_pop("score").alias("variance"))
    go = (F.col("n") >= least) & (F.col("variance") < variance)
    return g.select("query_id", "n", "variance", (go if always_over is None else go | (F.col("n") > always_over)).alias("rerank"))


def overlap_score(query: Column, passage: Column) -> Column:
    """The default relevance scorer: part of the query's terms that the passage holds. A model's UDF may take its place."""
    return F.size(F.array_intersect(terms(query), terms(passage))) / F.greatest(F.size(terms(query)), F.lit(1))


def rerank(queries: DataFrame, hits: DataFrame, k: int, threshold: float = 0.0, scorer=overlap_score, adaptive: bool = True, key: str = "chunk_id") -> DataFrame:
    """Orders the hits of gated queries by the scorer, drops those under the threshold if it is over 0; others keep theirs."""
    gated = hits.join(rerank_gate(hits).select("query_id", "rerank"), "query_id") if adaptive else hits.withColumn("rerank", F.lit(True))
    scored = gated.join(queries.select("query_id", F.col("text").alias("__q")), "query_id").withColumn("rerank_score", F.when(F.col("rerank"), scorer(F.col("__q"), F.col("text"))).otherwise(F.col("score"))).drop("__q")
    kept = scored.where(~F.col("rerank") | (F.col("rerank_score") >= threshold)) if threshold > 0 else scored
    return top_k(kept.drop("rank"), k, key, "rerank_score")


def answerable(queries: DataFrame, hits: DataFrame, kind: Column, threshold: Column) -> DataFrame:
    """Whether the best score reaches the threshold of the question's type."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    out = queries.select("query_id", kind.alias("kind"), threshold.alias("threshold")).join(best, "query_id", "left")
    return out.withColumn("best", F.coalesce("best", F.lit(0.0))).withColumn("answerable", F.col("best") >= F.col("threshold"))
