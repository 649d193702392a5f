"""The maintained text index against plain BM25 after inserts and deletes; exact and partitioned vector search against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieval, textindex
from lectern.operators.textindex import TextIndex
from lectern.operators.vectorindex import VectorIndex, learn_centroids


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(80)] + ["the"] * 40
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 60))))) for i in range(700)] + [(700, None), (701, ""), (702, "the"), (703, "w1 w1 w1")]
    return spark.createDataFrame(rows, "chunk_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 the"), (2, "w3 w3 w70"), (3, "unknown words"), (4, "the"), (5, "")], "query_id long, text string")


def best(df, k=7):
    return sorted((r.query_id, r.chunk_id, round(r.score, 6)) for r in retrieval.top_k(df.withColumn("score", F.round("score", 6)), k).collect())


def test_inserts_and_deletes(spark, docs, asked, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"))
    assert index.search(asked, 5).collect() == [] and index.stats() == (0, 0.0)
    index.delete(docs)
    index.insert(docs.where("chunk_id % 3 = 0"))
    index.insert(docs.where("chunk_id % 3 > 0"))
    assert best(index.search(asked, 7)) == best(retrieval.bm25(asked, docs))
    gone = docs.where("chunk_id % 5 = 0 or chunk_id > 5000")
    index.delete(gone)
    index.delete(gone)  # a second time changes nothing
    left = docs.where("chunk_id % 5 <> 0")
    assert best(index.search(asked, 7)) == best(retrieval.bm25(asked, left))
    assert index.stats()[0] == left.count()
    changed = docs.where("chunk_id % 10 = 0").withColumn("text", F.concat_ws(" ", "text", F.lit("w2 again")))
    index.insert(changed)  # ids that were deleted come back with other texts
    now = left.unionByName(changed)
    assert best(index.search(asked, 7)) == best(retrieval.bm25(asked, now))
    assert best(index.compact(str(tmp_path / "one")).search(asked, 7)) == best(retrieval.bm25(asked, now))
    df = {r.token: r.df for r in index.frequencies().collect()}
    assert df == {r.token: r.df for r in retrieval.postings(now).groupBy("token").agg(F.count("*").alias("df")).collect()}


def test_broken_batch_is_not_seen(spark, docs, asked, tmp_path):
    index = TextIndex(spark, str(tmp_path / "ix"))
    index.insert(docs.where("chunk_id < 300"))
    docs.where("chunk_id >= 300").select("chunk_id", F.lit(1).alias("dl")).write.parquet(str(tmp_path / "ix" / "docs" / "1"))  # a run that ended here
    assert best(index.search(asked, 7)) == best(retrieval.bm25(asked, docs.where("chunk_id < 300")))
    index.insert(docs.where("chunk_id >= 300"))
    assert best(index.search(asked, 7)) == best(retrieval.bm25(asked, docs))


def test_weights_steps_and_blocks(spark, docs, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK_QUERIES", 2)
    index = TextIndex(spark, str(tmp_path / "ix"))
    index.insert(docs)
    weighed = asked.withColumn("weight", F.lit(0.5)).unionByName(asked.withColumn("weight", F.lit(0.25)))
    assert best(index.search(weighed, 7)) == best(retrieval.bm25(weighed, docs))
    plan = index.search(asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(token" in plan


def test_index_of_is_built_once(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    first = textindex.index_of(table, "chunk_id")
    assert textindex.index_of(table, "chunk_id") is first and first.stats()[0] == docs.count()
    docs.limit(1).write.mode("append").parquet(str(tmp_path / "docs"))
    again = textindex.index_of(spark.read.parquet(str(tmp_path / "docs")), "chunk_id")
    assert again is not first and again.stats()[0] == docs.count() + 1


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 16))
    x = centers[rng.integers(0, 12, 3000)] + 0.35 * rng.standard_normal((3000, 16))
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0, 2.0]), (3005, [None] * 16)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "chunk_id long, embedding array<double>")
    return x, rows, rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return {(i, int(j)) for i in range(0, 3000, 100) for j in np.argsort(-(u @ u[i]), kind="stable")[:k]}


def test_knn(space, spark):
    x, rows, queries = space
    assert {(r.query_id, r.chunk_id) for r in retrieval.knn(queries, rows, 6).collect()} == brute(x, 6)
    assert [(r.query_id, r.chunk_id, round(r.score, 9)) for r in retrieval.knn(spark.createDataFrame([(9, [2.0, 4.0])], "query_id long, embedding array<double>"), rows, 3).collect()] == [(9, 3004, 1.0)]
    assert retrieval.knn(queries.limit(0), rows, 3).collect() == [] and retrieval.knn(queries, rows.limit(0), 3).collect() == []
    by = retrieval.knn(queries, rows.withColumn("part", F.col("chunk_id") % 2), 2, by="part").collect()
    assert len(by) == 30 * 4 and all(r.chunk_id % 2 == r.part for r in by)


def test_partitioned_index(space, spark, tmp_path):
    x, rows, queries = space
    index = VectorIndex.build(rows, str(tmp_path / "ivf"), 24)
    assert {(r.query_id, r.chunk_id) for r in index.search(queries, 6, 24).collect()} == brute(x, 6)
    probes = index.probes_for(queries, rows, 6)
    recall, share = index.measure(queries, rows, 6, probes)
    assert recall >= 0.9 and share < 0.35
    one = index.search(queries, 6, 1)
    assert "PartitionFilters: [list" in one._jdf.queryExecution().executedPlan().toString().replace("isnotnull(list", "list")
    index.insert(rows.where("chunk_id = 7").select((F.col("chunk_id") + 9000).alias("chunk_id"), "embedding"))
    again = index.search(rows.where("chunk_id = 7").select(F.col("chunk_id").alias("query_id"), "embedding"), 2, 2).collect()
    assert {r.chunk_id for r in again} == {7, 9007}


def test_no_vectors(space, spark, tmp_path):
    _, rows, queries = space
    assert learn_centroids(rows.limit(0), 4).shape == (0, 0)
    index = VectorIndex.build(rows.where("chunk_id = 3002"), str(tmp_path / "none"), 4)
    assert index.search(queries, 3, 4).collect() == []


def test_insert_counts_words_without_a_shuffle(spark, tmp_path, request):
    """A chunk's words are counted in its row: postings keep the table's partitions; ids that repeat are still put together."""
    rows = [(i, None if i % 17 == 0 else "" if i % 13 == 0 else " ".join(f"w{(i * j) % 19}" for j in range(i % 40))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "chunk_id long, text string").repartition(7)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", before))
    for n, table in enumerate((docs, docs.unionByName(docs.where("chunk_id < 5")))):
        index = textindex.TextIndex(spark, str(tmp_path / f"ix{n}"), "chunk_id")
        index.insert(table)
        got = spark.read.parquet(str(tmp_path / f"ix{n}" / "postings" / "0"))
        assert dict(got.dtypes) == {"chunk_id": "bigint", "token": "string", "dl": "int", "tf": "int"}
        have = sorted((r.chunk_id, r.token, r.tf) for r in got.collect())
        assert have == sorted((r.chunk_id, r.token, r.tf) for r in retrieval.postings(table).groupBy("chunk_id", "token").agg(F.sum("tf").alias("tf")).collect())
    parts = {r.f for r in spark.read.parquet(str(tmp_path / "ix0" / "postings" / "0")).select("_metadata.file_name").distinct().toDF("f").collect()}
    assert len(parts) == docs.rdd.getNumPartitions()


def test_insert_splits_texts_into_words_once(spark, tmp_path):
    """Each text was split into words for its length, for a filter and for its counts."""
    split = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        split.add(1)
        return text

    docs = spark.createDataFrame([(i, f"w{i % 7} w1" if i % 9 else None) for i in range(200)], "chunk_id long, text string")
    index = TextIndex(spark, str(tmp_path / "once"))
    index.insert(docs.withColumn("text", seen("text")))
    assert split.value <= 400 and index.stats() == (200, 2.0)  # once for the words, once for which texts are null


def test_steps_give_what_may_be_best_only(spark, tmp_path, monkeypatch):
    """A step gave its own k best, however far below those of the steps before."""
    monkeypatch.setattr(textindex, "STEP", 10)
    docs = spark.createDataFrame([(i, "w1 " * (1 if i else 9) + "x " * 20) for i in range(400)] + [(400 + i, "y") for i in range(600)], "chunk_id long, text string").coalesce(1)
    index = TextIndex(spark, str(tmp_path / "few"))
    index.insert(docs)
    found = index.search(spark.createDataFrame([(1, "w1")], "query_id long, text string"), 1)
    assert [r.chunk_id for r in retrieval.top_k(found, 1).collect()] == [0]
    monkeypatch.setattr(textindex, "CELLS", 1)
    again = index.search(spark.createDataFrame([(1, "w1 y")], "query_id long, text string"), 3)
    assert best(again, 3) == best(retrieval.bm25(spark.createDataFrame([(1, "w1 y")], "query_id long, text string"), docs), 3)


def test_best_of_in_steps(monkeypatch):
    """Matrices are bounded by rows and queries, however many there are; later slices give only what may still be best."""
    monkeypatch.setattr(retrieval, "QUERIES_A_STEP", 7)
    rng = np.random.default_rng(4)
    x, q = np.round(rng.standard_normal((300, 5)), 1), rng.standard_normal((33, 5))
    floor, got, given = np.full(33, -np.inf), {}, []
    for lo in range(0, 300, 40):
        for d, j, score in retrieval.best_of(x[lo : lo + 40], q, 6, floor):
            assert j.max() - j.min() < 7
            given.append(len(d))
            for row, query, value in zip(d + lo, j, score, strict=True):
                got.setdefault(query, []).append((-value, row))
    whole = np.clip(x @ q.T, -1, 1)
    for query in range(33):
        at_least = np.sort(x @ q[query])[-6] - 1e-12
        assert set(np.flatnonzero(x @ q[query] >= at_least)) <= {r for _, r in got[query]} and all(abs(-v - whole[r, query]) < 1e-12 for v, r in got[query])
    assert sum(given) < 33 * 6 * 8 * 0.7
