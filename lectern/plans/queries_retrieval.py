"""Queries of search, fusion, grading and reranking. Query set: the benchmark's items, and vectors whose id divides by 50."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import retrieval as r
from lectern.operators.textindex import index_of
from lectern.operators.vectorindex import VectorIndex
from lectern.plans.catalog import Tables, query
from lectern.session import shared_folder, written

_TOKENS = r"regexp_extract_all(regexp_replace(lower({}), '([a-z])[-_]([a-z])', '\1\2', 'g'), '[\p{{L}}\p{{N}}]+')"
BM25 = rf"""
    tok AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents),
    post AS (SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
    len AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY ALL),
    st AS (SELECT count(*) AS n, (SELECT count(*) FROM tok) / count(*) AS avgdl FROM documents),
    dfr AS (SELECT token, ln(st.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY token, st.n),
    idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfr) ELSE raw END AS idf FROM dfr),
    qt AS (SELECT query_id, token, sum(weight) AS qw FROM (SELECT query_id, weight, unnest({_TOKENS.format("text")}) AS token FROM q) GROUP BY ALL),
    bm AS (SELECT query_id, post.doc_id, round(sum(qw * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM qt JOIN post USING (token) JOIN idf USING (token) JOIN len ON len.doc_id = post.doc_id, st GROUP BY ALL)"""
Q1 = "q AS (SELECT item_id AS query_id, 1.0 AS weight, text FROM benchmark)"
COS = """kn AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
         FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"""


def top(source: str, k: int, by: str = "query_id", ident: str = "doc_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {ident}) AS rank FROM {source} QUALIFY rank <= {k}"


def benchmark_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def text_scores(t: Tables, queries: DataFrame | None = None) -> DataFrame:
    return index_of(t.documents, "doc_id").search(queries or benchmark_queries(t), 20).withColumn("score", F.round("score", 6))


def vector_queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {Q1}, {BM25}, t AS ({top('bm', 10)}) SELECT query_id, doc_id, score, rank FROM t")
def bm25_topk(t: Tables) -> DataFrame:
    return _ranked(r.top_k(text_scores(t), 10, "doc_id")).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH q AS (SELECT item_id AS query_id, 1.0 AS weight, text FROM benchmark UNION ALL SELECT item_id, 0.9, text || ' ' || text FROM benchmark
       UNION ALL SELECT b.item_id, 0.7, c.text FROM benchmark b JOIN benchmark c ON c.item_id = b.item_id + 1), {BM25}, t AS ({top('bm', 10)}) SELECT query_id, doc_id, score, rank FROM t""")
def multi_query_bm25(t: Tables) -> DataFrame:
    b = benchmark_queries(t)
    q = b.withColumn("weight", F.lit(1.0)).unionByName(b.select("query_id", F.concat("text", F.lit(" "), "text").alias("text"), F.lit(0.9).alias("weight"))).unionByName(b.select((F.col("query_id") - 1).alias("query_id"), "text", F.lit(0.7).alias("weight")).join(b.select("query_id"), "query_id", "left_semi"))
    return _ranked(r.top_k(text_scores(t, q), 10, "doc_id")).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {Q1}, {BM25}, t AS ({top('bm', 20)}), d AS (SELECT t.query_id, t.doc_id, t.score, documents.text, t.rank AS r0 FROM t JOIN documents USING (doc_id)),
       e AS (SELECT query_id, doc_id, score FROM d QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY r0) = 1), f AS ({top('e', 10)}) SELECT query_id, doc_id, score, rank FROM f""")
def bm25_topk_distinct_text(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    first = r.top_k(text_scores(t), 20, "doc_id")
    from pyspark.sql import Window

    best = Window.partitionBy("query_id", F.xxhash64("text"), "text").orderBy("rank")
    once = first.join(docs, "doc_id").withColumn("n", F.row_number().over(best)).where("n = 1").select("query_id", "doc_id", "score")
    return _ranked(r.top_k(once, 10, "doc_id"))


@query(f"WITH {Q1}, {BM25} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf) AS vocabulary, round((SELECT avg(idf) FROM idf), 6) AS mean_idf FROM st")
def bm25_corpus_stats(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    df = r.postings(docs, "doc_id").groupBy("token").agg(F.count("*").alias("df"))
    s = r.corpus_stats(docs)
    raw = df.crossJoin(F.broadcast(s)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    g = raw.agg(F.count("*").alias("vocabulary"), F.avg(F.when(F.col("raw") >= 0, F.col("raw"))).alias("pos"), F.sum((F.col("raw") >= 0).cast("long")).alias("n_pos"), F.avg("raw").alias("mean"))
    mean = (F.coalesce("pos", F.lit(0.0)) * F.col("n_pos") + 0.25 * F.col("mean") * (F.col("vocabulary") - F.col("n_pos"))) / F.col("vocabulary")
    return s.crossJoin(g).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "vocabulary", F.round(mean, 6).alias("mean_idf"))


@query(f"WITH {COS}, t AS ({top('kn', 10)}) SELECT query_id, doc_id AS vec_id, score, rank FROM t")
def knn_cosine_topk(t: Tables) -> DataFrame:
    hits = r.knn(vector_queries(t), t.embeddings, 12, "vec_id").withColumn("score", F.round("score", 6)).drop("rank")
    return _ranked(r.top_k(hits, 10, "vec_id")).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {COS}, t AS ({top('kn', 10)}) SELECT query_id, doc_id AS vec_id, score, rank FROM t")
def ivf_every_list(t: Tables) -> DataFrame:
    """The partitioned index with every list probed finds what the exact search does."""
    index = VectorIndex.build(t.embeddings, f"{shared_folder(t.spark)}/ivf-{uuid.uuid4().hex}", 12, "vec_id")
    hits = index.search(vector_queries(t), 12, 12).withColumn("score", F.round("score", 6)).drop("rank")
    return _ranked(r.top_k(hits, 10, "vec_id")).select("query_id", "vec_id", "score", "rank")


@query()
def ivf_recall(t: Tables) -> DataFrame:
    """Probes that reach nine tenths of the exact search's hits, and the share of the rows that they read."""
    index = VectorIndex.build(t.embeddings, f"{shared_folder(t.spark)}/ivf-{uuid.uuid4().hex}", 32, "vec_id")
    exact = index.exact(vector_queries(t), t.embeddings, 10)
    probes = index.probes_for(vector_queries(t), t.embeddings, 10, exact=exact)
    recall, share = index.measure(vector_queries(t), t.embeddings, 10, probes, exact)
    return t.spark.createDataFrame([(probes, recall, share)], "probes int, recall double, share double")


@query(f"""WITH {COS}, l AS (SELECT kn.query_id, e.label, kn.doc_id, kn.score FROM kn JOIN embeddings e ON e.vec_id = kn.doc_id WHERE kn.doc_id <> kn.query_id),
       t AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, doc_id) AS rank FROM l QUALIFY rank <= 2) SELECT query_id, label, doc_id AS vec_id, score, rank FROM t""")
def knn_per_label(t: Tables) -> DataFrame:
    hits = r.knn(vector_queries(t), t.embeddings, 5, "vec_id", by="label").where("vec_id <> query_id")
    best = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "vec_id")
    rounded = hits.drop("rank").withColumn("score", F.round("score", 6))
    return _ranked(rounded.withColumn("rank", F.row_number().over(best)).where("rank <= 2"))


def _pools(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Vector hits of query i are those of vector i; both pools of 20."""
    q = t.embeddings.join(F.broadcast(t.benchmark.select(F.col("item_id").alias("vec_id"))), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    v = r.knn(q, t.embeddings.withColumnRenamed("vec_id", "doc_id"), 30, "doc_id").withColumn("score", F.round("score", 6)).drop("rank")
    return r.top_k(v, 20, "doc_id").drop("rank"), r.top_k(text_scores(t), 20, "doc_id").drop("rank")


POOLS = f"""{Q1}, {BM25}, kv AS (SELECT b.item_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
       FROM benchmark b JOIN embeddings a ON a.vec_id = b.item_id, embeddings e),
       vh AS ({top('kv', 20)}), bh AS ({top('bm', 20)}),
       vn AS (SELECT *, score / CASE WHEN max(score) OVER w > 0 THEN max(score) OVER w ELSE 1 END AS s, count(*) OVER w AS n FROM vh WINDOW w AS (PARTITION BY query_id)),
       bn AS (SELECT *, score / CASE WHEN max(score) OVER w > 0 THEN max(score) OVER w ELSE 1 END AS s, count(*) OVER w AS n FROM bh WINDOW w AS (PARTITION BY query_id)),
       al AS (SELECT coalesce(vn.query_id, bn.query_id) AS query_id, coalesce(vn.doc_id, bn.doc_id) AS doc_id, vn.s AS sv, bn.s AS sb, vn.rank AS rv, bn.rank AS rb, vn.n AS nv, bn.n AS nb
              FROM vn FULL JOIN bn ON vn.query_id = bn.query_id AND vn.doc_id = bn.doc_id),
       am AS (SELECT *, coalesce(max(nv) OVER (PARTITION BY query_id), 0) AS mv, coalesce(max(nb) OVER (PARTITION BY query_id), 0) AS mb FROM al),
       fu AS (SELECT query_id, doc_id, round(0.5 * coalesce(sv, 0) + 0.5 * coalesce(sb, 0) + 0.001 / (least(coalesce(rv, mv + 1), coalesce(rb, mb + 1)) + 5), 6) AS score FROM am),
       si AS (SELECT query_id, doc_id, round(coalesce(0.5 * sv + 0.5 * sb, sv, sb), 6) AS score FROM al)"""


def _rounded_top(df: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return _ranked(r.top_k(df.withColumn("score", F.round("score", 6)).drop("rank"), k, key))


@query(f"WITH {POOLS}, t AS ({top('fu', 5)}) SELECT query_id, doc_id, score, rank FROM t")
def hybrid_fusion(t: Tables) -> DataFrame:
    v, b = _pools(t)
    return _rounded_top(r.fuse(v, b, 40, 0.5, "doc_id"), 5)


@query(f"WITH {POOLS}, t AS ({top('si', 5)}) SELECT query_id, doc_id, score, rank FROM t")
def simple_fusion(t: Tables) -> DataFrame:
    v, b = _pools(t)
    return _rounded_top(r.simple_fuse(v, b, 40, "doc_id"), 5)


@query(f"""WITH {POOLS}, ro AS (SELECT query_id, doc_id, score FROM vh UNION ALL SELECT query_id, doc_id, score FROM bh),
       oc AS (SELECT query_id, doc_id, round(count(*) / 61.0, 6) AS score, max(score) AS best_raw FROM ro GROUP BY ALL), t AS ({top('oc', 10)}) SELECT query_id, doc_id, score, best_raw, rank FROM t""")
def crag_rrf(t: Tables) -> DataFrame:
    v, b = _pools(t)
    return _rounded_top(r.occurrence_fuse(v.unionByName(b), 40, key="doc_id"), 10).select("query_id", "doc_id", "score", "best_raw", "rank")


@query(f"""WITH {POOLS}, ro AS (SELECT query_id, doc_id, rank FROM vh UNION ALL SELECT query_id, doc_id, rank FROM bh),
       rr AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM ro GROUP BY ALL), t AS ({top('rr', 10)}) SELECT query_id, doc_id, score, rank FROM t""")
def reciprocal_rank_fusion(t: Tables) -> DataFrame:
    v, b = _pools(t)
    rounds = r.top_k(v, 20, "doc_id").unionByName(r.top_k(b, 20, "doc_id"))
    return _rounded_top(r.reciprocal_rank_fuse(rounds, 40, key="doc_id"), 10)


GRADE = f"""WITH {Q1}, {BM25}, h0 AS ({top('bm', 5)}), h AS (SELECT h0.query_id, h0.rank, round(h0.score / 100, 6) AS score, d.text FROM h0 JOIN documents d USING (doc_id)),
       qq AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM q),
       cv AS (SELECT h.query_id, h.rank, len(list_intersect(qq.t, list_distinct(list_filter(regexp_split_to_array(lower(h.text), '\\s+'), lambda x: x <> '')))) / greatest(len(qq.t), 1) AS c FROM h JOIN qq USING (query_id) WHERE h.rank <= 3),
       ag AS (SELECT query_id, avg(c) AS ac, max(CASE WHEN rank = 1 THEN c END) AS c1 FROM cv GROUP BY ALL),
       mn AS (SELECT query_id, avg(score) AS m, count(*) AS n, var_pop(score) AS v FROM h GROUP BY ALL),
       sc AS (SELECT query_id, 0.4 * least(m * 2, 1) + 0.4 * ac + 0.2 * c1 AS s, c1, m FROM ag JOIN mn USING (query_id)),
       gr AS (SELECT q.query_id, coalesce(round(least(CASE WHEN c1 < 0.1 AND m < 0.3 THEN s * 0.5 ELSE s END, 1.0), 6), 0.0) AS score FROM q LEFT JOIN sc USING (query_id))"""


def _hits(t: Tables, k: int = 5) -> DataFrame:
    return r.top_k(text_scores(t), k, "doc_id").withColumn("score", F.round(F.col("score") / 100, 6)).join(t.documents.select("doc_id", "text"), "doc_id")


@query(f"{GRADE} SELECT query_id, score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM gr")
def crag_rules(t: Tables) -> DataFrame:
    return r.grade(benchmark_queries(t), _hits(t)).withColumn("score", F.round("score", 6))


@query(f"{GRADE} SELECT query_id, n, round(v, 6) AS variance, n >= 3 AND v < 0.1 AS rerank FROM mn")
def rerank_gate(t: Tables) -> DataFrame:
    return r.rerank_gate(_hits(t)).withColumn("variance", F.round("variance", 6))


@query(f"""{GRADE}, rs AS (SELECT h0.query_id, h0.doc_id, round(len(list_intersect(qq.t, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> '')))) / greatest(len(qq.t), 1), 6) AS score
       FROM h0 JOIN documents d USING (doc_id) JOIN qq ON qq.query_id = h0.query_id), t AS ({top('rs', 3)}) SELECT query_id, doc_id, score AS rerank_score, rank FROM t""")
def rerank_topk(t: Tables) -> DataFrame:
    out = r.rerank(benchmark_queries(t), _hits(t), 5, adaptive=False, key="doc_id")
    return _ranked(r.top_k(out.withColumn("rerank_score", F.round("rerank_score", 6)).drop("rank"), 3, "doc_id", "rerank_score")).select("query_id", "doc_id", "rerank_score", "rank")


@query(f"""{GRADE}, g2 AS (SELECT query_id, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM gr),
       ex AS ({top('bm', 8)}), bag AS (SELECT h0.query_id, h0.doc_id, round(h0.score / 100, 6) AS score, 0 AS more FROM h0 UNION ALL SELECT query_id, doc_id, round(score / 100, 6), 1 FROM ex),
       hi AS (SELECT bag.query_id, doc_id, score FROM bag JOIN g2 USING (query_id) WHERE level = 'high' AND more = 0),
       lo AS (SELECT bag.query_id, doc_id, round(count(*) / 61.0, 6) AS score FROM bag JOIN g2 USING (query_id) WHERE level <> 'high' GROUP BY ALL),
       un AS (SELECT * FROM hi UNION ALL SELECT * FROM lo), t AS ({top('un', 10)}) SELECT query_id, doc_id, score, rank FROM t""")
def crag_correct(t: Tables) -> DataFrame:
    more = written(_hits(t, 8), "hits")  # searched once
    hits = more.where("rank <= 5")
    v = r.grade(benchmark_queries(t), hits).withColumn("score", F.round("score", 6)).withColumn("level", F.when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.3, "medium").otherwise("low"))
    return _ranked(r.correct(v, hits, more, more, 10, "doc_id").withColumn("score", F.round("score", 6)))


@query(f"""{GRADE}, an AS (SELECT q.query_id, CASE WHEN regexp_matches(lower(text), '\\?$') THEN 'boolean' ELSE 'unknown' END AS k0 FROM q),
       be AS (SELECT query_id, max(score) AS best FROM h GROUP BY ALL)
       SELECT q.query_id, coalesce(be.best, 0.0) AS best, coalesce(be.best, 0.0) >= 0.15 AS answerable FROM q LEFT JOIN be USING (query_id)""")
def answerability(t: Tables) -> DataFrame:
    q = benchmark_queries(t)
    return r.answerable(q, _hits(t), F.lit("unknown"), F.lit(0.15)).select("query_id", "best", "answerable")


@query(f"""{GRADE}, pt AS (SELECT h0.query_id, h0.doc_id, h0.rank, d.source, d.text FROM (SELECT * FROM ({top('bm', 20)})) h0 JOIN documents d USING (doc_id)),
       f1 AS (SELECT *, min(rank) OVER (PARTITION BY query_id, source) AS first, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM pt),
       f2 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS g FROM f1 WHERE n <= 2)
       SELECT query_id, source AS file_name, g AS paper_no, n AS excerpt_no, substring(text, 1, 300) AS excerpt FROM f2 WHERE g <= 5""")
def group_excerpts(t: Tables) -> DataFrame:
    from lectern.operators.library import group_excerpts as run

    hits = _hits(t, 20).join(t.documents.select("doc_id", F.col("source").alias("file_name")), "doc_id")
    return run(hits).withColumns({c: F.col(c).cast("long") for c in ("paper_no", "excerpt_no")})


@query(f"""{GRADE}, ctx AS (SELECT h.query_id, string_agg('[来源' || h.rank || '] unknown' || chr(10) || h.text, chr(10) || chr(10) ORDER BY h.rank) AS context FROM h GROUP BY ALL)
       SELECT query_id, md5(context) AS digest, length(context) AS n_chars FROM ctx""")
def answer_context(t: Tables) -> DataFrame:
    from lectern.plans.pipelines import answer_context as run

    c = run(_hits(t).withColumn("file_name", F.lit(None).cast("string")))
    return c.select("query_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"))


@query()
def search_pipeline(t: Tables) -> DataFrame:
    from lectern.functions.boundary import embed
    from lectern.plans.pipelines import search

    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("file_name"), embed(F.col("text")).alias("embedding")).where("embedding is not null")
    chunks = written(chunks, "chunks")  # embedded once
    q = benchmark_queries(t).withColumn("embedding", embed(F.col("text")))
    return search(q, chunks).select("query_id", "rank", "chunk_id", "rerank_score", "quality", "level", "mode")
