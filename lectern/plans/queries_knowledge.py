"""Queries of enrichment, model steps, fused knowledge, figures, and the runs that index and evaluate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import graph, knowledge, multimodal
from lectern.plans import pipelines
from lectern.plans.catalog import Tables, query
from lectern.plans.queries_graph import V, vertices
from lectern.plans.queries_library import CH, chunks
from lectern.plans.queries_sources import _folder
from lectern.sources import sinks


def _pick(key: str, *values: str):
    """One of the values, by the remainder of the key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


@query("""WITH w AS (SELECT lower(p_name) AS k, p_type || ', ' || p_brand AS a, 1900 + p_partkey % 100 AS y, '10.' || p_partkey AS d FROM part WHERE p_partkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1)
          SELECT p_partkey AS ref_id, coalesce(a, 'x') AS ref_authors, CAST(coalesce(y, 7) AS INTEGER) AS ref_year, coalesce(d, '') AS ref_doi FROM part LEFT JOIN w ON lower(p_name) = k""")
def enriched_references(t: Tables) -> DataFrame:
    refs = t.part.select(F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("ref_title"), F.lit("x").alias("ref_authors"), F.lit(7).alias("ref_year"), F.lit("").alias("ref_doi"))
    date = F.concat((F.col("p_partkey") % 100 + 1900).cast("string"), F.lit("-01-02"))
    works = t.part.where("p_partkey % 3 = 0").select(F.upper("p_name").alias("title"), F.array("p_type", "p_brand").alias("authors"), date.alias("published_date"), F.concat(F.lit("10."), "p_partkey").alias("doi"), F.col("p_partkey").alias("rank"))
    return knowledge.enrich_references(refs, works).drop("ref_title")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 4 = 0 THEN 'failed' WHEN n_nationkey % 3 = 0 THEN 'skipped' WHEN n_nationkey % 2 = 1 THEN 'success' ELSE 'failed' END AS status
          FROM nation WHERE n_nationkey % 7 <> 0) GROUP BY status""")
def fetch_status(t: Tables) -> DataFrame:
    n = t.nation.withColumnRenamed("n_nationkey", "query_id")
    wanted = n.select("query_id", F.when(F.col("query_id") % 7 != 0, F.col("n_name")).otherwise(" ").alias("title"))
    name = F.concat("n_name", F.lit(".pdf")).alias("file_name")
    hits = n.where("query_id % 5 <> 0").select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), F.when((F.col("query_id") % 4 != 0), F.concat(F.lit("https://x.org/"), "query_id")).alias("url"), name)
    plan = knowledge.fetch_plan(wanted, hits, n.where("query_id % 3 = 0").select(name))
    return knowledge.status_counts(knowledge.fetched(plan, lambda url: F.when(url.rlike("[13579]$"), url.cast("binary"))))


@query("SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN 0.7 WHEN 1 THEN 0.25 WHEN 2 THEN 0.7 WHEN 3 THEN 0.8 ELSE 0.5 END::DOUBLE AS alpha FROM nation")
def fusion_weights(t: Tables) -> DataFrame:
    told = _pick("n_nationkey", "0.7 / 0.3", "0.2, 0.6", "use 7:3", "BM25 0.8", "neither")
    return t.nation.select(F.col("n_nationkey").alias("query_id"), F.round(knowledge.fusion_weight(told), 9).alias("alpha"))


@query("""SELECT item_id AS query_id, 0 AS variant_no, 1.0::DOUBLE AS weight, md5(text) AS digest FROM benchmark UNION ALL SELECT item_id, 1, 0.9, md5('again ' || item_id) FROM benchmark
          UNION ALL SELECT item_id, i + 1, 0.7, md5(['a 1', 'b'][i]) FROM benchmark, (SELECT unnest([1, 2]) AS i) WHERE item_id % 3 = 0
          UNION ALL SELECT item_id, i + 1, 0.7, md5(['first one', 'second', 'third'][i]) FROM benchmark, (SELECT unnest([1, 2, 3]) AS i) WHERE item_id % 3 = 1""")
def query_variants(t: Tables) -> DataFrame:
    told = _pick("item_id", 'Sure: ["a 1", "b"]', '1. "first one"\n2. "second"\n3. "third"\n4. "fourth"', "none")
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text", "item_id")
    return knowledge.query_variants(q, F.concat(F.lit("again "), "item_id"), told).select("query_id", "variant_no", "weight", F.md5("text").alias("digest"))


@query("SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 WHEN 2 THEN 0.2 ELSE 0.0 END::DOUBLE AS score, CASE item_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level FROM benchmark")
def model_grades(t: Tables) -> DataFrame:
    told = _pick("query_id", '{"score": 0.9, "level": "high"}', 'so {"score": 1.4, "level": "odd"} it is', '{"score": 0.2, "level": "low", "reasoning": "a "b" c"}', "no answer")
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    hits = t.documents.where("false").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), "text", F.lit(0.5).alias("score"))
    return knowledge.model_grade(q, hits, told)


def _evidence(t: Tables) -> DataFrame:
    rows = t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank"))
    return rows.withColumn("text", F.expr("repeat(char(96 + rank), if(query_id % 2 = 0, 900, 960))"))


@query("""SELECT item_id AS query_id, md5('[Evidence 1]' || chr(10) || repeat('a', n) || chr(10) || chr(10) || '[Evidence 2]' || chr(10) || repeat('b', n) || chr(10) || chr(10) || '[Evidence 3]' || chr(10) || repeat('c', n) || chr(10) || chr(10) || '[Evidence 4]' || chr(10) || repeat('d', n)
          || CASE WHEN n = 900 THEN chr(10) || chr(10) || '[Evidence 5]' || chr(10) || repeat('e', 400) ELSE '' END) AS digest FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 900 ELSE 960 END AS n FROM benchmark)""")
def evidence_context(t: Tables) -> DataFrame:
    return knowledge.evidence_text(_evidence(t)).select("query_id", F.md5("evidence").alias("digest"))


@query("SELECT item_id AS query_id, item_id % 3 = 2 AS is_supported, CASE item_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM benchmark")
def entailment(t: Tables) -> DataFrame:
    answers = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), _pick("item_id", "", "one", "two").alias("answer"))
    judge = lambda question, answer, evidence: F.when(answer == "one", 'so {"is_supported": false, "confidence": 0.8}').otherwise("unsure")
    return knowledge.entailment(answers, _evidence(t), judge)


@query(f"""WITH w AS (SELECT n_regionkey AS q, string_agg(n_nationkey || '. **' || n_name || '**' || chr(10) || '   s' || n_nationkey || chr(10), chr(10) ORDER BY n_nationkey) AS t FROM nation WHERE n_nationkey <= 10 GROUP BY 1),
       l AS (SELECT n_regionkey AS q, 'p' || n_nationkey % 2 AS paper, n_nationkey AS r, n_name, min(n_nationkey) OVER (PARTITION BY n_regionkey, n_nationkey % 2) AS lead, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 2 ORDER BY n_nationkey) AS n FROM nation),
       p AS (SELECT q, lead, '### ' || paper || chr(10) || string_agg('- ' || n_name || '...', chr(10) ORDER BY r) || chr(10) AS t FROM l WHERE n <= 2 GROUP BY q, lead, paper), pp AS (SELECT q, string_agg(t, chr(10) ORDER BY lead) AS t FROM p GROUP BY q)
       SELECT CAST(pp.q AS BIGINT) AS query_id, '{knowledge.KNOWLEDGE.strip()}' || chr(10) || chr(10) || coalesce('{knowledge.WEB.strip()}' || chr(10) || chr(10) || w.t || chr(10), '') || '{knowledge.LOCAL.strip()}' || chr(10) || chr(10) || pp.t AS context FROM pp LEFT JOIN w USING (q)""")
def fused_knowledge(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_regionkey").cast("long").alias("query_id"), F.col("n_nationkey").alias("rank"), "n_name")
    web = n.select("query_id", "rank", F.col("n_name").alias("title"), F.concat(F.lit("s"), "rank").alias("snippet"))
    local = n.select("query_id", "rank", F.concat(F.lit("p"), F.col("rank") % 2).alias("paper"), F.col("n_name").alias("text"))
    return knowledge.fuse_knowledge(web, local)


@query("SELECT n_nationkey AS id, n_name AS title, 3 AS novelty FROM nation")
def asked_ideas(t: Tables) -> DataFrame:
    model = lambda prompt: F.concat(F.lit('<think>[1]</think>Here:\n```json\n[{"title": "'), prompt, F.lit('", "novelty": 3}]\n```'))
    rows = knowledge.ask(t.nation, F.col("n_name"), model, "array<struct<title: string, novelty: int>>", "ideas")
    return rows.select(F.col("n_nationkey").alias("id"), F.explode("ideas").alias("x")).select("id", "x.*")


@query("SELECT item_id AS question_id FROM benchmark ORDER BY item_id LIMIT 7")
def limited_questions(t: Tables) -> DataFrame:
    return knowledge.limit_questions(t.benchmark.select(F.col("item_id").alias("question_id")), 7)


@query("SELECT source AS file_name, doc_id AS chunk_index FROM documents WHERE source IS NOT NULL ORDER BY source, doc_id LIMIT 25")
def first_chunks(t: Tables) -> DataFrame:
    return knowledge.sample_chunks(t.documents.where("source is not null").select(F.col("source").alias("file_name"), F.col("doc_id").alias("chunk_index")), 25, "first")


def _items(t: Tables) -> DataFrame:
    saved = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("f/"), "p_partkey", F.lit(".png")))
    return t.part.select(F.col("p_brand").alias("path"), _pick("p_partkey", "image", "table", "formula").alias("kind"), (F.col("p_partkey") % 10).cast("int").alias("page_number"), F.col("p_partkey").cast("int").alias("item_index"), _pick("p_partkey", "", "Figure 7: x", "Table 12. y", "A view").alias("caption"), saved.alias("saved_path"))


@query("""SELECT p_brand AS path, (p_partkey % 10) || '-' || CASE WHEN p_partkey % 3 = 1 OR p_partkey % 4 = 2 THEN 'Table' ELSE 'Figure' END || CASE p_partkey % 4 WHEN 1 THEN '7' WHEN 2 THEN '12' ELSE CAST(p_partkey AS VARCHAR) END || '-' || p_partkey || '.png' AS file,
          CASE p_partkey % 4 WHEN 1 THEN 'Figure 7: x' WHEN 2 THEN 'Table 12. y' ELSE 'A view' END AS caption FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 4 > 0""")
def figure_files(t: Tables) -> DataFrame:
    return multimodal.figures_and_tables(_items(t))


@query("""SELECT * FROM (SELECT p_brand AS path, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Figure 7: x' WHEN 2 THEN 'Table 12. y' ELSE 'A view' END AS caption, CAST(p_partkey % 10 AS INTEGER) AS page_number,
          CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 10, p_partkey) - 1 AS INTEGER) AS place, CASE WHEN p_partkey % 2 = 0 THEN 'f/' || p_partkey || '.png' END AS saved_path FROM part WHERE p_partkey % 3 = 0) WHERE saved_path IS NOT NULL""")
def figure_paths(t: Tables) -> DataFrame:
    return multimodal.figure_paths(_items(t))


@query("SELECT p_partkey AS chunk_id, i AS ord, 'No caption' AS head, 'e' || i AS tail FROM part, (SELECT unnest(range(5)) AS i)")
def cross_triplets(t: Tables) -> DataFrame:
    blank = [F.lit(x).alias(n) for n, x in (("head_type", "Figure"), ("relation", "shows"), ("relation_type", "cross"), ("tail_type", "Other"), ("evidence", ""))]
    extract = lambda text, caption, path: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(caption.alias("head"), *blank, F.concat(F.lit("e"), i).alias("tail"), F.lit(0.5).alias("confidence")))
    items = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"), F.lit("").alias("caption"), F.lit("x.png").alias("image_path"))
    return multimodal.cross_triplets(items, extract).select("chunk_id", "ord", "head", "tail")


@query(f"WITH {V}, q AS (SELECT lower(n_name) AS name FROM nation UNION SELECT 'nowhere ' || r_regionkey FROM region) SELECT q.name, v.id IS NOT NULL AS contained, v.name AS entity, v.type FROM q LEFT JOIN v ON v.id = lower(q.name)")
def entity_lookup(t: Tables) -> DataFrame:
    names = t.nation.select(F.lower("n_name").alias("name")).unionByName(t.region.select(F.concat(F.lit("nowhere "), "r_regionkey").alias("name")))
    return graph.lookup(vertices(t), names)


@query("SELECT source AS file_name, CAST(sum(CASE WHEN source = 'src3' THEN doc_id * 10 ELSE doc_id END) AS BIGINT) AS total FROM documents WHERE source IS NOT NULL GROUP BY source")
def rebuilt_file(t: Tables) -> DataFrame:
    """A chunk table, of which one file is parsed and written again."""
    path = _folder(t)
    rows = t.documents.where("source is not null").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_name"))
    sinks.rebuild_chunks(rows, path)
    sinks.rebuild_chunks(rows.withColumn("chunk_id", F.col("chunk_id") * 10), path, "src3")
    return t.spark.read.parquet(path).groupBy(F.col("file_name").cast("string").alias("file_name")).agg(F.sum("chunk_id").alias("total"))


@query("SELECT item_id AS question_id, md5(text) AS digest, '[\"a\",\"b\"]' AS contexts FROM benchmark")
def dumped_results(t: Tables) -> DataFrame:
    path = _folder(t)
    sinks.dump(t.benchmark.select(F.col("item_id").alias("question_id"), F.md5("text").alias("digest"), F.array(F.lit("a"), F.lit("b")).alias("contexts")), path, "csv")
    return t.spark.read.option("header", True).option("escape", '"').schema("question_id long, digest string, contexts string").csv(path)


@query("SELECT n_nationkey, '2024-03-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || ' 04:05:06' AS plain, '202403' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '_040506' AS compact FROM nation")
def time_stamps(t: Tables) -> DataFrame:
    at = F.expr("make_timestamp_ntz(2024, 3, n_nationkey + 1, 4, 5, 6)")
    return t.nation.select("n_nationkey", tx.stamp(at).alias("plain"), tx.stamp(at, True).alias("compact"))


@query("SELECT 'p' || n_nationkey AS paper_id, n_name AS paper_title, 'p' || n_nationkey || '.txt' AS file_name, 3 AS chunk_count, 1 AS figure_caption_count, 'dev' AS source_split FROM nation")
def indexed_papers(t: Tables) -> DataFrame:
    texts = F.array(F.struct(F.lit("Intro").alias("section_name"), F.array(F.expr("repeat('ab ', 30)"), F.lit("short"), F.concat(F.expr("repeat('cd ', 30)"), "n_name")).alias("paragraphs")))
    figures = F.array(F.struct(F.lit("fig1.png").alias("file"), F.concat(F.lit("A caption that is long enough: "), "n_name").alias("caption")))
    papers = t.nation.select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), texts.alias("full_text"), figures.alias("figures_and_tables"))
    return pipelines.index_papers(papers, _folder(t), split="dev").drop("added_time").withColumns({c: F.col(c).cast("int") for c in ("chunk_count", "figure_caption_count")})


@query("SELECT item_id AS question_id, CASE WHEN item_id % 2 = 0 THEN 'old' ELSE 'new ' || md5(text) END AS predicted_answer FROM benchmark")
def answered_alone(t: Tables) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("question_id"), "text")
    old = q.where("question_id % 2 = 0").select("question_id", F.lit("old").alias("predicted_answer"), F.array().cast("array<string>").alias("predicted_evidence"))
    return pipelines.predict_alone(q, old, lambda text: F.concat(F.lit("new "), F.md5(text))).select("question_id", "predicted_answer")


@query("SELECT md5(text) AS src, 'r' AS label, 't' AS dst, 'doc_' || n AS chunk_id FROM (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS n FROM benchmark) WHERE length(text) >= 50")
def graph_of_documents(t: Tables) -> DataFrame:
    blank = [F.lit(x).alias(n) for n, x in (("head_type", "Other"), ("relation", "r"), ("relation_type", "text"), ("tail", "T"), ("tail_type", "Other"), ("evidence", ""))]
    extract = lambda text: F.array(F.struct(F.md5(text).alias("head"), *blank, F.lit(0.5).alias("confidence")))
    return pipelines.graph_of_documents(t.benchmark.select(F.col("item_id").alias("ident"), "text"), extract)[1].select("src", "label", "dst", "chunk_id")


@query(f"WITH {CH}, d AS (SELECT file_name FROM ch WHERE length(text) > 0 AND NOT regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') GROUP BY ALL HAVING count(*) >= 5) SELECT 'kept' AS metric, count(*) AS n, 1.0::DOUBLE AS mean FROM d")
def testset_run(t: Tables) -> DataFrame:
    def ask(pieces: Iterator[str]) -> list[tuple[str, str, str]]:
        digest = hashlib.md5()
        for p in pieces:
            digest.update(p.encode())
        return [("Which method works best?", digest.hexdigest(), digest.hexdigest())]

    return pipelines.evaluate_testset(chunks(t), ask, {"kept": lambda question, answer, reference: (answer == reference).cast("double")}, in_pieces=True)[1].select("metric", "n", "mean")
