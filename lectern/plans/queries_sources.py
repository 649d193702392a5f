"""Queries of readers, writers and compound pipelines. What they write goes to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import evaluation, graph, library
from lectern.plans import pipelines
from lectern.plans.catalog import Tables, query
from lectern.plans.queries_graph import E_, V, edges, vertices
from lectern.plans.queries_library import CH, RF, chunks
from lectern.session import shared_folder
from lectern.sources import files, sinks


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/query-{uuid.uuid4().hex}"


@query("SELECT doc_id, md5(text) AS digest, lang FROM documents")
def jsonl_scan(t: Tables) -> DataFrame:
    """Documents written as JSON lines, with blank and broken lines among them, and read back."""
    path = _folder(t)
    good = t.documents.select(F.to_json(F.struct("doc_id", "text", "lang")).alias("value"))
    bad = t.nation.select(F.when(F.col("n_nationkey") % 2 == 0, "").otherwise('{"doc_id": 1, "te').alias("value"))
    good.unionByName(bad).write.text(path)
    return files.read_jsonl(t.spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("SELECT 'p' || n_nationkey AS id, n_name AS title, 1 AS questions FROM nation")
def keyed_json_scan(t: Tables) -> DataFrame:
    """An object of objects in one file."""
    path = _folder(t)
    paper = F.struct(F.col("n_name").alias("title"), F.array(F.struct(F.lit("q").alias("question"), F.lit("1").alias("question_id"))).alias("qas"))
    pairs = t.nation.select(F.concat(F.lit('"p'), "n_nationkey", F.lit('": '), F.to_json(paper)).alias("v"))
    pairs.agg(F.concat(F.lit("{"), F.array_join(F.collect_list("v"), ","), F.lit("}")).alias("value")).write.text(path)
    return files.read_keyed_json(t.spark, path).select("id", "title", F.size("qas").alias("questions"))


@query("SELECT event_type, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY event_type")
def metric_csv_scan(t: Tables) -> DataFrame:
    path = _folder(t)
    t.events.select("event_type", "value").write.option("header", True).csv(path)
    return files.read_metrics(t.spark, path).groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@query("SELECT e.vec_id AS chunk_id, d.source AS file_name FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.source = 'src3'")
def chunk_table_scan(t: Tables) -> DataFrame:
    """Chunks appended to a table partitioned by file, then scanned for one file."""
    path = _folder(t)
    rows = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select(F.col("vec_id").alias("chunk_id"), F.col("source").alias("file_name"), "text", "embedding")
    sinks.insert_chunks(rows, path)
    return files.scan_chunks(t.spark.read.parquet(path), "src3", columns=["chunk_id", "file_name"])


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def id_scan(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("chunk_id"), "source")
    return files.scan_chunks(rows, ids=t.benchmark.select(F.col("item_id").alias("chunk_id"))).select(F.col("chunk_id").alias("doc_id"), "source")


@query(f"WITH {V}, {E_} SELECT 'vertex' AS kind, count(*) AS n FROM v UNION ALL SELECT 'edge', count(*) FROM e")
def graph_backup_restore(t: Tables) -> DataFrame:
    where = sinks.backup_graph(vertices(t), edges(t), _folder(t), "20240101_000000")
    v, e = sinks.restore_graph(t.spark, where)
    return v.agg(F.count("*").alias("n")).select(F.lit("vertex").alias("kind"), "n").unionByName(e.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "n"))


@query(f"WITH {V} SELECT id, name, type FROM v")
def graph_save_load(t: Tables) -> DataFrame:
    path = _folder(t)
    e = edges(t).withColumn("weight", F.lit(1.0)).withColumn("chunk_id", F.lit("c"))
    sinks.save_graph(vertices(t).withColumn("description", F.lit("")), e, path)
    return sinks.load_graph(t.spark, path)[0].select("id", "name", "type")


@query("SELECT o_orderkey AS query_id, CAST(rank AS INTEGER) AS rank, CASE WHEN rank = 1 THEN 'https://arxiv.org/pdf/1901.' || lpad(CAST(o_orderkey % 90000 AS VARCHAR), 5, '0') ELSE 'https://x.org/a' END AS url, CASE WHEN rank = 1 THEN '1901.' || lpad(CAST(o_orderkey % 90000 AS VARCHAR), 5, '0') END AS arxiv_id, CASE WHEN rank = 1 THEN '1901.' || lpad(CAST(o_orderkey % 90000 AS VARCHAR), 5, '0') ELSE 'A title ' || o_orderkey END || '.pdf' AS file_name FROM orders, (SELECT unnest([1, 2]) AS rank)")
def search_result_urls(t: Tables) -> DataFrame:
    works = t.orders.selectExpr("o_orderkey as query_id", "explode(array(1, 2, 101)) as rank", "concat('A: title? ', o_orderkey) as title").withColumn("title", F.regexp_replace("title", ": ", " "))
    works = works.withColumn("download_urls", F.expr("if(rank = 1, array('https://x.org/a', concat('https://arxiv.org/pdf/1901.', lpad(cast(query_id % 90000 as string), 5, '0'))), array('https://x.org/a'))"))
    return files.search_results(works, 2).select("query_id", "rank", "url", "arxiv_id", "file_name")


@query(f"WITH {CH} SELECT file_name, count(*) AS chunk_count, min(added_time) AS added_time FROM ch GROUP BY ALL ORDER BY file_name LIMIT 20")
def list_documents(t: Tables) -> DataFrame:
    return library.list_documents(chunks(t))


@query("SELECT count(*) AS row_count, 64 AS dim, 'cosine' AS metric, count(*) = 0 AS empty FROM embeddings")
def index_stats(t: Tables) -> DataFrame:
    return library.index_stats(t.embeddings, 64)


@query(f"WITH {CH} SELECT 'paper' || n_nationkey * 3 || '.pdf' AS file_name FROM nation WHERE 'paper' || n_nationkey * 3 || '.pdf' NOT IN (SELECT file_name FROM ch)")
def sync_new_files(t: Tables) -> DataFrame:
    folder = t.nation.select(F.concat(F.lit("paper"), F.col("n_nationkey") * 3, F.lit(".pdf")).alias("file_name"))
    return pipelines.sync(folder, chunks(t))


@query(f"""WITH {CH}, {RF}, z AS (SELECT DISTINCT file_name FROM ch WHERE file_name NOT IN (SELECT file_name FROM rk)) SELECT file_name, count(*) AS n FROM ch WHERE file_name NOT IN (SELECT file_name FROM z) GROUP BY ALL UNION ALL SELECT file_name, 1 FROM z""")
def reparse_zero_reference(t: Tables) -> DataFrame:
    c = chunks(t).select("chunk_id", "file_name", "chunk_index", "text", "cited_references")
    again = lambda f: f.selectExpr("cast(0 as bigint) as chunk_id", "file_name", "cast(0 as bigint) as chunk_index", "'again' as text")
    return pipelines.reparse(c, c.select("file_name").distinct(), again).groupBy("file_name").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS question_id, CASE WHEN doc_id % 3 = 0 THEN 'translated ' || doc_id ELSE md5(text) END AS answer FROM documents")
def translate_answers(t: Tables) -> DataFrame:
    p = t.documents.select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("回答"), "doc_id")).otherwise(F.md5("text")).alias("predicted_answer"))
    return pipelines.translate(p, F.concat(F.lit("translated "), "question_id")).select("question_id", F.col("predicted_answer").alias("answer"))


@query("SELECT item_id AS query_id, item_id % 4 < 3 AS vision FROM benchmark")
def vision_routing(t: Tables) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 4 == 0, "show the figure").otherwise("zzz").alias("text"))
    s = t.benchmark.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 4 == 1, "a.png").alias("image_path"), F.lit(False).alias("is_caption"), F.when(F.col("item_id") % 4 == 2, "as in Table 3").otherwise("none").alias("text"))
    return pipelines.use_vision(q, s)


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.999 WHEN 2 THEN 0.0 ELSE 0.666667 END::DOUBLE AS f1 FROM documents")
def semantic_f1(t: Tables) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", F.round(evaluation.semantic_f1(pick("same", "True", " ", "The cat sat on the mat."), pick("Same", "yes", "x", "A cat sat")), 6).alias("f1"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents")
def occurrence_index(t: Tables) -> DataFrame:
    return library.occurrence_index(t.documents.select("doc_id", "source"), ["source"], ["doc_id"]).withColumn("n", F.col("n").cast("long"))


@query("SELECT least(20, count(*)) AS n, true AS repeatable FROM documents")
def random_sample(t: Tables) -> DataFrame:
    a, b = (library.random_rows(t.documents.select("doc_id"), 20, "doc_id", 7) for _ in range(2))
    return a.join(b.withColumn("again", F.lit(1)), "doc_id", "left").agg(F.count("*").alias("n"), F.every(F.col("again").isNotNull()).alias("repeatable"))


@query("SELECT lower('Fig ' || p_partkey) AS src, label, CASE label WHEN '__is_a__' THEN 'Figure' WHEN '__has_path__' THEN p_partkey || '.png' ELSE substring(p_name, 1, 200) END AS dst FROM part, (SELECT unnest(['__is_a__', '__has_path__', '__has_description__']) AS label)")
def graph_item_entities(t: Tables) -> DataFrame:
    items = t.part.select(F.concat(F.lit("Fig "), "p_partkey").alias("item_id"), F.concat("p_partkey", F.lit(".png")).alias("path"), F.col("p_name").alias("description"))
    return graph.item_rows(items, "Figure")[1]


@query("SELECT doc_id AS query_id, '[1] ' || source || ' (0.500)' || chr(10) || CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS shown FROM documents")
def format_hits(t: Tables) -> DataFrame:
    h = t.documents.select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), F.col("source").alias("file_name"), F.lit(0.5).alias("score"), "text")
    return h.select("query_id", pipelines.format_hits(h).alias("shown"))


@query(f"WITH {CH} SELECT file_name, count(*) AS chunks FROM ch WHERE length(text) > 0 AND NOT regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') GROUP BY ALL HAVING count(*) >= 5")
def testset_documents(t: Tables) -> DataFrame:
    return pipelines.testset(chunks(t)).select("file_name", "chunks")


_RAW = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN replace(props, '"', '''') WHEN 2 THEN 'broken ' || event_type
          ELSE '{"k": {"n": "' || event_id || '"}, "t": "' || event_type || '"}' END"""


@query(f"""WITH r AS (SELECT event_id, {_RAW} AS raw FROM events), j AS (SELECT event_id, coalesce(try_cast(raw AS JSON), try_cast(replace(raw, '''', '"') AS JSON), json_object('raw', raw)) AS j FROM r)
       SELECT event_id, try_cast(j->>'$.k' AS INTEGER) AS k, try_cast(j->>'$.k.n' AS INTEGER) AS k_n, j->>'$.t' AS t, j->>'$.raw' AS raw FROM j""")
def metadata_fields(t: Tables) -> DataFrame:
    from lectern.functions.boundary import metadata_fields as fields
    from lectern.functions.boundary import metadata_of

    raw = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.replace("props", F.lit('"'), F.lit("'"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("broken "), "event_type"))
    raw = raw.otherwise(F.concat(F.lit('{"k": {"n": "'), "event_id", F.lit('"}, "t": "'), "event_type", F.lit('"}')))
    v = t.events.select("event_id", metadata_of(raw).alias("v"))
    return v.select("event_id", *fields(F.col("v"), {"k": "int", "k.n": "int", "t": "string", "raw": "string"}))


@query("SELECT doc_id, lang, length(text) AS n FROM documents WHERE contains(text, 'de') AND lang = 'de'")
def paged_search(t: Tables) -> DataFrame:
    """A search of a paged service that holds the documents; the language is a filter of the service."""
    from lectern.sources.paged import register

    store = _folder(t)
    t.documents.select("doc_id", "text", "lang").write.option("parquet.block.size", 8 << 20).parquet(f"{store}/documents")  # what the service holds
    found = register(t.spark).read.format("paged_search").option("service", "lectern.sources.paged:file_service").option("table", f"{store}/documents").option("index", f"{store}/index").option("query", "de")
    return found.option("page", 100).schema("doc_id long, text string, lang string").load().where("lang = 'de'").select("doc_id", "lang", F.length("text").cast("long").alias("n"))


_HAN = "translate(lower(text), 'bcdfghijklmnoprstuvwxyz ', '一二三四五六七八九十百千万人口手山水火木金土日')"


@query(rf"""WITH RECURSIVE d AS (SELECT item_id, {_HAN} AS text FROM benchmark),
       tk AS (SELECT item_id, unnest(range(len(x))) AS pos, unnest(x) AS token FROM (SELECT item_id, regexp_extract_all(text, '[一-鿿]+|[^一-鿿\P{{L}}]+|\p{{N}}+') AS x FROM d)),
       ru AS (SELECT token AS run, count(*) AS n FROM tk WHERE token SIMILAR TO '[一-鿿]+' GROUP BY ALL),
       su AS (SELECT run, n, i, k, substring(run, i::INT, k::INT) AS word FROM (SELECT run, n, i, unnest(range(1, least(4, length(run) - i + 1) + 1)) AS k FROM (SELECT run, n, unnest(range(1, length(run) + 1)) AS i FROM ru))),
       wo AS (SELECT word, sum(n) AS n FROM su GROUP BY word HAVING length(word) = 1 OR sum(n) >= 5),
       co AS (SELECT word, -ln(n / (SELECT sum(n) FROM wo)) AS c FROM wo),
       ed AS (SELECT run, i + k - 1 AS j, list({{'k': k, 'c': c}}) AS o FROM su JOIN co USING (word) GROUP BY ALL),
       op AS (SELECT run, list(o ORDER BY j) AS o FROM ed GROUP BY run),
       dp AS (SELECT run, 0 AS j, [0.0::DOUBLE] AS best, []::BIGINT[] AS back FROM op
              UNION ALL SELECT run, j + 1, list_append(best, p.v), list_append(back, -p.k) FROM (SELECT dp.run, dp.j, best, back,
                list_sort(list_transform(op.o[dp.j + 1], lambda x: {{'v': round(best[dp.j + 2 - x.k] + x.c, 9), 'k': -x.k}}))[1] AS p FROM dp JOIN op ON op.run = dp.run WHERE dp.j < length(dp.run))),
       pa AS (SELECT run, j, back, []::VARCHAR[] AS words FROM dp WHERE j = length(run)
              UNION ALL SELECT run, j - back[j], back, list_prepend(substring(run, (j - back[j] + 1)::INT, back[j]::INT), words) FROM pa WHERE j > 0),
       fi AS (SELECT run, array_to_string(words, ' ') AS words FROM pa WHERE j = 0)
       SELECT item_id, string_agg(coalesce(fi.words, token), ' ' ORDER BY pos) AS tokens FROM tk LEFT JOIN fi ON fi.run = tk.token GROUP BY item_id""")
def han_segments(t: Tables) -> DataFrame:
    """Texts of mixed script: all letters but a, e and q stand for Han characters."""
    from lectern.operators.segment import count_words, segment

    texts = t.benchmark.select("item_id", F.translate(F.lower("text"), "bcdfghijklmnoprstuvwxyz ", "一二三四五六七八九十百千万人口手山水火木金土日").alias("text"))
    return segment(texts, count_words(texts), "item_id").select("item_id", F.array_join("tokens", " ").alias("tokens"))
