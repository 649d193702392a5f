"""Queries of model answers, marks, captions, formulas, figure files, backups and bounded calls."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import boundary, calls
from lectern.functions import text as tx
from lectern.operators import chunking, citations, multimodal
from lectern.plans.catalog import Tables, query
from lectern.plans.queries_sources import _folder
from lectern.sources import sinks


@query("SELECT event_id, CAST(2000 + event_id % 25 AS INTEGER) AS year, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END AS suffix FROM events")
def year_suffixes(t: Tables) -> DataFrame:
    mark = F.concat(F.lit("("), 2000 + F.col("event_id") % 25, F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "a").otherwise("b"), F.lit(")"))
    year, suffix = tx.year_suffix(mark)
    return t.events.select("event_id", year.alias("year"), suffix.alias("suffix"))


@query("""WITH p AS (SELECT doc_id, text, strpos(text, 'the') - 1 AS k FROM documents WHERE contains(text, 'the'))
       SELECT doc_id, substring(text, greatest(k - 50, 0) + 1, k - greatest(k - 50, 0) + 53) AS context FROM p""")
def mark_contexts(t: Tables) -> DataFrame:
    d = t.documents.withColumn("at", F.instr("text", "the") - 1).where("at >= 0")
    return d.select("doc_id", tx.context("text", F.col("at"), F.lit(3)).alias("context"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def model_output(t: Tables) -> DataFrame:
    said = F.concat(F.lit("<think>not\nthis</think>\n```json\n"), "text", F.lit("\n```\n"))
    return t.documents.select("doc_id", F.md5(tx.strip_model_output(said)).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN doc_id END AS a FROM documents")
def model_json(t: Tables) -> DataFrame:
    """The value in answers that are fenced, within prose, after a thinking block, cut off, or have none."""
    one = F.concat(F.lit('[{"a": '), "doc_id", F.lit("}"))
    kind = F.col("doc_id") % 5
    said = F.when(kind == 0, F.concat(F.lit("```json\n"), one, F.lit("]\n```"))).when(kind == 1, F.concat(F.lit("It is "), one, F.lit("], I think"))).when(kind == 2, F.concat(F.lit("<think>[1]</think>"), one, F.lit("]")))
    said = said.when(kind == 3, F.concat(one, F.lit(', {"b": "'))).otherwise(F.lit("I can't say"))
    return t.documents.select("doc_id", F.get(F.from_json(boundary.json_of(said), "array<struct<a: long>>"), F.lit(0))["a"].alias("a"))


@query("SELECT p_partkey, p_name AS ref_title, 'ref by ' || p_brand AS ref_authors, CASE WHEN p_size % 2 = 0 THEN CAST(1950 + p_size AS INTEGER) END AS ref_year, CASE WHEN p_size % 3 > 0 THEN '10.1/' || p_partkey END AS ref_doi FROM part")
def parsed_references(t: Tables) -> DataFrame:
    year = F.when(F.col("p_size") % 2 == 0, (1950 + F.col("p_size")).cast("string")).otherwise(F.lit("in press"))
    doi = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("10.1/"), "p_partkey")).otherwise(F.lit(" "))
    said = F.concat(F.lit("Here: "), F.to_json(F.array(F.struct(F.col("p_name").alias("title"), F.concat(F.lit("ref by "), "p_brand").alias("authors"), year.alias("year"), doi.alias("doi"), F.lit("").alias("venue")))))
    refs = t.part.select("p_partkey", F.explode(boundary.parse_references(said)).alias("r"))
    return refs.where("r.ref_venue is null").select("p_partkey", "r.ref_title", "r.ref_authors", "r.ref_year", "r.ref_doi")


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || chr(10) || '=== Formulas ===' || chr(10) || '$$x_' || doc_id || '$$' ELSE text END) AS digest FROM documents")
def enhanced_texts(t: Tables) -> DataFrame:
    formula = lambda x: F.struct(x.alias("text"), F.lit("display").alias("type"))
    shown = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x_"), "doc_id")).otherwise(F.lit("  "))
    return t.documents.select("doc_id", F.md5(tx.enhanced("text", F.array(formula(shown), formula(F.lit(" "))))).alias("digest"))


@query("SELECT doc_id AS chunk_id, text, source AS file_name, CAST(n_chars % 7 AS BIGINT) AS chunk_index FROM documents")
def light_chunks(t: Tables) -> DataFrame:
    wide = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("file_name"), (F.col("n_chars") % 7).alias("chunk_index"), "lang", F.lit("x").alias("all_images"))
    return chunking.light_metadata(wide).select("chunk_id", "text", "file_name", "chunk_index")


@query("SELECT doc_id, md5(text) AS digest, true AS fits FROM documents")
def reference_batches(t: Tables) -> DataFrame:
    """Batches of a long section are its text again, and none is too long."""
    s = t.documents.select("doc_id", F.lit(0).alias("section_no"), F.col("text").alias("content"))
    b = citations.split_batches(s, "doc_id", 2000)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("batch", "content"))), lambda x: x["content"]), "\n")
    # a line over the limit is cut, so that its parts come back with line ends between them
    same = b.groupBy("doc_id").agg(whole.alias("whole"), (F.max(F.length("content")) <= 2000).alias("fits")).join(t.documents.select("doc_id", "text"), "doc_id")
    return same.select("doc_id", F.md5(F.when(F.replace("whole", F.lit("\n"), F.lit("")) == F.replace("text", F.lit("\n"), F.lit("")), F.col("text"))).alias("digest"), "fits")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Figure 1: a' || doc_id WHEN 1 THEN 'Fig. 2. b' WHEN 2 THEN NULL ELSE 'Figure 1: only' END AS caption,
          CASE WHEN doc_id % 4 = 3 THEN 'Table 1: t' END AS table_caption FROM documents""")
def nth_captions(t: Tables) -> DataFrame:
    k = (F.col("doc_id") % 4).cast("int")
    page = F.when(k < 3, F.concat(F.lit("Text\nFigure 1: a"), "doc_id", F.lit("\nmore of Figure 9\n  Fig. 2. b\nend"))).otherwise(F.lit("Figure 1: only\nTable 1: t\nbody"))
    return t.documents.select("doc_id", citations.nth_caption(page, F.when(k < 3, k).otherwise(F.lit(5))).alias("caption"), citations.nth_caption(page, F.lit(0), "table").alias("table_caption"))


@query("""WITH c AS (SELECT o_orderkey AS chunk_id, o_custkey % 40 AS paper, o_orderkey % 7 AS a, o_orderkey % 5 AS b FROM orders),
       m AS (SELECT chunk_id, paper, a AS number, 0 AS seen FROM c UNION ALL SELECT chunk_id, paper, b, 1 FROM c WHERE a <> b)
       SELECT m.chunk_id, CAST(number AS VARCHAR) AS number, 'f' || number AS path, CAST(row_number() OVER (PARTITION BY m.chunk_id ORDER BY seen) AS BIGINT) AS n
       FROM m WHERE number < 6""")
def formula_links(t: Tables) -> DataFrame:
    """Chunks and the formulas that they name by number; papers have the formulas 0 to 5."""
    text = F.concat(F.lit("by Equation ("), F.col("o_orderkey") % 7, F.lit("), see Eq. "), F.col("o_orderkey") % 5)
    chunks = t.orders.select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 40).alias("paper_id"), text.alias("text"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(5)))
    items = t.orders.select((F.col("o_custkey") % 40).alias("paper_id")).distinct().select("paper_id", numbers.alias("k")).select("paper_id", F.col("k").cast("string").alias("number"), F.lit(0).alias("page"), F.concat(F.lit("f"), "k").alias("path"))
    return citations.link_items(chunks, items, citations.FORMULA).select("chunk_id", "number", "path", F.col("n").cast("long").alias("n"))


@query("SELECT 'p' || n_regionkey || '/' || n_name || '.png' AS path, CAST(length(n_name) AS BIGINT) AS size, md5(n_name) AS digest FROM nation")
def written_figures(t: Tables) -> DataFrame:
    """Figure files written by the tasks and read back."""
    folder = _folder(t)
    figures = t.nation.select(F.concat(F.lit("p"), "n_regionkey").alias("paper_id"), F.col("n_name").alias("figure_id"), F.encode("n_name", "UTF-8").alias("content"))
    multimodal.write_figures(figures, folder).write.format("noop").mode("overwrite").save()
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace(F.regexp_extract("path", "([^/]+/[^/]+)$", 1), "%20", " ").alias("path"), F.col("length").alias("size"), F.md5("content").alias("digest"))


@query("SELECT 'b' || event_id AS name, CAST(event_id % 1000 AS VARCHAR) || '.0B' AS size FROM events ORDER BY ts DESC, 'b' || event_id LIMIT 10")
def newest_backups(t: Tables) -> DataFrame:
    files = t.events.select(F.concat(F.lit("/backups/b"), "event_id").alias("path"), F.col("ts").alias("modificationTime"), (F.col("event_id") % 1000).alias("length"))
    return sinks.list_backups(files).select("name", "size")


def _digests(texts: list) -> list:
    return [hashlib.md5(x.encode()).hexdigest() for x in texts]


@query("SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN md5(text) END AS answer, CAST(CASE WHEN doc_id % 7 > 0 THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM documents")
def bounded_calls(t: Tables) -> DataFrame:
    """A service that is called with a hundred texts at a time; rows without a text aren't sent."""
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("text")).alias("text"))
    out = calls.call_service(rows, "text", _digests, limits=calls.Limits(tasks=4))
    # a batch of nulls alone isn't sent at all
    return out.select("doc_id", "answer", "attempts")
