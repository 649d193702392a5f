"""Readers: directories of papers, JSON lines, keyed JSON, graph snapshots, tables of chunks and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "docx", "doc", "txt", "md", "html", "htm")
ANSWER = "struct<unanswerable: boolean, extractive_spans: array<string>, yes_no: boolean, free_form_answer: string, evidence: array<string>, highlighted_evidence: array<string>>"
PAPER = f"struct<id: string, title: string, abstract: string, full_text: array<struct<section_name: string, paragraphs: array<string>>>, qas: array<struct<question: string, question_id: string, answers: array<struct<answer: {ANSWER}, annotation_id: string, worker_id: string>>>>, figures_and_tables: array<struct<caption: string, file: string>>>"


def scan_directory(spark: SparkSession, path: str, recursive: bool = False, content: bool = False) -> DataFrame:
    """(path, file_name, modificationTime, length[, content]) of papers; hidden ._ files are left out. One level unless recursive."""
    glob = "*.{" + ",".join(x for s in SUFFIXES for x in (s, s.upper())) + "}"
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    df = df.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).where(~F.col("file_name").startswith("._"))
    return df if content else df.drop("content")


def last_by_name(files: DataFrame) -> DataFrame:
    return files.groupBy("file_name").agg(F.max("path").alias("path"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_keyed_json(spark: SparkSession, path: str, value: str = PAPER) -> DataFrame:
    """An object of objects, {id: value}: one row a value, id filled from the key."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "v")).select("key", "v.*")
    return rows.withColumn("id", F.col("key")).drop("key")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot {entities: {id: ..}, triplets: [[head, relation, tail]]} (gzip or plain) as vertices and edges."""
    whole = spark.read.text(path, wholetext=True)
    schema = "struct<entities: map<string, struct<name: string, type: string, description: string>>, triplets: array<array<string>>, relation_count: long>"
    g = whole.select(F.from_json("value", schema).alias("g"))
    v = g.select(F.explode("g.entities").alias("id", "v")).select("id", "v.*")
    e = g.select(F.explode("g.triplets").alias("t")).select(F.lower(F.col("t")[0]).alias("src"), F.col("t")[1].alias("label"), F.lower(F.col("t")[2]).alias("dst"))
    return v, e


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def scan_chunks(chunks: DataFrame, file_name: str | None = None, ids: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """A filtered scan: by file, by a frame of ids (semi join), of some columns; filters and columns reach the files."""
    out = chunks if file_name is None else chunks.where(F.col("file_name") == file_name)
    if ids is not None:
        out = out.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return out.select(columns) if columns else out


def search_results(works: DataFrame, limit: int = 100) -> DataFrame:
    """Of search answers (query_id, rank, title, download_urls): the URL to fetch, the arXiv id, the file name."""
    from lectern.functions import text as tx

    ident = F.get(F.filter(F.transform("download_urls", lambda u: tx.arxiv_id(u)), lambda x: x.isNotNull()), F.lit(0))
    return works.where(F.col("rank") <= limit).select("query_id", "rank", "title", tx.best_url("download_urls").alias("url"), ident.alias("arxiv_id"), tx.arxiv_filename(ident, F.col("title")).alias("file_name"))
