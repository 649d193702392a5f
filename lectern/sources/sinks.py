"""Writers: chunk tables, graph snapshots and backups, CSV for graph tools, reports, evaluation files."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.classify import node_color, node_type


def insert_chunks(chunks: DataFrame, path: str, vector: str = "embedding") -> None:
    """Appends chunks; a null vector is an error. Partitioned by file so that scans of one file prune."""
    checked = chunks.withColumn(vector, F.when(F.col(vector).isNotNull(), F.col(vector)).otherwise(F.raise_error(F.lit("a chunk has no vector"))))
    checked.write.mode("append").partitionBy("file_name").parquet(path)


def replace_files(chunks: DataFrame, path: str) -> None:
    """Stores chunks in a table by file; files that it holds already are replaced, all others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_name").parquet(path)


def _swap(spark: SparkSession, path: str) -> tuple:
    target, fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + s) for s in ("", ".new", ".old"))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, fresh, old


def recover(spark: SparkSession, path: str) -> str:
    """The path of a table that overwrite() keeps, after it has mended a swap that was broken off: with its table moved away and
    no new one in place, the old one comes back. Read a table through it where another run may have died."""
    fs, target, _, old = _swap(spark, path)
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    return path


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces a table that df may be read from: written beside it, then swapped in by Hadoop renames. At every moment the old or the
    new table is there whole, under its name or, between the two renames, under `.old`, from where recover() brings it back."""
    spark = df.sparkSession
    recover(spark, path)
    fs, target, fresh, old = _swap(spark, path)
    df.write.mode("overwrite").parquet(fresh.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def rebuild_chunks(chunks: DataFrame, path: str, file_name: str | None = None) -> None:
    """Replaces the whole chunk table by newly parsed chunks, or only the rows of one file: other files' folders stay."""
    rows = chunks if file_name is None else chunks.where(F.col("file_name") == file_name)
    mode = "static" if file_name is None else "dynamic"
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("file_name").parquet(path)


def dump(df: DataFrame, path: str, kind: str = "json") -> None:
    """A test set or chunks as JSON lines, results as CSV with a header (structures as JSON text)."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").json(path)


def clear(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Two tables of gzipped JSON lines, committed by Spark; a failed write leaves the last one in place."""
    for name, df in (("vertices", vertices), ("edges", edges)):
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("id string, name string, type string, description string").json(f"{path}/vertices"), spark.read.schema("src string, label string, dst string, weight double, chunk_id string").json(f"{path}/edges")


def backup_graph(vertices: DataFrame, edges: DataFrame, folder: str, stamp: str) -> str:
    out = f"{folder.rstrip('/')}/graph_backup_{stamp}"
    vertices.write.mode("errorifexists").parquet(f"{out}/vertices")
    edges.write.mode("errorifexists").parquet(f"{out}/edges")
    return out


def restore_graph(spark: SparkSession, backup: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{backup}/vertices"), spark.read.parquet(f"{backup}/edges")


def list_backups(files: DataFrame, k: int = 10) -> DataFrame:
    """The newest k of (path, modificationTime, length), with a readable size."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.orderBy(F.desc("modificationTime"), "name").limit(k).select("name", "modificationTime", tx.human_size("length").alias("size"))


def bloom_nodes(vertices: DataFrame) -> DataFrame:
    """vertices (id, name, labels, paper_id) as id, type, label, color, title, paper_id."""
    kind = node_type(F.col("labels"))
    return vertices.select("id", kind.alias("type"), tx.ellipsis("name", 50, "unknown").alias("label"), node_color(kind).alias("color"), F.col("name").alias("title"), "paper_id")


def bloom_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes, as source, target, type."""
    ids = nodes.select("id")
    e = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("label").alias("type"))
    return e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "type")


def write_bloom(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes = bloom_nodes(vertices)
    nodes.write.mode("overwrite").option("header", True).csv(f"{folder}/nodes")
    bloom_edges(edges, nodes).write.mode("overwrite").option("header", True).csv(f"{folder}/edges")


def graph_html(vertices: DataFrame, edges: DataFrame, path: str, limit: int = 500) -> None:
    """A page that draws at most `limit` vertices and the edges between them."""
    some = vertices.orderBy("id").limit(limit)
    nodes = [r.asDict() for r in some.select("id", tx.ellipsis("name", 40).alias("label"), "type").collect()]
    links = [r.asDict() for r in bloom_edges(edges, some).limit(5 * limit).collect()]
    rows = "".join(f"<tr><td>{html.escape(x['source'])}</td><td>{html.escape(x['type'])}</td><td>{html.escape(x['target'])}</td></tr>" for x in links)
    data = json.dumps({"nodes": nodes, "links": links}).replace("</", "<\\/")
    Path(path).write_text(f"<!DOCTYPE html><meta charset=utf-8><title>Graph</title><p>{len(nodes)} vertices, {len(links)} edges</p><table>{rows}</table><script type=application/json id=graph>{data}</script>")


def report_markdown(summary: DataFrame, title: str, weak: DataFrame | None = None) -> str:
    """A Markdown report of a metric summary (a few rows), with advice for poor metrics and the weakest samples."""
    rows = sorted(summary.collect(), key=lambda r: r["metric"])
    fmt = lambda v: "-" if v is None else f"{v:.4f}"
    out = [f"# {title}", "", "| metric | n | mean | std | min | max | grade |", "|---|---|---|---|---|---|---|"]
    out += [f"| {r['metric']} | {r['n']} | {fmt(r['mean'])} | {fmt(r['std'])} | {fmt(r['min'])} | {fmt(r['max'])} | {r['grade']} |" for r in rows]
    advice = [f"- {r['metric']}: look at retrieval and prompts first" for r in rows if r["grade"] == "poor"]
    out += ["", "## To improve", *(advice or ["- nothing stands out"])]
    if weak is not None:
        out += ["", "## Weak samples", *[f"- {r['question']} | {r['answer']}" for r in weak.collect()]]
    return "\n".join(out) + "\n"


def report_html(summary: DataFrame, title: str) -> str:
    body = report_markdown(summary, title).split("\n")
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(c.strip())}</td>" for c in line.strip("|").split("|")) + "</tr>" for line in body if line.startswith("|") and not line.startswith("|---"))
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{rows}</table>"


def write_eval_format(papers: DataFrame, folder: str) -> None:
    """JSON lines by split, and an empty prediction template."""
    papers.write.mode("overwrite").partitionBy("split").json(f"{folder}/papers")
    q = papers.select(F.explode("qas").alias("q")).select("q.question_id", F.lit("").alias("predicted_answer"), F.array().cast("array<string>").alias("predicted_evidence"))
    q.write.mode("overwrite").json(f"{folder}/template")
