"""Helpers shared by the corpus operators: shared-folder tables, size-checked broadcasts and components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side whose rows, at the given width, take more than this is shuffled and not broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 256
#: Stands for a null document id in keys; sorts before every other id.
NULL_ID = -(1 << 63)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a new temporary one in local mode only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_staged: dict[str, SparkSession] = {}


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors. The table goes with
    unstage(), or when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(_clear)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*dfs: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_staged_at", None)
        if spark := _staged.pop(path, None):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    for path, spark in list(_staged.items()):
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame) -> DataFrame:
    """df in a clone of its session in which an Arrow batch has BATCH_ROWS rows: texts are long, so Spark's 10,000 would not
    bound the memory of a Python worker. The session that the caller goes on using keeps its own setting."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        return df
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(key, str(BATCH_ROWS))
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)


def small(df: DataFrame, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows of `width` bytes stay under `limit`, else df as it is."""
    return F.broadcast(df) if df.count() * width <= limit else df


def id_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): rows (id, root) with the smallest id of the component for each id in an edge.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each a pre-aggregated minimum and a join;
    every round is written to the shared folder. Ends when a round changes no edge.
    """
    rename = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    mark = lambda df: df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(rename(edges, "b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = rename(both.join(low, "a").where("b > a"), "b", "m").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = rename(large.join(low, "a").where("b <> m"), "b", "m")
        old, edges = edges, stage(rest.unionByName(rename(low, "a", "m")).where("a <> b").distinct(), "cc")
        unstage(old)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def whole_rows(df: DataFrame, keep: bool) -> list[Column]:
    """With keep: one struct column `row` of all columns of df, which may bear any names."""
    return [F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")] if keep else []


def several_texts(rows: DataFrame, key: str, text_hash: str) -> DataFrame | None:
    """Keys other than NULL_ID that stand on rows of different texts: (key, __several), or None if there are none."""
    found = rows.select(key, text_hash).where(F.col(key) != NULL_ID).distinct().groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    found = stage(found.select(key, F.lit(True).alias("__several")), "several")
    n = found.count()
    return (F.broadcast(found) if n * 16 <= BROADCAST_BYTES else found) if n else None
