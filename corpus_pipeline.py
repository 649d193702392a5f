"""From raw documents to shards: language ID, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, langid, mixing, near_dup, sharding
from lectern.llm.common import NULL_ID, bounded, id_key, several_texts, small, stage, whole_rows
from lectern.session import ship

#: A document goes if no language reaches this mean posterior (or it has no letter).
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no learned language, go; a null lang is filled in with the predicted one."""
    model = langid.train(docs, held_out=False)
    out = langid.identify(docs, model, keep=True)
    if model is not None:
        out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return out.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 one row stays: that of the smallest id. Documents
    without an id of their own (it is null, or stands on another text too) come after all others, by a hash of the text."""
    docs = bounded(docs)
    rows = docs.select(id_key("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), F.col("text").alias("__text"), *whole_rows(docs, True))
    several = several_texts(rows, "__id", "__hash")
    told = F.col("__id") == NULL_ID
    if several is not None:
        rows = rows.join(several, "__id", "left")
        told = told | F.col("__several").isNotNull()
    last = F.shiftrightunsigned("__hash", 2).bitwiseOR(F.lit(1 << 62))
    rows = rows.select(F.when(told, last).otherwise(F.col("__id")).alias("__key"), "__text", "row")
    near = stage(near_dup.near_duplicates(rows, k=5, num=4, den=5, id_col="__key", text_col="__text").select(F.col("doc_id").alias("__key"), "kept"), "near")
    gone = stage(near.where("not kept").select("__key").distinct(), "gone")
    again = stage(near.groupBy("__key").agg(F.count("*").alias("n"), F.first("kept").alias("kept")).where("kept and n > 1").select("__key"), "again")
    kept = rows.join(small(gone, 16), "__key", "left_anti").select("__key", "row")
    if not again.isEmpty():  # rows that repeat a document
        again = small(again, 16)
        one = kept.join(again, "__key", "left_semi").groupBy("__key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(again, "__key", "left_anti").unionByName(one)
    return kept.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to source, language and topic marginals."""
    return mixing.mix(docs, keep=True).where("selected").select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document."""
    return sharding.assign_shards(docs, shards=40)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]
#: Learned and iterative stages: SQL can't express them; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
