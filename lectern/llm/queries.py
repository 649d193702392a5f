"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, decontaminate, langid, licenses, masked_lm, mixing, near_dup, oracles, periodic, resample, sharding, substring, toxicity, wrapper
from lectern.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op2_raking_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs))
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_switches")


def op4_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op5_rabin_karp_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(_table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=40)


def op8_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, num=4, den=5)


def op10_masked_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(_table(spark, sf_dir, "documents"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(_table(spark, sf_dir, "documents"), periodic.planted, texts=False)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.rate(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_toxic")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_multiprobe_lsh, op2_raking_mixture, op3_crf_language, op4_wrapper_text, op5_rabin_karp_windows, op6_qgram_bands, op7_karmarkar_karp, op8_diagonal_voting, op9_bayes_minhash, op10_masked_window, op11_word_runs, op12_importance_draw, op13_subsequence_svm)}


def oracle_sql() -> dict[str, str]:
    return {"op5_rabin_karp_windows": oracles.substring_sql(), "op8_diagonal_voting": oracles.licenses_sql(), "op9_bayes_minhash": oracles.near_duplicates_sql(), "op12_importance_draw": oracles.resample_sql()}
