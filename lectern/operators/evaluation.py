"""Question answering evaluation: gold answers, token and evidence F1, evidence spans, metric summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.classify import grade


def _strings(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def gold_answers(papers: DataFrame, text_only: bool = False) -> DataFrame:
    """One row an annotation of papers (id, qas): question_id, n, answer, type, evidence. An unanswerable one has the type
    none, spans extractive (joined), free text abstractive, yes/no boolean; text_only drops evidence of floats."""
    q = papers.select(F.col("id").alias("paper_id"), F.explode("qas").alias("q")).select("paper_id", "q.question_id", "q.question", F.posexplode("q.answers").alias("n", "a"))
    q = q.select("paper_id", "question_id", "question", "n", "a.answer.*")
    spans, free = _strings(F.col("extractive_spans")), F.coalesce("free_form_answer", F.lit(""))
    kind = F.when(F.coalesce("unanswerable", F.lit(False)), "none").when(F.size(spans) > 0, "extractive").when(free != "", "abstractive").when(F.col("yes_no").isNotNull(), "boolean")
    answer = F.when(kind == "none", "Unanswerable").when(kind == "extractive", F.array_join(spans, ", ")).when(kind == "abstractive", free).when(kind == "boolean", F.when(F.col("yes_no"), "Yes").otherwise("No"))
    evidence = _strings(F.col("evidence"))
    if text_only:
        evidence = F.filter(evidence, lambda e: ~e.contains("FLOAT SELECTED"))
    return q.select("paper_id", "question_id", "question", "n", answer.alias("answer"), kind.alias("type"), evidence.alias("evidence"))


def flatten_questions(papers: DataFrame) -> DataFrame:
    """One row a question: the first annotation's answer and its kind (null, yes_no or free_text)."""
    g = papers.select(F.col("id").alias("paper_id"), F.explode("qas").alias("q")).select("paper_id", "q.question_id", "q.question", F.get("q.answers", F.lit(0)).alias("a"))
    a = F.col("a.answer")
    free = F.coalesce(F.nullif(a["free_form_answer"], F.lit("")), F.array_join(_strings(a["extractive_spans"]), ", "))
    kind = F.when(F.col("a").isNull() | F.coalesce(a["unanswerable"], F.lit(False)), "null").when(a["yes_no"].isNotNull(), "yes_no").otherwise("free_text")
    return g.select("paper_id", "question_id", "question", kind.alias("type"), F.when(kind == "yes_no", F.when(a["yes_no"], "Yes").otherwise("No")).when(kind == "free_text", free).alias("answer"))


def paragraph_nodes(papers: DataFrame, least: int = 50) -> DataFrame:
    """One row a paragraph of at least 50 characters; paragraph_index is its place in the section before the filter."""
    s = papers.select(F.col("id").alias("paper_id"), "title", F.posexplode("full_text").alias("section_index", "s"))
    p = s.select("paper_id", "title", "section_index", "s.section_name", F.posexplode("s.paragraphs").alias("paragraph_index", "text"))
    return p.where(F.length(tx.strip("text")) >= least)


def caption_nodes(papers: DataFrame, least: int = 20) -> DataFrame:
    """One row a figure or table caption, named by its file."""
    f = papers.select(F.col("id").alias("paper_id"), F.posexplode("figures_and_tables").alias("figure_index", "f")).select("paper_id", "figure_index", "f.caption", "f.file")
    f = f.where(F.length(tx.strip("caption")) >= least)
    return f.withColumn("text", F.concat(F.when(F.lower("file").startswith("fig"), "Figure: ").otherwise("Table: "), "caption"))


def dataset_stats(papers: DataFrame) -> DataFrame:
    per = papers.select(F.size("qas").alias("q"), F.expr("aggregate(full_text, 0L, (n, s) -> n + size(s.paragraphs))").alias("p"))
    n = F.greatest(F.count("*"), F.lit(1))
    return per.agg(F.count("*").alias("papers"), F.sum("q").alias("questions"), F.sum("p").alias("paragraphs"), (F.sum("q") / n).alias("questions_per_paper"), (F.sum("p") / n).alias("paragraphs_per_paper"))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the multisets of normalised tokens."""
    p, g = _bag(pred), _bag(gold)
    same = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(p, lambda x: x == t)), F.size(F.filter(g, lambda x: x == t))))
    return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def evidence_f1(pred: Column, gold: Column) -> Column:
    """Shared distinct entries over the list lengths; 1 if both are empty, 0 if one is."""
    pred, gold = _strings(pred), _strings(gold)
    same = F.size(F.array_intersect(pred, gold))
    return F.when((F.size(pred) == 0) & (F.size(gold) == 0), 1.0).when((F.size(pred) == 0) | (F.size(gold) == 0) | (same == 0), 0.0).otherwise(2.0 * same / (F.size(pred) + F.size(gold)))


def _bag(x: Column) -> Column:
    return F.filter(F.split(tx.normalize_answer(x), " "), lambda t: t != "")


def best_scores(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per question the best answer F1, the type of the first annotation that reaches it, the best evidence F1, missing.

    Token overlaps are counted by a join on (question, token), so long answers cost in proportion to their length."""
    p = predictions.select("question_id", _bag(F.coalesce("predicted_answer", F.lit(""))).alias("p"), "predicted_evidence")
    g = gold.select("question_id", "n", "type", "evidence", _bag(F.coalesce("answer", F.lit(""))).alias("g"))
    pc = p.select("question_id", F.explode("p").alias("token")).groupBy("question_id", "token").agg(F.count("*").alias("cp"))
    gc = g.select("question_id", "n", F.explode("g").alias("token")).groupBy("question_id", "n", "token").agg(F.count("*").alias("cg"))
    same = gc.join(pc, ["question_id", "token"]).groupBy("question_id", "n").agg(F.sum(F.least("cg", "cp")).alias("same"))
    j = g.select("question_id", "n", "type", "evidence", F.size("g").alias("ng")).join(p.select("question_id", F.size("p").alias("np"), "predicted_evidence"), "question_id", "left").join(same, ["question_id", "n"], "left")
    missing = F.col("np").isNull()
    a = F.when(F.col("same").isNull(), 0.0).otherwise(2.0 * F.col("same") / (F.col("np") + F.col("ng")))
    e = F.when(missing, 0.0).otherwise(evidence_f1(F.col("predicted_evidence"), F.col("evidence")))
    j = j.select("question_id", "n", "type", missing.alias("missing"), a.alias("a"), e.alias("e"))
    return j.groupBy("question_id").agg(F.max("a").alias("answer_f1"), F.max_by("type", F.struct("a", -F.col("n"))).alias("type"), F.max("e").alias("evidence_f1"), F.bool_or("missing").alias("missing"))


def run_metrics(scores: DataFrame) -> DataFrame:
    """One row: means over all questions and by type (0 for a type without questions), and the missing ones."""
    by = [F.coalesce(F.avg(F.when(F.col("type") == t, F.col("answer_f1"))), F.lit(0.0)).alias(f"answer_f1_{t}") for t in ("extractive", "abstractive", "boolean", "none")]
    return scores.agg(F.avg("answer_f1").alias("answer_f1"), *by, F.avg("evidence_f1").alias("evidence_f1"), F.sum(F.col("missing").cast("long")).alias("missing"))


def semantic_f1(pred: Column, gold: Column, model: Column | None = None) -> Column:
    """1 if equal, .999 for the same yes/no, 0 if either is blank; else the model's score, or token F1 without one."""
    p, g = tx.collapse(F.lower(pred)), tx.collapse(F.lower(gold))
    yes = lambda x: F.when(x.isin("yes", "true"), True).when(x.isin("no", "false"), False)
    token = token_f1(pred, gold)
    return F.when((p == "") | (g == ""), 0.0).when(p == g, 1.0).when(yes(p) == yes(g), 0.999).otherwise(token if model is None else F.coalesce(model, token))


def metric_summary(results: DataFrame, metrics: list[str], by: str | None = None) -> DataFrame:
    """Rows (metric[, group], n, mean, std, min, max, grade); NaN and null values are not counted; std is the sample's."""
    keep = [by] if by else []
    values = results.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias("v")) for m in metrics])).alias("x")).select(*keep, "x.*")
    out = values.groupBy("metric", *keep).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return out.withColumn("grade", F.when(F.col("mean").isNull(), "invalid").otherwise(grade(F.col("mean"))))


def weak_samples(results: DataFrame, metric: str = "faithfulness", under: float = 0.5, k: int = 10, then: str = "answer") -> DataFrame:
    """The k weakest by metric, question and `then`, nulls last, so that rows of equal metric and question don't come as the tasks end."""
    weak = results.where(F.col(metric) < under).orderBy(metric, *[F.asc_nulls_last(c) for c in ("question", then)]).limit(k)
    return weak.select(F.substring("question", 1, 80).alias("question"), F.substring("answer", 1, 60).alias("answer"), metric)


def evidence_sentences(sources: DataFrame, queries: DataFrame, per_source: int = 2, most: int = 500) -> DataFrame:
    """Up to two sentences of each source that share most with the query: 15 for each shared number, 10 for each shared
    keyword; joined greedily (a sentence that would pass `most` characters is skipped); prefixes of 50 are not repeated.

    sources: query_id, rank, text; queries: query_id, text. Returns query_id, spans (array)."""
    q = queries.select("query_id", tx.keywords("text").alias("kw"), tx.numbers("text").alias("nums"))
    s = sources.join(q, "query_id").select("query_id", "rank", "kw", "nums", F.posexplode(tx.plain_sentences("text")).alias("pos", "sentence"))
    points = F.size(F.array_intersect(tx.numbers("sentence"), "nums")) * 15 + F.size(F.array_intersect(tx.keywords("sentence"), "kw")) * 10
    s = s.withColumn("points", points).where("points > 0")
    first = s.groupBy("query_id", "rank").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("points")).alias("less"), "pos", "sentence"))), 1, per_source).alias("top"))
    every = first.groupBy("query_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "top"))), lambda x: x["top"])).alias("all"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))
    fold = F.aggregate("all", start, lambda acc, x: F.when((acc["n"] + F.length(x["sentence"]) <= most) & ~F.exists(acc["out"], lambda o: F.substring(o, 1, 50) == F.substring(x["sentence"], 1, 50)), F.struct(F.concat(acc["out"], F.array(x["sentence"])).alias("out"), (acc["n"] + F.length(x["sentence"])).alias("n"))).otherwise(acc))
    return every.select("query_id", fold["out"].alias("spans"))


# Span lengths, distances and counts of the positional span extractor.
LEAST, AIM, MOST, APART, SPANS = 80, 250, 300, 50, 5


def positional_spans(text: str, query: str, answer: str = "") -> list[tuple[int, int]]:
    """Spans around hits of the query's and answer's numbers and long words: hits closer than 50 are merged, each
    cluster is widened to about 250 characters and moved to word ends; spans that start within 50 of a kept one go."""
    want = f"{query} {answer}".lower()
    keys = set(re.findall(r"[\d,.]*\d", want)) | set(re.findall(r"\b[a-z]{4,}\b", want))
    hits = sorted((m.start(), m.end()) for k in keys for m in re.finditer(re.escape(k), text.lower()))
    clusters: list[list[int]] = []
    for a, b in hits:
        if clusters and a - clusters[-1][1] < APART:
            clusters[-1][1] = max(clusters[-1][1], b)
        else:
            clusters.append([a, b])
    out: list[tuple[int, int]] = []
    for a, b in clusters:
        room = max(0, AIM - (b - a))
        lo, hi = max(0, a - room // 2), min(len(text), b + room - room // 2)
        hi = min(hi, lo + MOST)
        while lo > 0 and not text[lo - 1].isspace() and lo > a - MOST:
            lo -= 1
        while hi < len(text) and not text[hi].isspace() and hi - lo < MOST + APART:
            hi += 1
        if hi - lo >= min(LEAST, len(text)) and not any(abs(lo - s) < APART for s, _ in out):
            out.append((lo, hi))
    return out[:SPANS]


def evidence_positions(sources: DataFrame, queries: DataFrame, most: int = 500) -> DataFrame:
    """(query_id, rank, begin, end, span) by positional_spans, in order, until 5 spans or `most` characters are passed."""
    j = sources.select("query_id", "rank", "text").join(queries.select("query_id", F.col("text").alias("query")), "query_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.query_id, r.rank, a, b, r.text[a:b]) for r in pdf.itertuples(index=False) for a, b in positional_spans(r.text, r.query)]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "begin", "end", "span"])

    kind = sources.schema["query_id"].dataType.simpleString()
    from pyspark.sql import Window

    spans = j.mapInPandas(run, f"query_id {kind}, rank int, begin int, end int, span string")
    w = Window.partitionBy("query_id").orderBy("rank", "begin").rowsBetween(Window.unboundedPreceding, 0)
    counted = spans.withColumn("total", F.sum(F.length("span")).over(w)).withColumn("n", F.count("*").over(w))
    return counted.where((F.col("total") <= most) & (F.col("n") <= SPANS)).drop("total", "n")
