"""Around a library: enriching references, fetching works, steps that a language model takes, fused knowledge.

A model is a function of Columns that gives the Column of its answers (a UDF of one's own); what is asked and how answers are
read is worked out here, in the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.boundary import json_of
from lectern.operators import retrieval

#: Variants of a query weigh this much: as asked, rewritten, expanded.
WEIGHTS = (1.0, 0.9, 0.7)
#: Headings of fused knowledge (fixed values).
KNOWLEDGE, WEB, LOCAL = "# 收集到的相关知识\n", "## 网络资源\n", "## 本地论文库\n"
#: Characters and sources of the evidence of an answer, and the least that is worth cutting one for.
EVIDENCE_CHARS, EVIDENCE_SOURCES, EVIDENCE_LEAST = 4000, 5, 200


def _some(x: Column | str) -> Column:
    return F.nullif(F.col(x) if isinstance(x, str) else x, F.lit(""))


def enrich_references(references: DataFrame, works: DataFrame) -> DataFrame:
    """References (ref_title, ref_authors, ref_year, ref_doi, ..) with what a work of the same title, but for case, knows.

    works: title, authors (array), published_date, doi, rank; of works that share a title the first by rank counts. Only what
    the work has replaces what the reference says."""
    first = works.where(F.length("title") > 0).groupBy(F.lower("title").alias("__k")).agg(F.min_by(F.struct("authors", "published_date", "doi"), F.struct("rank", "title")).alias("__w"))
    year = _some(F.regexp_extract("__w.published_date", r"(\d{4})", 1)).cast("int")
    names = F.when(F.size("__w.authors") > 0, F.array_join("__w.authors", ", "))
    out = references.join(first, F.lower("ref_title") == F.col("__k"), "left")
    return out.withColumns({"ref_authors": F.coalesce(names, "ref_authors"), "ref_year": F.coalesce(year, "ref_year"), "ref_doi": F.coalesce(_some("__w.doi"), "ref_doi")}).drop("__k", "__w")


def fetch_plan(wanted: DataFrame, hits: DataFrame, files: DataFrame) -> DataFrame:
    """What to do for each wanted work (query_id, title): status skipped (its file is there), fetch, or failed (no hit or URL).

    hits: query_id, rank, url, file_name of a search (sources.files.search_results). Blank titles are not asked for."""
    best = hits.groupBy("query_id").agg(F.min_by(F.struct("url", "file_name"), "rank").alias("h")).select("query_id", "h.*")
    out = wanted.where(F.length(F.trim("title")) > 0).join(best, "query_id", "left").join(files.select("file_name", F.lit(True).alias("there")).distinct(), "file_name", "left")
    status = F.when(_some("url").isNull(), "failed").when(F.col("there"), "skipped").otherwise("fetch")
    return out.select("query_id", "title", "url", "file_name", status.alias("status"))


def fetched(plan: DataFrame, fetch: Callable[[Column], Column]) -> DataFrame:
    """The plan carried out: fetch gives the bytes of a URL or null; those without become failed, the others success."""
    got = plan.withColumn("content", F.when(F.col("status") == "fetch", fetch(F.col("url"))))
    return got.withColumn("status", F.when(F.col("status") != "fetch", F.col("status")).when(F.col("content").isNull(), "failed").otherwise("success"))


def status_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count("*").alias("n"))


def fusion_weight(answer: Column, default: float = 0.5) -> Column:
    """The weight of the text search that a model's answer names: "0.7 / 0.3", "0.7, 0.3", "7:3" or "BM25: 0.7"."""
    out = F.lit(None).cast("double")
    for mark in (r"(\d+\.?\d*)\s*/\s*(\d+\.?\d*)", r"(\d+\.?\d*)\s*,\s*(\d+\.?\d*)", r"(\d+)\s*:\s*(\d+)"):
        a, b = (F.regexp_extract(answer, mark, i).try_cast("double") for i in (1, 2))
        out = F.coalesce(out, F.when(a + b > 0, a / (a + b)))
    return F.coalesce(out, F.regexp_extract(answer, r"(?i)BM25[:\s]+(\d+\.?\d*)", 1).try_cast("double"), F.lit(default))


def query_variants(queries: DataFrame, rewritten: Column, expansions: Column, most: int = 3) -> DataFrame:
    """(query_id, variant_no, weight, text): the query as asked, its rewriting, and the expansions in a model's answer: those of
    its JSON array, else up to `most` that stand in quotes on lines of their own."""
    array = F.from_json(F.regexp_extract(expansions, r"(?s)(\[.*\])", 1), "array<string>")
    quoted = F.slice(F.transform(F.regexp_extract_all(expansions, F.lit(r'(?:^|\n)\s*\d*\.?\s*["“”]([^"“”]+)["“”]'), F.lit(1)), F.trim), 1, most)
    more = F.when(F.size(F.coalesce(array, F.array())) > 0, array).otherwise(F.coalesce(quoted, F.array().cast("array<string>")))
    texts = F.concat(F.array(F.col("text"), F.coalesce(_some(F.trim(rewritten)), F.col("text"))), more)
    rows = queries.select("query_id", F.posexplode(texts).alias("variant_no", "text")).where(F.length("text") > 0)
    weight = F.when(F.col("variant_no") == 0, WEIGHTS[0]).when(F.col("variant_no") == 1, WEIGHTS[1]).otherwise(WEIGHTS[2])
    return rows.select("query_id", "variant_no", weight.alias("weight"), "text")


def model_grade(queries: DataFrame, hits: DataFrame, answer: Column) -> DataFrame:
    """Grading by a model's answer (a JSON object with score and level, or what can be read of a broken one); by the rules of
    retrieval.grade where there is no object. answer: of the columns query_id and text of queries."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    read = F.from_json(body, "score double, level string")
    score = F.coalesce(read["score"], F.regexp_extract(body, r'"score"\s*:\s*([0-9.]+)', 1).try_cast("double"), F.lit(0.5))
    level = F.coalesce(read["level"], _some(F.regexp_extract(body, r'"level"\s*:\s*"([^"]+)"', 1)), F.lit("medium"))
    level = F.when(level.isin("high", "medium", "low"), level).when(score >= 0.3, "medium").otherwise("low")
    judged = queries.withColumn("__a", answer).withColumn("__good", F.length(body) > 0)
    told = judged.where("__good").select("query_id", F.least(score, F.lit(1.0)).alias("score"), level.alias("level"))
    rules = retrieval.grade(judged.where("not coalesce(__good, false)").select("query_id", "text"), hits)
    return told.unionByName(rules.select("query_id", "score", "level"))


def evidence_text(hits: DataFrame) -> DataFrame:
    """(query_id, evidence): the first five sources, numbered, to 4,000 characters in all; the one that goes past them is cut
    if more than 200 are left, and ends the text either way."""
    rows = hits.where((F.col("rank") <= EVIDENCE_SOURCES) & (F.length("text") > 0)).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("s"))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, x: Column) -> Column:
        left = EVIDENCE_CHARS - acc["used"]
        past = F.length(x["text"]) > left
        text = F.when(acc["over"] | past & (left <= EVIDENCE_LEAST), None).when(past, F.substring(x["text"], F.lit(1), left)).otherwise(x["text"])
        line = F.concat(F.lit("[Evidence "), x["rank"].cast("string"), F.lit("]\n"), text)
        return F.struct((acc["used"] + F.coalesce(F.length(text), F.lit(0))).alias("used"), (acc["over"] | past).alias("over"), F.when(text.isNull(), acc["parts"]).otherwise(F.concat(acc["parts"], F.array(line))).alias("parts"))

    return rows.select("query_id", F.array_join(F.aggregate("s", start, add, lambda acc: acc["parts"]), "\n\n").alias("evidence"))


def entailment(answers: DataFrame, hits: DataFrame, judge: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(query_id, is_supported, confidence) of answers (query_id, question, answer): judge(question, answer, evidence) answers
    with a JSON object. Without an answer or evidence: false, 0; without an object that can be read: true, 0.5."""
    rows = answers.join(evidence_text(hits), "query_id", "left").withColumn("__none", _some("answer").isNull() | _some("evidence").isNull())
    rows = rows.withColumn("__a", F.when(~F.col("__none"), judge(F.col("question"), F.col("answer"), F.col("evidence"))))
    read = F.from_json(F.regexp_extract("__a", r"(?s)(\{.*\})", 1), "is_supported boolean, confidence double")
    return rows.select("query_id", F.when(F.col("__none"), False).otherwise(F.coalesce(read["is_supported"], F.lit(True))).alias("is_supported"), F.when(F.col("__none"), 0.0).otherwise(F.coalesce(read["confidence"], F.lit(0.5))).alias("confidence"))


def fuse_knowledge(web: DataFrame, local: DataFrame) -> DataFrame:
    """(query_id, context): the first 10 web results (rank, title, snippet), and of the first 5 papers among the local ones (rank,
    paper, text) the first 2 excerpts of 300 characters."""
    lines = lambda rows, key, line: rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*key, line.alias("t")))), lambda x: x["t"]).alias("t"))
    w = lines(web.where("rank <= 10"), ["rank"], F.concat("rank", F.lit(". **"), F.coalesce("title", F.lit("")), F.lit("**\n   "), F.coalesce("snippet", F.lit("")), F.lit("\n")))
    own = local.withColumn("paper", F.coalesce("paper", F.lit("Unknown")))
    order = own.groupBy("query_id", "paper").agg(F.min("rank").alias("first"))
    order = order.withColumn("paper_no", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).where("paper_no <= 5").drop("first")
    two = own.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "paper").orderBy("rank"))).where("n <= 2").join(order, ["query_id", "paper"])
    text = F.substring("text", 1, 300)
    papers = two.groupBy("query_id", "paper_no", "paper").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.when(F.length(text) > 0, F.concat(F.lit("- "), text, F.lit("..."))).alias("t")))), lambda x: x["t"]), "\n").alias("x"))
    papers = lines(papers, ["paper_no"], F.concat(F.lit("### "), "paper", F.when(F.length("x") > 0, F.concat(F.lit("\n"), "x")).otherwise(""), F.lit("\n")))
    both = w.withColumnRenamed("t", "w").join(papers.withColumnRenamed("t", "p"), "query_id", "full_outer")
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.array(F.lit(head)), c)).otherwise(F.array().cast("array<string>"))
    return both.select("query_id", F.array_join(F.concat(F.array(F.lit(KNOWLEDGE)), part(WEB, "w"), part(LOCAL, "p")), "\n").alias("context"))


def ask(rows: DataFrame, prompt: Column, model: Callable[[Column], Column], schema: str, name: str = "reply") -> DataFrame:
    """rows with a model's reply to a prompt, read as JSON of that schema wherever it stands in the text; null if it can't be.
    Ideas, analyses and web searches are asked for this way."""
    return rows.withColumn(name, F.from_json(json_of(model(prompt)), schema))


def limit_questions(questions: DataFrame, most: int | None, ident: str = "question_id") -> DataFrame:
    """The first `most` questions by id; all without it."""
    return questions if most is None else questions.orderBy(ident).limit(most)


def sample_chunks(chunks: DataFrame, most: int | None = None, how: str = "uniform", seed: int = 0) -> DataFrame:
    """Chunks in the order of file and place: all of them, the first `most`, or as many that a hash spreads over all."""
    if most is not None:
        chunks = chunks.orderBy(*(["file_name", "chunk_index"] if how == "first" else [F.xxhash64(F.lit(seed), "file_name", "chunk_index")])).limit(most)
    return chunks.orderBy("file_name", "chunk_index")
