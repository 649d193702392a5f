"""Statistics and upkeep of a chunk collection: references, duplicates, versions, deletes, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.matching import matches


def _cited(chunks: DataFrame) -> DataFrame:
    """One row a cited reference with its place; titles of fewer than 5 characters go."""
    order = [F.col("file_name"), F.col("chunk_index")]
    refs = chunks.select(F.struct(*order).alias("at"), F.col("file_name").alias("paper"), F.posexplode("cited_references").alias("pos", "r"))
    refs = refs.select(F.struct("at", "pos").alias("ord"), F.coalesce("paper", F.lit("")).alias("paper"), "r.*")
    return refs.where(F.length(tx.strip("ref_title")) >= 5).withColumn("key", tx.normalize_title("ref_title"))


def citation_frequency(chunks: DataFrame, distinct: bool = False) -> DataFrame:
    """title, times_cited, authors, year, doi by normalised title; most cited first, ties to the first seen.

    Raw: every mention counts and the last spelling shows. distinct: each citing paper counts once (mentions without a
    paper count each) and the first spelling shows. chunks: file_name, chunk_index, cited_references (array of structs).
    """
    r = _cited(chunks)
    first = lambda c: F.min_by(c, "ord")
    shown = first("ref_title") if distinct else F.max_by("ref_title", "ord")
    n = F.count_distinct(F.when(F.col("paper") != "", F.col("paper"))) + F.sum((F.col("paper") == "").cast("int")) if distinct else F.count("*")
    return r.groupBy("key").agg(shown.alias("title"), n.cast("long").alias("times_cited"), first("ref_authors").alias("authors"), first("ref_year").alias("year"), first("ref_doi").alias("doi"), F.min("ord").alias("first_seen"))


def top_cited(chunks: DataFrame, k: int = 20, distinct: bool = False) -> DataFrame:
    """The k most cited; k = -1 asks for the papers without references instead."""
    if k == -1:
        return zero_reference_papers(chunks)
    return citation_frequency(chunks, distinct).orderBy(F.desc("times_cited"), "first_seen").limit(k).drop("first_seen")


def reference_totals(chunks: DataFrame) -> DataFrame:
    refs = _cited(chunks).agg(F.count("*").alias("total_refs"), F.count_distinct("key").alias("unique_titles"))
    return refs.crossJoin(chunks.agg(F.count("*").alias("total_chunks")))


def zero_reference_papers(chunks: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """Papers no chunk of which cites anything, with their chunk count; papers (file_name) may name some without chunks."""
    has = F.coalesce(F.size("cited_references") > 0, F.lit(False))
    out = chunks.groupBy("file_name").agg(F.bool_or(has).alias("has"), F.count("*").alias("chunk_count")).where("not has").drop("has")
    if papers is not None:
        every = papers.select("file_name").distinct().join(chunks.select("file_name").distinct(), "file_name", "left_anti").withColumn("chunk_count", F.lit(0).cast("long"))
        out = out.unionByName(every)
    return out


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """(file_name, chunk_index) that occur more than once, and how often; a missing index counts as -1."""
    return chunks.groupBy("file_name", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index")).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_summary(chunks: DataFrame) -> DataFrame:
    g = chunks.groupBy("file_name", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index")).agg(F.count("*").alias("copies"))
    return g.agg(F.sum((F.col("copies") > 1).cast("long")).alias("duplicate_keys"), F.sum(F.col("copies") - 1).alias("extra_rows"), F.count("*").alias("remaining_rows"))


def document_stats(chunks: DataFrame) -> DataFrame:
    """Per file: chunk_count, first added_time and the first GitHub URL seen."""
    order = F.struct(F.coalesce("chunk_index", F.lit(-1)), F.col("chunk_id"))
    url = tx.github_url("text")
    return chunks.groupBy(F.coalesce("file_name", F.lit("unknown")).alias("file_name")).agg(F.count("*").alias("chunk_count"), F.min("added_time").alias("added_time"), F.min_by(url, F.when(url.isNotNull(), order)).alias("github_url"))


def named_text(chunks: DataFrame) -> DataFrame:
    """Chunks that ordered_text() joins."""
    return chunks.where((F.coalesce("file_name", F.lit("unknown")) != "unknown") & ~tx.blank("text"))


def ordered_text(chunks: DataFrame, least: int = 1, separator: str = "\n\n", every: bool = False) -> DataFrame:
    """Each paper's chunks joined in the order of their ids; blank ones and papers named unknown are left out. every: all rows
    count, those without a name as one paper, and all texts are joined but null ones."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"])
    joined = F.when(F.count("text") > 0, F.array_join(texts, separator))
    return (chunks if every else named_text(chunks)).groupBy("file_name").agg(F.count("*").alias("chunks"), joined.alias("text")).where(F.col("chunks") >= least)


def latest_versions(files: DataFrame) -> DataFrame:
    """Of (file_name), each arXiv id with several versions: which row is the latest and which go."""
    base, version = tx.version_parts("file_name")
    f = files.select("file_name", base.alias("base"), version.alias("version")).where("base is not null")
    w = Window.partitionBy("base")
    f = f.withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("version"), "file_name")))
    return f.where("n > 1").select("file_name", "base", "version", (F.col("rn") > 1).alias("outdated"))


def delete_by_name(chunks: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """What is left after a delete; exact=False also removes files whose name merely contains it."""
    hit = F.col("file_name") == name if exact else F.col("file_name").contains(name)
    return chunks.where(~F.coalesce(hit, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Union in which the last row of a key wins: new over old; among new, the largest of `order`."""
    o = F.col(order) if order else F.lit(0)
    both = old.withColumn("__ord", F.struct(F.lit(0).alias("n"), o.alias("o"))).unionByName(new.withColumn("__ord", F.struct(F.lit(1).alias("n"), o.alias("o"))))
    w = Window.partitionBy(*keys).orderBy(F.desc("__ord"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__ord")


def pending(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Questions without a prediction, or with a blank one."""
    done = predictions.where(F.length(tx.strip(F.coalesce("predicted_answer", F.lit("")))) > 0).select("question_id")
    return questions.join(done, "question_id", "left_anti")


def split_found(wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that exist among files (with their path), and those that don't."""
    last = files.groupBy("file_name").agg(F.max("path").alias("path"))
    return wanted.join(last, "file_name"), wanted.join(last, "file_name", "left_anti")


def resolve_file(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For each name the file meant: the exact one, then with .pdf .PDF .docx .txt .md, then the first that contains it."""
    w = wanted.select(F.col("file_name").alias("wanted")).distinct()
    exact = w.select("wanted", F.posexplode(F.array(*[F.concat("wanted", F.lit(s)) for s in ("", ".pdf", ".PDF", ".docx", ".txt", ".md")])).alias("priority", "file_name")).join(files.select("file_name").distinct(), "file_name")
    names = files.select("file_name").distinct()
    held = matches(names.select(F.lower("file_name").alias("low")).distinct(), "low", w.select(F.lower("wanted").alias("term")).distinct(), "term")
    part = w.withColumn("term", F.lower("wanted")).join(held, "term").join(names.withColumn("low", F.lower("file_name")), "low").select("wanted", F.lit(9).alias("priority"), "file_name")
    return exact.select("wanted", "priority", "file_name").unionByName(part).groupBy("wanted").agg(F.min_by("file_name", F.struct("priority", "file_name")).alias("file_name"))


def valid_nodes(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    return chunks.where((F.length(tx.strip(F.coalesce("text", F.lit("")))) > 0) & (F.size(F.coalesce(F.col(vector), F.array().cast("array<float>"))) > 0))


def insert_sizes(chunks: DataFrame, dim: Column) -> DataFrame:
    return chunks.agg(F.sum(F.length("text")).alias("text_chars"), F.sum(F.coalesce(F.length("metadata"), F.lit(0))).alias("metadata_chars"), F.sum(dim * 4).alias("vector_bytes"))


def group_excerpts(hits: DataFrame, groups: int = 5, each: int = 2, chars: int = 300) -> DataFrame:
    """The first 2 hits of the first 5 papers seen, cut to 300 characters."""
    w = Window.partitionBy("query_id", "file_name")
    seen = hits.withColumn("first", F.min("rank").over(w)).withColumn("n", F.row_number().over(w.orderBy("rank")))
    seen = seen.where(F.col("n") <= each).withColumn("g", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first")))
    return seen.where(F.col("g") <= groups).select("query_id", "file_name", F.col("g").alias("paper_no"), F.col("n").alias("excerpt_no"), F.substring("text", 1, chars).alias("excerpt"))


def occurrence_index(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds n: which occurrence of its key a row is, from 0."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def random_rows(rows: DataFrame, k: int, ident: str, seed: int = 0) -> DataFrame:
    """k rows that only the id and the seed decide."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(ident)), ident).limit(k)


def index_stats(chunks: DataFrame, dim: int, metric: str = "cosine") -> DataFrame:
    return chunks.agg(F.count("*").alias("row_count")).withColumn("dim", F.lit(dim)).withColumn("metric", F.lit(metric)).withColumn("empty", F.col("row_count") == 0)


def list_documents(chunks: DataFrame, k: int = 20) -> DataFrame:
    """The first k files with their chunk counts; one placeholder row if there are none."""
    rows = chunks.groupBy("file_name").agg(F.count("*").alias("chunk_count"), F.min("added_time").alias("added_time")).orderBy("file_name").limit(k)
    none = chunks.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit("No documents").alias("file_name"), F.lit(0).cast("long").alias("chunk_count"), F.lit("").alias("added_time"))
    return rows.unionByName(none)


def global_rank(rows: DataFrame, key: str, parts: int = 200) -> DataFrame:
    """rows with n, their rank from 0 by a numeric key: ranks within ranges of the key, plus the counts of the ranges before
    (at most `parts` of them come to the driver), so that no task sorts everything."""
    cuts = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.002)))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col(key))) if cuts else F.lit(0)
    placed = rows.withColumn("__part", place)
    before, skip = 0, []
    for part, many in sorted(map(tuple, placed.groupBy("__part").agg(F.count("*")).collect())):
        skip += [F.lit(part), F.lit(before)]
        before += many
    within = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return placed.withColumn("n", within + F.create_map(*skip)[F.col("__part")] if skip else within).drop("__part")
