"""Compound operators: ingest, retrieve, search, graph search, evaluation runs; each one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.boundary import embed
from lectern.functions.classify import answer_type, route, threshold, visual_query, visual_text
from lectern.operators import citations, evaluation, graph, library, retrieval
from lectern.operators.chunking import Chunker, chunk_documents
from lectern.session import written

SAMPLE = pa.schema([(c, pa.string()) for c in ("file_name", "question", "answer", "reference")])


@dataclass(frozen=True)
class Config:
    chunk_size: int = 512
    chunk_overlap: int = 0
    least_chunk: int = 100
    top_k: int = 5
    vector_pool: int = 50
    text_pool: int = 100
    alpha: float = 0.5
    embed_dim: int = 64
    rerank_threshold: float = 0.0
    score_cutoff: float | None = None

    def validate(self) -> None:
        if self.embed_dim % 64:
            raise ValueError("embed_dim must divide by 64")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must lie in [0, 1]")


def ingest(docs: DataFrame, config: Config = Config(), model=None, references: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Documents (file_name, text) to stored chunks: chunked, linked to references, embedded, blank ones dropped."""
    config.validate()
    chunks = chunk_documents(docs, Chunker(config.chunk_size, config.chunk_overlap, config.least_chunk), "file_name")
    chunks = chunks.withColumn("chunk_id", F.xxhash64("file_name", "chunk_index")).withColumn("paper_id", F.col("file_name")).withColumn("github_url", tx.github_url("text"))
    if references is not None:
        chunks = chunks.join(citations.cited_references(chunks, references), "chunk_id", "left")
    return library.valid_nodes(chunks.withColumn("embedding", embed(F.col("text"), config.embed_dim, model)))


def retrieve(queries: DataFrame, chunks: DataFrame, config: Config = Config(), key: str = "chunk_id") -> DataFrame:  # noqa: B008
    """Hybrid retrieval of queries (query_id, text, embedding): pools of both searches, fused, with their texts."""
    v = retrieval.knn(queries, chunks, config.vector_pool, key)
    b = retrieval.bm25_top_k(queries, chunks, config.text_pool, key)
    fused = retrieval.fuse(v, b.select("query_id", key, "score"), config.top_k, config.alpha, key)
    if config.score_cutoff is not None:
        fused = fused.where(F.col("score") >= config.score_cutoff)
    return fused.join(chunks.select(key, "text", "file_name"), key)


def search(queries: DataFrame, chunks: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """retrieve, grade, rerank: hits with the verdict and the mode that the router gives each query. The hits are written once."""
    hits = written(retrieve(queries, chunks, config), "hits")
    verdicts = retrieval.grade(queries, hits)
    ranked = retrieval.rerank(queries, hits, config.top_k, config.rerank_threshold)
    modes = queries.select("query_id", route(F.col("text")).alias("mode"))
    return ranked.join(verdicts.select("query_id", F.col("score").alias("quality"), "level"), "query_id").join(modes, "query_id")


def answer_context(hits: DataFrame) -> DataFrame:
    """Per query the numbered sources as one text."""
    line = F.concat(F.lit("[来源"), F.col("rank"), F.lit("] "), F.coalesce("file_name", F.lit("unknown")), F.lit("\n"), F.col("text"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def format_hits(hits: DataFrame, chars: int = 200) -> Column:
    return F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce("file_name", F.lit("unknown")), F.lit(" ("), F.format_string("%.3f", "score"), F.lit(")\n"), tx.ellipsis("text", chars))


def use_vision(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether a query needs a vision model: by its words, or by an image, caption or mention among its sources."""
    s = sources.groupBy("query_id").agg(F.bool_or(F.length(F.coalesce("image_path", F.lit(""))) > 0).alias("image"), F.bool_or(F.coalesce("is_caption", F.lit(False))).alias("caption"), F.bool_or(visual_text(F.col("text"))).alias("mention"))
    no = F.lit(False)
    return queries.join(s, "query_id", "left").select("query_id", (visual_query(F.col("text")) | F.coalesce("image", no) | F.coalesce("caption", no) | F.coalesce("mention", no)).alias("vision"))


def answer_or_refuse(queries: DataFrame, hits: DataFrame) -> DataFrame:
    kind = answer_type(F.col("text"))
    return retrieval.answerable(queries, hits, kind, threshold(kind))


def graph_search(vertices: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    found, triplets = graph.search(vertices, edges, queries, k)
    return graph.context_text(found, triplets)


def hybrid_context(vector_hits: DataFrame, entities: DataFrame, triplets: DataFrame) -> DataFrame:
    """Texts of the first 5 hits, 10 entities, 3 + 3 triplets, as one context a query."""
    texts = vector_hits.where("rank <= 5").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.substring("text", 1, 300).alias("t")))), lambda x: x["t"]), "\n").alias("texts"))
    return texts.join(graph.context_text(entities, triplets, 10, 3), "query_id", "full_outer").select("query_id", F.concat_ws("\n\n", "texts", "context").alias("context"))


def reparse(chunks: DataFrame, files: DataFrame, again) -> DataFrame:
    """Papers without references that a file exists for are parsed again; their old rows are replaced."""
    zero = library.zero_reference_papers(chunks).join(files, "file_name", "left_semi").select("file_name")
    return chunks.join(zero, "file_name", "left_anti").unionByName(again(files.join(zero, "file_name", "left_semi")), allowMissingColumns=True)


def sync(folder: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files of a folder that are not in the collection yet."""
    return folder.join(chunks.select("file_name").distinct(), "file_name", "left_anti")


def translate(predictions: DataFrame, translator: Column) -> DataFrame:
    """Answers with CJK characters are translated; all other rows pass as they are."""
    return predictions.withColumn("predicted_answer", F.when(tx.contains_cjk("predicted_answer"), translator).otherwise(F.col("predicted_answer")))


def predict(questions: DataFrame, chunks: DataFrame, predictions: DataFrame, answer, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Answers the questions still open (query_id, text, embedding), with evidence, and merges them into the predictions."""
    todo = library.pending(questions.withColumnRenamed("query_id", "question_id"), predictions).withColumnRenamed("question_id", "query_id")
    hits = retrieve(todo, chunks, config)
    spans = evaluation.evidence_sentences(hits, todo)
    context = answer_context(hits)
    new = todo.join(context, "query_id", "left").join(spans, "query_id", "left").select(F.col("query_id").alias("question_id"), answer(F.col("text"), F.col("context")).alias("predicted_answer"), F.coalesce("spans", F.array().cast("array<string>")).alias("predicted_evidence"))
    return library.upsert(predictions, new, ["question_id"])


def evaluate(gold: DataFrame, predictions: DataFrame, cut_to_predicted: bool = False) -> DataFrame:
    """Run metrics; cut_to_predicted keeps only gold questions that were predicted (missing is then 0)."""
    g = gold.join(predictions.select("question_id").distinct(), "question_id", "left_semi") if cut_to_predicted else gold
    return evaluation.run_metrics(evaluation.best_scores(g, predictions))


def testset(chunks: DataFrame, least: int = 5) -> DataFrame:
    """Papers of at least 5 main-content chunks, as whole texts in a fixed order."""
    from lectern.functions.classify import is_main_content

    return library.ordered_text(chunks.where(is_main_content(F.col("text"))), least)


def index_counts(chunks: DataFrame, k: int = 10) -> DataFrame:
    """The k papers with most chunks."""
    return chunks.groupBy("file_name").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("chunks"), "file_name").limit(k)


def index_papers(papers: DataFrame, path: str, config: Config = Config(), model=None, figures: bool = True, split: str = "") -> DataFrame:  # noqa: B008
    """Paragraphs (and captions) of papers, embedded and stored in a chunk table; returns the statistics of these papers.

    A paper that is stored already is replaced (its folder of the table is), so that a second run changes nothing; other papers
    stay as they are. Without figures only texts are stored. A paper without a paragraph or caption long enough is not listed."""
    from lectern.sources import sinks

    p = evaluation.paragraph_nodes(papers).select("paper_id", "title", "text", F.lit(False).alias("is_caption"), F.concat_ws("-", F.lit("p"), "section_index", "paragraph_index").alias("place"))
    if figures:
        c = evaluation.caption_nodes(papers).join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id")
        p = p.unionByName(c.select("paper_id", "title", "text", F.lit(True).alias("is_caption"), F.concat_ws("-", F.lit("c"), "figure_index").alias("place")))
    rows = p.withColumn("chunk_id", F.xxhash64("paper_id", "place")).withColumn("file_name", F.concat("paper_id", F.lit(".txt")))
    sinks.replace_files(library.valid_nodes(rows.withColumn("embedding", embed(F.col("text"), config.embed_dim, model))), path)
    stored = papers.sparkSession.read.parquet(path).join(papers.select(F.col("id").alias("paper_id")).distinct(), "paper_id", "left_semi")
    return stored.groupBy("paper_id", F.col("title").alias("paper_title"), "file_name").agg(F.count("*").alias("chunk_count"), F.sum(F.col("is_caption").cast("long")).alias("figure_caption_count"), F.lit(split).alias("source_split"), tx.stamp().alias("added_time"))


def predict_alone(questions: DataFrame, predictions: DataFrame, answer) -> DataFrame:
    """Answers the questions still open (question_id, text) by the model alone, without search or evidence."""
    new = library.pending(questions, predictions).select("question_id", answer(F.col("text")).alias("predicted_answer"), F.array().cast("array<string>").alias("predicted_evidence"))
    return library.upsert(predictions, new, ["question_id"])


def read_testset(chunks: DataFrame, ask: Callable[[Iterator[str]], Iterable[tuple[str, str, str]]], least: int = 5) -> DataFrame:
    """(file_name, question, answer, reference) that ask() gives for each text of testset(), which it gets in pieces, one after
    another: a paper is read as its chunks come off the sort, so that it is never held whole, be it larger than a row or a task."""
    from lectern.functions.classify import is_main_content

    good = library.named_text(chunks.where(is_main_content(F.col("text")))).select("file_name", "chunk_id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
        for name, own in groupby(rows, itemgetter(0)):
            texts = (t for _, t in own)
            first = list(islice(texts, least))
            if len(first) == least:
                pieces = (piece for n, t in enumerate(chain(first, texts)) for piece in (("\n\n", t) if n else (t,)))
                yield pa.RecordBatch.from_pylist([dict(zip(SAMPLE.names, (name, *s), strict=True)) for s in ask(pieces)], SAMPLE)

    ordered = good.repartition("file_name").sortWithinPartitions("file_name", "chunk_id", "text")
    return ordered.mapInArrow(read, "file_name string, question string, answer string, reference string")


def evaluate_testset(chunks: DataFrame, ask, metrics: dict, least: int = 5, in_pieces: bool = False) -> tuple[DataFrame, DataFrame]:
    """A test set from the papers' whole texts, answered, filtered and scored: samples with their metrics, and the summary.

    ask(text) gives array<struct<question, answer, reference>>, and with in_pieces is that of read_testset(), for papers that are
    no row's size; metrics: name -> (question, answer, reference) -> Column."""
    from lectern.functions.classify import is_low_quality

    if in_pieces:
        rows = read_testset(chunks, ask, least)
    else:
        rows = testset(chunks, least).select("file_name", F.explode(ask(F.col("text"))).alias("s")).select("file_name", "s.*")
    rows = rows.where(~is_low_quality(F.col("question")))
    scored = rows.withColumns({name: f(F.col("question"), F.col("answer"), F.col("reference")) for name, f in metrics.items()})
    return scored, evaluation.metric_summary(scored, list(metrics))


def graph_of_documents(docs: DataFrame, extract) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graph.build of whole documents (ident, text), which become the chunks doc_0, doc_1, .. in the order of their ids."""
    rows = library.global_rank(docs, "ident").select(F.concat(F.lit("doc_"), "n").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("doc_"), "n").alias("paper_id"), "text")
    return graph.build(rows, extract)
