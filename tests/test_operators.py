"""Operators on hand cases."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, citations, evaluation, graph, layout, library, retrieval
from lectern.operators.chunking import Chunker


def test_bm25_matches_formula(spark):
    import math

    docs = [(1, "red fox red"), (2, "blue fox"), (3, "green hen sings"), (4, "")]
    q = spark.createDataFrame([(7, "red fox fox")], "query_id long, text string")
    got = {r.chunk_id: r.score for r in retrieval.bm25(q, spark.createDataFrame(docs, "chunk_id long, text string")).collect()}
    bags = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, bags.values())) / len(docs)
    df = {w: sum(w in b for b in bags.values()) for b in bags.values() for w in b}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    for i, b in bags.items():
        want = sum(idf[w] * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for w in "red fox fox".split() if w in b)
        assert got.get(i, 0) == pytest.approx(want)


def test_bm25_search_is_bm25(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 23))) for i in range(200)], "chunk_id long, text string")
    q = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i} w3", 0.5 + i) for i in range(9)], "query_id long, text string, weight double")
    best = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in retrieval.top_k(df.withColumn("score", F.round("score", 6)), 7).collect())
    assert best(retrieval.bm25_search(q, docs.repartition(3), 7)) == best(retrieval.bm25(q, docs))
    assert retrieval.bm25_search(q.limit(0), docs, 7).collect() == [] and retrieval.bm25_search(q, docs.limit(0), 7).collect() == []


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double")


def test_fusion(spark):
    v, b = hits(spark, [(1, "A", 0.9), (1, "B", 0.6)]), hits(spark, [(1, "B", 10.0), (1, "C", 5.0)])
    got = [(r.chunk_id, round(r.score, 6)) for r in retrieval.fuse(v, b, 3).orderBy("rank").collect()]
    assert got == [("B", 0.8335), ("A", 0.500167), ("C", 0.250143)]
    got = [(r.chunk_id, round(r.score, 6)) for r in retrieval.simple_fuse(v, b, 3).orderBy("rank").collect()]
    assert got == [("A", 1.0), ("B", 0.833333), ("C", 0.5)]
    only = [r.chunk_id for r in retrieval.fuse(v, b, 2, alpha=1.0).orderBy("rank").collect()]
    assert only == ["A", "B"]


def test_occurrences(spark):
    r = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (1, "a", 0.3)], "query_id long, text string, score double")
    assert [(x.text, round(x.score, 6), x.best_raw) for x in retrieval.occurrence_fuse(r).orderBy("rank").collect()] == [("a", 0.032787, 0.3), ("b", 0.016393, 0.2)]


def test_grading(spark):
    q = spark.createDataFrame([(1, "graph neural networks"), (2, "nothing")], "query_id long, text string")
    h = spark.createDataFrame([(1, 1, "graph neural networks are fun", 0.8), (1, 2, "networks", 0.4)], "query_id long, rank int, text string, score double")
    got = {r.query_id: (round(r.score, 6), r.level) for r in retrieval.grade(q, h).collect()}
    assert got == {1: (0.866667, "high"), 2: (0.0, "low")}


def test_rerank_gate(spark):
    h = hits(spark, [(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7), (2, "a", 1.0), (2, "b", 0.0), (2, "c", 0.0), (3, "a", 0.5), (3, "b", 0.5)])
    got = {r.query_id: r.rerank for r in retrieval.rerank_gate(h).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_correct_by_level(spark):
    v = spark.createDataFrame([(1, "high"), (2, "low")], "query_id long, level string")
    h = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.1)], "query_id long, text string, score double")
    more = spark.createDataFrame([(1, "z", 0.9), (2, "b", 0.2), (2, "c", 0.2)], "query_id long, text string, score double")
    got = sorted((r.query_id, r.text, round(r.score, 4)) for r in retrieval.correct(v, h, more, more).collect())
    assert got == [(1, "a", 0.9), (2, "b", round(2 / 61, 4)), (2, "c", round(1 / 61, 4))]


def test_knn_ties_and_zero(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [3.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.chunk_id, r.score) for r in retrieval.knn(q, v, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (4, 0.0)]


REF = "array<struct<ref_id: string, ref_title: string, ref_authors: string, ref_year: int, ref_doi: string, ref_venue: string>>"


def refs(*titles):
    return [("r", t, "A", 2000, None, None) for t in titles]


def test_citation_frequency(spark):
    rows = [("p1", 0, refs("Attention Is All You Need")), ("p1", 1, refs("attention is  all you need", "BERT")), ("p2", 0, refs("ATTENTION IS ALL YOU NEED")), ("p3", 0, [])]
    c = spark.createDataFrame(rows, f"file_name string, chunk_index int, cited_references {REF}")
    raw = library.citation_frequency(c).collect()
    assert [(r.title, r.times_cited) for r in raw] == [("ATTENTION IS ALL YOU NEED", 3)]
    once = library.citation_frequency(c, distinct=True).collect()
    assert [(r.title, r.times_cited) for r in once] == [("Attention Is All You Need", 2)]
    assert [r.file_name for r in library.top_cited(c, -1).collect()] == ["p3"]


def test_duplicates(spark):
    c = spark.createDataFrame([("f", 0)] * 3 + [("f", 1)] + [("g", 0)] * 2, "file_name string, chunk_index int")
    assert tuple(library.duplicate_summary(c).first()) == (2, 3, 3)


def test_versions(spark):
    f = spark.createDataFrame([("2603.11298.pdf",), ("2603.11298v2.pdf",), ("2401.00001.pdf",), ("2603.11298v10.pdf",)], "file_name string")
    assert sorted(r.file_name for r in library.latest_versions(f).where("outdated").collect()) == ["2603.11298.pdf", "2603.11298v2.pdf"]


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([(1, "a"), (2, " ")], "question_id int, predicted_answer string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "question_id int, predicted_answer string")
    both = library.upsert(old, new, ["question_id"])
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    q = spark.createDataFrame([(1,), (2,), (4,)], "question_id int")
    assert sorted(r[0] for r in library.pending(q, old).collect()) == [2, 4]


def test_resolve(spark):
    f = spark.createDataFrame([("A.pdf",), ("b.txt",), ("my long name.md",)], "file_name string")
    w = spark.createDataFrame([("A",), ("b.txt",), ("LONG",), ("zz",)], "file_name string")
    assert {r.wanted: r.file_name for r in library.resolve_file(w, f).collect()} == {"A": "A.pdf", "b.txt": "b.txt", "LONG": "my long name.md"}


@pytest.mark.parametrize(("authors", "want"), [("Steven J. Gortler, et al.", "Gortler"), ("Marc Levoy and Pat Hanrahan", "Levoy"), ("Tianwei Liu, et al.", "Liu"), ("S. Karamcheti", "Karamcheti"), ("", None), (None, None), ("Sammy Davis Jr", "Davis")])
def test_surname(spark, authors, want):
    assert spark.createDataFrame([(authors,)], "a string").select(citations.surname_of("a")).first()[0] == want


def test_surname_of_lists(spark):
    cases = {"Li Wei": "Wei", "J Smith, K. Jones": "Smith", "Jr Dr": "Jr", "van Dam, A. & Feiner": "Dam", "Ann Lee MD et al.": "Lee", "Ö. Åberg": "Åberg", "A. Bee, C. Dee, et al": "Dee", "Ann Bee,": "Bee", "Madonna": "Madonna", "  ": None}
    got = spark.createDataFrame([(a,) for a in cases], "a string").select("a", citations.surname_of("a").alias("s")).collect()
    assert {r.a: r.s for r in got} == cases


def test_author_years_places(spark):
    text = "(Doe 1999; Roe, 2001b; nobody) Poe (2000) [Zoe and Noe 1990; x] end Coe et al., 1987; (Moe 1970)"
    rows = spark.createDataFrame([(text,), (None,), ("none",), ("[;]",)], "t string").select(citations.author_years(F.col("t"))).collect()
    got = [(c.author, c.year, text[c.position : c.position + 3]) for c in rows[0][0]]
    assert got == [("Doe", "1999", "Doe"), ("Roe", "2001b", "Roe"), ("Poe", "2000", "Poe"), ("Zoe", "1990", "Zoe"), ("Coe et al.", "1987", "Coe"), ("Moe", "1970", "(Mo")]
    assert [r[0] for r in rows[1:]] == [None, [], []]


@pytest.mark.parametrize(("mark", "want"), [("[1, 2-4]", [1, 2, 3, 4]), ("[3-7]", [3, 4, 5, 6, 7]), ("[1 - 3]", [1, 3]), ("[9]", [9])])
def test_numeric_citations(spark, mark, want):
    df = spark.createDataFrame([(1, f"text {mark} more")], "chunk_id int, text string")
    assert [r.ref_no for r in citations.numeric_citations(df).orderBy("ref_no").collect()] == want


def test_link_drops_unknown(spark):
    c = spark.createDataFrame([(1, "p", "a [1] b [998]")], "chunk_id int, paper_id string, text string")
    r = spark.createDataFrame([("p", "ref_1")], "paper_id string, ref_id string")
    assert citations.cited_references(c, r).first().ref_ids == ["ref_1"]


def test_author_year(spark):
    refs = spark.createDataFrame([("p", "ref_1", "Steven J. Gortler, et al.", 1996, 1), ("p", "ref_2", "Marc Levoy and Pat Hanrahan", 1996, 2), ("p", "ref_3", "Tianwei Liu, et al.", 2023, 3), ("p", "ref_4", "Xin Liu, et al.", 2023, 4)], "paper_id string, ref_id string, ref_authors string, ref_year int, ord int")
    text = "Gortler et al. (1996) and Levoy (1996); see [Barron et al. 2022; Liu et al. 2023a] or (Liu et al. 2023)."
    c = citations.author_year_citations(spark.createDataFrame([(1, text)], "chunk_id int, text string")).withColumn("paper_id", F.lit("p"))
    got = [(r.author.split()[0], r.year, r.ref_id) for r in citations.resolve_author_year(c, refs).orderBy("position").collect()]
    assert got == [("Gortler", "1996", "ref_1"), ("Levoy", "1996", "ref_2"), ("Barron", "2022", None), ("Liu", "2023a", "ref_4"), ("Liu", "2023", "ref_4")]


def test_reference_batches():
    section = "\n".join(f"[{i}] " + "x" * 50 for i in range(100))
    pieces = citations.batch_references(section, 1000)
    assert "\n".join(pieces) == section and max(map(len, pieces)) <= 1000


@pytest.mark.parametrize("text", ["", "   ", "\n\n\n", None])
def test_chunk_blank(text):
    assert Chunker(50, 10, 100).split(text) == []


def test_chunker_cases():
    assert [len(c) for c in Chunker(130, 0, 100).split("\n\n".join(["a" * 60] * 3))] == [122, 60]
    assert Chunker(20, 0, 5, parity=True).split("aaaa bbbb\n\ncccc dddd\n\neeee") == []
    whole = Chunker(20, 0, 5).split("aaaa bbbb\n\ncccc dddd\n\neeee")
    assert len(whole) == 1 and all(w in whole[0] for w in "aaaa bbbb cccc dddd eeee".split())
    long = "这是一个句子，用来测试分块。" * 20
    assert max(map(len, Chunker(100, 20, 50).split(long))) <= 120


def test_chunker_keeps_all_words():
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(i % 40 + 1)) + "." for i in range(60))
    joined = " ".join(Chunker(200, 0, 50).split(text))
    assert all(w.rstrip(".") in joined for w in text.split())


def test_chunk_documents(spark):
    d = spark.createDataFrame([(1, "a" * 60 + "\n\n" + "b" * 80), (2, None)], "doc_id long, text string")
    got = chunking.chunk_documents(d, Chunker(100, 0, 20)).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, len(r.text)) for r in got] == [(1, 0, 60), (1, 1, 80)]


def scored(spark, f, a, b, kind="string"):
    return spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(f(F.col("a"), F.col("b"))).first()[0]


def test_f1(spark):
    assert scored(spark, evaluation.token_f1, "The cat sat on the mat.", "A cat sat") == pytest.approx(2 / 3)
    assert scored(spark, evaluation.token_f1, "", "x") == 0
    assert scored(spark, evaluation.evidence_f1, ["x", "y"], ["y", "z", "w"], "array<string>") == pytest.approx(0.4)
    assert scored(spark, evaluation.evidence_f1, [], [], "array<string>") == 1
    assert scored(spark, evaluation.evidence_f1, ["x"], [], "array<string>") == 0
    assert scored(spark, evaluation.semantic_f1, "True", "yes") == pytest.approx(0.999)


def test_positional_spans():
    text = "lorem ipsum " * 40 + "the accuracy was 93.5 percent here " + "dolor sit " * 40
    spans = evaluation.positional_spans(text, "What accuracy", "93.5")
    assert spans and any("93.5" in text[a:b] for a, b in spans) and all(b - a <= 350 for a, b in spans)


def test_boxes(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    b = spark.createDataFrame([(1, 1, 0, (0.0, 0.0, 2.0, 2.0)), (1, 1, 1, (1.0, 1.0, 3.0, 3.0)), (1, 1, 2, (0.0, 0.0, 2.0, 1.9))], f"doc_id long, page int, idx int, bbox {box}")
    assert sorted(r.idx for r in layout.suppress(b).collect()) == [0, 1]
    assert layout.overlaps(b, 0.1).where("idx = 0 and idx2 = 1").first().iou == pytest.approx(1 / 7)


def graph_tables(spark):
    e = spark.createDataFrame([("BERT", "Model", "first", 1), ("Google", "Organization", "", 2), ("NLP", "Domain", "", 3), ("bert", "Other", "second", 4)], "name string, type string, description string, ord int")
    edges = spark.createDataFrame([("bert", "developed_by", "google"), ("bert", "used_for", "nlp"), ("google", "focuses_on", "nlp"), ("nlp", "loops", "bert")], "src string, label string, dst string")
    return graph.add_entities(None, e), edges


def test_graph(spark):
    v, e = graph_tables(spark)
    assert {r.id: r.description for r in v.collect()}["bert"] == "first"
    q = spark.createDataFrame([(1, "BERT"), (2, "about nlp")], "query_id long, text string")
    assert sorted((r.query_id, r.id, r.score) for r in graph.search_entities(v, q).collect()) == [(1, "bert", 1.0), (2, "nlp", 0.5)]
    start = spark.createDataFrame([("bert",)], "id string")
    assert {(r.src, r.dst, r.hop) for r in graph.k_hop(e, start, 3).collect()} == {("bert", "google", 1), ("bert", "nlp", 1), ("google", "nlp", 2), ("nlp", "bert", 2)}
    assert sorted(r.neighbour for r in graph.neighbours(e, start, "USED_for").collect()) == ["nlp"]
    found, triplets = graph.search(v, e, q)
    assert "BERT (Model)" in graph.context_text(found, triplets).where("query_id = 1").first().context


def test_graph_build(spark):
    from lectern.functions.boundary import pattern_triplets

    text = "In short we find that ModelA uses Attention and ModelA improves Baseline in all of the tests."
    c = spark.createDataFrame([("p", 0, "c0", text), ("p", 1, "c1", "short")], "paper_id string, chunk_index int, chunk_id string, text string")
    v, e, counters = graph.build(c, pattern_triplets)
    assert {(r.src, r.label, r.dst) for r in e.collect()} == {("modela", "uses", "attention"), ("modela", "improves", "baseline")}
    row = counters.first()
    assert (row.chunks, row.skipped, row.triplets, row.batches) == (2, 1, 2, 1)


def test_graph_build_keeps_all_triplets(spark):
    from lectern.functions.boundary import pattern_triplets

    text = "We see: " + ". ".join(f"Model{i} uses Part{i}" for i in range(1100))
    c = spark.createDataFrame([("p", 0, "c0", text), ("p", 1, "c1", "Later on we find that MODEL1050 uses Part1050 once more.")], "paper_id string, chunk_index int, chunk_id string, text string")
    v, e, counters = graph.build(c, pattern_triplets)
    got = {(r.src, r.label, r.dst): (r.added, r.chunk_id) for r in e.collect()}
    assert got == {(f"model{i}", "uses", f"part{i}"): (1 + (i == 1050), "c0") for i in range(1100)}
    assert v.where("id = 'model1050'").first().name == "Model1050" and v.count() == 2200
    assert counters.first().triplets == 1101
    assert graph.build(c, pattern_triplets, most=5)[1].count() == 6


def test_cache_outcomes_across_batches(spark):
    import datetime as dt
    import random

    from lectern.streaming.incremental import cache_outcomes

    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), start + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(300)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    got = {r.event_id: r.hit for r in cache_outcomes(spark.createDataFrame(rows, "key string, ts timestamp, event_id long"), 60).collect()}
    spark.conf.set(key, before)
    made, want = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[i] = k in made and (t - made[k]).total_seconds() < 60
        if not want[i]:
            made[k] = t
    assert got == want


def test_pattern_triplets_are_ascii(spark):
    """Words end at other letters, as in the SQL of graph_build (RE2)."""
    from lectern.functions.boundary import pattern_triplets

    text = "éIn of erßie and X1 is ré, Model has Ciónx, No\u00a0is here, So\x0bis there"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(pattern_triplets(F.col("t"))).alias("x")).select("x.head", "x.relation", "x.tail").collect()
    assert [tuple(r) for r in got] == [("In", "of", "er"), ("Model", "has", "Ci")]
    import duckdb

    from lectern.plans.queries_graph import _FOUND

    sql = duckdb.execute(f"SELECT unnest({_FOUND.format(1)}), unnest({_FOUND.format(2)}), unnest({_FOUND.format(3)}) FROM (SELECT ? AS text)", [text]).fetchall()
    assert sql == [tuple(r) for r in got]


def test_weak_samples_of_ties(spark):
    """Rows of equal metric and question are taken by their answer, not by their place."""
    rows = [("q", a, 0.1) for a in "hgfedcba"] + [("p", "z", 0.2), ("q", "a", 0.7)]
    for again in (rows, rows[::-1]):
        df = spark.createDataFrame(again, "question string, answer string, faithfulness double").repartition(3)
        assert [tuple(r) for r in evaluation.weak_samples(df, k=3).collect()] == [("q", a, 0.1) for a in "abc"]


def test_semantic_chunks_of_huge_paragraphs(spark, tmp_path):
    """A short paragraph before one of more than ten sizes: one chunk in the query, as in its SQL; the chunker splits it by default."""
    import duckdb

    from lectern.plans import catalog

    texts = ["short one\n" + "Some words of it. " * 500, "short one\n" + "x" * 6000 + "\nend", "Plain text. " * 900, "a\n\nb", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, catalog.queries()["semantic_chunks"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(catalog.oracle_sql()["semantic_chunks"]).fetchall())
    assert max(len(r[2]) for r in got) > 5120 and max(map(len, Chunker(512, 50, 100).split(texts[0].replace("\n", "\n\n")))) <= 512


def test_chunks_are_made_some_rows_at_a_time(spark):
    """One output batch a step of rows, not one of all chunks of 10,000 documents."""
    import pyarrow as pa

    d = spark.range(1000).selectExpr("id as doc_id", "repeat('word of text. ', 20 + cast(id % 3 as int)) as text").coalesce(1)
    batches = chunking.chunk_documents(d, split=chunking.simple_split).mapInArrow(lambda bs: (type(b).from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert sum(r.n for r in batches) == 1000
    seen = []

    class Frame:
        schema = d.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            seen.extend(b.num_rows for b in run([pa.RecordBatch.from_pydict({"key": list(range(1000)), "text": ["a b"] * 999 + [None]})]))
            return self

        def withColumnRenamed(self, *_):  # noqa: N802
            return self

    chunking.chunk_documents(Frame(), split=chunking.simple_split)
    assert sum(seen) == 999 and max(seen) <= chunking.ROWS_A_STEP


def against_sql(spark, folder, name):
    """The rows of a query and of its SQL over the parquet tables in a folder, sorted."""
    import duckdb

    from lectern.plans import catalog

    db = duckdb.connect()
    for p in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    sql = db.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(sql, key=repr)


def test_clause_split_of_blank_texts(spark, tmp_path):
    """Blank and null texts have no clauses, as in the SQL; white space is ASCII there, and U+001E cuts."""
    texts = ["", " \n", None, "a, b；c", "a,\u00a0b ;\u3000", "a,\x0bb", "a\x1eb, c\x1e", "，；,;", "x\r\n, y \n", "\u00a0", "\x1e", "a \u2028", "b \x85", "abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, sql = against_sql(spark, tmp_path, "clause_split")
    assert got == sql
    assert [n for _, n, _ in sorted(got)[:4]] == [0, 0, None, 3]


def test_ordered_concat_of_blank_texts(spark, tmp_path):
    """Blank texts count and are joined, null ones count only, and rows without an id are a paper, as in the SQL."""
    texts = {0: "", 37: " \n", 1: None, 74: None, 3: " "}
    rows = [(i, texts.get(i, f"text {i}")) for i in range(37 * 5) if i % 37 < 4] + [(37 * k + 9, None) for k in range(5)] + [(None, "same")] * 6
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, sql = against_sql(spark, tmp_path, "ordered_concat")
    assert got == sql and len(got) == 6
    assert ("paper9.pdf", 5, None) in got


def test_weak_samples_of_nulls_and_ties(spark, tmp_path):
    """Null props come last and rows without an id don't count, as in the SQL; ties go by id."""
    odd = [(i, "click", 1.0, None) for i in range(20, 23)] + [(None, "view", 0.5, "a")] * 3
    tied = [(i, "zyxwvutsrqpo"[i % 12], 1.0, "b") for i in range(36, 80)]
    for part, rows in (("nulls", odd + tied[:8]), ("ties", tied[::-1])):
        spark.createDataFrame(rows, "event_id long, event_type string, value double, props string").write.parquet(str(tmp_path / part / "events.parquet"))
    got, sql = against_sql(spark, tmp_path / "nulls", "weak_samples")
    assert got == sql and len(got) == 10
    got, _ = against_sql(spark, tmp_path / "ties", "weak_samples")
    assert [r[1] for r in got] == sorted("zyxwvutsrq")
