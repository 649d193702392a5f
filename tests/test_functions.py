"""Text functions and classifiers on hand cases."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import boundary, classify
from lectern.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


def test_normalizers(spark):
    assert one(spark, tx.normalize_answer("t"), t="The  cat, an apple; A  dog!") == "cat apple dog"
    assert one(spark, tx.normalize_title("t"), t=" Deep  Title\n2 ") == "deep title 2"
    assert one(spark, tx.sanitize("t"), t="a\x00b\x01 \n c") == "ab c"
    assert one(spark, tx.normalize_answer("t"), t=None) is None


def test_splits(spark):
    assert one(spark, tx.paragraphs("t"), t="a\n\n \n\nb ") == ["a", "b"]
    assert one(spark, tx.sentences("t"), t="One. Two!三。四？ end") == ["One.", "Two!", "三。", "四？", "end"]
    assert one(spark, tx.clauses("t"), t="a, b；c") == ["a,", "b；", "c"]
    assert one(spark, tx.clauses("t"), t="abc") == ["abc"]
    assert one(spark, tx.plain_sentences("t"), t="e.g.this. Next") == ["e.g.this.", "Next"]


def test_tokens_and_keywords(spark):
    assert one(spark, tx.bm25_tokens("t"), t="Anti-scam foo_bar, x1!") == ["antiscam", "foobar", "x1"]
    assert one(spark, tx.keywords("t"), t="éeaument Word word abc _under four4 long") == ["word", "long"]
    assert one(spark, tx.numbers("t"), t="a1 22 3.5") == ["22", "3", "5"]


@pytest.mark.parametrize(("n", "want"), [(6400, "6.2KB"), (10, "10.0B"), (3 << 20, "3.0MB"), (5 << 28, "1.2GB")])
def test_human_size(spark, n, want):
    assert spark.range(1).select(tx.human_size(F.lit(n))).first()[0] == want


def test_marks(spark):
    assert one(spark, tx.page_number("t"), t="x [Page 12] 第 3 页") == 12
    assert one(spark, tx.page_number("t"), t="第 3 页") == 3
    assert one(spark, tx.page_number("t"), t="none") == 0
    assert one(spark, tx.github_url("t"), t="see https://github.com/a-b/c.d) x") == "https://github.com/a-b/c.d"
    assert one(spark, tx.github_url("t"), t="none") is None
    assert one(spark, tx.arxiv_filename(F.col("i"), F.col("t")), i="", t="A: title/with? marks") == "A titlewith marks.pdf"
    assert one(spark, tx.ellipsis("t", 3, "unknown"), t="") == "unknown"
    assert one(spark, tx.ellipsis("t", 3), t="abcd") == "abc..."


def test_versions(spark):
    df = spark.createDataFrame([("2603.11298.pdf",), ("2603.11298v2.pdf",), ("x.pdf",)], "n string")
    assert [tuple(r) for r in df.select(*tx.version_parts("n")).collect()] == [("2603.11298", 1), ("2603.11298", 2), (None, None)]


def test_tables(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1,2"), F.lit('q"x')))
    assert spark.range(1).select(tx.table_markdown(rows)).first()[0].split("\n")[0] == "| a | b\\|c |"
    assert spark.range(1).select(tx.table_csv(rows)).first()[0] == 'a,b|c\n"1,2","q""x"'
    assert "<td>b|c</td>" in spark.range(1).select(tx.table_html(rows)).first()[0]


@pytest.mark.parametrize(("q", "kind"), [("What is the accuracy?", "boolean"), ("How many sentences are in the dataset", "extractive"), ("Describe the method", "abstractive"), ("zzz", "unknown")])
def test_answer_type(spark, q, kind):
    assert one(spark, classify.answer_type(F.col("q")), q=q) == kind


def test_answer_type_fixed(spark):
    assert one(spark, classify.answer_type(F.col("q"), fixed=True), q="if the paper helps at all?") == "none"


@pytest.mark.parametrize(("q", "mode", "entities"), [("BERT和GPT的关系", "graph_local", ["BERT", "GPT"]), ("深度学习的发展趋势", "graph_global", ["深度学习"]), ("什么是Transformer", "vector", []), ("How does it work", "vector", [])])
def test_route(spark, q, mode, entities):
    assert one(spark, classify.route(F.col("q")), q=q) == mode
    assert one(spark, classify.route_entities(F.col("q")), q=q) == entities


@pytest.mark.parametrize(("line", "want"), [("References", True), ("5. REFERENCES", True), ("References:", True), ("Appendix A. References", True), ("Reference Point Feature", False), ("参考文献", True)])
def test_reference_title(spark, line, want):
    assert one(spark, classify.is_reference_title(F.col("x")), x=line) is want


def test_filters(spark):
    assert one(spark, classify.is_main_content(F.col("t")), t="plain text of a method") is True
    assert one(spark, classify.is_main_content(F.col("t")), t="mail a@b.org") is False
    assert one(spark, classify.is_main_content(F.col("t")), t="Ada Lovelace\nAlan Turing\ntext") is False


def test_main_content_of_long_lines(spark):
    """Thousands of names on a line overflowed the stack of Java's matcher, which ends an executor; runs without an end took quadratic time."""
    names = "Ada " * 30_000
    f = classify.is_main_content(F.col("t"))
    assert one(spark, f, t=f"{names}\ntext") is True
    assert one(spark, f, t=f"{names}\n{names}\ntext") is False
    assert one(spark, f, t=f"{names}9\n{names}\ntext") is True
    assert one(spark, f, t="x" * 300_000) is True
    assert one(spark, f, t="x" * 300_000 + "@b.org") is False
    assert one(spark, f, t="a" + " " * 300_000 + "b") is True
    assert one(spark, classify.is_low_quality(F.col("t")), t="Which conference was it") is True
    assert one(spark, classify.visual_query(F.col("t")), t="show the CHART") is True
    assert one(spark, classify.entity_type(F.col("t")), t=" dataset ") == "Dataset"
    assert one(spark, classify.node_type(F.array(F.lit("Figure"), F.lit("Paper")))) == "Paper"


@pytest.mark.parametrize(
    ("raw", "want"),
    [('[{"a": 1}]', '[{"a": 1}]'), ('```json\n[{"a": 1}]\n```', '[{"a": 1}]'), ('<think>[x]</think>[{"a": 1}]', '[{"a": 1}]'), ('so: [{"a": 1}] done', '[{"a": 1}]'), (r'[{"a": "\d"}]', '[{"a": "\\\\d"}]'), ('[{"a": 1}, {"b": ', '[{"a": 1}]'), ("nothing", None), (None, None)],
)
def test_extract_json(raw, want):
    assert boundary.extract_json(raw) == want


def test_metadata(spark):
    rows = [("{'a': 1}",), ("oops 'x'",), (None,), ("",), ('{"a": {"b": [1, 2]}, "n": "7"}',), ("[1",)]
    df = spark.createDataFrame(rows, "raw string").withColumn("v", boundary.metadata_of(F.col("raw")))
    out = [tuple(r) for r in df.select(F.to_json("v"), *boundary.metadata_fields(F.col("v"), {"a": "int", "a.b": "array<int>", "n": "int", "raw": "string"})).collect()]
    assert out == [('{"a":1}', 1, None, None, None), ('{"raw":"oops \'x\'"}', None, None, None, "oops 'x'"), ("{}", None, None, None, None), ("{}", None, None, None, None), ('{"a":{"b":[1,2]},"n":"7"}', None, [1, 2], 7, None), ('{"raw":"[1"}', None, None, None, "[1")]


def test_parse_references(spark):
    raw = '```json\n[{"title": "T", "authors": "A", "year": "2020", "doi": " ", "venue": "V"}, {"title": "U", "year": "20x"}]\n```'
    rows = one(spark, boundary.parse_references(F.col("r")), r=raw)
    assert [(x.ref_title, x.ref_year, x.ref_doi, x.ref_venue) for x in rows] == [("T", 2020, None, "V"), ("U", None, None, None)]


def test_embedding(spark):
    v = one(spark, boundary.embed(F.col("t"), 64), t="some text here")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6
    with pytest.raises(ValueError):
        boundary.embed(F.lit("x"), 65)


def test_name_lines_between_white_space(spark):
    """White space around a name line is passed by its pattern; blank() says what strip() leaves."""
    from lectern.functions import classify
    from lectern.functions import text as tx

    spaced = ["\u3000Ada Bo\u0085", "\x1cAda\u2003Bo", "\tAda Bo \r", "Ada", "Ada Bo x", "ada Bo", "\u00a0", "", "\n\u2028", "Ada\u00a0Bo"]
    df = spark.createDataFrame([(i, f"{x}\nÉa Bo\nrest", x) for i, x in enumerate(spaced)], "i int, text string, line string").repartition(3)
    got = {r.i: (r.main, r.blank) for r in df.select("i", classify.is_main_content(F.col("text")).alias("main"), tx.blank("line").alias("blank")).collect()}
    assert [i for i in got if not got[i][0]] and sorted(i for i in got if not got[i][0]) == [0, 2]
    assert sorted(i for i in got if got[i][1]) == [6, 7, 8]
