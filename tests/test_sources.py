"""Readers, writers and streams on temporary folders."""

import gzip
import json

from pyspark.sql import functions as F

from lectern.sources import files, sinks
from lectern.streaming import incremental


def test_scan_and_resolve(spark, tmp_path):
    for name in ("a.pdf", "b.TXT", "._c.pdf", "d.exe"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.md").write_text("y")
    assert sorted(r.file_name for r in files.scan_directory(spark, str(tmp_path)).collect()) == ["a.pdf", "b.TXT"]
    assert sorted(r.file_name for r in files.scan_directory(spark, str(tmp_path), recursive=True).collect()) == ["a.pdf", "b.TXT", "e.md"]


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "k.json").write_text(json.dumps({"p1": {"title": "T", "qas": []}, "p2": {"title": "U"}}))
    assert sorted((r.id, r.title) for r in files.read_keyed_json(spark, str(tmp_path / "k.json")).collect()) == [("p1", "T"), ("p2", "U")]


def test_graph_snapshot(spark, tmp_path):
    snap = {"entities": {"a": {"name": "A", "type": "T", "description": ""}}, "triplets": [["A", "r", "B"]], "relation_count": 1}
    (tmp_path / "g.json.gz").write_bytes(gzip.compress(json.dumps(snap).encode()))
    v, e = files.read_graph(spark, str(tmp_path / "g.json.gz"))
    assert v.first().name == "A" and tuple(e.first()) == ("a", "r", "b")


def test_graph_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("t", "TestEntity", "T", "d")], "id string, name string, type string, description string")
    e = spark.createDataFrame([("t", "r", "t", 1.0, "c")], "src string, label string, dst string, weight double, chunk_id string")
    sinks.save_graph(v, e, str(tmp_path / "g"))
    v2, e2 = sinks.load_graph(spark, str(tmp_path / "g"))
    assert v2.collect() == v.collect() and e2.collect() == e.collect()
    where = sinks.backup_graph(v, e, str(tmp_path), "20240101_000000")
    assert sinks.restore_graph(spark, where)[0].count() == 1
    sinks.graph_html(v, e, str(tmp_path / "g.html"))
    assert "TestEntity" in (tmp_path / "g.html").read_text()


def test_insert_delete_clear(spark, tmp_path):
    path = str(tmp_path / "chunks")
    c = spark.createDataFrame([(1, "a.pdf", "x", [1.0]), (2, "b.pdf", "y", [2.0])], "chunk_id long, file_name string, text string, embedding array<float>")
    sinks.insert_chunks(c, path)
    plan = spark.read.parquet(path).where("file_name = 'a.pdf'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(file_name" in plan
    sinks.overwrite(spark.read.parquet(path).where("file_name <> 'a.pdf'"), path)
    assert [r.chunk_id for r in spark.read.parquet(path).collect()] == [2]
    assert sinks.clear(spark, path)


def test_reports(spark):
    from lectern.operators.evaluation import metric_summary

    r = spark.createDataFrame([(0.9, "q", "a"), (float("nan"), "q", "a"), (0.8, "q", "a")], "faithfulness double, question string, answer string")
    s = metric_summary(r, ["faithfulness"])
    text = sinks.report_markdown(s, "Report")
    assert "| faithfulness | 2 | 0.8500" in text and "good" in text
    assert "<td>faithfulness</td>" in sinks.report_html(s, "Report")


def test_ingest_stream_once(spark, tmp_path):
    src, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one paragraph of text that is long enough to stand as a chunk\n\nanother")
    for _ in range(2):
        incremental.ingest_stream(spark, src, table, check).awaitTermination(60)
    assert spark.read.parquet(table).count() == 1
    (tmp_path / "in" / "b.txt").write_text("second file")
    incremental.ingest_stream(spark, src, table, check).awaitTermination(60)
    assert {r.file_name for r in spark.read.parquet(table).collect()} == {"a.txt", "b.txt"}


def test_rate_windows_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}",) for s in range(40)] + [("2024-01-01 02:00:00",)]
    df = spark.createDataFrame(rows, "ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    q = incremental.rate_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), limit=30).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.requests, r.over) for r in spark.table("rates").collect()) == [(1, False), (40, True)]


def test_testset_of_long_name_lines(spark):
    """A chunk whose line holds thousands of names ended the executor that read it."""
    from lectern.plans import pipelines

    rows = [(i, "a.pdf", "Ada " * 30_000 + f"\nmethod {i}") for i in range(6)] + [(9, "a.pdf", "mail x@y.org")]
    c = spark.createDataFrame(rows, "chunk_id long, file_name string, text string")
    assert [tuple(r) for r in pipelines.testset(c).select("file_name", "chunks").collect()] == [("a.pdf", 6)]


def test_testset_run_of_long_name_lines(spark):
    from lectern.plans import pipelines

    c = spark.createDataFrame([(i, "a.pdf", "Ada " * 30_000 + f"\nmethod {i}") for i in range(6)], "chunk_id long, file_name string, text string")
    ask = lambda text: F.array(F.struct(F.lit("Which method works best?").alias("question"), F.md5(text).alias("answer"), F.md5(text).alias("reference")))
    _, summary = pipelines.evaluate_testset(c, ask, {"kept": lambda question, answer, reference: (answer == reference).cast("double")})
    assert [(r.metric, r.n, r.mean) for r in summary.collect()] == [("kept", 1, 1.0)]


def test_testset_run_in_pieces(spark):
    """A paper's text is read in pieces, none of which holds more than a chunk, and gives what the whole one does."""
    from lectern.plans import pipelines

    rows = [(i % 90, f"{'ab'[i % 2]}.pdf", f"{'Ada Lovelace' * (i % 3)}\nmethod {i}") for i in range(200)] + [(i, "c.pdf", "few") for i in range(4)] + [(900, None, "x"), (901, "a.pdf", " \n"), (902, "a.pdf", None)]
    c = spark.createDataFrame(rows, "chunk_id long, file_name string, text string").repartition(7)

    def ask(pieces):
        pieces = list(pieces)
        return [("Which method works best?", "".join(pieces), str(max(map(len, pieces))))]

    whole = {r.file_name: r.text for r in pipelines.testset(c).collect()}
    read = pipelines.read_testset(c, ask).collect()
    assert len(whole) == 2 and {r.file_name: r.answer for r in read} == whole and all(int(r.reference) < 40 for r in read)
    scored, summary = pipelines.evaluate_testset(c, ask, {"kept": lambda question, answer, reference: (answer != reference).cast("double")}, in_pieces=True)
    assert scored.count() == 2 and [(r.metric, r.n, r.mean) for r in summary.collect()] == [("kept", 2, 1.0)]
