"""Bounded calls, the paged source, segmentation, deep searches and safe replacement."""

import itertools
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lectern.functions import calls
from lectern.operators import graph
from lectern.operators.segment import best_path, count_words, segment
from lectern.sources import paged, sinks


def test_attempts_and_back_off():
    asked, slept = [], []

    def failing(texts):
        asked.append(list(texts))
        if len(asked) < 3:
            raise OSError("busy")
        return [t.upper() for t in texts]

    free = calls.Bucket(None)
    assert calls.attempt(failing, ["a", "b"], calls.Limits(), free, slept.append) == (["A", "B"], 3, None)
    assert asked == [["a", "b"]] * 3 and slept == [1.0, 2.0]
    assert calls.attempt(lambda t: [], ["a"], calls.Limits(attempts=2), free, slept.append) == ([None], 2, "0 answers to 1 texts")


def test_bucket_keeps_the_rate():
    now = [0.0]
    bucket = calls.Bucket(4.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    times = []
    for _ in range(9):
        bucket.take()
        times.append(now[0])
    assert times == [k / 4 for k in range(9)]


def test_call_service(spark, tmp_path):
    folder = str(tmp_path)

    def call(texts):
        name = os.path.join(folder, str(hash(tuple(texts))))
        if "7" in texts and not os.path.exists(name):  # the first call of this batch fails
            open(name, "w").close()
            raise OSError("busy")
        if "13" in texts:
            raise ValueError("never")
        return [f"<{t}>" for t in texts]

    rows = spark.range(40).select("id", F.when(F.col("id") != 20, F.col("id").cast("string")).alias("t"))
    got = {r.id: r for r in calls.call_service(rows, "t", call, limits=calls.Limits(batch=4, pause=0.01, tasks=2)).collect()}
    assert len(got) == 40 and got[20].answer is None and got[20].attempts == 0
    assert got[13].answer is None and got[13].attempts == 3 and got[13].error == "ValueError: never"
    assert all(r.answer == f"<{r.t}>" for r in got.values() if r.error is None and r.t) and (got[7].attempts, got[7].answer) in ((2, "<7>"), (3, None))


def test_call_service_in_rounds(spark, tmp_path, monkeypatch):
    """However many texts there were, each of `tasks` tasks read its share of them at once."""
    monkeypatch.setattr(calls, "TASK_BYTES", 2000)
    folder = str(tmp_path)

    def call(texts):
        from pyspark import TaskContext

        with open(os.path.join(folder, f"{TaskContext.get().taskAttemptId()}"), "a") as f:
            f.write(f"{sum(map(len, texts))}\n")
        return [t[:4] for t in texts]

    rows = spark.range(900).select("id", F.when(F.col("id") % 5 > 0, F.format_string("%04d%s", "id", F.lit("x" * 46))).alias("t"))
    got = calls.call_service(rows, "t", call, limits=calls.Limits(batch=10, tasks=2)).collect()
    assert sorted((r.id, r.answer, r.attempts) for r in got) == [(i, f"{i:04d}" if i % 5 else None, 1 if i % 5 else 0) for i in range(900)]
    read = [sum(map(int, (tmp_path / name).read_text().split())) for name in os.listdir(folder)]
    assert len(read) >= 18 and max(read) < 6000 and sum(read) == 720 * 50


def test_paged_search(spark, tmp_path):
    rows = [(i, f"text {i % 3}", "de" if i % 2 else "en") for i in range(95)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "log").mkdir()
    read = paged.register(spark).read.format("paged_search").option("service", "lectern.sources.paged:file_service").option("table", str(tmp_path / "t")).option("log", str(tmp_path / "log"))
    df = read.option("query", "text 1").option("page", 4).option("pages_a_task", 2).schema("doc_id long, text string, lang string").load().where("lang = 'de' and doc_id > 10")
    assert sorted(r.doc_id for r in df.collect()) == [i for i, t, x in rows if t == "text 1" and x == "de" and i > 10]
    asked = [json.loads((tmp_path / "log" / f).read_text()) for f in os.listdir(tmp_path / "log")]
    assert {json.dumps(a["filters"]) for a in asked if a["limit"]} == {'{"lang": "de"}'} and max(a["limit"] for a in asked) == 4
    assert "doc_id" in df._jdf.queryExecution().executedPlan().toString() and df.rdd.getNumPartitions() == math.ceil(16 / 8)


def test_file_service_holds_no_table(tmp_path):
    """A search scans the table once, in batches, and a page decodes the row groups of its rows only."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "t").mkdir()
    ids = [(i * 7919) % 20_000 for i in range(20_000)]
    texts = [None if i % 11 == 0 else f"text {i % 3} " + "x" * 2000 for i in ids]
    for n in range(2):
        pq.write_table(pa.table({"doc_id": ids[n::2], "text": texts[n::2], "lang": ["de" if i % 2 else None for i in ids[n::2]]}), tmp_path / "t" / f"{n}.parquet", row_group_size=1000)
    for options in ({"table": str(tmp_path / "t")}, {"table": f"file://{tmp_path}/t", "index": f"file://{tmp_path}/index"}):
        for query, filters in (("text 1", {"lang": "de"}), ("", {}), ("", {"lang": None}), ("none", {})):
            want = sorted(i for i, t in zip(ids, texts, strict=True) if query in (t or "") and all(("de" if i % 2 else None) == v for v in filters.values()))
            before = pa.total_allocated_bytes()
            assert paged.file_service(query, filters, 0, 0, options) == (len(want), [])
            assert pa.total_allocated_bytes() - before < 4 << 20 and pa.default_memory_pool().max_memory() < 1 << 30
            for offset in (0, 90, 100, 2950, 5, len(want)):
                total, rows = paged.file_service(query, filters, offset, 100, options)
                assert total == len(want) and [r["doc_id"] for r in rows] == want[offset : offset + 100]
    assert len(os.listdir(tmp_path / "index")) == 4


def test_paged_search_query_reads_pages_of_a_store(spark, tmp_path, monkeypatch):
    """The query's service scans the table once for all its pages; before, each page read the whole table."""
    from lectern.plans import catalog

    texts = [f"der Text {i}" if i % 2 else f"ein Text {i}" for i in range(3000)]
    spark.createDataFrame([(i, x, "de" if i % 4 < 2 else "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["paged_search"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.lang, r.n) for r in got) == [(i, "de", len(x)) for i, x in enumerate(texts) if "de" in x and i % 4 < 2]
    kept = [f for folder, _, names in os.walk(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) for f in names if folder.endswith("/index")]
    assert any(f.endswith(".npy") for f in kept)


def test_paged_stream_reads_no_page_twice(spark, tmp_path):
    table = str(tmp_path / "t")
    schema = "doc_id long, text string"
    spark.createDataFrame([(i, "x") for i in range(25)], schema).coalesce(1).write.parquet(table)
    (tmp_path / "log").mkdir()

    def run():
        s = paged.register(spark).readStream.format("paged_search").option("service", "lectern.sources.paged:file_service").option("table", table).option("log", str(tmp_path / "log")).option("page", 10).schema(schema).load()
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([(i, "x") for i in range(25, 40)], schema).coalesce(1).write.mode("append").parquet(table)
    run()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))
    asked = sorted((a["offset"], a["limit"]) for f in os.listdir(tmp_path / "log") if (a := json.loads((tmp_path / "log" / f).read_text()))["limit"])
    assert asked == [(0, 10), (10, 10), (20, 5), (25, 10), (35, 5)]


def test_best_path():
    cost = {"中": 3.0, "国": 3.0, "人": 2.5, "中国": 2.0, "国人": 4.0, "民": 3.0, "人民": 1.0}
    for run in ("中国人民", "人中国", "国国", "中甲国"):
        splits = ([run[a:b] for a, b in itertools.pairwise([0, *c, len(run)])] for r in range(len(run)) for c in itertools.combinations(range(1, len(run)), r))
        price = lambda ws: sum(cost.get(w, 9.0 if len(w) == 1 else math.inf) for w in ws)
        assert price(best_path(run, cost, 9.0)) == min(map(price, splits))
    assert best_path("中国人民", cost, 9.0) == ["中国", "人民"]


def test_segment(spark):
    df = spark.createDataFrame([(1, "中国人民 deep-learning 中国"), (2, "人民 is 人民。中国"), (3, None), (4, "plain")], "doc_id long, text string")
    d = count_words(df, least=2)
    assert {r.word: r.n for r in d.collect()}["中国"] == 3
    got = {r.doc_id: r.tokens for r in segment(df, d).collect()}
    assert got == {1: ["中国", "人民", "deeplearning", "中国"], 2: ["人民", "is", "人民", "中国"], 3: None, 4: ["plain"]}


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_expand(spark, depth):
    e = [("a", "l", "b"), ("b", "l", "c"), ("c", "l", "a"), ("c", "m", "d"), ("hub", "l", "a"), *[("d", "x", f"n{i}") for i in range(30)]]
    df = spark.createDataFrame(e, "src string, label string, dst string")
    starts = spark.createDataFrame([("a",), ("hub",)], "id string")
    key = lambda f: sorted((r.start, r.src, r.label, r.dst, r.hop) for r in f.collect())
    assert key(graph.expand(df, starts, depth)) == key(graph.k_hop(df, starts, depth))
    assert graph.expand(df, starts.limit(0), depth).collect() == []


def test_overwrite_recovers(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite(spark.range(3), path)
    os.rename(path, path + ".old")  # a run that died between the two renames
    assert spark.read.parquet(sinks.recover(spark, path)).count() == 3
    os.rename(path, path + ".old")
    sinks.overwrite(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not os.path.exists(path + ".old")


def test_papers_are_replaced(spark, tmp_path):
    from lectern.plans.pipelines import index_papers

    paper = lambda i, n: (i, f"title {i}", [("Intro", [f"paragraph {k} " + "long " * 20 for k in range(n)])], [])
    schema = "id string, title string, full_text array<struct<section_name: string, paragraphs: array<string>>>, figures_and_tables array<struct<caption: string, file: string>>"
    path = str(tmp_path / "chunks")
    run = lambda rows, split: {(r.paper_id, r.chunk_count, r.source_split) for r in index_papers(spark.createDataFrame(rows, schema), path, split=split).collect()}
    assert run([paper("a", 2), paper("b", 3)], "dev") == {("a", 2, "dev"), ("b", 3, "dev")}
    assert run([paper("c", 1)], "test") == {("c", 1, "test")}
    assert run([paper("a", 4)], "dev") == {("a", 4, "dev")}
    assert spark.read.parquet(path).count() == 8
