"""The stages on the smallest tables, each on its predecessor's rows."""

import corpus_pipeline
from lectern.llm.decontaminate import find_leaks


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, step in corpus_pipeline.STAGES:
        kept.append(step(spark, kept[-1], sf_dir).cache())
        if name != "sharding":
            assert kept[-1].columns == docs.columns
            assert kept[-1].exceptAll(kept[-2]).count() == 0
    counts = [k.count() for k in kept]
    assert counts[1] == counts[0]  # no document of these is without a language
    assert counts[2] < counts[1] and counts[2] >= docs.select("text").distinct().count() * 0.9
    gone = {r.doc_id for r in find_leaks(kept[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept[3].collect()} == {r.doc_id for r in kept[2].collect()} - gone
    assert 0.3 * counts[3] < counts[4] < counts[3] and counts[5] == counts[4]


def test_run_and_registry(spark, sf_dir):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sorted(int(k[2:].split("_")[0]) for k in names if k.startswith("op")) == list(range(1, 11))
    assert corpus_pipeline.run(spark, sf_dir).count() > 50


def test_odd_rows(spark, sf_dir, odd, empty):
    for df in (odd, empty):
        for _, step in corpus_pipeline.STAGES[:4]:
            assert step(spark, df, sf_dir).columns == df.columns


def test_repeated_rows_and_null_ids(spark, sf_dir, frame):
    t, u = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    docs = frame([(1, t), (1, t), (2, t), (None, t + " x"), (None, u), (None, u), (3, "a b c"), (3, "d e f"), (4, None)])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([(1, t), (None, u), (3, "a b c"), (3, "d e f"), (4, None)], key=repr)
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    docs = frame([(None, u), (None, "so " + passage + " it is"), (1, u), (1, passage), (2, None)])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([(None, u), (1, u), (2, None)], key=repr)


def test_session_keeps_its_batches(spark, sf_dir, frame):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for _, step in corpus_pipeline.STAGES:
        step(spark, frame([(1, "one two three")]), sf_dir).collect()
    assert spark.conf.get(key) == before
