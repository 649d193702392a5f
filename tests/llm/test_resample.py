"""Importance resampling against a plain version, and its bytes and words against zlib and a regular expression."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import queries, resample, tokens
from lectern.llm.resample import importance_resample


def words(t):
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]


def brute(docs, target):
    s, t = (Counter(zlib.crc32(w) % 10000 for x in texts for w in words(x)) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        own = [zlib.crc32(w) % 10000 for w in words(x)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    good = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    for k, r in enumerate(good[: 10 * len(good) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_words_and_crcs():
    texts = ["Ab1 cd-EF", None, "", "x", "y", "é中文 z" + "q" * 300 + " " + "w" * 64 + " " + "v" * 65, "A" * 70_000, "--", "end"]
    buf, offsets = tokens.utf8(pa.array(texts))
    buf = tokens.LOWER[buf]
    starts, ends, first = resample.word_bounds(buf, offsets)
    want = [words(t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    assert [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [x for w in want for x in w]
    assert resample.crcs(buf, starts, ends).tolist() == [zlib.crc32(x) for w in want for x in w]


def test_against_plain(spark, frame):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)] + ["Ünder", "naïve", "42"]
    docs = [(i, " ".join(rng.choice(vocab, int(rng.integers(1, 60))))) for i in range(400)]
    docs += [(7, docs[7][1])] * 3 + [(7, "other text " * 15), (None, "a b " * 20), (None, None), (500, None), (501, ""), (502, "same " * 30), (503, "Same " * 30)]
    target = [" ".join(rng.choice(vocab[:40], 50)) for _ in range(30)] + [None, ""]
    got = importance_resample(frame(docs), spark.createDataFrame([(t,) for t in target], "text string"))
    assert rows(got) == brute(docs, target)


def test_one_document_of_most_rows(spark, frame):
    """Ranks stay gapless where a third of all rows repeat one document."""
    docs = [(1, "one two three four five " * 5)] * 600 + [(i, f"w{i} " * 25) for i in range(2, 1200)]
    got = importance_resample(frame(docs).repartition(5), spark.createDataFrame([("one two",)], "text string"), percent=50)
    drawn = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert drawn == list(range(1, 1799 * 50 // 100 + 1))


def test_odd_and_empty(spark, odd, empty):
    none = spark.createDataFrame([], "text string")
    want = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(importance_resample(odd, none)) == brute(want, [])
    assert importance_resample(empty, none).collect() == []
    assert importance_resample(empty, none).schema.simpleString() == "struct<doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint>"


def test_drawn_rows_look_like_the_target(spark, sf_dir):
    out = queries.op12_importance_draw(spark, sf_dir).toPandas()
    assert out["rank"].notna().sum() == (out["n_features"] >= 20).sum() // 10
    drawn = out[out["rank"].notna()]
    assert drawn["score"].min() >= out[(out["n_features"] >= 20) & out["rank"].isna()]["score"].max()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 66])
def test_word_lengths(n):
    buf = np.frombuffer(b"k" * n + b" kk", np.uint8)
    starts, ends, _ = resample.word_bounds(buf, np.array([0, len(buf)]))
    assert resample.crcs(buf, starts, ends).tolist() == [zlib.crc32(b"k" * x) for x in ([n, 2] if n else [2])]
