"""Segmentation of Han text: the likeliest path over a lattice of words, by frequencies counted from the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest word, least count of a word of two and more characters, and words that a dictionary holds at most (the most frequent).
LONGEST, LEAST, WORDS = 4, 5, 500_000
HAN = r"[一-鿿]+"


def count_words(texts: DataFrame, text: str = "text", least: int = LEAST, most: int = WORDS) -> DataFrame:
    """(word, n) of the stretches of up to four characters in the texts' runs of Han characters; single characters always."""
    runs = texts.select(F.explode(F.regexp_extract_all(text, F.lit(f"({HAN})"), F.lit(1))).alias("run"))
    runs = runs.groupBy("run").agg(F.count("*").alias("n"))  # equal runs are cut once
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - i + 1)), lambda k: F.substring(F.col("run"), i, k))))
    words = runs.select(F.explode(cut).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where((F.length("word") == 1) | (F.col("n") >= least)).orderBy(F.desc("n"), "word").limit(most)


def best_path(run: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The words of the path of least cost; of equal paths the one with the longer word nearer the end. A character that is no word costs `unknown`."""
    best, back = [0.0], [0]
    for j in range(1, len(run) + 1):
        options = []
        for k in range(1, min(LONGEST, j) + 1):
            c = cost.get(run[j - k : j], unknown if k == 1 else None)
            if c is not None:
                options.append((round(best[j - k] + c, 9), -k))
        value, k = min(options)
        best.append(value)
        back.append(-k)
    out, j = [], len(run)
    while j:
        out.append(run[j - back[j] : j])
        j -= back[j]
    return out[::-1]


def segment(texts: DataFrame, dictionary: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tokens): letters and digits as bm25_tokens() has them, and the words of the best path through each run of Han
    characters. dictionary: (word, n), at most WORDS of them, which are broadcast; a word costs -ln of its share."""
    words = {r.word: r.n for r in dictionary.limit(WORDS).collect()}
    total = max(1, sum(words.values()))
    shared = texts.sparkSession.sparkContext.broadcast(({w: -math.log(n / total) for w, n in words.items()}, math.log(total) + 1))
    kind = texts.schema[ident].dataType.simpleString()
    from lectern.functions import text as tx

    # a run of Han stands alone, so that it is a token of its own
    parts = tx.bm25_tokens(F.regexp_replace(text, f"({HAN})", " $1 "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, unknown = shared.value
        known: dict[str, list[str]] = {}
        for batch in batches:
            out = []
            for tokens in batch.column(1).to_pylist():
                row = []
                for t in tokens or []:
                    if "一" <= t[0] <= "鿿":
                        if t not in known:
                            if len(known) > 100_000:
                                known.clear()
                            known[t] = best_path(t, cost, unknown)
                        row += known[t]
                    else:
                        row.append(t)
                out.append(row if tokens is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=[ident, "tokens"])

    return texts.select(ident, parts.alias("tokens")).mapInArrow(run, f"`{ident}` {kind}, tokens array<string>")
