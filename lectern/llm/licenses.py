"""License scans by diagonal voting: word k-gram hashes joined to template positions; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases of which every place counts, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that count when most of their words stand near one diagonal.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-3.0-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}
#: Runs of what is not a separator; the separators are listed one by one, which Java looks up in one bit table.
WORD = "[^" + "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in "0123456789abcdefghijklmnopqrstuvwxyz") + "]+"
#: Words in a gram; diagonals this close are merged; part of a notice's words that must be found on them.
K, NEAR, SHARE = 2, 2, 0.9
#: The template that the last place of every text joins, which so carries the text's number of words.
END = -1


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row a gram: template, label, whether it is a base phrase, its number of words, the gram's position, hash and words.
    The row END has no words and the hash 0."""
    rows = [(END, None, False, 0, 0, [None] * K)]
    for tpl, (phrase, label, kind) in enumerate([*((p, x, True) for p, x in base.items()), *((p, x, False) for x, p in notices.items())]):
        w = phrase.split()
        rows += [(tpl, label, kind, len(w), pos, w[pos : pos + K]) for pos in range(len(w) - K + 1)]
    df = spark.createDataFrame(rows, "tpl int, label string, base boolean, m int, pos int, g array<string>")
    words = [F.get("g", F.lit(i)) for i in range(K)]
    return df.select("tpl", "label", "base", "m", "pos", F.when(F.col("tpl") == END, F.lit(0)).otherwise(F.xxhash64(*words)).alias("gram"), *[w.alias(f"t{i}") for i, w in enumerate(words)])


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds license phrases and notices in every whole text.

    A-Z are lower-cased; words are runs of ASCII digits and letters and all characters past ASCII. All rolling k-grams are
    joined to the template positions by their hash and compared word by word; hits vote by (row, template, diagonal). A base
    phrase counts at each diagonal that holds all of its words. For a notice, diagonals at most 2 apart merge, and the span
    is verified: the part of the notice's words found in it must reach 0.9. Returns doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score (best part of a template's words found, 1 for a base phrase, 0 for none) for every
    input row. Null and empty texts have no words and score 0. Rows that repeat an id are scanned each. Other columns are
    not read.

    Each text is tokenised once. The last of its places, which starts no gram, joins a template row of its own: it carries
    the number of words through the grouping, so that no join has to bring it back.
    """
    spark = docs.sparkSession
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    text = F.col(text_col)
    # lower() alone would also make ASCII letters of U+212A and U+0130
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    low = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    # an id for the row itself: all that is known of it comes from this one pass
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"))
    shifted = [F.when(F.size("words") > i, F.slice("words", i + 1, F.size("words"))).otherwise(F.array().cast("array<string>")).alias(f"w{i}") for i in range(1, K)]
    places = words.select("row", "doc", F.arrays_zip(F.col("words").alias("w0"), *shifted).alias("z")).select("row", "doc", F.posexplode_outer("z").alias("at", "g"))
    w = [F.col(f"g.w{i}") for i in range(K)]
    last = w[1].isNull()
    places = places.select("row", "doc", "at", *[x.alias(f"w{i}") for i, x in enumerate(w)], F.when(last, F.lit(0)).when(w[-1].isNotNull(), F.xxhash64(*w)).alias("gram"))
    table = templates(spark, base, notices)
    equal = F.lit(True)
    for i in range(K):
        equal = equal & (F.col(f"w{i}") == F.col(f"t{i}"))
    hits = places.join(F.broadcast(table), (places["gram"] == table["gram"]) & F.when(F.col("tpl") == END, F.col("w1").isNull()).otherwise(equal))
    hits = hits.select("row", "doc", "tpl", "label", "base", "m", "pos", F.coalesce(F.col("at") - F.col("pos"), F.lit(-1)).alias("diagonal"))
    votes = hits.groupBy("row", "doc", "tpl", "label", "base", "m", "diagonal").agg(F.collect_list("pos").alias("pos"))
    per = votes.groupBy("row", "doc", "tpl", "label", "base", "m").agg(F.sort_array(F.collect_list(F.struct("diagonal", "pos"))).alias("d"))
    # base: every diagonal with all grams; notices: runs of neighbouring diagonals, each with the grams of all of them
    full = F.transform(F.filter("d", lambda x: F.size(x["pos"]) == F.col("m") - (K - 1)), lambda x: x["diagonal"])
    merged = lambda acc, x: F.when(x["diagonal"] - acc["last"] <= NEAR, F.array_union(acc["pos"], x["pos"])).otherwise(x["pos"])
    covered = lambda pos: F.size(F.array_distinct(F.flatten(F.transform(pos, lambda p: F.array(*[p + i for i in range(K)])))))
    # words found: those in a gram that was hit
    run = F.aggregate(
        "d",
        F.struct(F.lit(-1000000000).alias("last"), F.array().cast("array<int>").alias("pos"), F.lit(0).alias("best")),
        lambda acc, x: F.struct(x["diagonal"].alias("last"), merged(acc, x).alias("pos"), F.greatest(acc["best"], covered(merged(acc, x))).alias("best")),
    )["best"]
    none = F.array().cast("array<int>")
    judged = per.select(
        *("row", "doc", "label", "base", "m"),
        F.when(F.col("tpl") == END, F.col("d")[0]["diagonal"] + 1).alias("n_words"),
        F.when(F.col("base"), full).otherwise(none).alias("places"),
        F.when(F.col("tpl") == END, F.lit(0)).when(F.col("base"), F.when(F.size(full) > 0, F.col("m")).otherwise(0)).otherwise(run).alias("found"),
    )
    judged = judged.where(F.col("n_words").isNotNull() | (F.col("base") & (F.size("places") > 0)) | (~F.col("base") & (F.col("found") >= F.ceil(F.col("m") * SHARE))))
    summed = judged.groupBy("row", "doc").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.size("places")).cast("long").alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"),
        F.max(F.array_max("places")).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(F.col("m") > 0, F.col("found") / F.col("m")).otherwise(0.0)).alias("score"),
    )
    return summed.select(F.col("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
