"""Sharding: Karmarkar-Karp differencing over groups of equal texts, in bounded pieces, level by level."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_key, stage

#: Items that one task combines.
FAN_IN = 8000
#: Groups above half a piece's share of a shard are placed before all others, at most so many a shard.
MOST_HEAVY = 2000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: combine the two partial partitions of largest spread, oppositely ordered, until one is left.

    sums: one row an item, one column a shard (an indivisible item has one column that is not 0). Returns for each item
    the shard that each of its columns goes to, and the final sums. Ties go to the earlier item.
    """
    n, m = sums.shape
    if not n:
        return np.zeros((0, m), np.int64), np.zeros(m, np.int64)
    parts: list[np.ndarray] = []
    perm: list[np.ndarray] = []
    for row in sums:
        by = np.argsort(-row, kind="stable")
        parts.append(row[by])
        perm.append(by)
    heap = [(int(p[-1] - p[0]), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        both = parts[i] + parts[j][::-1]
        by = np.argsort(-both, kind="stable")
        made.append((i, j, by))
        parts.append(both[by])
        parts[i] = parts[j] = None
        heapq.heappush(heap, (int(parts[-1][-1] - parts[-1][0]), len(parts) - 1))
    # from the last partition back to the items: column of a partition -> final shard
    goes: list = [None] * len(parts)
    goes[-1] = np.arange(m)
    for k in range(len(made) - 1, -1, -1):
        i, j, by = made[k]
        to = np.empty(m, np.int64)
        to[by] = goes[n + k]  # column before the sorting
        goes[i], goes[j], goes[n + k] = to, to[::-1], None
    out = np.empty((n, m), np.int64)
    for i in range(n):
        out[i, perm[i]] = goes[i]
    return out, parts[-1]


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts documents into shards of nearly equal bytes (UTF-8 bytes of the text plus 16); law `bytes`.

    Documents of equal text stay together; only a group heavier than a whole shard, which no shard could hold, is dealt out
    by a hash of doc_id in the fewest pieces that fit. Null and empty texts are one group. Where groups make more than one piece and some outweigh
    half of a piece's share of a shard, these (at most MOST_HEAVY a shard) are differenced first, and the pieces of the others in
    rounds: each starts from its share of the loads so far, so that light groups fill up what heavy ones leave, and the last
    piece from all of them. Returns
    doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard, by a hash range and then doc_id) and
    grown_shard (null under this law). No documents: no rows. Rows that repeat an id get a slot each; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(id_key(id_col).alias("doc"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.xxhash64(text).alias("hash"))
    base = stage(base, "sizes").withColumn("size", F.col("bytes") + 16)
    key = ["hash", "crc", "bytes"]
    total = base.agg(F.sum("size"), F.count("*")).first()
    cap = max(1, -(-(total[0] or 0) // shards))
    large = base.groupBy(*key).agg(F.sum("size").alias("weight")).where(F.col("weight") > cap)
    large = large.select(*key, F.ceil(F.col("weight") / cap).alias("pieces"))  # fewer than shards
    base = base.join(F.broadcast(large), key, "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc", "bytes", F.lit(7)), "pieces")).cast("int")).drop("pieces")
    key.append("piece")
    groups = base.groupBy(*key).agg(F.sum("size").alias("weight"))
    groups = stage(groups.withColumn("item", F.xxhash64(*key)), "groups")
    level = -(-groups.count() // FAN_IN) or 1
    heavy: list = []
    loads = np.zeros(shards, np.int64)
    shard_of: list[int] = []
    least = cap / min(2 * level, MOST_HEAVY)
    if level > 1 and not groups.where(F.col("weight") > least).isEmpty():
        # shards * MOST_HEAVY groups at most, as the weights of all sum up to the shards
        heavy = sorted(groups.where(F.col("weight") > least).select("weight", "item", *key).collect(), key=lambda r: (-r["weight"], *r[1:]))
        sums = np.zeros((len(heavy), shards), np.int64)
        sums[:, 0] = [r["weight"] for r in heavy]
        to, loads = difference(sums)
        shard_of = to[:, 0].tolist()
        groups = groups.where(F.col("weight") <= least)

    def first(loads: np.ndarray, left: int):
        def place(pdf):
            pdf = pdf.sort_values(["weight", "item", *key], ascending=[False, True, True, True, True, True])
            sums = np.zeros((len(pdf) + 1, shards), np.int64)
            sums[0] = loads * (int(pdf["weight"].sum()) / left)  # this piece's share of what is placed already
            sums[1:, 0] = pdf["weight"]
            to, _ = difference(sums)
            shard = np.empty(shards, np.int64)
            shard[to[0]] = np.arange(shards)
            return pdf.assign(local=(shard[to[1:, 0]] if loads.any() else to[1:, 0]).astype("int32"))

        return place

    groups = groups.withColumn("chunk", F.pmod("item", F.lit(level)).cast("long"))
    schema = groups.schema.simpleString()[7:-1].replace(":", " ") + ", local int"

    def pieces(lo: int, hi: int, loads: np.ndarray, left: int) -> DataFrame:
        own = groups.where((F.col("chunk") >= lo) & (F.col("chunk") < hi))
        return stage(own.repartition(max(1, min(n, hi - lo)), "chunk").groupBy("chunk").applyInPandas(first(loads, max(1, left)), schema), "placed")

    if heavy:  # seven eighths of the pieces, then of what is left: each round fills up what all before have really made
        at, placed, left = 0, None, (total[0] or 0) - int(loads.sum())
        while at < level:
            to = at + (level - at - max(1, (level - at) // 8) or 1)
            own = pieces(at, to, loads, left)
            for r in own.groupBy("local").agg(F.sum("weight").alias("weight")).collect():  # a row a shard
                loads[r["local"]] += r["weight"]
                left -= r["weight"]
            placed = own if placed is None else placed.unionByName(own)
            at = to
        level = 1  # the columns of all pieces are the shards already
    else:
        placed = pieces(0, level, loads, 1)
    column, at = "local", placed.groupBy("chunk", F.col("local").alias("column")).agg(F.sum("weight").alias("weight")).withColumn("below", F.col("chunk"))
    mapping = None

    def combine(pdf):
        chunks = np.sort(pdf["below"].unique())
        sums = np.zeros((len(chunks), shards), np.int64)
        np.add.at(sums, (np.searchsorted(chunks, pdf["below"]), pdf["column"]), pdf["weight"])
        to, _ = difference(sums)
        import pandas as pd

        return pd.DataFrame({"above": pdf["above"].iloc[0], "below": np.repeat(chunks, shards), "column": np.tile(np.arange(shards, dtype="int32"), len(chunks)), "goes": to.ravel().astype("int32"), "weight": sums.ravel()})

    while level > 1:
        fan = max(2, FAN_IN // 8)
        at = at.select("below", "column", "weight", F.floor(F.col("below") / fan).alias("above"))
        level = -(-level // fan)
        step = stage(at.repartition(max(1, min(n, level)), "above").groupBy("above").applyInPandas(combine, "above long, below long, column int, goes int, weight long"), "step")
        if mapping is None:
            mapping = step.select(F.col("below").alias("chunk"), F.col("column").alias("local"), F.col("above").alias("top"), F.col("goes").alias("shard"))
        else:
            mapping = mapping.join(step.select(F.col("below").alias("top"), F.col("column").alias("shard"), F.col("above").alias("next"), F.col("goes")), ["top", "shard"]).select("chunk", "local", F.col("next").alias("top"), F.col("goes").alias("shard"))
        at = step.groupBy(F.col("above").alias("below"), F.col("goes").alias("column")).agg(F.sum("weight").alias("weight"))
    if mapping is not None:
        placed = placed.join(mapping.drop("top"), ["chunk", "local"]).select(*key, "shard")
    else:
        placed = placed.select(*key, F.col(column).alias("shard"))
    if heavy:
        own = [(*(r[k] for k in key), to) for r, to in zip(heavy, shard_of, strict=True)]
        placed = placed.unionByName(docs.sparkSession.createDataFrame(own, placed.schema))
    # slots: rank within (shard, hash range of the id) plus the counts of the ranges before
    ranges = max(1, -(-(total[1] or 0) // (shards * 20000)))
    rows = stage(base.join(placed, key).select("doc", "size", "crc", "shard", F.pmod(F.xxhash64("doc", F.lit(11)), F.lit(ranges)).cast("int").alias("range")), "sharded")
    from pyspark.sql import Window

    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("many"))
    before = counts.withColumn("skip", F.sum("many").over(Window.partitionBy("shard").orderBy("range")) - F.col("many")).drop("many")
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc", "crc", "size"))
    out = rows.withColumn("rank", rank).join(before, ["shard", "range"])
    return out.select(
        F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc")).alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - 1 + F.col("skip")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
