"""MinHash near-dedup: banded candidates, sequential Bayesian pruning by signature batches, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import bounded, components, id_key, small, stage, unstage

U = np.uint64
#: 40 bands of 5 rows: a pair at 0.8 shares none with probability 1.3e-7.
BANDS, ROWS = 40, 5
#: Signature values (16 bits each) that are compared, and how many at a time.
COMPARED, BATCH = 128, 32
#: A pair is pruned once its posterior probability of being similar enough is below this.
MISS = 1e-7
#: Documents of a candidate cluster that one task compares with one another.
BLOCK = 800
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_FOLD = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | U(1)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of k words (A-Z lower-cased); of all its words if it has fewer."""
    buf, offsets = tokens.utf8(texts)
    for lo, hi in tokens.blocks(offsets):
        part = offsets[lo : hi + 1]
        h, _, _, first = tokens.words(buf[part[0] : part[-1]], part - part[0], lower=True)
        grams = tokens.rolling(h, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - k + 1]) if b - a >= k else tokens.rolling(h[a:b], b - a) ^ U(b - a) if b > a else grams[:0]


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    if not len(s):
        return 0, 0
    both = np.array([np.add.reduce(tokens.mix(s)), np.bitwise_xor.reduce(tokens.mix(s + U(0x632BE59BD9B4E019)))], U)
    return tuple(both.view(np.int64).tolist())


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> U(32)).astype(np.uint32)[None, :]
    return np.minimum.reduce([(x[:, i : i + 2048] * _A + _B).min(axis=1) for i in range(0, x.shape[1], 2048)])


def _sign(k: int):
    names = ["doc", "n", "s1", "s2", "bands", "sig"]
    offset = (np.arange(BANDS, dtype=np.uint64) * U(0xD6E8FEB86659FD93))[None, :]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sigs = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                a, b = set_hash(s)
                one.append(a)
                two.append(b)
                sigs.append(signature(s) if len(s) else np.zeros(BANDS * ROWS, np.uint32))
            sig = np.array(sigs, np.uint32).reshape(-1, BANDS * ROWS)
            keys = tokens.mix(np.add.reduce(sig.reshape(-1, BANDS, ROWS).astype(U) * _FOLD, axis=2) + offset).view(np.int64)
            low = (tokens.mix(sig[:, :COMPARED].astype(U)) & U(0xFFFF)).astype(np.uint16)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), bands, pa.array([x.tobytes() for x in low], pa.binary())], names=names)

    return sign


@lru_cache
def floors(num: int, den: int) -> tuple[int, ...]:
    """For 32, 64, ... compared values the fewest matches that keep a pair: with a uniform prior the posterior of the
    similarity after m of h matches is Beta(m + 1, h - m + 1); below the floor its mass over num/den is under MISS."""
    t, out = num / den, []
    for h in range(BATCH, COMPARED + 1, BATCH):
        # P(Beta(m + 1, h - m + 1) >= t) = P(Binomial(h + 1, t) <= m)
        mass, m = 0.0, -1
        while mass < MISS:
            m += 1
            mass += math.comb(h + 1, m) * t**m * (1 - t) ** (h + 1 - m)
        out.append(m)
    return tuple(out)


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows of two signature matrices survive all batches."""
    left, got = np.arange(len(x)), np.zeros(len(x), np.int32)
    for i, floor in enumerate(floors(num, den)):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        got = got + (x[left, cut] == y[left, cut]).sum(axis=1)
        left, got = left[got >= floor], got[got >= floor]
    return left


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(x) + len(y)
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    same = both - len(np.union1d(x, y)) if both < 200 else int((np.diff(np.sort(np.concatenate((x, y)), kind="stable")) == 0).sum())
    return den * same >= num * (both - same)


def _verify(num: int, den: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, p, q, s, t = batch.columns
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, COMPARED) for c in (p, q))
            good = [i for i in alike(x, y, num, den) if linked(np.frombuffer(s[i].as_py(), U), np.frombuffer(t[i].as_py(), U), num, den)]
            yield pa.RecordBatch.from_arrays([a.take(pa.array(good, pa.int64())), b.take(pa.array(good, pa.int64()))], names=["a", "b"])

    return verify


def _block_links(num: int, den: int):
    """All links between documents of a block, or of a pair of blocks, that are not in one component yet."""
    import pandas as pd

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("doc").sort_values("doc")
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                root[v] = root.get(root[v], root[v])
                v = root[v]
            return v

        docs, comp, side = pdf["doc"].tolist(), pdf["root"].tolist(), pdf["side"].to_numpy()
        sets = [np.frombuffer(x, U) for x in pdf["items"]]
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, COMPARED)
        size = np.array([len(x) for x in sets])
        pair, out = len(set(side.tolist())) > 1, []
        for i in range(len(docs) - 1):
            rest = np.arange(i + 1, len(docs))
            rest = rest[(den * np.minimum(size[rest], size[i]) >= num * np.maximum(size[rest], size[i])) & ((side[rest] != side[i]) if pair else True)]
            rest = rest[[find(comp[j]) != find(comp[i]) for j in rest]] if len(rest) else rest
            if len(rest):
                for j in rest[alike(np.broadcast_to(sig[i], (len(rest), COMPARED)), sig[rest], num, den)]:
                    p, q = find(comp[i]), find(comp[j])
                    if p != q and linked(sets[i], sets[j], num, den):
                        root[max(p, q)] = min(p, q)
                        out.append((docs[i], docs[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return links


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose sets of k-word shingles have a Jaccard similarity of num/den or more.

    Returns doc_id, n_shingles, component_id (smallest id reachable, itself included) and kept (doc_id = component_id)
    for every input row. A text of fewer than k words is one shingle of all its words; a text without words, or null, has
    none and is linked with nothing. Rows that repeat an id are one document: where their texts differ, the one
    of the smallest set hash stands for all of them (each keeps its own n_shingles). A null id is an id of its own and comes back as null. Other columns are not read.

    Equal sets count as one class. Candidates share one of 40 bands; each is first held against the smallest id of its
    bucket (so a bucket of n sends n pairs). Buckets whose members then still lie in several components form clusters. A
    cluster of at most BLOCK documents is compared in one task; in a larger one only members of the same bucket are compared,
    block by block, so that a long chain of buckets costs no more than its buckets do. Pairs that are connected already are
    passed over.
    """
    docs = bounded(docs)
    source = docs.select(id_key(id_col).alias("doc"), F.col(text_col).alias("text"))
    signed = stage(source.mapInArrow(_sign(k), "doc long, n int, s1 long, s2 long, bands array<long>, sig binary"), "signed")
    plain = signed.select("doc", "n", "s1", "s2")
    ids = plain.groupBy("doc").agg(F.min(F.struct("s1", "s2", "n")).alias("k")).select("doc", "k.*")
    classes = stage(ids.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = signed.join(classes.select(F.col("rep").alias("doc"), "s1", "s2", "n"), ["doc", "s1", "s2", "n"], "left_semi")
    members = reps.select("doc", F.posexplode("bands").alias("band", "key"))
    # the heads are written, so the join stands alone and a bucket of any size can be split
    heads = stage(members.groupBy("band", "key").agg(F.min("doc").alias("head"), F.count("*").alias("many")).where("many > 1"), "heads")
    members = stage(members.join(small(heads, 40), ["band", "key"]), "members")
    stars = stage(members.where("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    chosen = small(stage(members.select("doc").distinct(), "candidates"), 16)
    marks = signed.join(chosen, "doc", "left_semi").join(classes.select(F.col("rep").alias("doc"), "s1", "s2", "n"), ["doc", "s1", "s2", "n"], "left_semi").select("doc", "s1", "s2", "sig")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = list(shingle_sets(batch.column(1), k))
            one, two = zip(*map(set_hash, items), strict=True) if items else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([s.tobytes() for s in items], pa.binary())], names=["doc", "s1", "s2", "items"])

    wide = source.join(chosen, "doc", "left_semi").mapInArrow(sets, "doc long, s1 long, s2 long, items binary").join(marks, ["doc", "s1", "s2"])
    wide = stage(wide.select("doc", "sig", "items").dropDuplicates(["doc"]), "sets")
    pairs = stars.join(wide.select(F.col("doc").alias("a"), F.col("sig").alias("p"), F.col("items").alias("s")), "a").join(wide.select(F.col("doc").alias("b"), F.col("sig").alias("q"), F.col("items").alias("t")), "b")
    links = stage(pairs.select("a", "b", "p", "q", "s", "t").mapInArrow(_verify(num, den), "a long, b long"), "links")
    roots = stage(components(links), "roots")

    labelled = members.where("many > 2").join(roots.withColumnRenamed("id", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    labelled = stage(labelled.select("band", "key", "doc", "root"), "labelled")
    open_ = stage(labelled.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low <> high").drop("high"), "open")
    ours = stage(labelled.join(small(open_, 40), ["band", "key"]), "ours")
    spare = [heads, members, stars, links, labelled, open_, ours, wide]
    if not ours.isEmpty():
        cluster = stage(components(ours.select(F.col("root").alias("a"), F.col("low").alias("b")).distinct()), "clusters").select(F.col("id").alias("root"), F.col("root").alias("cluster"))
        cast = stage(ours.select("doc", "root").distinct().join(cluster, "root"), "cast")
        large = stage(cast.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("cluster"), "large")
        none = F.lit(0)
        whole = cast.join(small(large, 16), "cluster", "left_anti").select("cluster", none.alias("band"), none.cast("long").alias("key"), none.alias("x"), none.alias("y"), none.alias("side"), "doc", "root")
        # members of one bucket, in blocks by a hash; each block meets every block of its bucket
        parts = F.ceil(F.col("many") / BLOCK).cast("int")
        local = ours.join(cluster, "root").join(small(large, 16), "cluster", "left_semi").withColumn("side", F.pmod(F.xxhash64("doc"), parts).cast("int"))
        local = local.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        local = local.select("cluster", "band", "key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "doc", "root")
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        group = ["cluster", "band", "key", "x", "y"]
        found = whole.unionByName(local).join(wide, "doc").select(*group, "side", "doc", "root", "sig", "items").repartition(n, *group).groupBy(*group).applyInPandas(_block_links(num, den), "a long, b long")
        more = stage(links.unionByName(found), "links")
        old, roots = roots, stage(components(more), "roots")
        spare += [old, cast, large, more]
    unstage(*spare)
    # classes of one document need no join back
    kin = ids.where("n > 0").join(classes.where("copies > 1").drop("copies"), ["s1", "s2", "n"], "left").select("doc", F.coalesce("rep", "doc").alias("rep"))
    every = plain.select("doc", "n").join(kin, "doc", "left").withColumn("rep", F.coalesce("rep", "doc"))
    out = every.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("root", "rep"))
    return out.select(
        F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("component") != F.lit(-(1 << 63)), F.col("component")).alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"),
    )
