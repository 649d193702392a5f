"""A knowledge graph in two tables: vertices (id, name, type, description) and edges (src, label, dst, weight, chunk_id)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import shared_folder
from lectern.functions.classify import entity_type
from lectern.operators.matching import matches


def _key(x: Column | str) -> Column:
    return F.lower(F.col(x) if isinstance(x, str) else x)


def add_entities(vertices: DataFrame | None, new: DataFrame) -> DataFrame:
    """vertices plus new (name, type, description, ord); names differ by more than case, and the first one stays."""
    fresh = new.select(_key("name").alias("id"), "name", "type", "description", F.struct(F.lit(1).alias("a"), F.col("ord").cast("long").alias("b")).alias("o"))
    if vertices is not None:
        fresh = vertices.select("id", "name", "type", "description", F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b")).alias("o")).unionByName(fresh)
    first = fresh.groupBy("id").agg(F.min_by(F.struct("name", "type", "description"), "o").alias("v"))
    return first.select("id", "v.*")


def triplet_entities(triplets: DataFrame) -> DataFrame:
    """(name, type, description, ord) of both ends of triplets with non-blank head, relation and tail."""
    good = valid_triplets(triplets)
    end = lambda n, i: good.select(F.col(n).alias("name"), entity_type(F.coalesce(f"{n}_type", F.lit("Other"))).alias("type"), F.lit("").alias("description"), (F.col("ord") * 2 + i).alias("ord"))
    return end("head", 0).unionByName(end("tail", 1))


def valid_triplets(triplets: DataFrame) -> DataFrame:
    good = None
    for c in ("head", "relation", "tail"):
        one = F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
        good = one if good is None else good & one
    return triplets.where(good)


def edges_of(triplets: DataFrame) -> DataFrame:
    """Distinct edges, how often each was added, and the first chunk."""
    t = valid_triplets(triplets)
    return t.groupBy(_key("head").alias("src"), F.col("relation").alias("label"), _key("tail").alias("dst")).agg(F.count("*").alias("added"), F.min_by("chunk_id", "ord").alias("chunk_id"), F.max("confidence").alias("weight"))


def missing_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices of type UNKNOWN for ends of edges that no vertex stands for."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(vertices.select("id"), "id", "left_anti").select("id", F.col("id").alias("name"), F.lit("UNKNOWN").alias("type"), F.lit("").alias("description"))


def item_rows(items: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of figures or tables (item_id, path, description): type, path and description (200 characters)."""
    v = items.select(_key("item_id").alias("id"), F.col("item_id").alias("name"), F.lit(kind).alias("type"), F.col("description"))
    facts = F.array(F.struct(F.lit("__is_a__").alias("label"), F.lit(kind).alias("value")), F.struct(F.lit("__has_path__").alias("label"), F.col("path").alias("value")), F.struct(F.lit("__has_description__").alias("label"), F.substring("description", 1, 200).alias("value")))
    e = items.select(_key("item_id").alias("src"), F.explode(facts).alias("f")).select("src", "f.label", F.col("f.value").alias("dst")).where(F.length("dst") > 0)
    return v, e


def lookup(vertices: DataFrame, names: DataFrame) -> DataFrame:
    """For each name whether an entity of it, but for case, is there, and its id, name, type."""
    return names.select("name").distinct().withColumn("id", _key("name")).join(vertices.select("id", F.col("name").alias("entity"), "type"), "id", "left").select("name", F.col("entity").isNotNull().alias("contained"), "entity", "type")


def neighbours(edges: DataFrame, starts: DataFrame, label: str | None = None, direction: str = "both", most: int = 50) -> DataFrame:
    """(id, label, neighbour) of start ids, at most 50 each; direction: out, in or both."""
    e = edges if label is None else edges.where(F.lower("label") == label.lower())
    out = e.select(F.col("src").alias("id"), "label", F.col("dst").alias("neighbour"))
    back = e.select(F.col("dst").alias("id"), "label", F.col("src").alias("neighbour"))
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct().join(starts.select("id").distinct(), "id", "left_semi")
    w = Window.partitionBy("id").orderBy("neighbour", "label")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def k_hop(edges: DataFrame, starts: DataFrame, depth: int = 1, most: int | None = None) -> DataFrame:
    """Edges reached from each start (start, id) along their direction in at most depth steps, with the step.

    One join a step; a vertex is entered once, so cycles end. most: the first edges by (hop, src, label, dst)."""
    e = edges.select("src", "label", "dst").distinct()
    front = starts.select(F.col("id").alias("start"), "id").distinct()
    seen, out = front, None
    for hop in range(1, depth + 1):
        step = front.join(e, F.col("id") == F.col("src")).select("start", "src", "label", "dst", F.lit(hop).alias("hop"))
        out = step if out is None else out.unionByName(step)
        front = step.select("start", F.col("dst").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        seen = seen.unionByName(front)
    if most is not None:
        w = Window.partitionBy("start").orderBy("hop", "src", "label", "dst")
        out = out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
    return out


def expand(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """k_hop() for any depth: each hop's edges are written to the shared folder before the next one, so a plan holds one join and
    one anti-join however deep the search is, and it ends with the first hop that reaches nothing new."""
    spark = edges.sparkSession
    at = f"{shared_folder(spark)}/expand-{uuid.uuid4().hex}"
    edges.select("src", "label", "dst").distinct().write.parquet(f"{at}/edges")
    e = spark.read.parquet(f"{at}/edges")
    starts.select(F.col("id").alias("start"), "id").distinct().write.parquet(f"{at}/seen/0")
    seen_schema = spark.read.parquet(f"{at}/seen/0").schema
    hops = []
    for hop in range(1, depth + 1):
        front = spark.read.schema(seen_schema).parquet(f"{at}/seen/{hop - 1}")
        front.join(e, F.col("id") == F.col("src")).select("start", "src", "label", "dst", F.lit(hop).alias("hop")).write.parquet(f"{at}/hops/{hop}")
        step = spark.read.parquet(f"{at}/hops/{hop}")
        hops.append(f"{at}/hops/{hop}")
        seen = spark.read.schema(seen_schema).option("recursiveFileLookup", True).parquet(f"{at}/seen")
        step.select("start", F.col("dst").alias("id")).distinct().join(seen, ["start", "id"], "left_anti").write.parquet(f"{at}/seen/{hop}")
        if spark.read.schema(seen_schema).parquet(f"{at}/seen/{hop}").isEmpty():
            break
    return spark.read.parquet(*hops) if hops else e.select(F.lit(None).cast("string").alias("start"), "src", "label", "dst", F.lit(0).alias("hop")).limit(0)


def search_entities(vertices: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Entities whose name holds the whole query (1.0) or one of its words (0.5), the best k of each query.

    Only the distinct words and whole queries are held against the distinct names, in blocks of bounded size; what is found is
    joined back by name and word."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("q")).where("q <> ''").withColumn("words", F.filter(F.split("q", r"\s+"), lambda w: w != ""))
    terms = q.select(F.explode(F.array_append("words", F.col("q"))).alias("term")).distinct()
    held = matches(vertices.select(F.lower("name").alias("low")).distinct(), "low", terms, "term")
    asked = q.select("query_id", F.explode(F.array_distinct(F.array_append("words", F.col("q")))).alias("term"), "q")
    best = asked.join(held, "term").groupBy("query_id", "low").agg(F.max(F.when(F.col("term") == F.col("q"), 1.0).otherwise(0.5)).alias("score"))
    scored = vertices.withColumn("low", F.lower("name")).join(best, "low").select("query_id", "id", "name", "type", "score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vertices: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 5, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Entities of each query, and the distinct triplets around them (head, relation, tail)."""
    found = search_entities(vertices, queries, k)
    hops = k_hop(edges, found.select("id"), depth, most=100)
    t = found.select("query_id", F.col("id").alias("start")).join(hops, "start").groupBy("query_id", F.col("src").alias("head"), F.col("label").alias("relation"), F.col("dst").alias("tail")).agg(F.min("hop").alias("hop"))
    return found, t


def context_text(entities: DataFrame, triplets: DataFrame, top_entities: int = 5, top_triplets: int = 10) -> DataFrame:
    """Per query a text of its best entities and triplets."""
    e = entities.where(F.col("rank") <= top_entities).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name", "type"))), lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), x["type"], F.lit(")"))), "\n").alias("entities"))
    w = Window.partitionBy("query_id").orderBy("hop", "head", "relation", "tail")
    t = triplets.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top_triplets).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "head", "relation", "tail"))), lambda x: F.concat(F.lit("- "), x["head"], F.lit(" -["), x["relation"], F.lit("]-> "), x["tail"])), "\n").alias("triplets"))
    return e.join(t, "query_id", "full_outer").select("query_id", F.concat_ws("\n", F.coalesce("entities", F.lit("")), F.coalesce("triplets", F.lit(""))).alias("context"))


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, distinct relations, relations added."""
    added = F.sum("added") if "added" in edges.columns else F.count("*")
    return vertices.agg(F.count("*").alias("entities")).crossJoin(edges.agg(F.count("*").alias("relations"), F.coalesce(added, F.lit(0)).alias("relations_added")))


def type_histogram(vertices: DataFrame, column: str = "type") -> DataFrame:
    return vertices.groupBy(column).agg(F.count("*").alias("n"))


def with_both_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    v = vertices.select("id")
    return edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")


def build(chunks: DataFrame, extract, per_batch: int = 4, least: int = 50, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, edges and counters from chunks (paper_id, chunk_index, chunk_id, text).

    extract: a Column of text -> array<struct<head, head_type, relation, relation_type, tail, tail_type, confidence,
    evidence>> (a model's UDF; functions.boundary has a local one). Chunks of fewer than 50 characters are not read; all
    triplets of a chunk stay, by falling confidence. most: only so many of each chunk (for multimodal input)."""
    numbered = chunks.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("paper_id").orderBy("chunk_index", "chunk_id")) - 1) / per_batch))
    read = numbered.withColumn("t", F.when(F.length("text") >= least, extract(F.col("text"))))
    best = F.sort_array(F.transform("t", lambda x: F.struct((-F.coalesce(x["confidence"], F.lit(0.5))).alias("less"), x.alias("x"))))
    best = best if most is None else F.slice(best, 1, most)
    t = read.select("paper_id", "batch", "chunk_id", "chunk_index", F.posexplode(F.transform(best, lambda b: b["x"])).alias("pos", "x"))
    t = t.select("paper_id", "batch", "chunk_id", (F.col("chunk_index").cast("long") * (1 << 28) + F.col("pos")).alias("ord"), "x.*")
    edges = edges_of(t)
    vertices = add_entities(None, triplet_entities(t))
    counters = read.groupBy("paper_id").agg(F.count("*").alias("chunks"), F.sum((F.length("text") < least).cast("long")).alias("skipped"), F.sum((F.coalesce(F.size("t"), F.lit(0)) <= 0).cast("long")).alias("empty"), F.sum(F.greatest(F.coalesce(F.size("t"), F.lit(0)), F.lit(0)).cast("long")).alias("triplets"), F.count_distinct("batch").alias("batches"))
    return vertices, edges, counters
