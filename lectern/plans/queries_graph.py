"""Queries of the knowledge graph: nations, regions, customers and suppliers as entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import graph as g
from lectern.plans.catalog import Tables, query
from lectern.sources import sinks

V = """v AS (SELECT lower(n_name) AS id, n_name AS name, 'Nation' AS type FROM nation UNION ALL SELECT lower(r_name), r_name, 'Region' FROM region
       UNION ALL SELECT lower(c_name), c_name, 'Customer' FROM customer UNION ALL SELECT lower(s_name), s_name, 'Supplier' FROM supplier)"""
E_ = """e AS (SELECT lower(n_name) AS src, 'in' AS label, lower(r_name) AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
       UNION ALL SELECT lower(c_name), 'lives_in', lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
       UNION ALL SELECT lower(s_name), 'based_in', lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def vertices(t: Tables) -> DataFrame:
    one = lambda df, c, kind: df.select(F.lower(c).alias("id"), F.col(c).alias("name"), F.lit(kind).alias("type"))
    return one(t.nation, "n_name", "Nation").unionByName(one(t.region, "r_name", "Region")).unionByName(one(t.customer, "c_name", "Customer")).unionByName(one(t.supplier, "s_name", "Supplier"))


def edges(t: Tables) -> DataFrame:
    n = F.broadcast(t.nation)
    one = lambda df, a, label, b: df.select(F.lower(a).alias("src"), F.lit(label).alias("label"), F.lower(b).alias("dst"))
    return one(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "in", "r_name").unionByName(one(t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "lives_in", "n_name")).unionByName(one(t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "based_in", "n_name"))


@query(f"WITH {V} SELECT type, count(*) AS n FROM v GROUP BY type")
def graph_type_histogram(t: Tables) -> DataFrame:
    return g.type_histogram(vertices(t))


@query(f"WITH {V}, {E_} SELECT (SELECT count(*) FROM v) AS entities, count(*) AS relations, count(*) AS relations_added FROM e")
def graph_stats(t: Tables) -> DataFrame:
    return g.stats(vertices(t), edges(t))


@query(f"""WITH {E_}, s AS (SELECT DISTINCT lower(s_name) AS start FROM supplier), h1 AS (SELECT start, src, label, dst, 1 AS hop FROM s JOIN e ON e.src = s.start),
       h2 AS (SELECT h.start, e.src, e.label, e.dst, 2 AS hop FROM (SELECT DISTINCT start, dst FROM h1) h JOIN e ON e.src = h.dst) SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def graph_k_hop(t: Tables) -> DataFrame:
    return g.k_hop(edges(t), t.supplier.select(F.lower("s_name").alias("start"), F.lower("s_name").alias("id")).select("id"), 2)


@query(f"""WITH {E_}, b AS (SELECT src AS id, label, dst AS neighbour FROM e UNION SELECT dst, label, src FROM e), n AS (SELECT DISTINCT lower(n_name) AS id FROM nation)
       SELECT b.id, label, neighbour FROM b JOIN n USING (id) QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY neighbour, label) <= 50""")
def graph_neighbours(t: Tables) -> DataFrame:
    return g.neighbours(edges(t), t.nation.select(F.lower("n_name").alias("id")))


@query(f"""WITH {V}, q AS (SELECT r_regionkey AS query_id, lower(r_name) AS q FROM region UNION ALL SELECT 100 + n_nationkey, lower(n_name) || ' supplier#00000000' || (n_nationkey % 10) FROM nation),
       m AS (SELECT query_id, id, name, type, CASE WHEN contains(lower(name), q) THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM q, v WHERE contains(lower(name), q) OR len(list_filter(string_split(q, ' '), lambda w: w <> '' AND contains(lower(v.name), w))) > 0)
       SELECT query_id, id, name, type, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m QUALIFY rank <= 5""")
def graph_entity_search(t: Tables) -> DataFrame:
    q = t.region.select(F.col("r_regionkey").cast("long").alias("query_id"), F.col("r_name").alias("text")).unionByName(t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("query_id"), F.concat("n_name", F.lit(" supplier#00000000"), F.col("n_nationkey") % 10).alias("text")))
    return g.search_entities(vertices(t), q).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {V}, {E_}, k AS (SELECT id FROM v WHERE type <> 'Customer') SELECT src, label, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def graph_edge_endpoints(t: Tables) -> DataFrame:
    return g.with_both_ends(edges(t), vertices(t).where("type <> 'Customer'")).select("src", "label", "dst")


@query(f"""WITH {V}, {E_}, k AS (SELECT id FROM v WHERE type <> 'Nation'), x AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, 'UNKNOWN' AS type FROM x WHERE id NOT IN (SELECT id FROM k)""")
def graph_missing_ends(t: Tables) -> DataFrame:
    return g.missing_ends(edges(t), vertices(t).where("type <> 'Nation'")).select("id", "type")


_T = "SELECT 'Part ' || (l_partkey % 50) AS head, CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE 'from' END AS relation, CASE WHEN l_suppkey % 2 = 0 THEN 'SUPP ' ELSE 'Supp ' END || (l_suppkey % 7) AS tail, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"


def _triplets(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("concat('Part ', l_partkey % 50) as head", "'Method/technique' as head_type", "if(l_linenumber % 4 = 0, ' ', 'from') as relation", "concat(if(l_suppkey % 2 = 0, 'SUPP ', 'Supp '), l_suppkey % 7) as tail", "'thing' as tail_type", "l_orderkey * 10 + l_linenumber as ord", "cast(l_discount as double) as confidence", "cast(l_orderkey as string) as chunk_id")


@query(f"""WITH t AS ({_T}), x AS (SELECT head AS name, 'Method/Technique' AS type, ord * 2 AS o FROM t WHERE trim(relation) <> '' UNION ALL SELECT tail, 'Other', ord * 2 + 1 FROM t WHERE trim(relation) <> '')
       SELECT lower(name) AS id, arg_min(name, o) AS name, arg_min(type, o) AS type FROM x GROUP BY lower(name)""")
def graph_entity_upsert(t: Tables) -> DataFrame:
    return g.add_entities(None, g.triplet_entities(_triplets(t))).select("id", "name", "type")


@query(f"""WITH t AS ({_T}) SELECT lower(head) AS src, relation AS label, lower(tail) AS dst, count(*) AS added FROM t WHERE trim(relation) <> '' GROUP BY ALL""")
def graph_relation_upsert(t: Tables) -> DataFrame:
    return g.edges_of(_triplets(t)).select("src", "label", "dst", "added")


@query(f"""WITH {V}, {E_}, q AS (SELECT r_regionkey AS query_id, lower(r_name) AS q FROM region), f AS (SELECT query_id, id FROM q, v WHERE contains(lower(name), q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 5)
       SELECT query_id, count(DISTINCT e.src || e.label || e.dst) AS triplets FROM f LEFT JOIN e ON e.src = f.id GROUP BY query_id""")
def graph_search(t: Tables) -> DataFrame:
    q = t.region.select(F.col("r_regionkey").cast("long").alias("query_id"), F.col("r_name").alias("text"))
    found, trip = g.search(vertices(t), edges(t), q)
    n = trip.groupBy("query_id").agg(F.count("*").alias("triplets"))
    return found.select("query_id").distinct().join(n, "query_id", "left").select("query_id", F.coalesce("triplets", F.lit(0)).cast("long").alias("triplets"))


@query(f"""WITH {V}, {E_} SELECT src AS source, dst AS target, label AS type FROM e""")
def bloom_edges(t: Tables) -> DataFrame:
    return sinks.bloom_edges(edges(t), vertices(t))


@query(f"""WITH {V} SELECT id, CASE type WHEN 'Nation' THEN 'Venue' WHEN 'Region' THEN 'Paper' ELSE 'Other' END AS type, name AS label, CASE type WHEN 'Region' THEN '#3498DB' ELSE '#95A5A6' END AS color FROM v""")
def bloom_nodes(t: Tables) -> DataFrame:
    v = vertices(t).withColumn("labels", F.array(F.expr("case type when 'Nation' then 'Venue' when 'Region' then 'Paper' else 'x' end"))).withColumn("paper_id", F.lit("p"))
    return sinks.bloom_nodes(v).select("id", "type", "label", "color")


_FOUND = r"regexp_extract_all(text, '\b([A-Z][\w-]+)\s+(uses|improves|extends|outperforms|is|has|of|and|the)\s+([A-Za-z][\w-]+)', {})"


@query(f"""WITH t AS (SELECT unnest({_FOUND.format(1)}) AS h, unnest({_FOUND.format(2)}) AS r, unnest({_FOUND.format(3)}) AS l FROM documents WHERE length(text) >= 50)
       SELECT lower(h) AS src, r AS label, lower(l) AS dst, count(*) AS added FROM t GROUP BY ALL""")
def graph_build(t: Tables) -> DataFrame:
    from lectern.functions.boundary import pattern_triplets

    chunks = t.documents.selectExpr("concat('p', doc_id % 37) as paper_id", "doc_id as chunk_index", "cast(doc_id as string) as chunk_id", "text")
    _, e, _ = g.build(chunks, pattern_triplets)
    return e.select("src", "label", "dst", "added")


_DEEP = """SELECT DISTINCT 's' || l_suppkey AS src, 'ships' AS label, 'p' || l_partkey AS dst FROM lineitem
           UNION SELECT DISTINCT 'p' || l_partkey, 'needs', 's' || (l_partkey % 97 + 1) FROM lineitem WHERE l_partkey % 5 = 0"""


@query(f"""WITH RECURSIVE e AS ({_DEEP}), r AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS id, 0 AS hop FROM supplier WHERE s_suppkey <= 3
             UNION SELECT r.start, e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.id WHERE r.hop < 5),
       v AS (SELECT start, id, min(hop) AS hop FROM r GROUP BY ALL) SELECT v.start, e.src, e.label, e.dst, v.hop + 1 AS hop FROM v JOIN e ON e.src = v.id""")
def graph_deep_search(t: Tables) -> DataFrame:
    """Six steps over a graph with hubs: every supplier ships many parts."""
    ships = t.lineitem.selectExpr("concat('s', l_suppkey) as src", "'ships' as label", "concat('p', l_partkey) as dst")
    needs = t.lineitem.where("l_partkey % 5 = 0").selectExpr("concat('p', l_partkey) as src", "'needs' as label", "concat('s', l_partkey % 97 + 1) as dst")
    return g.expand(ships.unionByName(needs), t.supplier.where("s_suppkey <= 3").selectExpr("concat('s', s_suppkey) as id"), 6)
