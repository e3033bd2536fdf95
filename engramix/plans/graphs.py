"""Graph algorithms over the relational tables seen as a typed graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramix.operators import graph
from engramix.sources.tables import read


def _edges(spark, folder):
    """Nation -> supplier, customer -> order as one edge table with disjoint node numbers."""
    supplier = read(spark, folder, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_nationkey").cast("long").alias("src"), (F.col("s_suppkey") + 1000).cast("long").alias("dst"), F.lit("HAS_SUPPLIER").alias("etype"), F.lit(0.8).cast("double").alias("weight"))
    customer = read(spark, folder, "customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") + 1_000_000).cast("long").alias("dst"), F.lit("HAS_CUSTOMER").alias("etype"), F.lit(None).cast("double").alias("weight"))
    order = read(spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice").select((F.col("o_custkey") + 1_000_000).cast("long").alias("src"), (F.col("o_orderkey") + 100_000_000).cast("long").alias("dst"), F.lit("ORDERED").alias("etype"), F.lit(1.0).alias("weight"))
    nation = read(spark, folder, "nation", "n_nationkey", "n_regionkey").select((F.col("n_regionkey") + 500).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"), F.lit("HAS_NATION").alias("etype"), F.lit(2.0).alias("weight"))
    return supplier.unionByName(customer).unionByName(order).unionByName(nation)


def traversal(spark, folder):
    """Nodes within three hops of each region."""
    starts = read(spark, folder, "region", "r_regionkey").select((F.col("r_regionkey") + 500).cast("long").alias("start"))
    return graph.traverse(_edges(spark, folder), starts, 3).groupBy("start", "depth").agg(F.count("*").alias("nodes"), F.min("node").alias("first_node"))


def shortest_path(spark, folder):
    """Length of the shortest directed path from region 501 to every supplier, at most three hops."""
    pairs = read(spark, folder, "supplier", "s_suppkey").select(F.lit(501).cast("long").alias("start"), (F.col("s_suppkey") + 1000).cast("long").alias("goal"))
    return graph.shortest_paths(_edges(spark, folder), pairs, 3)


def pagerank_weighted(spark, folder):
    """Three rounds of personalised PageRank from two regions, by edge weight and type."""
    seeds = spark.createDataFrame([(500,), (502,)], "node long")
    weights = {"HAS_SUPPLIER": 1.5, "HAS_CUSTOMER": 1.0, "ORDERED": 0.5, "HAS_NATION": 1.0}
    scored = graph.personalised_pagerank(_edges(spark, folder), seeds, 0.85, 3, 0.0, weights)
    return scored.select("node", F.round("score", 10).alias("score"))


def _together(spark, folder):
    """Parts that stand together in at least two orders."""
    return graph.cooccurrence(read(spark, folder, "lineitem", "l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").where("weight >= 2")


def cooccurrence_pairs(spark, folder):
    return _together(spark, folder)


def communities(spark, folder):
    """Parts grouped by label propagation over their co-occurrence."""
    return graph.label_propagation(_together(spark, folder)).groupBy("label").agg(F.count("*").alias("members"), F.min("node").alias("first_member")).where("members >= 2")


def linked_parts(spark, folder):
    """Connected components of suppliers, nations and regions."""
    from engramix.operators.components import components

    e = _edges(spark, folder).where("etype in ('HAS_SUPPLIER', 'HAS_NATION')")
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    return components(nodes, e).groupBy("component").agg(F.count("*").alias("members"))


def hierarchy_closure(spark, folder):
    """Every goal with all goals under it: region, nation, customer."""
    top = read(spark, folder, "region", "r_regionkey").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"))
    mid = read(spark, folder, "nation", "n_nationkey", "n_regionkey").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))
    low = read(spark, folder, "customer", "c_custkey", "c_nationkey").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"))
    return graph.descendants(top.unionByName(mid).unionByName(low), "id", "parent").where("depth > 0").groupBy("root", "depth").agg(F.count("*").alias("nodes"))


QUERIES = {f.__name__: f for f in (traversal, shortest_path, pagerank_weighted, cooccurrence_pairs, communities, linked_parts, hierarchy_closure)}

_E = """e AS (SELECT s_nationkey::BIGINT AS src, (s_suppkey + 1000)::BIGINT AS dst, 'HAS_SUPPLIER' AS etype, 0.8::DOUBLE AS weight FROM supplier UNION ALL SELECT c_nationkey, c_custkey + 1000000, 'HAS_CUSTOMER', NULL FROM customer
  UNION ALL SELECT o_custkey + 1000000, o_orderkey + 100000000, 'ORDERED', 1.0 FROM orders UNION ALL SELECT n_regionkey + 500, n_nationkey, 'HAS_NATION', 2.0 FROM nation)"""
_STEP = """SELECT node, sum(s) AS score FROM (SELECT dst AS node, score * p * 0.85 AS s FROM {0} JOIN st ON node = src UNION ALL SELECT node, score * 0.15 FROM s0) GROUP BY 1"""

SQL = {
    "traversal": f"""WITH RECURSIVE {_E}, t AS (SELECT (r_regionkey + 500)::BIGINT AS start, (r_regionkey + 500)::BIGINT AS node, 0 AS depth FROM region UNION SELECT start, dst, depth + 1 FROM t JOIN e ON node = src WHERE depth < 3),
        b AS (SELECT start, node, min(depth) AS depth FROM t GROUP BY 1, 2) SELECT start, depth::INT AS depth, count(*) AS nodes, min(node) AS first_node FROM b WHERE depth > 0 GROUP BY 1, 2""",
    "shortest_path": f"""WITH RECURSIVE {_E}, t AS (SELECT 501::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM t JOIN e ON node = src WHERE depth < 3)
        SELECT 501::BIGINT AS start, node AS goal, min(depth)::INT AS length FROM t WHERE node IN (SELECT s_suppkey + 1000 FROM supplier) GROUP BY 2""",
    "pagerank_weighted": f"""WITH {_E}, w AS (SELECT src, dst, sum(coalesce(weight, 1) * CASE etype WHEN 'HAS_SUPPLIER' THEN 1.5 WHEN 'ORDERED' THEN 0.5 ELSE 1.0 END) AS w FROM e GROUP BY 1, 2),
        st AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w), s0 AS (SELECT unnest([500, 502])::BIGINT AS node, 0.5 AS score), s1 AS ({_STEP.format('s0')}), s2 AS ({_STEP.format('s1')}), s3 AS ({_STEP.format('s2')})
        SELECT node, round(score, 10) AS score FROM s3""",
    "cooccurrence_pairs": """WITH m AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS e FROM lineitem) SELECT x.e AS a, y.e AS b, count(*) AS weight FROM m x JOIN m y ON x.s = y.s AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2""",
    "linked_parts": f"""WITH RECURSIVE {_E}, l AS (SELECT src AS u, dst AS v FROM e WHERE etype IN ('HAS_SUPPLIER', 'HAS_NATION') UNION ALL SELECT dst, src FROM e WHERE etype IN ('HAS_SUPPLIER', 'HAS_NATION')),
        t AS (SELECT DISTINCT u AS n, u AS r FROM l UNION SELECT l.v, t.r FROM t JOIN l ON t.n = l.u), c AS (SELECT n, min(r) AS component FROM t GROUP BY 1) SELECT component, count(*) AS members FROM c GROUP BY 1""",
    "hierarchy_closure": """WITH RECURSIVE g AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
        t AS (SELECT id AS root, id AS node, 0 AS depth FROM g UNION ALL SELECT t.root, g.id, depth + 1 FROM t JOIN g ON g.parent = t.node WHERE depth < 5)
        SELECT root, depth::INT AS depth, count(*) AS nodes FROM t WHERE depth > 0 GROUP BY 1, 2""",
}
