"""Graph queries: customers are companies, orders are orders, parts are products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.keys import short_key
from quarrystone.operators import graph
from quarrystone.operators.gates import gate, report
from quarrystone.plans.tables import table


def _relations(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Arguments of graph.occurrences() and graph.facts_of() for the relations of the case."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return [
        (orders, ("company", F.col("o_custkey")), "company_has_order", ("order", F.col("o_orderkey")), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"))),
        (lines, ("order", F.col("l_orderkey")), "order_has_product", ("product", F.col("l_partkey")), F.concat_ws("/", F.lit("lineitem"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))),
    ]


def case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [graph.occurrences(*r) for r in _relations(spark, sf_dir)])


def _typed(spark: SparkSession, sf_dir: str, parts: str = "true") -> list[tuple]:
    """Arguments of graph.nodes() for the nodes of the case, with those parts only that meet a condition."""
    return [
        ("company", table(spark, sf_dir, "customer"), F.col("c_custkey"), F.lit("customer")),
        ("order", table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.lit("orders")),
        ("product", table(spark, sf_dir, "part").filter(parts), F.col("p_partkey"), F.lit("part")),
    ]


def case_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(*_typed(spark, sf_dir))


def case_orphans(spark: SparkSession, sf_dir: str, parts: str = "true") -> DataFrame:
    return graph.orphans_of(_relations(spark, sf_dir), _typed(spark, sf_dir, parts))


def relation_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [graph.facts_of(*r) for r in _relations(spark, sf_dir)])


def relation_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.catalog(relation_fact(spark, sf_dir), case_nodes(spark, sf_dir))


def node_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_nodes(spark, sf_dir)


def orphan_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose product is not registered: the registry holds parts up to size 40 only."""
    found = case_orphans(spark, sf_dir, "p_size <= 40")
    return found.groupBy("relation", "to_type", "to").agg(F.count("*").alias("n")).groupBy("relation").agg(F.sum("n").alias("orphans"), F.count("*").alias("missing_nodes"))


def unreferenced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unreferenced_of(_relations(spark, sf_dir), _typed(spark, sf_dir)).select("node_id", "node_type", "value")


def relation_time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence count and first and last time key of each relation; relations without dated evidence stay."""
    lines = table(spark, sf_dir, "lineitem")
    evidence = lines.select(
        F.col("l_orderkey").alias("subject"), F.col("l_partkey").alias("object"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("key")
    )
    bounds = evidence.groupBy("subject", "object").agg(
        F.count("*").alias("evidence_count"), F.min("key").alias("first_event_sort_key"), F.max("key").alias("last_event_sort_key")
    )
    relations = lines.select(F.col("l_orderkey").alias("subject"), F.col("l_partkey").alias("object")).distinct()
    return relations.join(bounds, ["subject", "object"], "left")


def multiparent_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that several orders hold."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("object")).agg(
        F.countDistinct("l_orderkey").alias("parents"), F.count("*").alias("occurrences")
    ).filter("parents > 1")


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = case_nodes(spark, sf_dir)
    return nodes.groupBy("node_type").agg(F.count("*").alias("nodes"), F.countDistinct("value").alias("distinct_values"))


def relation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and occurrences of each relation, merged from both sides so neither hides the other."""
    edges = case_edges(spark, sf_dir)
    by_fact = graph.facts(edges.filter("relation <> 'order_has_product'")).groupBy("relation").agg(F.count("*").alias("facts"))
    by_occurrence = edges.groupBy("relation").agg(F.count("*").alias("occurrences"), F.countDistinct("source_rel").alias("sources"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return by_fact.join(by_occurrence, "relation", "full").select("relation", zero("facts"), zero("occurrences"), zero("sources"))


def node_evidence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence at either end of a node, and its first source."""
    facts = relation_fact(spark, sf_dir)
    ends = facts.select(F.col("from_id").alias("node_id"), "evidence_count", "first_source").union(facts.select("to_id", "evidence_count", "first_source"))
    return ends.groupBy("node_id").agg(F.sum("evidence_count").alias("evidence"), F.min("first_source").alias("first_source"))


def node_pairs_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products seen with a company, through two joins on the node dimension; all keys are plain values, which stand for their nodes."""
    owned, held = (graph.ends_of(*r) for r in _relations(spark, sf_dir))
    names = {kind: df.select(value.alias(kind)).filter(F.col(kind).isNotNull()).distinct() for kind, df, value, _ in _typed(spark, sf_dir) if kind != "order"}
    orders = owned.select(F.col("_left").alias("company"), F.col("_right").alias("order")).distinct()
    lines = held.select(F.col("_left").alias("order"), F.col("_right").alias("product")).distinct()
    pairs = lines.join(orders, "order").groupBy("company", "product").agg(F.count("*").alias("orders"))
    found = pairs.join(names["company"], "company").join(names["product"], "product")
    return found.select(F.col("company").cast("string").alias("company"), F.col("product").cast("string").alias("product"), "orders")


def graph_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistency of the graph: one row for each gate."""
    edges, nodes, facts = case_edges(spark, sf_dir), case_nodes(spark, sf_dir), relation_fact(spark, sf_dir)
    evidence = facts.agg(F.sum("evidence_count").alias("n")).select(F.col("n"))
    return report(
        gate("ORPHAN_ENDPOINTS", case_orphans(spark, sf_dir)),
        gate("UNREFERENCED_ORDERS", graph.unreferenced_of(_relations(spark, sf_dir), _typed(spark, sf_dir), "order")),
        gate("EVIDENCE_SUM", evidence.join(edges.agg(F.count("*").alias("m")), F.col("n") != F.col("m"))),
        gate("SELF_LOOPS", edges.filter("from_id = to_id")),
        gate("DUPLICATE_NODES", nodes.groupBy(short_key(F.col("node_id")).alias("k")).count().filter("count > 1")),
    )


QUERIES = {
    f.__name__: f
    for f in (node_registry, relation_fact, relation_catalog, orphan_endpoints, unreferenced_nodes, relation_time_bounds, multiparent_objects, entity_counts, relation_stats, node_evidence_totals, node_pairs_by_company, graph_gates)
}

EDGES_SQL = """
edges AS (
  SELECT 'company:' || sha256(o_custkey::varchar) AS from_id, 'company_has_order' AS relation,
         'order:' || sha256(o_orderkey::varchar) AS to_id, 'orders/' || o_orderkey AS source_rel FROM orders
  UNION ALL
  SELECT 'order:' || sha256(l_orderkey::varchar), 'order_has_product', 'product:' || sha256(l_partkey::varchar),
         'lineitem/' || l_orderkey || '/' || l_linenumber FROM lineitem)"""
NODES_SQL = """
nodes AS (
  SELECT 'company:' || sha256(c_custkey::varchar) AS node_id, 'company' AS node_type, c_custkey::varchar AS value, 'customer' AS source_rel FROM customer
  UNION SELECT 'order:' || sha256(o_orderkey::varchar), 'order', o_orderkey::varchar, 'orders' FROM orders
  UNION SELECT 'product:' || sha256(p_partkey::varchar), 'product', p_partkey::varchar, 'part' FROM part)"""
FACTS_SQL = """
facts AS (
  SELECT from_id, relation, to_id, count(*) AS evidence_count, min(source_rel) AS first_source, max(source_rel) AS last_source
  FROM edges GROUP BY ALL)"""

ORACLES = {
    "relation_fact": f"WITH {EDGES_SQL}, {FACTS_SQL} SELECT * FROM facts",
    "relation_catalog": f"""WITH {EDGES_SQL}, {FACTS_SQL}, {NODES_SQL}
SELECT upper(substr(sha256(from_id || chr(0) || relation || chr(0) || to_id), 1, 32)) AS fact_id,
       s.node_type AS from_type, s.value AS from_value, relation, o.node_type AS to_type, o.value AS to_value,
       evidence_count, first_source, last_source
FROM facts LEFT JOIN nodes s ON s.node_id = from_id LEFT JOIN nodes o ON o.node_id = to_id""",
    "node_registry": f"WITH {NODES_SQL} SELECT * FROM nodes",
    "orphan_endpoints": f"""WITH {EDGES_SQL}
SELECT relation, count(*) AS orphans, count(DISTINCT to_id) AS missing_nodes FROM edges
WHERE relation = 'order_has_product' AND to_id NOT IN (SELECT 'product:' || sha256(p_partkey::varchar) FROM part WHERE p_size <= 40) GROUP BY relation""",
    "unreferenced_nodes": f"""WITH {EDGES_SQL}, {NODES_SQL}
SELECT node_id, node_type, value FROM nodes WHERE node_id NOT IN (SELECT from_id FROM edges UNION SELECT to_id FROM edges)""",
    "relation_time_bounds": """
SELECT l_orderkey AS subject, l_partkey AS object, count(*) AS evidence_count,
       min(epoch_us(l_shipdate)) AS first_event_sort_key, max(epoch_us(l_shipdate)) AS last_event_sort_key
FROM lineitem GROUP BY ALL""",
    "multiparent_objects": """
SELECT l_partkey AS object, count(DISTINCT l_orderkey) AS parents, count(*) AS occurrences FROM lineitem
GROUP BY ALL HAVING count(DISTINCT l_orderkey) > 1""",
    "entity_counts": f"WITH {NODES_SQL} SELECT node_type, count(*) AS nodes, count(DISTINCT value) AS distinct_values FROM nodes GROUP BY ALL",
    "relation_stats": f"""WITH {EDGES_SQL}, {FACTS_SQL},
f AS (SELECT relation, count(*) AS facts FROM facts WHERE relation <> 'order_has_product' GROUP BY ALL),
o AS (SELECT relation, count(*) AS occurrences, count(DISTINCT source_rel) AS sources FROM edges GROUP BY ALL)
SELECT coalesce(f.relation, o.relation) AS relation, coalesce(facts, 0) AS facts, coalesce(occurrences, 0) AS occurrences, coalesce(sources, 0) AS sources
FROM f FULL JOIN o ON f.relation = o.relation""",
    "node_evidence_totals": f"""WITH {EDGES_SQL}, {FACTS_SQL},
ends AS (SELECT from_id AS node_id, evidence_count, first_source FROM facts UNION ALL SELECT to_id, evidence_count, first_source FROM facts)
SELECT node_id, sum(evidence_count)::bigint AS evidence, min(first_source) AS first_source FROM ends GROUP BY ALL""",
    "node_pairs_by_company": """
SELECT o_custkey::varchar AS company, l_partkey::varchar AS product, count(DISTINCT o_orderkey) AS orders
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
    "graph_gates": f"""WITH {EDGES_SQL}, {FACTS_SQL}, {NODES_SQL},
v AS (
  SELECT 'ORPHAN_ENDPOINTS' AS gate_id, (SELECT count(*) FROM edges WHERE from_id NOT IN (SELECT node_id FROM nodes) OR to_id NOT IN (SELECT node_id FROM nodes)) AS violations
  UNION ALL SELECT 'UNREFERENCED_ORDERS', (SELECT count(*) FROM nodes WHERE node_type = 'order' AND node_id NOT IN (SELECT from_id FROM edges UNION SELECT to_id FROM edges))
  UNION ALL SELECT 'EVIDENCE_SUM', ((SELECT sum(evidence_count) FROM facts) <> (SELECT count(*) FROM edges))::bigint
  UNION ALL SELECT 'SELF_LOOPS', (SELECT count(*) FROM edges WHERE from_id = to_id)
  UNION ALL SELECT 'DUPLICATE_NODES', (SELECT count(*) FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(*) > 1)))
SELECT gate_id, violations::bigint AS violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v""",
}
