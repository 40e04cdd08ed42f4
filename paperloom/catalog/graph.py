"""Registered graph queries: the relational tables become a property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.registry import register, table, with_ctes
from paperloom.catalog.triples import CHAIN, CLASH, decided_triples, flat_props, raw_triples, RAW
from paperloom.operators import graph as kg
from paperloom.operators import triples as tp
from paperloom.session import materialize

NODES = [
    kg.NodeMap("customer", "Customer", "c_custkey", {"name": "c_name", "segment": "c_mktsegment", "nation": "c_nationkey"}),
    kg.NodeMap("nation", "Nation", "n_nationkey", {"name": "n_name"}),
    kg.NodeMap("region", "Region", "r_regionkey", {"name": "r_name"}),
    kg.NodeMap("supplier", "Supplier", "s_suppkey", {"name": "s_name"}),
    kg.NodeMap("part", "Part", "p_partkey", {"name": "p_name", "brand": "p_brand", "size": "p_size"}),
    kg.NodeMap("orders", "Order", "o_orderkey", {"name": "concat('order ', cast(o_orderkey as string))", "priority": "o_orderpriority"}),
    kg.NodeMap("part", "TypeWord", "item", {"name": "lower(item)"}, explode="split(p_type, ' ')"),
    kg.NodeMap("customer", "Segment", "nullif(c_mktsegment, 'BUILDING')", {"name": "c_mktsegment"}),
]
EDGES = [
    kg.EdgeMap("customer", "Customer", "c_custkey", "LOCATED_IN", "Nation", "c_nationkey"),
    kg.EdgeMap("supplier", "Supplier", "s_suppkey", "LOCATED_IN", "Nation", "s_nationkey", {"source": "'supplier'"}),
    kg.EdgeMap("nation", "Nation", "n_nationkey", "PART_OF", "Region", "n_regionkey"),
    kg.EdgeMap("orders", "Order", "o_orderkey", "PLACED_BY", "Customer", "o_custkey", {"status": "o_orderstatus"}),
    kg.EdgeMap("lineitem", "Supplier", "l_suppkey", "SUPPLIES", "Part", "l_partkey"),
    kg.EdgeMap("part", "Part", "p_partkey", "HAS_TYPE", "TypeWord", "item", explode="split(p_type, ' ')"),
    kg.EdgeMap("customer", "Customer", "c_custkey", "IN_SEGMENT", "Segment", "nullif(c_mktsegment, 'BUILDING')"),
]
TABLES = ("customer", "nation", "region", "supplier", "part", "orders", "lineitem")

SQL_NODES = """nodes AS (
  SELECT 'Customer' AS label, c_custkey::VARCHAR AS key, 'name=' || c_name || ';nation=' || c_nationkey || ';segment=' || c_mktsegment AS props, c_name AS name FROM customer
  UNION ALL SELECT 'Nation', n_nationkey::VARCHAR, 'name=' || n_name, n_name FROM nation
  UNION ALL SELECT 'Region', r_regionkey::VARCHAR, 'name=' || r_name, r_name FROM region
  UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR, 'name=' || s_name, s_name FROM supplier
  UNION ALL SELECT 'Part', p_partkey::VARCHAR, 'brand=' || p_brand || ';name=' || p_name || ';size=' || p_size, p_name FROM part
  UNION ALL SELECT 'Order', o_orderkey::VARCHAR, 'name=order ' || o_orderkey || ';priority=' || o_orderpriority, 'order ' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'TypeWord', w, 'name=' || lower(w), lower(w) FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part)
  UNION ALL SELECT DISTINCT 'Segment', c_mktsegment, 'name=' || c_mktsegment, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')"""
SQL_EDGES = """edges AS (
  SELECT 'Customer' AS src_label, c_custkey::VARCHAR AS src_key, 'LOCATED_IN' AS rel_type, 'Nation' AS dst_label, c_nationkey::VARCHAR AS dst_key, '' AS props FROM customer
  UNION ALL SELECT 'Supplier', s_suppkey::VARCHAR, 'LOCATED_IN', 'Nation', s_nationkey::VARCHAR, 'source=supplier' FROM supplier
  UNION ALL SELECT 'Nation', n_nationkey::VARCHAR, 'PART_OF', 'Region', n_regionkey::VARCHAR, '' FROM nation
  UNION ALL SELECT 'Order', o_orderkey::VARCHAR, 'PLACED_BY', 'Customer', o_custkey::VARCHAR, 'status=' || o_orderstatus FROM orders
  UNION ALL SELECT DISTINCT 'Supplier', l_suppkey::VARCHAR, 'SUPPLIES', 'Part', l_partkey::VARCHAR, '' FROM lineitem
  UNION ALL SELECT DISTINCT 'Part', p_partkey::VARCHAR, 'HAS_TYPE', 'TypeWord', w, '' FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part)
  UNION ALL SELECT 'Customer', c_custkey::VARCHAR, 'IN_SEGMENT', 'Segment', c_mktsegment, '' FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def tables_of(spark, folder):
    return {name: table(spark, folder, name) for name in TABLES}


def raw_graph(spark, folder):
    return kg.graph_from_records(tables_of(spark, folder), NODES, EDGES)


def shown_props(df):
    return df.withColumn("props", flat_props(F.col("props"))).drop("seq")


@register("graph_nodes", "E6", with_ctes(SQL_NODES, select="SELECT label, key, props FROM nodes"))
def graph_nodes(spark, folder):
    return shown_props(kg.merge_nodes(raw_graph(spark, folder)[0]))


@register("graph_edges", "E6", with_ctes(SQL_EDGES, select="SELECT * FROM edges"))
def graph_edges(spark, folder):
    return shown_props(kg.merge_edges(raw_graph(spark, folder)[1]))


@register("node_upsert", "E1", with_ctes(SQL_NODES, select="""
SELECT 'Customer' AS label, c_custkey::VARCHAR AS key,
  'name=' || c_name || ';nation=' || c_nationkey || ';segment=' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'CHANGED' END || ';tier=gold' AS props FROM customer
UNION ALL SELECT label, key, props FROM nodes WHERE label <> 'Customer'
UNION ALL SELECT 'Claim', 'new', 'text=new'"""))
def node_upsert(spark, folder):
    nodes, _ = raw_graph(spark, folder)
    tables = {**tables_of(spark, folder), "one": spark.range(1)}
    changed = [
        kg.NodeMap("customer", "Customer", "c_custkey", {"segment": "CASE WHEN c_custkey % 2 = 1 THEN 'CHANGED' END", "tier": "'gold'"}),
        kg.NodeMap("one", "Claim", "'new'", {"text": "'new'"}),
    ]
    updates, _ = kg.graph_from_records(tables, changed, EDGES[:1], seq=2)
    return shown_props(kg.merge_nodes(nodes, updates))


@register("edge_upsert", "E2", with_ctes(SQL_EDGES, select="""
SELECT src_label, src_key, rel_type, dst_label, dst_key,
  CASE WHEN src_label = 'Supplier' AND rel_type = 'LOCATED_IN' THEN 'since=2024;source=changed' WHEN src_label = 'Order' THEN 'kind=web;' || props ELSE props END AS props
FROM edges"""))
def edge_upsert(spark, folder):
    _, edges = raw_graph(spark, folder)
    changed = [
        kg.EdgeMap("supplier", "Supplier", "s_suppkey", "LOCATED_IN", "Nation", "s_nationkey", {"source": "'changed'", "since": "'2024'"}),
        kg.EdgeMap("orders", "Order", "o_orderkey", "PLACED_BY", "Customer", "o_custkey", {"kind": "'web'"}),
    ]
    _, updates = kg.graph_from_records(tables_of(spark, folder), NODES[:1], changed, seq=2)
    return shown_props(kg.merge_edges(edges, updates))


@register("dangling_edges", "E3", with_ctes(SQL_NODES, SQL_EDGES, "kept AS (SELECT label, key FROM nodes WHERE props NOT LIKE '%BUILDING%')", select="""
SELECT src_label, src_key, rel_type, dst_label, dst_key, 'src' AS side FROM edges e WHERE NOT EXISTS (SELECT 1 FROM kept WHERE label = src_label AND key = src_key)
UNION ALL SELECT src_label, src_key, rel_type, dst_label, dst_key, 'dst' FROM edges e WHERE NOT EXISTS (SELECT 1 FROM kept WHERE label = dst_label AND key = dst_key)"""))
def dangling_edges(spark, folder):
    nodes, edges = raw_graph(spark, folder)
    kept = nodes.where("NOT coalesce(props['segment'], '') LIKE '%BUILDING%'")
    return kg.dangling_edges(kept, kg.merge_edges(edges))


@register("key_violations", "E4", """
SELECT label, key_property, value, count(*) AS n, CASE WHEN value IS NULL THEN 'null' ELSE 'duplicate' END AS violation FROM (
  SELECT 'Gene' AS label, 'hgnc_symbol' AS key_property, c_mktsegment AS value FROM customer
  UNION ALL SELECT 'Paper', 'pmid', o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT 'Drug', 'name', l_partkey::VARCHAR FROM lineitem
  UNION ALL SELECT 'Disease', 'name', CASE WHEN n_regionkey > 0 THEN n_name END FROM nation)
GROUP BY 1, 2, 3 HAVING value IS NULL OR count(*) > 1""")
def key_violations(spark, folder):
    raw = [
        kg.NodeMap("customer", "Gene", "'-'", {"hgnc_symbol": "c_mktsegment"}),
        kg.NodeMap("orders", "Paper", "'-'", {"pmid": "o_orderkey"}),
        kg.NodeMap("lineitem", "Drug", "'-'", {"name": "l_partkey"}),
        kg.NodeMap("nation", "Disease", "'-'", {"name": "CASE WHEN n_regionkey > 0 THEN n_name END"}),
    ]
    nodes, _ = kg.graph_from_records(tables_of(spark, folder), raw, EDGES[:1])
    return kg.constraint_violations(nodes)


@register("predicate_check", "E5", with_ctes(RAW, select="""
SELECT predicate, count(*) AS n, CASE WHEN predicate <> 'dances_with' THEN upper(predicate) END AS rel_type, predicate <> 'dances_with' AS known FROM raw GROUP BY 1"""))
def predicate_check(spark, folder):
    return kg.check_predicates(raw_triples(spark, folder))


ANNOTATIONS = [(f"Group {n}", {"name": f"Group {n}", "category": "annotation"}) for n in range(5)]


@register("node_annotation", "E7", with_ctes(SQL_NODES, """chosen AS (
  SELECT key, row_number() OVER (ORDER BY key) AS n FROM nodes WHERE label = 'Part')""", select="""
SELECT label, key, CASE WHEN n IS NULL THEN props ELSE 'annotation=ANNOTATION-' || format('{:04d}', n) || ';annotation_target=Group ' || n % 5 || ';' || props END AS props
FROM nodes LEFT JOIN chosen USING (key) WHERE label = 'Part'
UNION ALL SELECT label, key, props FROM nodes WHERE label <> 'Part'
UNION ALL SELECT 'Pathway', 'Group ' || i, 'category=annotation;name=Group ' || i FROM range(5) r(i)
UNION ALL SELECT 'edge', key, 'Group ' || n % 5 || ';annotation=ANNOTATION-' || format('{:04d}', n) FROM chosen"""))
def node_annotation(spark, folder):
    nodes, edges = raw_graph(spark, folder)
    nodes, edges = kg.annotate_nodes(nodes, edges, "Part", ANNOTATIONS, "Pathway", "PARTICIPATES_IN", "annotation")
    links = edges.where("rel_type = 'PARTICIPATES_IN'").select(
        F.lit("edge").alias("label"), F.col("src_key").alias("key"), F.concat_ws(";", "dst_key", flat_props(F.col("props"))).alias("props")
    )
    return shown_props(nodes).unionByName(links)


LOADERS = [
    ("places", [NODES[1], NODES[2]], [EDGES[2]]),
    ("parties", [NODES[0], NODES[3], NODES[7]], [EDGES[0], EDGES[1], EDGES[6]]),
    ("trade", [NODES[4], NODES[5], NODES[6]], [EDGES[3], EDGES[4], EDGES[5]]),
]


@register("load_summary", "E8", with_ctes(SQL_NODES, SQL_EDGES, select="""
SELECT 'places' AS loader, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes_loaded, (SELECT count(*) FROM nation) AS edges_loaded
UNION ALL SELECT 'parties', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING'),
  (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING')
UNION ALL SELECT 'trade', (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT sum(len(string_split(p_type, ' ')))::BIGINT FROM part),
  (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT sum(len(string_split(p_type, ' ')))::BIGINT FROM part)
UNION ALL SELECT 'merged', (SELECT count(*) FROM nodes), (SELECT count(*) FROM edges)"""))
def load_summary(spark, folder):
    nodes, edges, summary = kg.load_all(tables_of(spark, folder), LOADERS)
    merged = nodes.agg(F.count("*").alias("nodes_loaded")).select(
        F.lit("merged").alias("loader"), "nodes_loaded", edges.agg(F.count("*").alias("n")).scalar().alias("edges_loaded")
    )
    return summary.unionByName(merged)


@register("kg_stats", "E9", with_ctes(SQL_NODES, SQL_EDGES, select="""
SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label
UNION ALL SELECT 'type', rel_type, count(*) FROM edges GROUP BY rel_type
UNION ALL SELECT 'with_properties', 'Part: brand, size', count(*) FROM nodes WHERE label = 'Part'
UNION ALL SELECT 'with_properties', 'Order: brand', 0"""))
def kg_stats(spark, folder):
    nodes, edges = raw_graph(spark, folder)
    return kg.kg_stats(kg.merge_nodes(nodes), kg.merge_edges(edges), {"Part": ["brand", "size"], "Order": ["brand"]})


@register("node_lookup", "E10", """
SELECT n_nationkey::BIGINT AS request_id, 'Customer' AS label, c_custkey::VARCHAR AS key FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'
UNION ALL SELECT 1000 + n_nationkey, 'Nation', n_nationkey::VARCHAR FROM nation""")
def node_lookup(spark, folder):
    nodes, _ = raw_graph(spark, folder)
    nations = table(spark, folder, "nation")
    requests = nations.selectExpr(
        "CAST(n_nationkey AS BIGINT) AS request_id", "'Customer' AS label", "map('nation', CAST(n_nationkey AS STRING), 'segment', 'BUILDING') AS wanted"
    ).unionByName(nations.selectExpr("CAST(1000 + n_nationkey AS BIGINT) AS request_id", "'Nation' AS label", "map('name', n_name) AS wanted"))
    return kg.find_nodes(nodes, requests).select("request_id", "label", "key")


@register("edge_lookup", "E10", """
SELECT o_orderkey AS request_id, o_orderkey % 1500 = o_custkey AS found, CASE WHEN o_orderkey % 1500 = o_custkey THEN 'status=' || o_orderstatus END AS props FROM orders""")
def edge_lookup(spark, folder):
    _, edges = raw_graph(spark, folder)
    requests = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS request_id", "'Order' AS src_label", "CAST(o_orderkey AS STRING) AS src_key", "'PLACED_BY' AS rel_type",
        "'Customer' AS dst_label", "CAST(o_orderkey % 1500 AS STRING) AS dst_key",
    )
    out = kg.find_edges(edges, requests)
    return out.select("request_id", "found", F.when(F.col("props").isNotNull(), flat_props(F.col("props"))).alias("props"))


@register("localized_counts", "E11", """
SELECT c_nationkey::VARCHAR AS place, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def localized_counts(spark, folder):
    _, edges = raw_graph(spark, folder)
    return kg.localized_counts(edges, ("Order", "PLACED_BY", "Customer"), ("Customer", "LOCATED_IN", "Nation"))


@register("three_hop_paths", "E12", """
SELECT o_orderkey::VARCHAR AS n0, c_custkey::VARCHAR AS n1, n_nationkey::VARCHAR AS n2, n_regionkey::VARCHAR AS n3
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def three_hop_paths(spark, folder):
    _, edges = raw_graph(spark, folder)
    return kg.path_match(edges, ["Order", "PLACED_BY", "Customer", "LOCATED_IN", "Nation", "PART_OF", "Region"])


@register("three_hop_to_region", "E12", """
SELECT o_orderkey::VARCHAR AS n0, c_custkey::VARCHAR AS n1, n_nationkey::VARCHAR AS n2, n_regionkey::VARCHAR AS n3
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2""")
def three_hop_to_region(spark, folder):
    _, edges = raw_graph(spark, folder)
    return kg.path_match(edges, ["Order", "PLACED_BY", "Customer", "LOCATED_IN", "Nation", "PART_OF", "Region"], {3: "2"})


@register("one_hop_targets", "E13", with_ctes(SQL_NODES, SQL_EDGES, select="""
SELECT s.label AS src_label, e.src_key, s.name AS src_name, rel_type, t.label AS dst_label, e.dst_key, t.name AS dst_name
FROM edges e JOIN nodes s ON s.label = src_label AND s.key = src_key JOIN nodes t ON t.label = dst_label AND t.key = dst_key WHERE rel_type = 'SUPPLIES'"""))
def one_hop_targets(spark, folder):
    nodes, edges = raw_graph(spark, folder)
    return kg.one_hop(kg.merge_nodes(nodes), kg.merge_edges(edges), "SUPPLIES")


@register("contradicting_pairs", "E13", with_ctes(*CHAIN, CLASH, "pairs AS (SELECT DISTINCT new_name, old_name FROM clash WHERE starts_with(new_name, 'S1') AND starts_with(old_name, 'S1'))", select="""
SELECT new_name AS a, old_name AS b FROM pairs UNION ALL SELECT old_name, new_name FROM pairs"""))
def contradicting_pairs(spark, folder):
    _, edges = tp.contradiction_records(decided_triples(spark, folder, stored=True))
    return kg.pairs_with_prefix(edges, "CONTRADICTS", "Hypothesis", "S1")


@register("members_per_group", "E13", 'SELECT c_nationkey::VARCHAR AS "group", count(*) AS members FROM customer GROUP BY 1')
def members_per_group(spark, folder):
    return kg.members_per_group(raw_graph(spark, folder)[1], "LOCATED_IN", "Customer", "Nation")


@register("first_members", "E13", """
SELECT "group", member, rank FROM (
  SELECT c_nationkey::VARCHAR AS "group", c_custkey::VARCHAR AS member, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey::VARCHAR) AS rank FROM customer) WHERE rank <= 15""")
def first_members(spark, folder):
    out = kg.first_members(raw_graph(spark, folder)[1], "LOCATED_IN", "Customer", "Nation")
    return out.withColumn("rank", F.col("rank").cast("long"))


LEVEL_CASE = "CASE label WHEN 'Region' THEN 1 WHEN 'Nation' THEN 2 WHEN 'Customer' THEN 3 WHEN 'Supplier' THEN 4 WHEN 'Part' THEN 5 WHEN 'Order' THEN 11 ELSE 10 END"
CATEGORY_CASE = "CASE WHEN label IN ('Region', 'Nation') THEN 'place' WHEN label IN ('Customer', 'Supplier') THEN 'party' ELSE 'trade' END"
EXPLORER = f"""enodes AS (
  SELECT lower(label) || '-' || key AS id, name, label AS type, {LEVEL_CASE} AS level, {CATEGORY_CASE} AS category FROM nodes),
links AS (SELECT lower(src_label) || '-' || src_key AS source, lower(dst_label) || '-' || dst_key AS target, lower(rel_type) AS predicate FROM edges)"""


def explorer(spark, folder):
    nodes, edges = raw_graph(spark, folder)
    # Of the graph, what the explorer shows is stored once and explored many times.
    shown_nodes = materialize(kg.merged_property(nodes, kg.NODE_KEY, "name"), "nodes").selectExpr(
        "lower(label) || '-' || key AS id", "name", "label AS type", f"{LEVEL_CASE} AS level", f"{CATEGORY_CASE} AS category"
    )
    links = materialize(edges.select(*kg.EDGE_KEY).distinct(), "edges").selectExpr(
        "lower(src_label) || '-' || src_key AS source", "lower(dst_label) || '-' || dst_key AS target", "lower(rel_type) AS predicate"
    )
    return shown_nodes, links


LEVEL_CTE = """picked AS (SELECT id FROM enodes WHERE level = 3),
around AS (SELECT id FROM picked UNION SELECT target FROM links WHERE source IN (SELECT id FROM picked) UNION SELECT source FROM links WHERE target IN (SELECT id FROM picked))"""
LEVEL_NAMES = "levels AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, '{name}', '{focus}')" for n, name, focus in kg.LEVELS) + ") v(level, level_name, focus))"


@register("level_nodes", "E14", with_ctes(SQL_NODES, SQL_EDGES, EXPLORER, LEVEL_CTE, LEVEL_NAMES, select="""
SELECT id, name, type, e.level::BIGINT AS level, category, coalesce(level_name, 'Unknown') AS level_name, coalesce(focus, '') AS focus
FROM enodes e LEFT JOIN levels l ON l.level = e.level WHERE id IN (SELECT id FROM around)"""))
def level_nodes(spark, folder):
    nodes, _ = kg.level_subgraph(*explorer(spark, folder), 3)
    return nodes.withColumn("level", F.col("level").cast("long"))


@register("level_links", "E14", with_ctes(SQL_NODES, SQL_EDGES, EXPLORER, """marked AS (
  SELECT l.*, coalesce(a.level = 3, false) AS from_level, coalesce(b.level = 3, false) AS to_level FROM links l LEFT JOIN enodes a ON a.id = source LEFT JOIN enodes b ON b.id = target),
around AS (SELECT id FROM enodes WHERE level = 3 UNION SELECT target FROM marked WHERE from_level UNION SELECT source FROM marked WHERE to_level)""", select="""
SELECT source, target, predicate FROM marked JOIN around a ON a.id = source JOIN around b ON b.id = target""").replace("WITH RECURSIVE", "WITH"))
def level_links(spark, folder):
    return kg.level_subgraph(*explorer(spark, folder), 3)[1]


@register("category_links", "E15", with_ctes(SQL_NODES, SQL_EDGES, EXPLORER, select="""
SELECT source, target, predicate FROM links WHERE source IN (SELECT id FROM enodes WHERE category = 'trade') AND target IN (SELECT id FROM enodes WHERE category = 'trade')"""))
def category_links(spark, folder):
    return kg.category_subgraph(*explorer(spark, folder), "trade")[1]


@register("node_search", "E16", with_ctes(SQL_NODES, SQL_EDGES, EXPLORER, select="""
SELECT term, id, name FROM enodes, (VALUES ('00001'), ('order 12'), ('nation-7')) t(term) WHERE contains(lower(name), term) OR contains(id, term)"""))
def node_search(spark, folder):
    return kg.search_nodes(explorer(spark, folder)[0], [" 00001", "Order 12", "nation-7", " "])
