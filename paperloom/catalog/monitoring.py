"""Registered monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.graph import SQL_EDGES, SQL_NODES, raw_graph
from paperloom.catalog.registry import register, table, with_ctes
from paperloom.catalog.structure import CHUNKS, paper_texts
from paperloom.catalog.triples import CHAIN, NEW, SUMMARY, decided_triples, entity_counts, raw_triples
from paperloom.functions.ranking import shown
from paperloom.operators import graph as kg
from paperloom.operators import monitoring as mon
from paperloom.operators import structure as st
from paperloom.operators import triples as tp

STAGE_BUDGETS = (("click", 60.0), ("error", 40.0), ("purchase", 20.0), ("view", 100.0))


@register("stage_latency", "G1", """
WITH s AS (
  SELECT event_type AS stage, count(*) AS n, sum(value) AS total_ms, avg(value) AS mean_ms, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms FROM events GROUP BY 1)
SELECT stage, n, round(total_ms, 4) AS total_ms, round(mean_ms, 6) AS mean_ms, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms,
  round(total_ms / (SELECT sum(value) FROM events), 6) AS share, budget_ms, p95_ms <= budget_ms AS within_budget
FROM s LEFT JOIN (SELECT stage, b::DOUBLE AS budget_ms FROM (VALUES """ + ", ".join(f"('{s}', {b})" for s, b in STAGE_BUDGETS) + ") v(stage, b)) USING (stage)")
def stage_latency(spark, folder):
    trace = table(spark, folder, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    budgets = spark.createDataFrame(STAGE_BUDGETS, "stage string, budget_ms double")
    out = mon.stage_latency(trace, budgets)
    return out.withColumns(
        {"total_ms": F.round("total_ms", 4), **{c: shown(c) for c in ("mean_ms", "p50_ms", "p95_ms", "share")}}
    )


@register("run_latency", "G1", "SELECT user_id AS run_id, count(*) AS stages, round(sum(value), 4) AS total_ms FROM events GROUP BY 1")
def run_latency(spark, folder):
    trace = table(spark, folder, "events").select(F.col("user_id").alias("run_id"), F.col("value").alias("ms"))
    return mon.run_latency(trace).withColumn("total_ms", F.round("total_ms", 4))


@register("headline_stats", "G2", with_ctes(SQL_NODES, SQL_EDGES, *CHAIN, select="""
SELECT (SELECT count(*) FROM nodes) + count(DISTINCT paper) AS nodes, (SELECT count(*) FROM edges) AS edges, count(DISTINCT paper) AS papers,
  count(*) FILTER (status = 'merged') AS triples FROM decided"""))
def headline_stats(spark, folder):
    nodes, edges = raw_graph(spark, folder)
    papers = raw_triples(spark, folder).select(
        F.lit("Paper").alias("label"), F.col("paper").alias("key"), F.create_map(F.lit("pmid"), F.col("paper")).alias("props"),
        F.lit(1).cast("long").alias("seq"),
    )
    merged = decided_triples(spark, folder).where("status = 'merged'")
    return mon.headline_stats(kg.merge_nodes(nodes, papers), kg.merge_edges(edges), merged)


TITLED = "SELECT doc_id::VARCHAR AS id, 'Study of ' || source || ' number ' || doc_id AS title FROM documents"


def titled(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("Study of "), "source", F.lit(" number "), F.col("doc_id").cast("string")).alias("title"),
    )


@register("library_search", "G3", f"SELECT * FROM ({TITLED}) WHERE contains(lower(title), 'src1') OR contains(lower(id), 'src1')")
def library_search(spark, folder):
    return mon.search_library(titled(spark, folder), " SRC1 ")


@register("library_all", "G3", TITLED)
def library_all(spark, folder):
    return mon.search_library(titled(spark, folder), "  ")


@register("library_records", "G4", with_ctes(*CHUNKS, *CHAIN, NEW, SUMMARY, f"titles AS ({TITLED})", select="""
SELECT id, title, CASE WHEN coalesce(chunks, 0) = 0 THEN 'processing' WHEN coalesce(triples, 0) > 0 AND coalesce(triples_merged, 0) = 0 THEN 'needs-review' ELSE 'indexed' END AS status,
  coalesce(chunks, 0) AS chunks, coalesce(entities, 0) AS entities, coalesce(triples_merged, 0) AS triples
FROM titles LEFT JOIN (SELECT doc_id::VARCHAR AS id, count(*) AS chunks FROM chunks GROUP BY 1) c USING (id)
LEFT JOIN (SELECT paper AS id, entities, triples, triples_merged FROM paper_summary) s USING (id)"""))
def library_records(spark, folder):
    chunks = st.chunk_papers(paper_texts(spark, folder)).groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.count("*").alias("chunks"))
    summary = tp.paper_kg_summary(decided_triples(spark, folder, stored=True), entity_counts(spark, folder)).withColumnRenamed("paper", "id")
    return mon.library_records(titled(spark, folder), chunks, summary)
