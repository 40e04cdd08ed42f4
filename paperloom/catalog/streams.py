"""Registered streaming queries: stored tables arrive as files and are taken once."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from pyspark.sql.types import LongType

from paperloom.catalog.registry import register, table, with_ctes
from paperloom.catalog.structure import CHUNKS, PATH_SQL, PAPER_TEXT_SQL
from paperloom.catalog.literature import request_log
from paperloom.catalog.triples import CLASH, CORPUS_ALIASES, CORPUS_RULES, SENTENCES, flat_props, rule_sql
from paperloom.operators import literature as lit
from paperloom.operators import triples as tp
from paperloom.session import fresh_folder
from paperloom.streaming import papers as sp


# Ingest normalises line by line first, so the twin does as well.
NORMALIZED_PAPER = rf"""paper_raw AS (SELECT doc_id, {PAPER_TEXT_SQL} AS text, {PATH_SQL} AS path FROM documents),
paper AS (
  SELECT doc_id, any_value(path) AS path, trim(string_agg(trim(regexp_replace(line, '\s+', ' ', 'g')), chr(10) ORDER BY i), ' ' || chr(10)) AS text
  FROM (SELECT doc_id, path, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, path, string_split(text, chr(10)) AS l FROM paper_raw)) GROUP BY 1)"""


@register("event_intake", "A4", "SELECT event_id, event_type, user_id FROM events")
def event_intake(spark, folder):
    out, checkpoint = fresh_folder(spark, "intake"), fresh_folder(spark, "checkpoint")
    for _ in range(2):  # the second poll finds nothing new
        sp.poll_once(sp.stream_table(spark, folder, "events.parquet"), sp.keyed_writer(out), checkpoint)
    return spark.read.parquet(out).select("event_id", "event_type", "user_id")


@register("streamed_ingest", "A5", with_ctes(NORMALIZED_PAPER, *CHUNKS[1:], select="SELECT doc_id, chunk_id, chunk_type, char_start, char_end FROM chunks"))
def streamed_ingest(spark, folder):
    out, checkpoint = fresh_folder(spark, "ingest"), fresh_folder(spark, "checkpoint")
    papers = sp.stream_table(spark, folder, "documents.parquet").selectExpr("doc_id", f"{PAPER_TEXT_SQL} AS text", f"{PATH_SQL} AS path")
    sp.poll_once(papers, sp.ingest_writer(out, CORPUS_RULES, CORPUS_ALIASES, buckets=8), checkpoint)
    chunks = sp.ingested(spark, out, "chunks")
    return chunks.select("doc_id", "chunk_id", "chunk_type", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


# The whole table taken at once, in the order of documents, sentences and rules: what the files must give one after the other.
GRAPH_CHAIN = (
    """normal AS (
  SELECT doc_id, trim(string_agg(trim(regexp_replace(line, '\\s+', ' ', 'g')), chr(10) ORDER BY i), ' ' || chr(10)) AS text
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) GROUP BY 1)""",
    SENTENCES.replace("FROM documents", "FROM normal"),
    rule_sql(),
    """firsts AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper, subject, predicate, object, confidence, evidence, row_number() OVER (ORDER BY doc_id, sentence, rule) AS seq FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, subject, predicate, object ORDER BY sentence, rule) AS n FROM hits) WHERE n = 1)""",
    """won AS (SELECT *, first(predicate) OVER (PARTITION BY subject, object, CASE predicate WHEN 'inhibits' THEN 'activates' ELSE predicate END ORDER BY seq) AS winner FROM firsts),
decided AS (SELECT *, CASE WHEN winner <> predicate THEN 'contradiction' ELSE 'merged' END AS status, CASE WHEN winner <> predicate THEN winner END AS existing_predicate FROM won)""",
    CLASH,
)
LABELS_SQL = " UNION ALL ".join(f"SELECT '{i}' AS id, '{label}' AS label" for i, label in sorted({a.entity_id: a.label for a in reversed(CORPUS_ALIASES)}.items()))
KEYS_SQL = "CASE label WHEN 'Gene' THEN 'hgnc_symbol' WHEN 'Variant' THEN 'hgvs' ELSE 'name' END"


def streamed_graph(spark, folder, files=3):
    """The graph after the documents have arrived in some files, in ranges of their ids, one batch a file."""
    out, landing, checkpoint = (fresh_folder(spark, n) for n in ("ingest", "landing", "checkpoint"))
    docs = table(spark, folder, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("path"))
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, wide = ends.low or 0, (ends.high or 0) - (ends.low or 0) + 1
    number = F.floor((F.col("doc_id") - low) * files / wide).cast(LongType())
    sink = sp.ingest_writer(out, CORPUS_RULES, CORPUS_ALIASES, chunks=False, buckets=8)
    # A range of ids may lie in a few of the stored files, so its texts are dealt over all cores.
    parts = min(4 * spark.sparkContext.defaultParallelism, 1000)
    for n in range(files):
        docs.where(number == n).repartition(parts, "doc_id").write.mode("append").parquet(landing)
        sp.poll_once(sp.stream_table(spark, landing, "*.parquet"), sink, checkpoint)
    return sp.ingest_graph(spark, out, buckets=8)


@register("streamed_graph_edges", "A5", with_ctes(*GRAPH_CHAIN, select="""
SELECT subject, predicate, object, upper(predicate) AS rel_type, count(DISTINCT paper) AS evidence_count, max(confidence) AS confidence, md5(arg_max(evidence, seq)) AS evidence_md5,
  arg_min(paper, seq) AS first_paper, arg_max(paper, seq) AS last_paper FROM decided WHERE status = 'merged' GROUP BY 1, 2, 3"""))
def streamed_graph_edges(spark, folder):
    edges = streamed_graph(spark, folder).read("edges")
    return edges.select(
        "subject", "predicate", "object", "rel_type", "evidence_count", "confidence", F.md5("evidence").alias("evidence_md5"), "first_paper", "last_paper"
    )


@register("streamed_graph_nodes", "A5", with_ctes(*GRAPH_CHAIN, select=f"""
SELECT 'Paper' AS label, CAST(doc_id AS VARCHAR) AS key, md5('doi=;pmid=' || doc_id || ';title=') AS props_md5 FROM documents
UNION ALL SELECT label, id, md5({KEYS_SQL} || '=' || id) FROM (SELECT DISTINCT unnest([subject, object]) AS id FROM decided) JOIN ({LABELS_SQL}) USING (id)
UNION ALL SELECT 'Hypothesis', new_name, md5('description=' || arg_max(evidence, seq) || ';name=' || new_name || ';status=disputed') FROM clash GROUP BY new_name
UNION ALL SELECT 'Hypothesis', old_name, md5('description=' || arg_max(d.evidence, d.seq) || ';name=' || old_name || ';status=disputed')
FROM (SELECT old_name, subject, object, existing_predicate, max(seq) AS until FROM clash GROUP BY ALL) c
JOIN decided d ON d.status = 'merged' AND d.subject = c.subject AND d.object = c.object AND d.predicate = c.existing_predicate AND d.seq < c.until GROUP BY old_name
UNION ALL SELECT 'Contradiction', id, md5('evidence=' || evidence || ';existing_predicate=' || existing_predicate || ';id=' || id || ';new_predicate=' || predicate
  || ';object_id=' || object || ';paper_doi=' || arg_max(paper, seq) || ';subject_id=' || subject)
FROM (SELECT *, substr(sha1(new_name || '|' || old_name || '|' || evidence), 1, 16) AS id FROM clash) GROUP BY id, evidence, existing_predicate, predicate, object, subject"""))
def streamed_graph_nodes(spark, folder):
    return streamed_graph(spark, folder).read("nodes").select("label", "key", F.md5(flat_props(F.col("props"))).alias("props_md5"))


@register("streamed_graph_links", "A5", with_ctes(*GRAPH_CHAIN, select=f"""
SELECT new_name AS src_key, 'CONTRADICTS' AS rel_type, old_name AS dst_key, md5('reason={tp.OPPOSING}') AS props_md5 FROM (SELECT DISTINCT new_name, old_name FROM clash)
UNION ALL SELECT old_name, 'CONTRADICTS', new_name, md5('reason={tp.OPPOSING}') FROM (SELECT DISTINCT new_name, old_name FROM clash)
UNION ALL SELECT new_name, 'SUPPORTS', paper, md5('evidence=' || arg_max(evidence, seq)) FROM clash GROUP BY new_name, paper"""))
def streamed_graph_links(spark, folder):
    return streamed_graph(spark, folder).read("links").select("src_key", "rel_type", "dst_key", F.md5(flat_props(F.col("props"))).alias("props_md5"))


REQUESTS_SQL = """
WITH RECURSIVE log AS (
  SELECT 'pubmed:' || event_type || '?[["user","' || user_id || '"]]' AS request_key, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2),
passed AS (
  SELECT request_key, min(ts) AS ts FROM log GROUP BY 1
  UNION ALL SELECT p.request_key, min(l.ts) FROM passed p JOIN log l ON l.request_key = p.request_key AND l.ts > p.ts + INTERVAL 7 DAY GROUP BY p.request_key, p.ts)
SELECT request_key, event_id FROM passed JOIN log USING (request_key, ts)"""


def keyed_requests(spark, folder):
    """The event log as a stream of requests."""
    events = sp.stream_table(spark, folder, "events.parquet")
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    return events.select(
        lit.request_key(F.lit("pubmed"), F.col("event_type"), params).alias("request_key"), F.col("ts").cast("timestamp").alias("fetched_at"), "event_id"
    )


@register("streamed_requests", "D14", REQUESTS_SQL)
def streamed_requests(spark, folder):
    out, checkpoint = fresh_folder(spark, "requests"), fresh_folder(spark, "checkpoint")
    passed = sp.dedupe_stream(keyed_requests(spark, folder), ["request_key"], "fetched_at", timedelta(days=7), "event_id")
    sp.poll_once(passed, sp.keyed_writer(out), checkpoint)
    return spark.read.parquet(out).select("request_key", "event_id")


@register("spread_requests", "D14", REQUESTS_SQL)
def spread_requests(spark, folder):
    """The same rows by rounds of least times, which no hot key holds up."""
    out, checkpoint = fresh_folder(spark, "requests"), fresh_folder(spark, "checkpoint")
    sp.poll_once(keyed_requests(spark, folder), sp.lifetime_writer(out, ["request_key"], "fetched_at", timedelta(days=7), "event_id", buckets=8), checkpoint)
    return sp.passed(spark, out, buckets=8).select("request_key", "event_id")
