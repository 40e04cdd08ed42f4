"""Batches of validated triples merged into a stored graph, one commit each."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import graph as kg
from paperloom.operators import triples as tp
from paperloom.session import materialize
from paperloom.sources.bucket_store import BucketStore, Table

GRAPH_TABLES = {
    # A predicate and its opposite lie in one bucket, as one decides about the other.
    "edges": Table(tp.EDGE_SCHEMA, ("subject", "object")),
    # With the paper, so an edge that most papers support is spread.
    "evidence": Table("subject string, predicate string, object string, paper string, batch long", ("subject", "predicate", "object", "paper")),
    "nodes": Table("label string, key string, props map<string,string>, seq long", tuple(kg.NODE_KEY)),
    "links": Table(
        "src_label string, src_key string, rel_type string, dst_label string, dst_key string, props map<string,string>, seq long", tuple(kg.EDGE_KEY)
    ),
}


def graph_store(spark: SparkSession, folder: str, buckets: int | None = None) -> BucketStore:
    """Edges with provenance, their evidence papers, nodes and contradiction links in a folder.

    ``buckets`` a table (default 64) should follow the graph: a batch rewrites each bucket that it
    touches, and each bucket is a file at least. A store keeps the number it began with.
    """
    return BucketStore(spark, folder, {name: t if buckets is None else t._replace(buckets=buckets) for name, t in GRAPH_TABLES.items()})


def entity_nodes(decided: DataFrame, entities: DataFrame) -> DataFrame:
    """``(label, key, props)`` of the entities of accepted triples, contradicting ones included."""
    sides = decided.where("status <> 'rejected'").select(F.explode(F.array("subject", "object")).alias("normalized_id")).distinct()
    names = F.create_map(*[F.lit(x) for item in kg.KEY_PROPERTIES.items() for x in item])
    own = F.coalesce(F.try_element_at(names, F.col("label")), F.lit("name"))
    return sides.join(entities, "normalized_id").select("label", F.col("normalized_id").alias("key"), F.create_map(own, F.col("normalized_id")).alias("props"))


def paper_nodes(docs: DataFrame) -> DataFrame:
    """Every paper ``(doc_id)`` of a batch, whether or not a triple was found in it, with ``doi`` and ``title`` where given."""
    given = {name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("") for name in ("doi", "title")}
    entries = [F.lit("pmid"), F.col("doc_id").cast("string"), *[x for name, value in given.items() for x in (F.lit(name), value)]]
    return docs.select(F.lit("Paper").alias("label"), F.col("doc_id").cast("string").alias("key"), F.create_map(*entries).alias("props"))


def adopt_edges(store: BucketStore, edges: DataFrame, batch_id: int = 0) -> None:
    """Commit the edges of another loader (``EDGE_SCHEMA`` and ``evidence_papers``) as the first batch of an empty store."""
    # Few edges may stand on many papers each, so they are dealt over the cores before their papers become rows.
    parts = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    kept, papers = tp.adopted_edges(materialize(edges, "loaded").repartition(parts, *tp.EDGE))
    kept = materialize(kept, "adopted")
    store.commit(
        batch_id, replaced={"edges": (kept, store.touched("edges", kept))}, added={"evidence": papers.withColumn("batch", F.lit(batch_id).cast("long"))}
    )


def merge_batch(
    store: BucketStore, checked: DataFrame, batch_id: int, entities: DataFrame, papers: DataFrame | None = None, decisions: str | None = None
) -> None:
    """Decide the validated triples of a batch against the stored edges and commit what they change.

    ``checked`` (read several times, so better stored) comes from ``validate_triples``;
    ``entities(normalized_id, label)`` name the nodes, ``papers`` are paper nodes. Only buckets that the
    batch's keys fall into are read and rewritten. Decided triples are written to ``decisions``,
    where given. A batch that was committed before changes nothing.
    """
    spark = checked.sparkSession
    if batch_id <= store.last_batch():
        return
    buckets = store.touched("edges", checked.where("valid"))
    existing = store.read("edges", buckets)
    decided = tp.decide_triples(checked, existing)
    if decisions is None:
        decided = materialize(decided, "decided")
    else:
        decided.write.mode("overwrite").parquet(decisions)
        decided = spark.read.schema(decided.schema).parquet(decisions)
    decided = decided.withColumn("paper", F.col("paper").cast("string"))
    known = store.read("evidence", store.touched("evidence", decided.where("status = 'merged'")))
    now = F.lit(datetime.now(timezone.utc).isoformat())
    edges, added = tp.merge_stored_provenance(decided, existing, known, now)
    nodes, links = tp.contradiction_records(decided, existing)
    nodes = nodes.unionByName(entity_nodes(decided, entities))
    if papers is not None:
        nodes = nodes.unionByName(papers)
    sequence = F.lit(batch_id).cast("long").alias("seq")
    nodes, links = (materialize(df.select("*", sequence), "updates") for df in (nodes, links))
    at_nodes, at_links = store.touched("nodes", nodes), store.touched("links", links)
    store.commit(
        batch_id,
        replaced={
            "edges": (edges, buckets),
            "nodes": (kg.merge_nodes(store.read("nodes", at_nodes), nodes), at_nodes),
            "links": (kg.merge_edges(store.read("links", at_links), links), at_links),
        },
        added={"evidence": added.withColumn("batch", F.lit(batch_id).cast("long"))},
    )
