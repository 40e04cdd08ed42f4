"""Monitoring aggregates: stage latency, headline counts and the paper library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import materialize

# Stage budgets in milliseconds (targets, not measurements).
BUDGETS_MS = {
    "query": 120_000.0,
    "ingest": 30_000.0,
    "graph_query": 1_000.0,
    "retrieval": 2_000.0,
    "fan_out": 5_000.0,
}


def exact_quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], buckets: int = 4096) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of ``shares``; null and NaN values are left out.

    A quantile lies between the values of two ranks. Each rank is looked for in a range of
    values, at first that of its group: the range is cut into ``buckets`` equal parts, whose
    counts tell in which one the rank lies, and the least and greatest value there are its next range,
    until they are equal. So every round is one sum by (group, range, bucket) with partial results,
    nothing is sorted, and neither a group with most rows nor values over many orders of magnitude
    pile up anywhere. A round narrows a range at least ``buckets`` times or to half of its
    distinct values' span.
    """
    values = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    groups = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    target = (F.col("n") - 1) * F.col("share")
    ends = F.array(F.struct(F.lit("lower").alias("end"), F.floor(target).alias("rank")), F.struct(F.lit("upper").alias("end"), F.ceil(target).alias("rank")))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in shares.items()])
    asked = groups.select("g", "n", "low", "high", F.inline(wanted)).select("g", "name", "low", "high", (target - F.floor(target)).alias("part"), F.inline(ends))
    asked = materialize(asked, "ranks")
    place = ["g", "low", "high"]
    while asked.where("low < high").limit(1).count():
        open_ = asked.where("low < high")
        ranges = open_.select(*place).distinct()
        # Halves before the difference, so that the widest ranges don't overflow.
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        within = values.join(ranges, values["g"].eqNullSafe(ranges["g"])).where("v BETWEEN low AND high").select(ranges["g"], "low", "high", "v")
        counted = within.groupBy(*place, F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("b")).agg(
            F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most")
        )
        before = Window.partitionBy(*place).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))).alias("p")
        met = open_.alias("o").join(
            placed, F.col("o.g").eqNullSafe(F.col("p.g")) & (F.col("o.low") == F.col("p.low")) & (F.col("o.high") == F.col("p.high"))
        ).where("rank >= first AND rank < first + c")
        narrowed = met.select("o.g", "name", F.col("least").alias("low"), F.col("most").alias("high"), "part", "end", (F.col("rank") - F.col("first")).alias("rank"))
        asked = materialize(asked.where("low >= high").unionByName(narrowed), "ranks")
    found = asked.groupBy("g", "name").agg(
        F.max(F.when(F.col("end") == "lower", F.col("low"))).alias("lower"), F.max(F.when(F.col("end") == "upper", F.col("low"))).alias("upper"),
        F.max("part").alias("part"),
    )
    at = F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("part")
    return found.groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("name") == name, at)).alias(name) for name in shares])


def stage_latency(trace: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """Latency per stage of ``trace(stage, ms)`` with share of the total and the budget verdict."""
    stages = trace.groupBy("stage").agg(
        F.count("*").alias("n"),
        F.sum("ms").alias("total_ms"),
        F.avg("ms").alias("mean_ms"),
    ).join(exact_quantiles(trace, "stage", "ms", {"p50_ms": 0.5, "p95_ms": 0.95}), "stage")
    total = trace.agg(F.sum("ms").alias("t")).scalar()
    out = stages.withColumn("share", F.when(total > 0, F.col("total_ms") / total).otherwise(0.0))
    if budgets is None:
        return out
    return out.join(budgets, "stage", "left").withColumn("within_budget", F.col("p95_ms") <= F.col("budget_ms"))


def run_latency(trace: DataFrame) -> DataFrame:
    """Total latency and number of stages per run of ``trace(run_id, stage, ms)``."""
    return trace.groupBy("run_id").agg(F.count("*").alias("stages"), F.sum("ms").alias("total_ms"))


def headline_stats(nodes: DataFrame, edges: DataFrame, triples: DataFrame) -> DataFrame:
    """True counts of nodes, edges, papers and triples in one row."""
    counts = nodes.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("label") == "Paper").alias("papers")
    )
    return counts.select(
        "nodes",
        edges.agg(F.count("*").alias("n")).scalar().alias("edges"),
        "papers",
        triples.agg(F.count("*").alias("n")).scalar().alias("triples"),
    )


def search_library(papers: DataFrame, term: str) -> DataFrame:
    """Papers whose title or id contains the term in any case; a blank term keeps all."""
    wanted = term.strip().lower()
    if not wanted:
        return papers
    return papers.where(F.contains(F.lower("title"), F.lit(wanted)) | F.contains(F.lower("id"), F.lit(wanted)))


def library_records(papers: DataFrame, chunk_counts: DataFrame, kg_summary: DataFrame) -> DataFrame:
    """One library record per paper.

    A paper without chunks is ``processing``; one with rejected or contradicting
    triples only is ``needs-review``; all others are ``indexed``.
    """
    rows = (
        papers.join(chunk_counts.select("id", "chunks"), "id", "left")
        .join(kg_summary.select("id", "entities", "triples_merged", "triples"), "id", "left")
        .fillna(0, ["chunks", "entities", "triples_merged", "triples"])
    )
    status = (
        F.when(F.col("chunks") == 0, "processing")
        .when((F.col("triples") > 0) & (F.col("triples_merged") == 0), "needs-review")
        .otherwise("indexed")
    )
    return rows.select("id", "title", status.alias("status"), "chunks", "entities", F.col("triples_merged").alias("triples"))
