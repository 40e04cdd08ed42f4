"""Hybrid retrieval: three rankings, rank fusion, lexical rerank — one plan per question table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import retrieval as rt

BIOMEDICAL = "pubmedbert"
GENERAL = "nomic"
# Hash salts of the two vector spaces.
SALTS = {BIOMEDICAL: "bio", GENERAL: "general"}


def three_lists(queries: DataFrame, docs: DataFrame, pool: int = rt.CANDIDATES) -> DataFrame:
    """BM25 and both hashed rankings as one table for fusion."""
    sparse = rt.sparse_lists(queries, docs, SALTS, pool)
    position = F.when(F.col("vector") == BIOMEDICAL, 1).otherwise(2)
    return rt.stack_lists({"bm25": rt.bm25_search(queries, docs, pool)}).unionByName(
        sparse.select(
            "query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score",
            F.col("vector").alias("source"), position.alias("position"),
        )
    )


def fuse_lists(stacked: DataFrame, docs: DataFrame, rrf_k: int | None = None) -> DataFrame:
    """Fusion with an explicit constant, or one that follows the corpus size."""
    if rrf_k is not None:
        return rt.fuse(stacked, rrf_k)
    size = docs.agg(F.count("*").alias("n"))
    constant = size.select(
        F.when(F.col("n") < rt.SMALL_CORPUS, rt.RRF_K_SMALL).otherwise(rt.RRF_K)
    ).scalar()
    return rt.fuse(stacked, constant)


def hybrid_retrieve(
    queries: DataFrame, docs: DataFrame, top_k: int = rt.ANSWERS, rrf_k: int | None = None
) -> DataFrame:
    """``docs(doc_id, text)`` and ``queries(query_id, query_text)`` to the best documents."""
    fused = fuse_lists(three_lists(queries, docs), docs, rrf_k)
    pool = fused.where(F.col("rank") <= rt.FUSED).select(
        "query_id", "doc_id", "rank", F.col("score").alias("fused_score"), "source_scores"
    )
    return rt.lexical_rerank(pool, queries, docs, top_k)
