"""A corpus pipeline: each stage reads the table that the stage before it has stored, the last one packs token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.decontaminate import decontaminate
from paperloom.llm.jaccard_join import one_of_each_group
from paperloom.llm.line_dedup import drop_shared_lines
from paperloom.llm.packing import pack_documents
from paperloom.llm.toxicity import fit_toxicity, score_toxicity
from paperloom.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labelled ones among them, doesn't call toxic."""
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), held_out=5)
    return score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten of them or more share; ``n_chars`` follows the text."""
    kept = drop_shared_lines(docs, min_documents=10)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones."""
    return one_of_each_group(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"), width=10, remove="documents").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that stayed, with their ids, in sequences of at most 1024 tokens.

    Workers that have gone through the other stages keep fewer pieces of the tokenizer.
    """
    return pack_documents(docs, "byte_bpe_50k.json", end_id=2, capacity=1024, ids=True, pieces_kept=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


# SQL can express neither the first stage nor the last; tests compare the rest with a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
