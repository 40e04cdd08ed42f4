"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def boxed(df: DataFrame, **inputs) -> DataFrame:
    """All columns of a row in one struct ``row`` beside the named inputs, so no column name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in inputs.items()])


def unboxed(df: DataFrame, columns: list[str], **outputs) -> DataFrame:
    """The row's own columns again, plus outputs; an output replaces a column of the same name."""
    replaced = {name.lower() for name in outputs}
    own = [F.col(f"row.`{c}`").alias(c) for c in columns if c.lower() not in replaced]
    given = {c.lower(): c for c in columns}
    return df.select(*own, *[c.alias(given.get(n.lower(), n)) for n, c in outputs.items()]).select(
        *[f"`{c}`" for c in columns], *[f"`{n}`" for n in outputs if n.lower() not in given]
    )


def worker_state(key: str, make):
    """An object that a Python worker makes once and keeps for its later tasks, until another operator's replaces it."""
    kept = sys.modules.setdefault("paperloom_worker_state", types.ModuleType("paperloom_worker_state")).__dict__.setdefault("kept", {})
    if key not in kept:
        if kept:
            kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:  # hand freed memory back, as the worker lives on
                trim(0)
        kept[key] = make()
    return kept[key]


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as bucket 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Send texts to Python in batches of fewer rows for what is stored inside the block; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
