"""Deterministic ranking: compare scores on nine decimals, then break ties by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import materialize

SCORE_DECIMALS = 9
SHOWN_DECIMALS = 6


def ranked(
    df: DataFrame,
    within: list[str],
    score: str,
    ties: list,
    k: int | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Number rows by falling score inside each group and keep the best k.

    The ``rank <= k`` filter sits right on the window, so Spark keeps only k rows
    per group and task before the shuffle, also for one very large group.
    """
    order = [F.round(F.col(score), SCORE_DECIMALS).desc()]
    order += [t if isinstance(t, Column) else F.col(t).asc() for t in ties]
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    return out if k is None else out.where(F.col(rank) <= k)


def numbered(df: DataFrame, key: str, number: str) -> DataFrame:
    """Number all rows from 1 in the order of a unique key.

    Rows are dealt to ranges of the key and stored; each range numbers its own and begins
    after the ranges before it, so only one count a range meets in one place.
    """
    ranges = materialize(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranges.withColumn(number, own).join(starts, "_range").withColumn(number, F.col(number) + F.col("_start")).drop("_range", "_start")


def shown(column: str | Column) -> Column:
    """A score rounded for output."""
    return F.round(F.col(column) if isinstance(column, str) else column, SHOWN_DECIMALS)
