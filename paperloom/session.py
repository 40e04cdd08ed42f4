"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on one machine a temporary one where none is set, else an error."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(_CHECKPOINT_KEY, folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder path of the shared folder; never reused between runs."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df, name: str):
    """Cut lineage through a table in the shared folder, so lost executors cost no recompute.

    The table is written here and now: what calls this runs a job while its result is being
    built. Tables stay until ``clear_shared`` or the folder's owner removes them.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Remove everything in the shared folder; for the end of a run that has it to itself."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
