"""Streaming intake: new files once each, idempotent batch sinks, repeat removal.

The seen-set is the file source's log in the checkpoint, so a restart goes on where it
stopped and a failed batch is tried again with the same files.
"""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators import structure as st
from paperloom.operators import triples as tp
from paperloom.plans.graph_merge import graph_store, merge_batch, paper_nodes
from paperloom.session import materialize
from paperloom.sources.bucket_store import BucketStore, Table


def stream_papers(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.txt",
    include_existing: bool = False,
    started: datetime | None = None,
    max_files: int = 1000,
) -> DataFrame:
    """Each new file of a folder as ``(path, text, modified)``.

    Without ``include_existing``, files older than ``started`` (default: now) are left out by
    their modification time.
    """
    files = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("value").alias("text"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )
    if include_existing:
        return files
    since = F.lit(started.astimezone() if started else datetime.now().astimezone())
    return files.where(F.col("modified") >= since)


LISTING = "path string, modificationTime timestamp, length long, content binary"
TRIES = "path string, tries int, delivered boolean, round long"


class PaperFolder:
    """Papers of a folder, taken file by file: one that can't be read holds up no other and is tried again.

    New files come from a stream over the folder's listing, whose log is the seen-set. Their
    texts are read by the batch itself; a file without a text is quarantined with the
    number of its tries. Each ``poll`` takes what is new, then tries quarantined files again,
    ``max_tries`` times in all. ``sink(papers, batch_id)`` gets ``(path, text, modified)`` and must be idempotent; rounds of
    retries have batch ids of their own.
    """

    def __init__(self, spark: SparkSession, folder: str, work: str, pattern: str = "*.txt", max_tries: int = 3, max_files: int = 1000):
        self.spark, self.folder, self.work, self.pattern = spark, folder, work, pattern
        self.max_tries, self.max_files = max_tries, max_files
        spark.createDataFrame([], TRIES).write.mode("ignore").parquet(f"{work}/tries/batch_id=-1")

    def _listing(self, reader):
        """Path and time of the files; their contents are not asked for, so a broken one can't fail it."""
        files = reader.format("binaryFile").schema(LISTING).option("pathGlobFilter", self.pattern)
        return files.load(self.folder).select("path", F.col("modificationTime").alias("modified"))

    def tries(self) -> DataFrame:
        """``(path, tries, delivered)`` of every file that failed at least once."""
        log = self.spark.read.schema(f"{TRIES}, batch_id long").parquet(f"{self.work}/tries")
        return log.groupBy("path").agg(F.count_if(~F.col("delivered")).alias("tries"), F.max("delivered").alias("delivered"))

    def _take(self, wanted: DataFrame, sink, batch_id: int, known: DataFrame | None = None) -> None:
        wanted = materialize(wanted, "wanted")
        paths = [r.path for r in wanted.select("path").collect()]  # as many as a batch may have files
        if not paths:
            return
        reader = self.spark.read.option("wholetext", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        texts = reader.text(paths).select(F.col("_metadata.file_path").alias("found"), F.col("value").alias("text"))
        papers = wanted.join(texts, _same_file(F.col("path"), F.col("found"))).select("path", "text", "modified")
        papers = materialize(papers, "papers")
        sink(papers, batch_id)
        # Only files that failed now or before are logged.
        failed = wanted.join(papers.select("path"), "path", "left_anti").select("path", F.lit(False).alias("delivered"))
        healed = papers.select("path", F.lit(True).alias("delivered"))
        healed = healed.limit(0) if known is None else healed.join(known, "path", "left_semi")
        log = failed.unionByName(healed).select("path", F.lit(1).alias("tries"), "delivered", F.lit(batch_id).cast("long").alias("round"))
        log.write.mode("overwrite").parquet(f"{self.work}/tries/batch_id={batch_id}")

    def poll(self, sink) -> None:
        listed = self._listing(self.spark.readStream.option("maxFilesPerTrigger", self.max_files))
        poll_once(listed, lambda batch, batch_id: self._take(batch, sink, batch_id), f"{self.work}/seen")
        waiting = self.tries().where((F.col("tries") < self.max_tries) & ~F.col("delivered")).orderBy("tries", "path").limit(self.max_files)
        # Retries go on from ids that no batch of new files reaches.
        rounds = self.spark.read.schema(f"{TRIES}, batch_id long").parquet(f"{self.work}/tries").where(F.col("batch_id") >= RETRIES)
        last = rounds.agg(F.max("batch_id")).first()[0]
        failed = waiting.select("path")
        self._take(self._listing(self.spark.read).join(failed, "path", "left_semi"), sink, RETRIES if last is None else last + 1, failed)


# Batch ids from here on are rounds of retries.
RETRIES = 1 << 40


def _same_file(listed: Column, found: Column) -> Column:
    """Whether a listed path and the encoded path of a text mean one file."""

    def plain(path: Column) -> Column:
        return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")

    return plain(listed) == plain(F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int = 1000) -> DataFrame:
    """Parquet files of one name pattern, or those of a stored table, as a stream with the schema of the stored files.

    A stored table is one file or a folder of files; as a pattern its name stands for both.
    """
    path = f"{folder}/{name}" if set(name) & set("*?[{") else f"{folder}/{{{name}}}"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def poll_once(stream: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Take everything that is there now, then stop. ``sink(batch, batch_id)`` must be idempotent."""
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def keyed_writer(folder: str):
    """Sink that writes each batch to its own ``batch_id`` folder; a retried batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def ingest_graph(spark: SparkSession, folder: str, buckets: int | None = None) -> BucketStore:
    """The graph of an ingest folder."""
    return graph_store(spark, f"{folder}/graph", buckets)


def ingest_writer(
    folder: str, rules=tp.RULES, aliases=tp.ALIASES, entities: DataFrame | None = None, chunks: bool = True, buckets: int | None = None,
):
    """Sink that chunks a batch of papers ``(doc_id, text, path)`` and merges its triples into the stored graph.

    Triples whose sides ``entities(normalized_id, label)`` (default: those of the aliases) don't
    hold are rejected. Edges stored by earlier batches come first when contradictions are
    decided, and their provenance is carried on. Chunks and decided triples are kept by
    ``batch_id``, where a retried batch overwrites itself; the graph's tables change in one
    commit, which is also what makes a batch count (``ingested``). One writer per folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = ingest_graph(spark, folder, buckets)
        if batch_id <= store.last_batch():
            return
        docs = st.normalize_text(batch)
        if chunks:
            st.chunk_papers(docs).write.mode("overwrite").parquet(f"{folder}/chunks/batch_id={batch_id}")
        known = entities
        if known is None:
            labels = {a.entity_id: a.label for a in reversed(aliases)}
            known = spark.createDataFrame(sorted(labels.items()), "normalized_id string, label string")
        checked = materialize(tp.validate_triples(tp.extract_triples(docs, rules, aliases), known), "validated")
        merge_batch(store, checked, batch_id, known, paper_nodes(batch), f"{folder}/triples/batch_id={batch_id}")

    return write


def ingested(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``chunks`` or ``triples`` of the batches that are committed."""
    return spark.read.parquet(f"{folder}/{name}").where(F.col("batch_id") <= ingest_graph(spark, folder).last_batch())


def current_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Merged edges over all batches, as an edge table with the latest properties."""
    edges = ingest_graph(spark, folder).read("edges")
    props = [x for name in ("evidence", "confidence", "evidence_count") for x in (F.lit(name), F.col(name).cast("string"))]
    return edges.select(
        F.lit("Entity").alias("src_label"), F.col("subject").alias("src_key"), F.col("rel_type"),
        F.lit("Entity").alias("dst_label"), F.col("object").alias("dst_key"), F.create_map(*props).alias("props"),
    )


def dedupe_stream(stream: DataFrame, keys: list[str], time: str, ttl: timedelta, tie: str, lateness: timedelta | None = None) -> DataFrame:
    """Drop repeats of a key inside the lifetime of the last row that went through.

    A row goes through if its key never did, or did so more than ``ttl`` ago. Rows of a key
    count in time order, ties by ``tie``; rows that come in a later batch than newer ones of
    their key are repeats. So the outcome does not depend on where batches are cut, as long as
    batches follow each other in time. The state of a key is one time, which the watermark evicts.

    The watermark lies ``lateness`` (default: ``ttl``) behind the newest time of all keys in
    earlier batches. Spark drops rows that are not newer than it, of any key, seen before or
    not; so give the greatest lateness that files or polls out of time order may have.
    """
    lifetime = ttl // timedelta(microseconds=1)

    def passing(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values(["_at", tie], kind="stable")
        times, last, kept = rows["_at"].to_numpy(), state.get[0] if state.exists else None, []
        at = 0 if last is None else int(times.searchsorted(last + lifetime, side="right"))
        while at < len(times):
            kept.append(at)
            last = int(times[at])
            at = int(times.searchsorted(last + lifetime, side="right"))
        state.update((last,))
        expiry = (last + lifetime) // 1000 + 1
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept].drop(columns="_at")

    timed = stream.withColumn("_at", F.unix_micros(F.col(time))).withWatermark(time, f"{(ttl if lateness is None else lateness) // timedelta(microseconds=1)} microseconds")
    return timed.groupBy(*keys).applyInPandasWithState(passing, stream.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


LAST_PASSED = {"state": Table("request string, last long", ("request",))}


def lifetime_store(spark: SparkSession, folder: str, buckets: int | None = None) -> BucketStore:
    """When each key last went through."""
    return BucketStore(spark, f"{folder}/state", {name: t if buckets is None else t._replace(buckets=buckets) for name, t in LAST_PASSED.items()})


def lifetime_writer(folder: str, keys: list[str], time: str, ttl: timedelta, tie: str, buckets: int | None = None):
    """Sink that writes the rows of a batch that ``dedupe_stream`` would let through, without holding a key in one task.

    A round finds, for every key, its first row that comes more than ``ttl`` after the last one
    that went through: a least row by key, formed before the shuffle, so a key with a third of
    all rows is spread like any other, and no row is joined back. There are as many rounds as rows of one key go through, at
    most the time that a batch covers over ``ttl``. Rows that follow newer ones of their key in a later batch are
    repeats if they are no more than ``ttl`` newer than the last that went through; no watermark drops any.
    Passed rows are kept by ``batch_id`` and count from the commit of the state on (``passed``). One writer per folder.
    """
    lifetime = ttl // timedelta(microseconds=1)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = lifetime_store(spark, folder, buckets)
        if batch_id <= store.last_batch():
            return
        request = F.to_json(F.struct(*keys))
        rows = materialize(batch.withColumns({"request": request, "_at": F.unix_micros(F.col(time))}).where("_at IS NOT NULL"), "requests")
        touched = store.touched("state", rows)
        state = materialize(store.read("state", touched), "state")
        path = f"{folder}/passed/batch_id={batch_id}"
        batch.limit(0).write.mode("overwrite").parquet(path)
        fresh = F.col("last").isNull() | (F.col("_at") > F.col("last") + lifetime)
        while True:
            # What the state rules out now stays out, so each round reads fewer rows than the one before.
            rows = rows.join(state, "request", "left").where(fresh).drop("last")
            first = rows.groupBy("request").agg(F.min_by(F.struct("_at", *batch.columns), F.struct("_at", F.col(tie).isNull(), tie)).alias("row"))
            first = materialize(first.select("request", "row"), "first")
            if not first.limit(1).count():
                break
            first.select("row.*").select(*batch.columns).write.mode("append").parquet(path)
            first = first.select("request", "row._at")
            moved = state.join(first, "request", "full").select("request", F.coalesce("_at", "last").alias("last"))
            state, rows = materialize(moved, "state"), materialize(rows, "requests")
        store.commit(batch_id, replaced={"state": (state, touched)}, added={})

    return write


def passed(spark: SparkSession, folder: str, buckets: int | None = None) -> DataFrame:
    """The rows that ``lifetime_writer`` let through in committed batches."""
    return spark.read.parquet(f"{folder}/passed").where(F.col("batch_id") <= lifetime_store(spark, folder, buckets).last_batch())
