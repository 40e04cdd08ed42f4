"""Tables in buckets of their keys that change together, one commit a batch.

A batch reads and rewrites only the buckets that its keys fall into, or adds rows to them.
It writes its rows to folders of its own and then one manifest that names the valid folders of
every bucket. Readers go by the newest manifest, so a batch that was killed between two
writes leaves nothing behind that counts, and one that is tried again after its commit changes nothing.
One writer per store. A store object reads the manifest once and then knows its own commits; ``refresh`` reads it again.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "batch long, name string, bucket int, part string"
FIRST = -1


class Table(NamedTuple):
    """Columns of a table and those of them whose hash picks the bucket of a row."""

    schema: str
    keys: tuple[str, ...]
    buckets: int = 64


def _parse(schema: str) -> StructType:
    return StructType.fromDDL(schema)


class BucketStore:
    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table]):
        self.spark, self.folder, self.tables = spark, folder, tables
        # The empty manifest makes an empty store readable; it is left alone where there is one.
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{folder}/manifest/from={FIRST:020d}")

        self._known: tuple[int, dict[str, dict[int, list[str]]]] | None = None

    def refresh(self) -> None:
        self._known = None

    def _state(self) -> tuple[int, dict[str, dict[int, list[str]]]]:
        """The newest batch, and the folders of every table's buckets: as many names as there are buckets and parts, whatever the rows."""
        if self._known is None:
            manifests = self.spark.read.schema(f"{MANIFEST}, from long").parquet(f"{self.folder}/manifest")
            newest = manifests.agg(F.max("from").alias("last")).select(F.coalesce("last", F.lit(FIRST)).alias("last"))
            valid: dict[str, dict[int, list[str]]] = {name: {} for name in self.tables}
            last = newest.first()[0]
            for r in manifests.where(F.col("from") == last).orderBy("batch", "part").collect():
                valid[r.name].setdefault(r.bucket, []).append(r.part)
            self._known = last, valid
        return self._known

    def last_batch(self) -> int:
        """The newest committed batch; -1 before the first."""
        return self._state()[0]

    def bucket_of(self, name: str) -> Column:
        table = self.tables[name]
        return F.pmod(F.xxhash64(*table.keys), F.lit(table.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """Buckets that hold the keys of ``rows``."""
        return sorted(r[0] for r in rows.select(self.bucket_of(name)).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as of the newest commit, or some of its buckets."""
        valid = self._state()[1][name]
        chosen = sorted(valid) if buckets is None else [b for b in buckets if b in valid]
        paths = [f"{self.folder}/{name}/{part}/bucket={b}" for b in chosen for part in valid[b]]
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch_id: int, replaced: dict[str, tuple[DataFrame, list[int]]], added: dict[str, DataFrame]) -> None:
        """``replaced`` tables hold all rows of the named buckets anew, ``added`` ones further rows; both count from the manifest on."""
        if batch_id <= self.last_batch():
            return
        part = f"batch={batch_id}-{uuid.uuid4().hex}"
        valid = {name: {bucket: list(parts) for bucket, parts in some.items()} for name, some in self._state()[1].items()}
        for name, (_, buckets) in replaced.items():
            for bucket in buckets:
                valid[name].pop(bucket, None)
        written = []
        for name, rows in [*((n, r) for n, (r, _) in replaced.items()), *added.items()]:
            path, schema = f"{self.folder}/{name}/{part}", self.tables[name].schema
            columns = [F.col(f.name) for f in _parse(schema).fields]
            rows.select(*columns, self.bucket_of(name).alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(path)
            written.append(self.spark.read.schema(f"{schema}, bucket int").parquet(path).select(F.lit(name).alias("name"), "bucket").distinct())
        # What was written tells which buckets have rows; only names are asked for.
        for r in reduce(DataFrame.union, written).collect():
            valid[r.name].setdefault(r.bucket, []).append(part)
        rows = [(batch_id, name, bucket, part) for name, parts in valid.items() for bucket, some in parts.items() for part in some]
        # One file, which the writer puts in place with a single rename.
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/from={batch_id:020d}")
        self._known = batch_id, valid
