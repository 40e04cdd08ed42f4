"""Token files: ids of whole documents in blocks of fixed-width bits, with block offsets for random access.

A file is a Parquet table of blocks, so any store that Spark reaches holds it. A block holds
whole documents: their ids and sizes, the place of its first id within its part, and the
packed ids. Parts follow each other in ascending doc_id order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import small_batches
from paperloom.llm.tokens import encoded_rows, vocabulary_size

BLOCK_IDS = 1 << 16
BLOCKS = "part int, block int, first long, n_ids long, bits int, doc_ids array<long>, sizes array<int>, payload binary"
_BLOCK_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
_WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a stream of ``bits`` bits each, most significant first; whole-byte widths as little-endian numbers."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    planes = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(planes[:, 32 - bits :]).tobytes()


def unpacked(payload, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from number ``first`` on, without touching the bits before them."""
    if bits in _WHOLE:
        return np.frombuffer(payload, _WHOLE[bits], count, first * bits // 8).astype("<u4")
    lead, skip = divmod(first * bits, 8)
    raw = np.frombuffer(payload, np.uint8, -(-(skip + count * bits) // 8), lead)
    planes = np.zeros((count, 32), np.uint8)
    planes[:, 32 - bits :] = np.unpackbits(raw)[skip : skip + count * bits].reshape(count, bits)
    return np.packbits(planes, axis=1).view(">u4").ravel().astype("<u4")


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every whole text, append ``end_id``, and write blocks in ascending doc_id order.

    Null ids come first, ties are ordered by text. A null or empty text is the end id alone.
    Repeated rows are written as often as they occur; other columns are left out. A block
    holds about ``block_ids`` ids; a longer document has a block of its own.

    Texts are range-partitioned and sorted by id, and encoded where they then lie, so the
    only shuffle moves each text once and no task holds more than a block.
    """
    bits = width_of(vocabulary_size(tokenizer))

    def scan(batches):
        part, block, first = TaskContext.get().partitionId(), 0, 0
        end = np.uint32(end_id).astype("<u4").tobytes()
        ids, codes, held = [], [], 0

        def row():
            numbers = np.frombuffer(b"".join(codes), "<u4")
            sizes = [len(c) // 4 for c in codes]
            values = (part, block, first, len(numbers), bits, ids, sizes, packed(numbers, bits))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, _BLOCK_TYPES)], names=[c.split()[0] for c in BLOCKS.split(", ")]
            )

        for batch in batches:
            for key, code in zip(batch.column(0).to_pylist(), encoded_rows(batch.column(1), tokenizer)):
                ids.append(key)
                codes.append(code + end)
                held += len(codes[-1]) // 4
                if held >= block_ids:
                    yield row()
                    block, first, held = block + 1, first + held, 0
                    ids, codes = [], []
        if ids:
            yield row()

    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(scan, BLOCKS).write.parquet(path)


def _part_bases(blocks: DataFrame) -> DataFrame:
    """Ids before each part. One number a part: the window's only task sees as many rows as there are parts."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))


def read_ids(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids of the whole file from number ``start`` on; only the blocks that hold them are unpacked, from their first wanted bit."""
    blocks = spark.read.parquet(path)
    based = blocks.join(_part_bases(blocks), "part").withColumn("base", F.col("part_base") + F.col("first"))
    wanted = based.where((F.col("base") < start + count) & (F.col("base") + F.col("n_ids") > start)).orderBy("base")
    out = []
    for row in wanted.select("base", "n_ids", "bits", "payload").toLocalIterator():
        lo, hi = max(start - row.base, 0), min(start + count - row.base, row.n_ids)
        out.append(unpacked(row.payload, row.bits, hi - lo, lo))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document; with ``digest`` their crc32 as ``ids_crc32`` instead of the ids.

    ``ids`` are little-endian unsigned 32-bit numbers. Each block is unpacked by itself.
    """
    shown = "ids_crc32 long" if digest else "ids binary"

    def scan(batches):
        for batch in batches:
            for keys, sizes, bits, first, part, payload in zip(*(batch.column(k) for k in range(6))):
                size = sizes.values.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(size)
                raw = unpacked(payload.as_buffer(), bits.as_py(), int(ends[-1])).tobytes()
                texts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.as_py(), pa.int64()), pa.array([part.as_py()] * len(size), pa.int32()), pa.array(first.as_py() + ends - size),
                        pa.array(size), pa.array([zlib.crc32(t) for t in texts] if digest else texts, pa.int64() if digest else pa.binary()),
                    ],
                    names=["doc_id", "part", "at", "n_tokens", shown.split()[0]],
                )

    blocks = spark.read.parquet(path)
    found = blocks.select("doc_ids", "sizes", "bits", "first", "part", "payload").mapInArrow(scan, f"doc_id long, part int, at long, n_tokens long, {shown}")
    return found.join(_part_bases(blocks), "part").select("doc_id", (F.col("part_base") + F.col("at")).alias("start"), "n_tokens", shown.split()[0])
