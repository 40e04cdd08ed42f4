"""Tables of vectors with whole components, and exact sums of the vectors of groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def component_bits(width: int) -> int:
    """Bits of a component's size up to which squared distances of ``width`` components fit a signed 64-bit number."""
    return (62 - int(max(width, 1) - 1).bit_length()) // 2 - 1


def whole_vectors(vectors: DataFrame, embedding: str, width: int, scale: int, **kept: Column) -> DataFrame:
    """``kept`` and ``ints``: floor(scale * x) of each component as little-endian signed 32-bit numbers.

    Left out are null vectors, those of another length than ``width``, and those with a null,
    non-finite or out-of-range component. Out of range is what needs more than
    ``component_bits`` bits (2^27 at 64 components), as squared distances would not fit a long.
    """
    limit = float(1 << min(component_bits(width), 31))
    rows = vectors.select(*[c.alias(n) for n, c in kept.items()], F.col(f"`{embedding}`").cast("array<double>").alias("ints"))
    names, others = [*kept, "ints"], len(kept)

    def scan(batches):
        for batch in batches:
            lists = batch.column(others)
            offsets = lists.offsets.to_numpy()
            right = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == width)
            rows = np.flatnonzero(right)
            values = lists.values.to_numpy(zero_copy_only=False)  # null components become NaN
            floors = np.floor(scale * values[offsets[rows][:, None] + np.arange(width)])
            fits = (np.abs(floors) < limit).all(axis=1) if width else np.ones(len(rows), bool)
            whole = np.ascontiguousarray(floors[fits].astype("<i4"))
            bytes_ = pa.BinaryArray.from_buffers(
                pa.binary(), len(whole), [None, pa.py_buffer((np.arange(len(whole) + 1) * 4 * width).astype(np.int32)), pa.py_buffer(whole.tobytes())]
            )
            taken = pa.array(rows[fits])
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(taken) for k in range(others)], bytes_], names=names)

    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(scan, f"{shown}, ints binary" if shown else "ints binary")


def matrix(column, width: int, kind: str = "<i4") -> np.ndarray:
    """A binary column as rows of ``width`` numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", x, x)


class GroupSums:
    """Exact sums and counts of the vectors of each group, gathered over a task."""

    SCHEMA = "part int, entry int, n long, sums array<long>"

    def __init__(self, parts: int, groups: int, width: int):
        self.sums, self.counts = np.zeros((parts, groups, width), np.int64), np.zeros((parts, groups), np.int64)

    def add(self, part: int, group: np.ndarray, x: np.ndarray) -> None:
        if len(group):
            order = np.argsort(group, kind="stable")
            held, first = np.unique(group[order], return_index=True)
            self.sums[part, held] += np.add.reduceat(x[order], first, axis=0)
            self.counts[part] += np.bincount(group, minlength=self.counts.shape[1])

    def batch(self) -> pa.RecordBatch:
        part, entry = np.nonzero(self.counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(self.counts[part, entry]),
                pa.array(list(self.sums[part, entry]), pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "sums"],
        )


def moved(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """``books[part, entry]`` with every entry of a non-empty group replaced by the floor of its mean.

    Tasks hand on one row a group, Spark adds them by component, and no more numbers than the
    books hold reach the driver.
    """
    by_component = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    out = books.copy()
    for r in by_component.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        out[r.part, r.entry, r.at] = r.x // r.n
    return out
