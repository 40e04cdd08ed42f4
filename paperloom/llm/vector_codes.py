"""Vector code compression: product codes by exact integer k-means, distances from limb-split matrix products.

Components are whole numbers. A number is split into limbs small enough that a matrix product
of limbs in double precision stays below 2^53 and is exact; the products are put together
again in 64-bit integers. So distances are exact at the speed of the floating-point
product, and the first smallest one decides.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.integers import GroupSums, matrix, moved, squares, whole_vectors
from paperloom.session import materialize

BLOCK = 4096


def limb_bits(width: int) -> int:
    """Bits a limb, so that sums of ``width`` products of two limbs stay below 2^53."""
    return (52 - int(max(width, 1) - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as doubles whose sum, each shifted by ``bits`` more than the one before, it is; the last one carries the sign."""
    count = max(1, -(-int(np.abs(x).max(initial=0)).bit_length() // bits))
    low = [(x >> (bits * i)) & ((1 << bits) - 1) for i in range(count - 1)]
    return [part.astype(np.float64) for part in (*low, x >> (bits * (count - 1)))]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products of the rows of two integer matrices, exact while they fit 64 bits."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    columns = [part.T for part in limbs(b, bits)]
    for i, rows in enumerate(limbs(a, bits)):
        for j, part in enumerate(columns):
            out += (rows @ part).astype(np.int64) << (bits * (i + j))
    return out


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row of ``x`` and its squared distance."""
    beyond = squares(book) - 2 * exact_products(x, book)
    entry = beyond.argmin(axis=1)
    return entry, squares(x) + beyond[np.arange(len(x)), entry]


class Codebooks(NamedTuple):
    """``books[part, entry]`` are the entries of each part, ``scale`` turns components into whole numbers."""

    books: np.ndarray
    scale: int

    def digest(self) -> str:
        """sha256 of all components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _blocks(column, parts: int, width: int):
    """Rows of whole numbers, some thousand at a time, cut into parts."""
    whole = matrix(column, parts * width)
    for at in range(0, len(whole), BLOCK):
        yield whole[at : at + BLOCK].astype(np.int64).reshape(-1, parts, width)


def train_codebooks(kept: DataFrame, parts: int, width: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks of a stored table ``(vec_id, ints)``: the vectors of the smallest ids, moved ``rounds`` times.

    Rows without an id start no entry. Equal ids are ordered by their components' bytes.
    With fewer rows than ``entries`` the books are shorter; with none they are empty.
    """
    first = kept.where("vec_id IS NOT NULL").select("vec_id", "ints").orderBy("vec_id", "ints").limit(entries).collect()
    books = np.frombuffer(b"".join(bytes(r.ints) for r in first), "<i4").astype(np.int64).reshape(len(first), parts, width).swapaxes(0, 1)
    for _ in range(rounds if len(first) else 0):

        def gathered(batches, books=books):
            groups = GroupSums(*books.shape)
            for batch in batches:
                for x in _blocks(batch.column(0), parts, width):
                    for part in range(parts):
                        groups.add(part, nearest_entries(x[:, part], books[part])[0], x[:, part])
            yield groups.batch()

        books = moved(books, kept.select("ints").mapInArrow(gathered, GroupSums.SCHEMA))
    return Codebooks(books, scale)


def encode_vectors(kept: DataFrame, codebooks: Codebooks) -> DataFrame:
    """A table with ``ints`` as one with ``code`` (a byte a part) and ``error`` (squared distance to what the code stands for).

    Without entries there is nothing to encode with: no rows.
    """
    books = codebooks.books
    parts, entries, width = books.shape
    others = [f for f in kept.schema.fields if f.name != "ints"]
    names = [f.name for f in others]

    def scan(batches):
        for batch in batches:
            if not entries:
                return
            codes, errors = [], []
            for x in _blocks(batch.column(len(names)), parts, width):
                found = [nearest_entries(x[:, part], books[part]) for part in range(parts)]
                codes += [row.tobytes() for row in np.column_stack([entry for entry, _ in found]).astype(np.uint8)]
                errors.append(sum(error for _, error in found))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(len(names))], pa.array(codes, pa.binary()), pa.array(np.concatenate(errors) if errors else [], pa.int64())],
                names=[*names, "code", "error"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return kept.select(*[f"`{n}`" for n in names], "ints").mapInArrow(scan, f"{schema}, code binary, error long")


def decode_vectors(codes: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``codes`` with ``embedding``: the vector that each code stands for, the middle of its whole numbers' cells."""
    books = codebooks.books.astype(float)
    names = [c for c in codes.columns if c not in ("code", "embedding")]

    def scan(batches):
        for batch in batches:
            code = matrix(batch.column(len(names)), len(books), np.uint8)
            vectors = np.concatenate([books[part][code[:, part]] for part in range(len(books))], axis=1)
            values = pa.array(((vectors + 0.5) / codebooks.scale).ravel())
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(code) + 1) * vectors.shape[1]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], lists], names=[*names, "embedding"])

    shown = codes.select(*[f"`{n}`" for n in names], "code")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:-1])
    return shown.mapInArrow(scan, f"{schema}, embedding array<double>" if schema else "embedding array<double>")


def compress_vectors(
    vectors: DataFrame, width: int = 64, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """``(vec_id, label, code, error)`` of every vector kept, as a stored table, and the codebooks to read codes with.

    Components become floor(scale * x), vectors are cut into ``parts`` equal parts. Null
    vectors, vectors of another length than ``width`` and those with a null, non-finite or
    out-of-range component (``whole_vectors``) are left out. Repeated rows count as often as
    they occur; a null id or label is kept. Other columns are left out, so no name can clash.
    An empty table gives no rows and empty books.

    The table is read once into whole numbers and scanned once a round. A task hands on one
    sum an entry, so neither a label nor an entry with a third of all rows is a group of its own.
    """
    if width % parts or not 0 < entries <= 256:
        raise ValueError("the width must be a multiple of the parts, and a code byte holds at most 256 entries")
    kept = materialize(
        whole_vectors(vectors, embedding, width, scale, vec_id=F.col(f"`{vec_id}`").cast("long"), label=F.col(f"`{label}`")), "whole-vectors"
    )
    codebooks = train_codebooks(kept, parts, width // parts, entries, rounds, scale)
    return materialize(encode_vectors(kept, codebooks), "codes"), codebooks


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors summed over equal labels, nulls together.

    The sums are stored, so Spark knows how small they are before it plans the join.
    """
    sums = materialize(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
