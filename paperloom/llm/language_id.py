"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Weights are fitted by follow-the-regularised-leader with an elastic net, which leaves most
of them zero, and probabilities are calibrated by one temperature on rows kept from the fit.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from paperloom.llm.common import boxed, bucket_of, unboxed, worker_state
from paperloom.llm.words import mixed
from paperloom.session import materialize

BITS = 15
FEATURES = 1 << BITS
ORDERS = (1, 2, 3)
UNKNOWN = "und"
# Bounds of the fit: rows a language, and rows in all.
ROWS_PER_LANGUAGE, ROWS = 800, 20_000
HASH_SLICES = 16


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed character n-grams of a whole text; runs of other characters than letters are one blank."""
    letters = worker_state("letters", _letters)
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, len(text), 1 << 18):  # a long text in pieces that overlap by a gram's reach
        piece = text[max(0, at - max(ORDERS) + 1) : at + (1 << 18)].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        code = np.where(letters[np.minimum(code, 0xFFFF)] | (code > 0xFFFF), code, 0).astype(np.uint64)
        code = code[(code > 0) | np.concatenate(([True], code[:-1] > 0))]
        gram = code
        for order in ORDERS:
            if order > 1:
                gram = gram[: len(code) - order + 1] * np.uint64(0x10FFFF + 1) + code[order - 1 :]
            if len(gram):
                counts += np.bincount((mixed(gram + np.uint64(order << 60)) >> np.uint64(64 - BITS)).astype(np.int64), minlength=FEATURES)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _weighted(index: np.ndarray, count: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """TF-IDF of one text, of unit length."""
    value = np.log1p(count) * rarity[index]
    norm = np.sqrt(value @ value)
    return value / norm if norm else value


class Model(NamedTuple):
    languages: list[str]
    rarity: np.ndarray
    weights: np.ndarray
    temperature: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def follow_leader(rows, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights of ``(index, value, class)`` rows, by follow-the-regularised-leader with an elastic net."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def led(index=slice(None)):
        shrunk = np.sign(z[index]) * np.maximum(np.abs(z[index]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[index])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for at in order.permutation(len(rows)):
            index, value, kind = rows[at]
            w = led(index)
            p = _softmax(value @ w)
            p[kind] -= 1
            slope = value[:, None] * p[None, :]
            square = slope * slope
            z[index] += slope - (np.sqrt(n[index] + square) - np.sqrt(n[index])) / alpha * w
            n[index] += square
    return led()


def best_temperature(logits: np.ndarray, kinds: np.ndarray) -> float:
    """The temperature of the highest likelihood, by golden section on its logarithm."""

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(kinds)), kinds]).sum())

    low, high, golden = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts: each task sends one vector, in slices that are summed in two steps."""
    slices = 16

    def scan(batches):
        seen, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += gram_counts(text.as_py()) > 0
                n += 1
        parts = np.split(seen, slices)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(slices), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * slices, pa.int32()),
                pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary()), pa.array([n] + [0] * (slices - 1), pa.int64()),
            ],
            names=["slice", "task", "seen", "n"],
        )

    def total(table: pa.Table) -> pa.Table:
        seen = sum(np.frombuffer(x, "<i8") for x in table.column("seen").to_pylist())
        return pa.table({
            "slice": table.column("slice")[:1], "task": table.column("task")[:1], "seen": pa.array([seen.tobytes()], pa.binary()),
            "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
        })

    schema = "slice int, task int, seen binary, n long"
    sums = texts.mapInArrow(scan, schema).groupBy("slice", "task").applyInArrow(total, schema).groupBy("slice").applyInArrow(total, schema)
    rows = sorted(sums.collect(), key=lambda r: r.slice)
    if not rows:
        return np.zeros(FEATURES, np.int64), 0
    return np.concatenate([np.frombuffer(r.seen, "<i8") for r in rows]), sum(r.n for r in rows)


def fit_languages(
    docs: DataFrame, held_out: tuple[int, int] = (4, 2), text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE,
    rows: int = ROWS,
) -> Model:
    """Learn from the texts and languages of rows whose id's crc32 modulo ``held_out[0]`` is not ``held_out[1]``.

    Document frequencies cover all such rows. The regression sees at most
    ``rows_per_language`` of each language and ``rows`` in all, those with the smallest
    id hash; every fifth of them sets the temperature. Rows with a null language or
    without a letter teach nothing. Without any such row there is no language to predict.
    """
    named = docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    taught = named.where((bucket_of(F.col("doc_id"), held_out[0]) != held_out[1]) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen, n = _document_frequencies(taught.select("text"))
    rarity = np.log((n + 1) / (seen + 1)) + 1
    # A slice of a language gives its smallest hashes first, so no window holds a language with most rows.
    order = F.xxhash64("chosen"), F.col("chosen")
    sliced = taught.select(F.col("doc_id").alias("chosen"), "lang").withColumn("slice", F.pmod(F.xxhash64("chosen", F.lit(1)), F.lit(HASH_SLICES)))
    for within in (("lang", "slice"), ("lang",)):
        sliced = sliced.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("place") <= rows_per_language)
    chosen = sliced.select("chosen", "lang", "place")
    chosen = materialize(chosen.orderBy("place", "lang").limit(rows).select("chosen").distinct(), "taught")

    def features(batches):
        for batch in batches:
            packed = []
            for text in batch.column(0).to_pylist():
                counts = gram_counts(text) if has_letter(text) else np.zeros(0, np.int64)
                index = np.flatnonzero(counts)
                packed.append(index.astype("<u2").tobytes() + counts[index].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary()), batch.column(2)], names=["lang", "grams", "place"])

    # The chosen ids are bounded by the two parameters, so they may be broadcast.
    sample = taught.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("text", "lang", F.xxhash64("doc_id").alias("place"))
    found = sorted((r for r in sample.mapInArrow(features, "lang string, grams binary, place long").collect() if r.grams), key=lambda r: (r.place, r.lang))
    languages = sorted({r.lang for r in found})
    table = []
    for r in found:
        size = len(r.grams) // 6
        index = np.frombuffer(r.grams, "<u2", size).astype(np.int64)
        table.append((index, _weighted(index, np.frombuffer(r.grams, "<u4", size, 2 * size), rarity), languages.index(r.lang)))
    kept = [row for k, row in enumerate(table) if k % 5] or table
    weights = follow_leader(kept, len(languages)) if table else np.zeros((FEATURES, 0))
    checked = [row for k, row in enumerate(table) if k % 5 == 0]
    temperature = 1.0
    if len(languages) > 1 and checked:
        temperature = best_temperature(np.array([v @ weights[i] for i, v, _ in checked]), np.array([k for _, _, k in checked]))
    return Model(languages, rarity, weights, temperature)


def _predicting(spark, model: Model) -> Column:
    shared = spark.sparkContext.broadcast(tuple(model))

    @arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        languages, rarity, weights, temperature = shared.value
        found, scores = [], []
        for item in texts:
            text = item.as_py()
            if not languages or not has_letter(text):
                found.append(UNKNOWN)
                scores.append(0.0)
                continue
            counts = gram_counts(text)
            index = np.flatnonzero(counts)
            p = _softmax(_weighted(index, counts[index], rarity) @ weights[index] / temperature)
            best = int(np.argmax(p))
            found.append(languages[best])
            scores.append(float(p[best]))
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predicted


def identify_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and its probability ``score``.

    Each whole text is read on its row; nothing is shuffled. A null text, or one without a
    letter, is ``und`` with score 0, and so is every text if no language was learned. Ties
    go to the language first in the alphabet. Columns of these names are replaced.
    """
    predicted = _predicting(docs.sparkSession, model)
    rows = boxed(docs).select("row", predicted(F.col(f"row.`{text}`")).alias("found"))
    return unboxed(rows, docs.columns, lang_pred=F.col("found.lang"), score=F.col("found.score"))
