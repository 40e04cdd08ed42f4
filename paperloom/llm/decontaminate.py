"""Benchmark decontamination: windows of test items looked for in every window of the documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from paperloom.llm.common import boxed, unboxed
from paperloom.llm.words import ALNUM, window_hashes, word_blocks
from paperloom.session import materialize

WINDOW_SCHEMA = "length int, hash long, words binary, item string"
HITS_DDL = "struct<n_words:bigint,runs:array<bigint>,spans:array<bigint>,n_hit:bigint,items:array<string>>"
_LONGS, _STRINGS = pa.list_(pa.int64()), pa.list_(pa.string())
_HIT_TYPES = {"n_words": pa.int64(), "runs": _LONGS, "spans": _LONGS, "n_hit": pa.int64(), "items": _STRINGS}
# Proven size bound of one broadcast: windows beyond it are looked for in further passes.
WINDOWS_PER_PASS = 2_000_000


def _words_between(data: np.ndarray, start, end) -> bytes:
    return b" ".join(bytes(data[a:b]) for a, b in zip(start, end)).lower()


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Each item's windows of ``width`` words; an item of fewer words, but not none, is one window."""

    def cut(batches):
        for batch in batches:
            texts, items = batch.column(0), batch.column(1).to_pylist()
            for data, w in word_blocks(texts, ALNUM):
                rows = []
                for i in range(w.first, w.last):
                    a, b = w.bounds[i - w.first], w.bounds[i - w.first + 1]
                    size = min(width, b - a)
                    if size == 0:
                        continue
                    for k, h in enumerate(window_hashes(w.hash[a:b], size)):
                        span = slice(a + k, a + k + size)
                        rows.append((size, h.astype(np.int64), _words_between(data, w.start[span], w.end[span]), items[i]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.string()))],
                        names=["length", "hash", "words", "item"],
                    )

    named = benchmark.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"))
    return named.mapInArrow(cut, WINDOW_SCHEMA).distinct()


class Windows:
    """A hash set of windows: by length, sorted hashes and the words and items of each."""

    def __init__(self, rows):
        grouped: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for length, code, words, item in rows:
            grouped.setdefault(length, {}).setdefault(code, {}).setdefault(bytes(words), []).append(item)
        self.hashes = {n: np.sort(np.array(list(by), np.int64).view(np.uint64)) for n, by in grouped.items()}
        self.known = grouped

    def candidates(self, code: np.ndarray, length: int) -> np.ndarray:
        """Indexes of windows whose hash is in the set."""
        known = self.hashes[length]
        found = np.searchsorted(known, code)
        found[found == len(known)] = 0
        return np.flatnonzero(known[found] == code)

    def verified(self, length: int, code: np.uint64, words: bytes) -> list[str]:
        return self.known[length][int(code.astype(np.int64))].get(words, [])


def _scan(windows) -> Column:
    """Hits of a broadcast set of windows, added to the runs and items that earlier passes found."""
    built: list[Windows] = []  # made once in each task

    @arrow_udf(HITS_DDL)
    def hits(texts: pa.Array, runs: pa.Array, items: pa.Array) -> pa.Array:
        if not built:
            built.append(Windows(windows.value))
        known, rows = built[0], []
        runs_before, items_before = runs.to_pylist(), items.to_pylist()
        for data, w in word_blocks(texts, ALNUM):
            count = w.last - w.first
            change = np.zeros(len(w.hash) + 1, np.int64)
            row_of = np.repeat(np.arange(count), np.diff(w.bounds))
            found = {i: set(items_before[w.first + i]) for i in range(count) if items_before[w.first + i]}
            for i in found:
                before = np.array(runs_before[w.first + i]) + w.bounds[i]
                np.add.at(change, before[0::2], 1)
                np.add.at(change, before[1::2], -1)
            for length in known.hashes:
                code = window_hashes(w.hash, length)
                for k in known.candidates(code, length):
                    if row_of[k] != row_of[k + length - 1]:
                        continue
                    span = slice(k, k + length)
                    of = known.verified(length, code[k], _words_between(data, w.start[span], w.end[span]))
                    if of:
                        change[k] += 1
                        change[k + length] -= 1
                        found.setdefault(int(row_of[k]), set()).update(of)
            inside = np.cumsum(change[:-1]) > 0
            for i in range(count):
                a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                if i in found:
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside[a:b], [False])).astype(np.int8)))
                    first, last = edges[0::2], edges[1::2]
                    spans = np.column_stack((w.start[a + first], w.end[a + last - 1])) - w.origin[i]
                    rows.append((b - a, edges.tolist(), spans.ravel().tolist(), int((last - first).sum()), sorted(found[i])))
                else:
                    rows.append((b - a, [], [], 0, []))
        columns = list(zip(*rows)) or [()] * len(_HIT_TYPES)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _HIT_TYPES.values())], names=list(_HIT_TYPES))

    return hits


@arrow_udf(StringType())
def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the given (start, end) byte runs."""
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        if text is not None and cuts:
            raw = text.encode()
            kept = [raw[a:b] for a, b in zip([0, *cuts[1::2]], [*cuts[0::2], len(raw)])]
            text = b"".join(kept).decode()
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 10, remove: str | None = "documents", windows_per_pass: int = WINDOWS_PER_PASS,
) -> DataFrame:
    """Find every window of ``width`` words of the benchmark in the documents.

    Words are runs of letters and digits, A-Z lower-cased, every character outside ASCII taken
    as a letter. An item of fewer words is one window. Adds ``n_words``, ``n_hit`` (words inside
    any occurrence), ``items`` (ids of items with an occurring window, sorted as strings) and
    ``contaminated``. ``remove='spans'`` cuts the hit runs out of the texts, ``'documents'``
    drops documents with a hit, ``None`` only marks.

    A null or empty text has no words. Repeated rows are judged alike, one by one. An item
    whose id is null is listed as ``null``; items without words match nothing. An empty
    benchmark leaves all documents. Output names replace columns of the same name.

    Documents are not shuffled: each pass scans their windows against one broadcast hash set,
    and a hit counts only after the words themselves have been compared. One set holds at most
    ``windows_per_pass`` windows; a larger benchmark is cut by hash into as many sets as it
    needs, and the documents, with what was found so far, are stored between the passes.
    """
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, item_id, item_text, width), "benchmark-windows")
    passes = max(1, -(-windows.count() // windows_per_pass))
    longs, strings = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    empty = F.named_struct(F.lit("runs"), longs, F.lit("items"), strings)
    rows = boxed(docs, hits=empty)
    for part in range(passes):
        chosen = windows.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == part)
        known = [(r.length, r.hash, bytes(r.words), r.item) for r in chosen.toLocalIterator()]
        scan = _scan(spark.sparkContext.broadcast(known))
        rows = rows.select("row", scan(F.col(f"row.`{text}`"), F.col("hits.runs"), F.col("hits.items")).alias("hits"))
        if part + 1 < passes:
            rows = materialize(rows, "contamination")
    outputs = {
        "n_words": F.col("hits.n_words"), "n_hit": F.col("hits.n_hit"), "items": F.col("hits.items"),
        "contaminated": F.col("hits.n_hit") > 0,
    }
    if remove == "spans":
        rows = rows.select("row", "hits", without_spans(F.col(f"row.`{text}`"), F.col("hits.spans")).alias("clean"))
        outputs = {text: F.col("clean"), **outputs}
    elif remove == "documents":
        rows = rows.where("hits.n_hit = 0")
    return unboxed(rows, docs.columns, **outputs)
