"""Best-fit packing: a configuration program over the histogram of piece lengths decides which lengths share a sequence.

Only the histogram (at most one number a length) meets the driver. A piece finds its place
from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from paperloom.llm.common import small_batches
from paperloom.llm.tokens import PIECES_KEPT, encoded_rows
from paperloom.session import materialize

PIECES = "part int, number long, doc_id long, piece int, start long, length long, ids_crc32 long, place long, ids binary"


def _cut(size: int, capacity: int) -> list[int]:
    """Borders of a document's pieces; of a longer one only the first piece may be short."""
    first = size if size <= capacity else size % capacity or capacity
    return [0, *range(first, size + 1, capacity)]


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, ids: bool, pieces_kept: int = PIECES_KEPT) -> DataFrame:
    """One row a piece: where it comes from, its length, and its place among pieces of that length in its task."""

    def scan(batches):
        part, number, places = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        names = [c.split()[0] for c in PIECES.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        end = np.uint32(end_id).astype("<u4").tobytes()
        rows = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for doc_id, code in zip(batch.column(0).to_pylist(), encoded_rows(batch.column(1), tokenizer, pieces_kept=pieces_kept)):
                code += end
                borders = _cut(len(code) // 4, capacity)
                for k, (a, b) in enumerate(zip(borders, borders[1:])):
                    raw = code[4 * a : 4 * b]
                    rows.append((part, number, doc_id, k, a, b - a, zlib.crc32(raw), int(places[b - a]), raw if ids else None))
                    places[b - a] += 1
                    number += 1
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return docs.mapInArrow(scan, PIECES)


class Slots(NamedTuple):
    """Where ranks of a length go: from ``first`` on, ``each`` a sequence, counted from ``sequence``, the first at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room, the highest total price of a configuration, and the index of a length in it (-1: as for one less).

    ``lengths`` rise.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(int(lengths[0]), capacity + 1):
        n = fitting[room]
        value = best[room - lengths[:n]] + prices[:n]
        top = int(value.argmax())
        if value[top] > best[room - 1]:
            best[room], choice[room] = value[top], top
        else:
            best[room] = best[room - 1]
    return best, choice


def priced(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> list[int]:
    """The configuration of the highest total price: unbounded knapsack by dynamic programming."""
    _, choice = _knapsack(lengths, prices, capacity)
    chosen, room = [], capacity
    while room >= lengths[0]:
        if choice[room] < 0:
            room -= 1
            continue
        chosen.append(int(lengths[choice[room]]))
        room -= chosen[-1]
    return chosen


def _priced_each(lengths: np.ndarray, choice: np.ndarray, opened: np.ndarray, capacity: int) -> np.ndarray:
    """For each opened length (an index) a row with the best configuration that holds it: how often each length occurs."""
    counts = np.zeros((len(opened), len(lengths)), np.int32)
    counts[np.arange(len(opened)), opened] = 1
    filled = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))
    rows, room = np.arange(len(opened)), filled[capacity - lengths[opened]]
    while len(rows):
        rows, room = rows[room > 0], room[room > 0]
        counts[rows, choice[room]] += 1
        room = filled[room - lengths[choice[room]]]
    return counts


class Cover(NamedTuple):
    """Fractional uses of configurations (their lengths as rising indexes and counts), the uses' total, and a bound no total is below."""

    uses: list[tuple[np.ndarray, np.ndarray, float]]
    total: float
    bound: float


# How much a use lowers its lengths' prices in each phase of the program, the rounds of a phase, the
# share of that rate by which a configuration may miss the best, and the gap to the bound that ends the program.
RATES, ROUNDS, NEAR_BEST, GAP = (0.5, 0.2, 0.08, 0.03, 0.01, 0.004), 60, 0.25, 0.001


def covering(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> Cover:
    """The covering program (fewest configurations that hold each length as often as demanded) by multiplicative weights.

    Each length has a price, which a round lowers by a factor for the share of the demand
    that the round covers. A round finds the best configuration for each length from one
    knapsack and makes a small fractional use of all that are near the best price, so
    prices move before any length is covered. The demand at the prices, over the best
    price of a configuration, bounds the total from below; a phase's uses, scaled, with
    what they leave uncovered in sequences of one length, bound it from above. Later
    phases begin with the prices of earlier ones and change them less.
    """
    price, bound, total, found = np.log(lengths.astype(float)), 0.0, np.inf, []
    mark = np.random.default_rng(0).integers(1, 1 << 62, len(lengths))  # tells rows of counts apart
    for rate in RATES:
        covered, pool = np.zeros(len(lengths)), {}
        for _ in range(ROUNDS):
            prices = np.exp(price - price.max())
            best, choice = _knapsack(lengths, prices, capacity)
            bound = max(bound, float(demand @ prices / best[capacity]))
            opened = np.flatnonzero(prices + best[capacity - lengths] >= (1 - NEAR_BEST * rate) * best[capacity])
            counts = _priced_each(lengths, choice, opened, capacity)
            counts = counts[np.unique(counts @ mark, return_index=True)[1]]
            share = counts / demand
            use = 1 / share.max(axis=1)
            crowd = (share * use[:, None]).sum(axis=0)
            use /= np.where(counts > 0, crowd, 0).max(axis=1)
            gained = use @ share
            covered += gained
            price -= rate * gained
            for row, n in zip(counts, use.tolist()):
                held = np.flatnonzero(row)
                key = (held.tobytes(), row[held].tobytes())
                pool[key] = pool.get(key, 0.0) + n
        spent, alone = sum(pool.values()), demand / (capacity // lengths)
        for level in np.quantile(covered, np.linspace(0, 1, 101)):
            if level > 0:
                above = spent / level + float(alone @ np.maximum(0, 1 - covered / level))
                if above < total:
                    total, found = above, [(*key, n / level) for key, n in pool.items()]
        if total <= (1 + GAP) * bound:
            break
    return Cover([(np.frombuffer(held, np.int64), np.frombuffer(n, np.int32), use) for held, n, use in found], total, bound)


def _rounded(cover: Cover, lengths: np.ndarray, left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Whole uses of the program's configurations, no more than is left of their lengths, which are taken from ``left``.

    Uses are floored; the fractions cut off become whole uses at even steps of their running total.
    """
    order = sorted(range(len(cover.uses)), key=lambda i: -cover.uses[i][2])
    amounts = np.array([cover.uses[i][2] for i in order])
    whole = np.floor(amounts).astype(np.int64)
    steps = np.floor(np.cumsum(amounts - whole) + 0.5).astype(np.int64)
    out = []
    for i, times in zip(order, (whole + np.diff(steps, prepend=0)).tolist()):
        held, n, _ = cover.uses[i]
        times = min(times, int((left[lengths[held]] // n).min()))
        if times > 0:
            left[lengths[held]] -= n * times
            out.append((dict(zip(lengths[held].tolist(), n.tolist())), times))
    return out


def _filled(chosen: list[int], left: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration with no more of a length than is left, its free room filled by the best fitting lengths."""
    taken: dict[int, int] = {}
    for length in chosen:
        if taken.get(length, 0) < left[length]:
            taken[length] = taken.get(length, 0) + 1
    room = capacity - sum(n * length for length, n in taken.items())
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        n = min(room // length, int(left[length]) - taken.get(length, 0))
        if n > 0:
            taken[length] = taken.get(length, 0) + n
            room -= n * length
    return taken


# Pieces of a length that the program may leave for the rounding.
ROUNDED = 16


def _completed(
    uses: list[tuple[dict[int, int], int]], left: np.ndarray, demand: np.ndarray, capacity: int, rate: float
) -> list[tuple[dict[int, int], int]]:
    """``uses`` and further ones for what is ``left``.

    Each step prices one configuration by a knapsack, a length costing the more the further
    its covered share lags behind the others', and uses it as often as its scarcest length
    allows, so a step settles a length at least. When no more than ``ROUNDED`` pieces of any
    length are left, the largest opens a sequence, which the best fitting others fill.
    """
    uses, left = uses[:], left.copy()
    while (left > ROUNDED).any():
        lengths = np.flatnonzero(left > ROUNDED)
        lag = left[lengths] / demand[lengths]
        prices = lengths * np.exp(rate * (lag - lag.mean()) * lengths / capacity)
        taken = _filled(priced(lengths, prices, capacity), left, capacity)
        times = min(int(left[length]) // n for length, n in taken.items())
        for length, n in taken.items():
            left[length] -= n * times
        uses.append((taken, times))
    while left.any():
        taken = _filled([int(np.flatnonzero(left)[-1])], left, capacity)
        for length, n in taken.items():
            left[length] -= n
        uses.append((taken, 1))
    return uses


def configurations(histogram: dict[int, int], capacity: int, rate: float = 4.0) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used, covering the histogram.

    The covering program is solved by multiplicative weights (``covering``), its fractional
    uses are rounded to whole ones, and what they leave is packed step by step
    (``_completed``). Where those steps alone need fewer sequences, as on some flat
    histograms on which the program ends before its gap is closed, they are kept instead.
    """
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        demand[length] = n
    if not demand.any():
        return []
    present, left = np.flatnonzero(demand), demand.copy()
    rounded = _rounded(covering(present, demand[present], capacity), present, left)
    plans = _completed(rounded, left, demand, capacity, rate), _completed([], demand, demand, capacity, rate)
    return min(plans, key=lambda uses: sum(times for _, times in uses))


def slots_of(uses: list[tuple[dict[int, int], int]]) -> Slots:
    """Ranges of ranks for each length of each configuration."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for taken, times in uses:
        offset = 0
        for length in sorted(taken, reverse=True):
            n = taken[length]
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Slots(*columns, sequence)


def _placing(slots: Slots):
    length, first, each, sequence, offset, _ = slots
    starts = np.searchsorted(length, np.arange(length.max() + 2)) if len(length) else np.zeros(1, np.int64)

    @arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        size, rank = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        out = np.zeros((2, len(size)), np.int64)
        for value in np.unique(size):
            rows = np.flatnonzero(size == value)
            at = starts[value] + np.searchsorted(first[starts[value] : starts[value + 1]], rank[rows], side="right") - 1
            within = rank[rows] - first[at]
            out[0, rows] = sequence[at] + within // each[at]
            out[1, rows] = offset[at] + within % each[at] * value
        return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["sequence_id", "offset"])

    return placed


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", ids: bool = True,
    pieces_kept: int = PIECES_KEPT,
) -> DataFrame:
    """Pieces of tokenized documents with the sequence and offset where each lies.

    A document is its ids and ``end_id``. Only documents over ``capacity`` are cut, into full
    pieces after a first one that may be shorter. Returns ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset`` and, with ``ids``, the piece's ids (little-endian
    unsigned 32-bit). Sequences are filled without gaps from offset 0.

    A null or empty text is the end id alone. Every row is a document, so repeated rows are
    packed as often as they occur; a null id stays null. Other columns are left out, and no
    name can clash. An empty table gives no rows.

    Texts are tokenized once, on their rows, into a stored table; what is shuffled is one
    narrow row a piece (and its ids, if asked for). Ranks come from each task's own count
    and the tasks' running totals by length, so a length of a third of all pieces is no
    group of its own. ``pieces_kept`` bounds the tokenizer's memory in a worker.
    """
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with small_batches(docs.sparkSession):
        pieces = materialize(tokenized_pieces(named, tokenizer, end_id, capacity, ids, pieces_kept), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = _placing(slots_of(configurations(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.drop("ids").join(bases, ["part", "length"]).withColumn("at", placed("length", F.col("base") + F.col("place")))
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"]
    if not ids:
        return ranked.select(*shown)
    return ranked.join(pieces.select("part", "number", "ids"), ["part", "number"]).select(*shown, "ids")
