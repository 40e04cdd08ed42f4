"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat, target, negation, reporting verb, other). Small
transducers rewrite the symbols of a clause: one marks what a negation reaches, one what is
reported, one what is aimed at a target. They are composed into one machine, and its outputs
are the matched patterns of a clause. A document's score weighs its pattern counts.

Which words and word beginnings insult is learned from labelled documents, beside a short
fixed list, and so are the weights of the patterns.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from paperloom.llm.common import boxed, bucket_of, small_batches, unboxed
from paperloom.llm.words import ALNUM, mixed, word_blocks
from paperloom.session import materialize

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DOUBTFUL = range(7)
HOSTILE = (INSULT, THREAT, DOUBTFUL)
# Well-known English words of each class.
SEEDS = {
    INSULT: ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "worthless", "pathetic", "disgusting", "dumb", "imbecile"),
    THREAT: ("kill", "murder", "shoot", "stab", "strangle", "lynch", "behead", "hurt", "destroy"),
    TARGET: ("you", "your", "yours", "he", "she", "him", "her", "they", "them", "their", "these", "those", "people"),
    NEGATION: ("not", "no", "never", "neither", "nor", "without", "hardly", "don", "isn", "aren", "wasn", "won", "didn"),
    REPORT: ("said", "says", "say", "wrote", "writes", "claimed", "claims", "reported", "reports", "quoted", "alleged", "told"),
}
MARKS = ("plain", "aimed", "negated", "reported")
PATTERNS = tuple(f"{mark} {kind}" for kind in ("insult", "threat", "doubtful insult") for mark in MARKS)
# Weights before any label is seen: constant, patterns in their order, and the densities of insults and doubtful insults.
PRIOR = np.array([-3.0, 4.0, 5.0, 0.0, 1.0, 3.0, 5.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])
PREFIXES = (4, 5, 6, 7)
# Bounds of the labelled sample and of the learned word list.
TOXIC_SAMPLE, CLEAN_SAMPLE, LEARNED = 4_000, 12_000, 2_000


class Transducer(NamedTuple):
    """A deterministic transducer: ``arcs[state][symbol] = (output, next state)``; state 0 starts."""

    arcs: list[dict]


def _transducer(states: int, step) -> Transducer:
    symbols = range(7 + len(PATTERNS))
    return Transducer([{s: step(state, s) for s in symbols} for state in range(states)])


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds the outputs of ``first`` into ``second``."""
    numbers, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    for p, q in todo:  # grows while it is walked
        row = {}
        for symbol, (middle, p2) in first.arcs[p].items():
            output, q2 = second.arcs[q][middle]
            if (p2, q2) not in numbers:
                numbers[p2, q2] = len(numbers)
                todo.append((p2, q2))
            row[symbol] = (output, numbers[p2, q2])
        arcs.append(row)
    return Transducer(arcs)


# Symbols from 7 on are patterns: a mark on an insult, a threat or a doubtful insult.
def _marked(kind: int, mark: int) -> int:
    return 7 + len(MARKS) * HOSTILE.index(kind) + mark


def _negations(state: int, symbol: int):
    """A negation reaches the next three words."""
    if symbol == NEGATION:
        return symbol, 3
    if symbol in HOSTILE and state:
        return _marked(symbol, 2), state - 1
    return symbol, max(0, state - 1)


def _reports(state: int, symbol: int):
    """What follows a reporting verb in its clause is reported."""
    if symbol == REPORT:
        return symbol, 1
    if state and symbol in HOSTILE:
        return _marked(symbol, 3), 1
    return symbol, state


def _aims(state: int, symbol: int):
    """An insult or threat up to four words after a target, or right before one, is aimed at it."""
    if symbol == TARGET:
        if state >= 5:
            return _marked(HOSTILE[state - 5], 1), 4
        return symbol, 4
    if symbol in HOSTILE:
        return _marked(symbol, int(1 <= state <= 4)), 5 + HOSTILE.index(symbol)
    return symbol, state - 1 if 1 <= state <= 4 else 0


GRAMMAR = compose(compose(_transducer(4, _negations), _transducer(2, _reports)), _transducer(8, _aims))


def clause_patterns(symbols) -> list[int]:
    """Indexes into ``PATTERNS`` of what the grammar finds in one clause."""
    state, found = 0, []
    for symbol in symbols:
        output, state = GRAMMAR.arcs[state][symbol]
        if output >= 7:
            found.append(output - 7)
    return found


def _units(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Codes of each word and of its beginnings, one column each; 0 where the word is shorter."""
    width = max(PREFIXES)
    at = np.minimum(start[:, None] + np.arange(width), len(data) - 1)
    letters = data[at]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint64)
    packed = np.cumsum(letters << (np.arange(width, dtype=np.uint64) * np.uint64(8)), axis=1, dtype=np.uint64)
    columns = [code | np.uint64(1)]
    for k in PREFIXES:
        columns.append(np.where(end - start >= k, packed[:, k - 1] * np.uint64(2) + np.uint64(k << 60), np.uint64(0)) & ~np.uint64(1))
    return np.column_stack(columns)


def _clauses(data: np.ndarray, w) -> np.ndarray:
    """The number of the clause of each word; rows never share one."""
    if not len(w.start):
        return w.start
    lo, hi = int(w.origin[0]), int(w.origin[-1])
    stops = np.isin(data[lo:hi], np.frombuffer(b".,;:!?\n\r", np.uint8))
    return np.cumsum(stops)[w.start - lo] + np.repeat(np.arange(w.last - w.first), np.diff(w.bounds))


class Model(NamedTuple):
    """Sorted unit codes with their class, and the weights of the patterns."""

    codes: np.ndarray
    classes: np.ndarray
    weights: np.ndarray


def _seed_units() -> dict[int, int]:
    units = {}
    for kind, words in SEEDS.items():
        for _, w in word_blocks(pa.array([" ".join(words)]), ALNUM):
            units.update({int(c | np.uint64(1)): kind for c in w.hash})
    return units


def pattern_counts(texts: pa.Array, codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How often each pattern matches in each text, and the number of words."""
    counts = np.zeros((len(texts), len(PATTERNS) + 1))
    for data, w in word_blocks(texts, ALNUM):
        counts[w.first : w.last, -1] = np.diff(w.bounds)
        if not len(w.start):
            continue
        kinds = np.zeros(len(w.start), np.int8)
        units = _units(data, w.start, w.end, w.hash)
        for column in reversed(range(units.shape[1])):  # whole words have the last say
            found = np.searchsorted(codes, units[:, column])
            found[found == len(codes)] = 0
            known = codes[found] == units[:, column]
            kinds[known] = classes[found[known]]
        hits = np.flatnonzero(np.isin(kinds, HOSTILE))
        if not len(hits):
            continue
        clause = _clauses(data, w)
        for number in np.unique(clause[hits]):
            a, b = np.searchsorted(clause, [number, number + 1])
            row = w.first + int(np.searchsorted(w.bounds, a, side="right")) - 1
            for pattern in clause_patterns(kinds[a:b].tolist()):
                counts[row, pattern] += 1
    return counts


def _features(counts: np.ndarray) -> np.ndarray:
    """A constant, the logarithms of the counts, and of how many insults stand in a hundred words."""
    found, words = counts[:, :-1], np.maximum(counts[:, -1], 1)
    dense = [np.log1p(100 * found[:, at : at + 2].sum(axis=1) / words) for at in (0, len(PATTERNS) - len(MARKS))]
    return np.column_stack((np.ones(len(counts)), np.log1p(found), *dense))


def _fitted(x: np.ndarray, y: np.ndarray, spread: float = 3.0) -> np.ndarray:
    """Logistic weights near the prior ones: Newton steps on the penalised likelihood."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - (w - PRIOR) / spread**2
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(len(w)) / spread**2, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


UNIT_COUNTS = "unit long, toxic_texts long, toxic_contexts long, clean_contexts long"
HELD = 1 << 21


class _Distinct:
    """Distinct 64-bit keys of many blocks. No more than twice ``HELD`` keys lie beside the distinct ones."""

    def __init__(self):
        self.keys, self.new, self.waiting = np.zeros(0, np.uint64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(np.unique(keys))
        self.waiting += len(self.new[-1])
        if self.waiting > HELD:
            self.merge()

    def merge(self) -> np.ndarray:
        fresh, self.new, self.waiting = np.unique(np.concatenate((*self.new, self.keys[:0]))), [], 0
        fresh = fresh[~np.isin(fresh, self.keys, assume_unique=True)]
        self.keys = np.concatenate((self.keys, fresh))
        self.keys.sort()
        return self.keys


def _blocks(batch: pa.RecordBatch, seen: int):
    """For each block the numbers of the texts of its words, their labels, the words before, and the units column by column."""
    labels = batch.column(1).to_numpy(zero_copy_only=False) > 0
    for data, w in word_blocks(batch.column(0), ALNUM):
        if len(w.start):
            row = np.repeat(np.arange(w.first, w.last), np.diff(w.bounds))
            before = mixed(np.concatenate((np.zeros(1, np.uint64), w.hash[:-1])))
            for unit in _units(data, w.start, w.end, w.hash).T:
                yield (row + seen).astype(np.uint64), labels[row], before, unit


def _spread_units(toxic: DataFrame, least_texts: int) -> DataFrame:
    """Units that at least ``least_texts`` texts of a task hold."""

    def scan(batches):
        units, counts, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for text, _, _, unit in _blocks(batch, seen):
                full = np.flatnonzero(unit)
                once = full[np.unique(mixed(unit[full] ^ mixed(text[full] + np.uint64(1))), return_index=True)[1]]
                held, n = np.unique(unit[once], return_counts=True)
                every, at = np.unique(np.concatenate((units, held)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, n)), len(every)).astype(np.int64)
                units = every
            seen += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(units[counts >= least_texts].view(np.int64))], names=["unit"])

    return toxic.select("text", "toxic").mapInArrow(scan, "unit long")


def _unit_contexts(sample: DataFrame, wanted: np.ndarray) -> DataFrame:
    """For each wanted unit, in how many toxic texts it stands, and after how many different words in toxic and clean texts.

    Counting contexts, not occurrences, keeps the words of a text with many copies from
    looking like insults; the count of texts rules out what only one long text repeats. A
    task holds eight bytes for each different (unit, text) and (unit, word before), whose hash keeps 32 bits.
    """

    def scan(batches):
        texts, contexts, seen = _Distinct(), _Distinct(), 0
        for batch in batches:
            for text, toxic, before, unit in _blocks(batch, seen):
                at = np.searchsorted(wanted, unit)
                at[at == len(wanted)] = 0
                full = np.flatnonzero(wanted[at] == unit) if len(wanted) else at[:0]
                owner, mark = at[full].astype(np.uint64), toxic[full]
                texts.add(owner[mark] << np.uint64(32) | text[full[mark]])
                contexts.add(owner << np.uint64(33) | before[full] >> np.uint64(32) << np.uint64(1) | mark.astype(np.uint64))
            seen += len(batch)
        by_text, by_context = texts.merge() >> np.uint64(32), contexts.merge()
        marked = (by_context & np.uint64(1)).astype(bool)
        owner = (by_context >> np.uint64(33)).astype(np.int64)
        counts = [np.bincount(rows, minlength=len(wanted)) for rows in (by_text.astype(np.int64), owner[marked], owner[~marked])]
        full = np.flatnonzero(sum(counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[full]) for c in (wanted.view(np.int64), *counts)], names=[c.split()[0] for c in UNIT_COUNTS.split(", ")]
        )

    return sample.select("text", "toxic").mapInArrow(scan, UNIT_COUNTS)


def _fitted_model(
    docs: DataFrame, labels: DataFrame, held_out: int, text: str,
    toxic_sample: int, clean_sample: int,
) -> Model:
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(bucket_of(F.col("doc_id"), held_out) != 0).withColumn("order", F.xxhash64("doc_id"))
    bounds = ((1, toxic_sample), (0, clean_sample))
    parts = [marks.where((F.col("toxic") > 0).cast("int") == kind).orderBy("order").limit(bound) for kind, bound in bounds]
    chosen = materialize(parts[0].union(parts[1]).select(F.col("doc_id").alias("label_id"), (F.col("toxic") > 0).cast("int").alias("toxic")), "labelled")
    # The chosen ids are bounded by the two parameters, so they may be broadcast.
    texts = docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    sample = materialize(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "toxic"), "labelled-texts").coalesce(4)
    sums = [F.sum(c).alias(c) for c in ("toxic_texts", "toxic_contexts", "clean_contexts")]
    # Five texts in four tasks are two in one of them; the sample bounds how many units that can be.
    spread = _spread_units(sample.where("toxic = 1"), least_texts=2).distinct().toPandas()
    wanted = np.sort(spread["unit"].to_numpy(np.int64).view(np.uint64))
    counted = materialize(_unit_contexts(sample, wanted).groupBy("unit").agg(*sums), "units")
    units = _seed_units()
    total = counted.agg(F.sum("toxic_contexts").alias("t"), F.sum("clean_contexts").alias("c")).first()
    if total.t and total.c:
        share = total.t / (total.t + total.c)
        t, c = F.col("toxic_contexts"), F.col("clean_contexts")
        ratio = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
        odds = (t / total.t) / ((c + F.lit(0.1)) / total.c)
        learned = counted.where((F.col("toxic_texts") >= 5) & (t >= 6) & (odds >= 8) & (ratio >= 40)).select("unit", odds.alias("odds"), ratio.alias("ratio"))
        for row in learned.orderBy(F.desc("ratio"), "unit").limit(LEARNED).collect():
            units.setdefault(row.unit % (1 << 64), INSULT if row.odds >= 100 else DOUBTFUL)
    codes = np.array(sorted(units), np.uint64)
    classes = np.array([units[int(c)] for c in codes], np.int8)

    def scan(batches):
        for batch in batches:
            counts = pattern_counts(batch.column(0), codes, classes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(counts.tolist(), pa.list_(pa.float64()))], names=["toxic", "counts"]
            )

    shown = sample.select("text", "toxic").mapInArrow(scan, "toxic int, counts array<double>").groupBy("toxic", "counts").count().toPandas()
    weights = PRIOR
    if shown["toxic"].nunique() == 2:
        x = np.repeat(_features(np.array(shown["counts"].tolist())), shown["count"], axis=0)
        weights = _fitted(x, np.repeat(shown["toxic"].to_numpy(float), shown["count"]))
    return Model(codes, classes, weights)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, held_out: int = 5, text: str = "text",
    toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE,
) -> Model:
    """Learn insulting words, word beginnings and pattern weights.

    Only documents whose id's crc32 is not divisible by ``held_out`` are used, of these at
    most ``toxic_sample`` and ``clean_sample``, those with the smallest id hash. A unit
    insults if it is 100 times as frequent in toxic texts, and doubtfully so from 8 times on;
    the likelihood ratio against equal frequency must be beyond chance. A document with several labels
    counts as toxic if one says so; null labels are left out. Without labels the fixed words
    and prior weights remain.
    """
    with small_batches(docs.sparkSession):
        return _fitted_model(docs, labels, held_out, text, toxic_sample, clean_sample)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Each whole text is scored by itself, on its row, with no shuffle. A null or empty text
    has no clause and gets the score of the constant alone. Repeated rows get equal scores.
    Columns called ``score`` or ``predicted`` are replaced.
    """
    codes, classes, weights = model

    @arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        x = _features(pattern_counts(texts, codes, classes))
        return pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), pa.float64())

    rows = boxed(docs).select("row", scores(F.col(f"row.`{text}`")).alias("score"))
    return unboxed(rows, docs.columns, score=F.col("score"), predicted=(F.col("score") >= 0.5).cast("int"))
