"""Mentions of a dictionary of any size: an automaton of all literals reads each text once.

The dictionary is a table. It is dealt into shards bounded in bytes, each of which is broadcast
and made into one automaton in every worker. Texts stay where they are; what shards find in
a document meets again by its id, where longer literals win.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, reduce
from itertools import accumulate, chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.ranking import numbered
from paperloom.session import materialize

# Bytes of literals in a shard, each of which takes some ten times as much in a worker.
SHARD_BYTES = 8 << 20
# Hits that a task holds before it hands them on.
HITS_AT_ONCE = 1 << 16
# Parts of the documents that hits of one literal are dealt into where they are shuffled.
PARTS = 32


class _Fold(dict):
    """Code points to their simple case folding, so a folded text keeps its length."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        upper = char.upper()
        low = (upper if len(upper) == 1 else char).lower()
        self[code] = ord(low) if len(low) == 1 else code
        return self[code]


_FOLD = _Fold()


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


def _in_word(char: str) -> bool:
    return char.isalnum() or char == "_"


# What ``_in_word`` tells of a character, as a pattern: runs of such characters.
RUN = re.compile(r"\w+")
# The one character that isn't in a word but is once folded.
IOTA_BELOW = "\u0345"


class Machine:
    """Numbered literals; of literals that differ in case alone the first counts.

    A literal that is one run of word characters stands only where a run of a text is that literal, so runs
    are looked up among ``words``, and only the ``others`` need an automaton.
    """

    def __init__(self, literals: Iterable[tuple[int, str]]):
        self.words, rest = {}, {}
        for number, literal in literals:
            key = folded(literal)
            if not key or key in self.words or key in rest:
                continue
            whole = literal[0].isalnum() and literal[-1].isalnum()
            if whole and RUN.fullmatch(literal):
                self.words[key] = number
            else:
                rest[key] = (number, len(key), whole)
        self.rest, self.others = rest, _automaton(rest)

    @cached_property
    def all(self):
        """An automaton of all literals, for texts whose runs change as they are folded."""
        return _automaton(self.rest | {key: (number, len(key), True) for key, number in self.words.items()})


def _automaton(literals: dict[str, tuple[int, int, bool]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for key, value in literals.items():
        machine.add_word(key, value)
    if len(machine):
        machine.make_automaton()
    return machine


def automaton(literals: Iterable[tuple[int, str]]) -> Machine:
    """What ``occurrences`` looks for in a text: numbered literals."""
    return Machine(literals)


def occurrences(machine: Machine, text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, end, literal)`` wherever a literal stands; one that begins and ends in a letter or digit only as whole words.

    Of places of one literal that overlap, the first from the left counts, then the next one free of it.
    """
    low, words, others, free = folded(text), machine.words, machine.others, {}
    if words and IOTA_BELOW in text:
        others = machine.all
    elif words:
        for run in RUN.finditer(low):
            number = words.get(run.group())
            if number is not None:
                yield *run.span(), number
    if not len(others):
        return
    for last, (number, size, word) in others.iter(low):
        start, end = last + 1 - size, last + 1
        if word and ((start and _in_word(text[start - 1])) or (end < len(text) and _in_word(text[end]))):
            continue
        if start >= free.get(number, 0):
            free[number] = end
            yield start, end, number


def longest_first(hits: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Hits that no longer one overlaps, in the order of the text; of equally long ones the smaller number, then the earlier place, wins."""
    hits = sorted(hits)
    if all(a[1] <= b[0] for a, b in pairwise(hits)):
        return hits
    starts, ends, kept = [], [], []
    for start, end, number in sorted(hits, key=lambda h: (h[0] - h[1], h[2], h[0])):
        at = bisect.bisect_right(starts, start)
        if (at and ends[at - 1] > start) or (at < len(starts) and starts[at] < end):
            continue
        starts.insert(at, start)
        ends.insert(at, end)
        kept.append((start, end, number))
    return sorted(kept)


class Shard:
    """Numbered literals of one shard; a worker makes their automaton once."""

    def __init__(self, literals: list[tuple[int, str]]):
        self.literals = literals

    @cached_property
    def machine(self):
        return automaton(self.literals)


HIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("literal", pa.int32()), ("mention", pa.string())])
HITS = "array<struct<start:int,end:int,literal:int,mention:string>>"


def _hits_of(docs: DataFrame, shard, resolve: bool) -> DataFrame:
    """``(doc_id, hits)`` of one broadcast shard; with ``resolve`` longer literals have won already."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shard.value.machine
        def of(text: str | None) -> list[tuple]:
            hits = occurrences(machine, text or "")
            return [(*hit, text[hit[0] : hit[1]]) for hit in (longest_first(hits) if resolve else hits)]

        for batch in batches:
            yield from _pieces(batch.column(0), (of(text.as_py()) for text in batch.column(1)))

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, hits {HITS}")


def _pieces(ids: pa.Array, found: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    """Hits of the rows of a batch, handed on whenever there are ``HITS_AT_ONCE``."""
    at, rows, count = 0, [], 0
    for hits in found:
        rows.append(hits)
        count += len(hits)
        if count >= HITS_AT_ONCE:
            yield _batch(ids.slice(at, len(rows)), rows)
            at, rows, count = at + len(rows), [], 0
    if rows:
        yield _batch(ids.slice(at, len(rows)), rows)


def _batch(ids: pa.Array, rows: list[list[tuple]]) -> pa.RecordBatch:
    columns = zip(*chain.from_iterable(rows)) if any(rows) else [()] * len(HIT)
    hits = pa.StructArray.from_arrays([pa.array(values, field.type) for values, field in zip(columns, HIT)], fields=list(HIT))
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, hits)], names=["doc_id", "hits"])


def _resolved(found: DataFrame) -> DataFrame:
    """Hits of a document from several shards, longer ones first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(hits: list[dict]) -> list[tuple]:
            said = {(h["start"], h["end"], h["literal"]): h["mention"] for h in hits}
            return [(*hit, said[hit]) for hit in longest_first(said)]

        for batch in batches:
            yield from _pieces(batch.column(0), (of(hits.as_py()) for hits in batch.column(1)))

    together = found.where(F.size("hits") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return together.mapInArrow(scan, f"doc_id {dict(found.dtypes)['doc_id']}, hits {HITS}")


def dictionary_mentions(docs: DataFrame, aliases: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, start, end, mention, entity_type, normalized_id)`` of ``docs(doc_id, text)`` with unique ids.

    ``aliases(alias, entity_type, normalized_id)`` may be of any size. Matching is
    case-insensitive and, for literals that begin and end in a letter or digit, of whole words.
    Longer literals win over shorter ones that they overlap, wherever their shards are; of
    equally long ones the first in the order of their texts. Aliases that differ in case alone are
    one literal. An alias may stand for several entities, each of which gives a row. Null and
    empty aliases are left out.

    With one shard a document is read and resolved in its place and never shuffled. With
    several it is read once for each, and its hits meet by ``doc_id``. What literals mean is broadcast
    where it takes no more than a shard; a larger table of meanings meets the hits by literal and
    part of the documents, so that a frequent word is not the task of one.
    """
    spark = docs.sparkSession
    given = aliases.where("alias IS NOT NULL AND alias <> ''").select("alias", "entity_type", "normalized_id").distinct()
    given = materialize(given.withColumn("low", F.lower("alias")), "aliases")
    texts = numbered(given.groupBy("low").agg(F.min("alias").alias("alias")), "low", "number")
    texts = texts.select("low", "alias", (F.col("number") - 1).cast("int").alias("literal"))
    sizes = given.agg(F.sum(F.octet_length("alias")), F.sum(F.octet_length(F.concat_ws("", "alias", "entity_type", "normalized_id")))).first()
    shards = max(1, -(-int(sizes[0] or 0) // shard_bytes))
    dealt = materialize(texts.withColumn("shard", F.pmod(F.xxhash64("low"), F.lit(shards)).cast("int")), "literals")
    parts = []
    for number in range(shards):
        # About shard_bytes of literals: what is collected and broadcast has that bound.
        rows = dealt.where(F.col("shard") == number).select("literal", "alias").orderBy("literal").collect()
        parts.append(_hits_of(docs, spark.sparkContext.broadcast(Shard([(r.literal, r.alias) for r in rows])), resolve=shards == 1))
    hits = parts[0] if shards == 1 else _resolved(reduce(DataFrame.unionByName, parts))
    spans = hits.select("doc_id", F.inline("hits"))
    meant = dealt.join(given.drop("alias"), "low").select("literal", "entity_type", "normalized_id")
    if (sizes[1] or 0) <= shard_bytes:
        found = spans.join(F.broadcast(meant), "literal")
    else:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part")
        copies = meant.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        found = spans.select("*", part).join(copies, ["literal", "part"])
    return found.select("doc_id", "start", "end", "mention", "entity_type", "normalized_id")
