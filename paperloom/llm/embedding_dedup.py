"""Embedding near-dedup: one navigable small-world graph a shard, every vector asked of every shard."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import hnsw
from paperloom.llm.common import boxed, unboxed
from paperloom.llm.graphs import components
from paperloom.session import materialize

SHARD_BYTES, BLOCK_QUERIES, DENSE_AT_ONCE = 8 << 20, 16_384, 2_000_000
# The first beam, how many queries are audited, the recall they must reach, and what rounding may turn an angle by.
BEAM, AUDITED, RECALL, SLACK = 32, 4096, 0.99, 1e-6


def unit_vector(values: list | None) -> np.ndarray | None:
    """A vector of length one in double precision; None for a null or zero vector or one with a null or non-finite component."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.array(values, float)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _units(vectors: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            units = [unit_vector(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], names=["vec_id", "unit"]
            )

    return vectors.mapInArrow(scan, "vec_id long, unit binary")


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, width)


def _shard_graphs(classes: DataFrame) -> DataFrame:
    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])
        shard, width = table.column("shard")[0].as_py(), table.column("width")[0].as_py()
        graph = hnsw.build(_matrix(table.column("unit"), width), seed=shard)
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "width": pa.array([width], pa.int32()), "graph": pa.array([graph.to_bytes()], pa.binary()),
            "reps": pa.array([table.column("rep").to_pylist()], pa.list_(pa.int64())),
            "copies": pa.array([table.column("copies").to_pylist()], pa.list_(pa.int64())),
        })

    return classes.groupBy("shard", "width").applyInArrow(grow, "shard int, width int, graph binary, reps array<long>, copies array<long>")


def dense_links(vectors: np.ndarray, weights: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many of the weighted vectors each query of a dense group links with, and edges that join what they link.

    Some query is a pivot for all that link with it. By their angles to the pivot, vectors
    near it surely link with a query and those far from it surely don't; only those between are
    compared, in blocks of a matrix product that are counted and forgotten. Of the edges
    ``(kind, a, b)``, those of kind 0 join two queries, those of kind 1 a query and a
    vector: each query with its pivot, and each vector with the pivot or the first query that it links with.
    """
    counts, edges, todo = np.zeros(len(queries), np.int64), [], np.arange(len(queries))
    turn = np.arccos(threshold)
    while len(todo):
        pivot = todo[0]
        own = queries[todo] @ queries[pivot]
        own[0] = 1.0
        mine, todo = todo[own >= threshold], todo[own < threshold]
        angle = np.arccos(np.clip(vectors @ queries[pivot], -1, 1))
        order = np.argsort(angle)
        angle, total = angle[order], np.concatenate(([0], np.cumsum(weights[order])))
        lean = np.arccos(np.clip(own[own >= threshold], -1, 1))
        by_lean = np.argsort(lean)
        mine, lean = mine[by_lean], lean[by_lean]
        sure = np.searchsorted(angle, turn - lean - SLACK, side="right")
        last = np.searchsorted(angle, turn + lean + SLACK, side="right")
        counts[mine] = total[sure]
        open_ = np.zeros(len(vectors), bool)
        open_[: np.searchsorted(angle, 2 * turn + SLACK, side="right")] = True
        at = 0
        while at < len(mine):
            low, high = int(sure[at:].min()), int(last[at:].max())
            step = max(1, DENSE_AT_ONCE // max(1, high - low))
            rows = slice(at, at + step)
            at += step
            if low == high:
                continue
            some, place = order[low:high], np.arange(low, high)
            hit = queries[mine[rows]] @ vectors[some].T >= threshold
            hit &= (place >= sure[rows, None]) & (place < last[rows, None])
            counts[mine[rows]] += hit @ weights[some]
            first = hit.argmax(axis=0)
            new = np.flatnonzero(hit.any(axis=0) & open_[low:high])
            edges.append((1, mine[rows][first[new]], some[new]))
            open_[low + new] = False
        held = np.flatnonzero(open_[: sure.max(initial=0)])  # what is surely linked with the query nearest to the pivot
        edges.append((1, np.full(len(held), mine[int(sure.argmax())]), order[held]))
        edges.append((0, mine, np.full(len(mine), pivot)))
    return counts, edges


def _others(q: np.ndarray, v: np.ndarray, ids: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without those of a query with itself."""
    other = ids[q] != reps[v]
    return q[other], v[other]


def true_links(graph: hnsw.Graph, queries: np.ndarray, ids: np.ndarray, reps: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, vector) pairs of different ids that link, by brute force."""
    step, found = max(1, DENSE_AT_ONCE // max(1, len(reps))), []
    for at in range(0, len(queries), step):
        q, v = np.nonzero(queries[at : at + step] @ graph.vectors.T >= threshold)
        found.append(_others(at + q, v, ids, reps))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a star for each component of an edge list: as many as needed to join the same nodes."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _found(graph, reps, copies, ids, queries, threshold: float, beam: int) -> pa.RecordBatch:
    """Links of a block of queries in one shard: a count a query, and the edges of spanning stars."""
    q, v, full = hnsw.linked(graph, queries, threshold, beam)
    q, v = _others(q, v, ids, reps)
    links = np.bincount(q, copies[v], minlength=len(ids)).astype(np.int64)
    a, b = spanning(ids[q], reps[v]) if len(q) else (ids[:0], ids[:0])
    ends = [(a, b)]
    if len(full):
        counts, edges = dense_links(graph.vectors, copies, queries[full], threshold)
        ends += [(ids[full[x]], ids[full[y]] if kind == 0 else reps[y]) for kind, x, y in edges]
        place = np.minimum(np.searchsorted(reps, ids[full]), len(reps) - 1)
        links[full] = counts - np.where(reps[place] == ids[full], copies[place], 0)
    a, b = (np.concatenate(c) for c in zip(*ends))
    asked = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((ids[asked], a))), pa.array([*links[asked].tolist(), *[None] * len(a)], pa.int64()),
            pa.array([*[None] * len(asked), *b.tolist()], pa.int64()),
        ],
        names=["node", "links", "other"],
    )


def _audit(graph, reps, copies, ids, queries, threshold: float, beam: int) -> pa.RecordBatch:
    """How many links the queries truly have in a shard, and how many of them are found: all of a full query, as it is answered in full."""
    size, links, found = len(reps), 0, 0
    step = max(1, DENSE_AT_ONCE // max(1, size))
    for at in range(0, len(ids), hnsw.SEARCHED_AT_ONCE):
        some, own = queries[at : at + hnsw.SEARCHED_AT_ONCE], ids[at : at + hnsw.SEARCHED_AT_ONCE]
        found_q, found_v, full = hnsw.linked(graph, some, threshold, beam)
        for low in range(0, len(own), step):
            # Few queries at a time: in a dense group each has as many links as the shard has vectors of it.
            q, v = true_links(graph, some[low : low + step], own[low : low + step], reps, threshold)
            hit = np.isin((low + q) * size + v, found_q * size + found_v) | np.isin(low + q, full)
            links += len(q)
            found += int(hit.sum())
    return pa.RecordBatch.from_arrays([pa.array([links], pa.int64()), pa.array([found], pa.int64())], names=["links", "found"])


def _answers(block: Callable[..., pa.RecordBatch]):
    """``block`` of one shard and one block of queries after the other; each block begins with the shard's graph."""

    def answer(batches):
        graph, ids, queries = None, [], []
        for batch in batches:
            graphs, vectors, reps = batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(len(batch)):
                if graphs[i].is_valid:
                    if ids:
                        yield block(*graph, np.array(ids), _stack(queries))
                        ids, queries = [], []
                    graph = (
                        hnsw.Graph.from_bytes(graphs[i].as_py()), np.array(batch.column(4)[i].as_py(), np.int64), np.array(batch.column(5)[i].as_py(), np.int64)
                    )
                    continue
                ids.append(reps[i])
                queries.append(vectors[i])
        if ids:
            yield block(*graph, np.array(ids), _stack(queries))

    return answer


def _met(queries: DataFrame, graphs: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Every query with every shard's graph of its length, one (shard, block of queries) a partition, the graph first."""
    block = F.pmod(F.xxhash64("spread"), F.lit(blocks)).cast("int")
    no_list = F.lit(None).cast("array<long>")
    asked = queries.select(
        "width", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"),
        F.lit(None).cast("binary").alias("graph"), "unit", "rep", no_list.alias("reps"), no_list.alias("copies"),
    )
    told = graphs.select(
        "width", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", F.lit(0).alias("kind"), "graph",
        F.lit(None).cast("binary").alias("unit"), F.lit(None).cast("long").alias("rep"), "reps", "copies",
    )
    # A block of a length that a shard lacks has no graph to ask.
    met = asked.join(F.broadcast(graphs.select("shard", "width")), ["shard", "width"], "left_semi").unionByName(told)
    cell = (F.col("shard") * blocks + F.col("block")).cast("int")
    dealt = met.repartitionById(shards * blocks, cell).sortWithinPartitions("shard", "block", "width", "kind")
    return dealt.select("kind", "graph", "unit", "rep", "reps", "copies")


class Audit(NamedTuple):
    """The beam that passed, how many true links the audited queries have, and how many of them the search finds."""

    beam: int
    links: int
    found: int

    def recall(self) -> float:
        return self.found / self.links if self.links else 1.0

    def least_recall(self, z: float = 1.96) -> float:
        """The lower end of the recall's Wilson interval; zero without a link."""
        n, p = self.links, self.recall()
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) if n else 0.0


def audited_beam(queries: DataFrame, graphs: DataFrame, shards: int, largest: int, threshold: float, beam: int, recall: float) -> Audit:
    """The first of the beams, each twice as wide as the one before, whose recall over all shards is at least ``recall``.

    ``queries`` are a bounded sample of all vectors; each shard tells their true links by
    brute force, and matches with oneself don't count.
    """
    while True:

        def block(*cell, beam=beam):
            return _audit(*cell, threshold, beam)

        told = _met(queries, graphs, shards, 1).mapInArrow(_answers(block), "links long, found long").agg(F.sum("links").alias("links"), F.sum("found").alias("found")).first()
        audit = Audit(beam, told.links or 0, told.found or 0)
        if audit.found >= recall * audit.links or beam >= largest:
            return audit
        beam *= 2


def _stack(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), float).reshape(len(units), -1)


def linked_and_audited(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, shard_bytes: int = SHARD_BYTES, beam: int = BEAM,
    audited: int = AUDITED, recall: float = RECALL,
) -> tuple[DataFrame, Audit]:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``, and the audit of the search behind them.

    Vectors link if their cosine, in double precision, is at least ``threshold``. ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id reachable by
    links, the row's own included, and ``kept`` says whether that is its own.

    A null or zero vector, one with a null or non-finite component, or one whose id is null
    links with nothing. Vectors of different length never link. Rows that give the same unit
    vector are one class: they link with each other, count with their number, and are
    searched once. Columns of these names are replaced. An empty table gives no rows.

    Every class is in the graph of one shard and is asked of all shards; graphs are bounded
    by ``shard_bytes``, so their number grows with the table. About ``audited`` classes,
    chosen by hash, tell the true links of a sample by brute force, and the beam is doubled until ``recall`` of
    them are found. A query whose beam is full of links lies in a dense group, whose links are
    counted in blocks of a matrix product (``dense_links``). Each task hands on one count a query
    and edges that span what is linked, so a group of linked vectors costs rows by its size, not its pairs.
    """
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    units = materialize(_units(named.where("vec_id IS NOT NULL")).where("unit IS NOT NULL"), "units")
    classes = units.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.select("*", (F.octet_length("unit") / 8).cast("int").alias("width"), F.xxhash64("unit").alias("spread")), "classes")
    size = classes.agg(F.sum(F.octet_length("unit")).alias("bytes"), F.count("*").alias("n")).first()
    shards = max(1, -(-int(size.bytes or 0) // shard_bytes))
    blocks = max(1, -(-size.n // BLOCK_QUERIES))
    classes = classes.select("*", F.pmod("spread", F.lit(shards)).cast("int").alias("shard"))
    graphs = materialize(_shard_graphs(classes), "graphs")
    sample = classes.where(F.pmod(F.xxhash64("spread", F.lit(1)), F.lit(max(1, size.n // audited))) == 0)
    largest = graphs.agg(F.max(F.size("reps"))).first()[0] or 1
    audit = audited_beam(sample, graphs, shards, largest, threshold, beam, recall)

    def block(*cell):
        return _found(*cell, threshold, audit.beam)

    answers = materialize(_met(classes, graphs, shards, blocks).mapInArrow(_answers(block), "node long, links long, other long"), "answers")
    counts = answers.where("links IS NOT NULL").groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    labels = components(answers.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    found = classes.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("label", "rep").alias("label")
    )
    found = materialize(found, "found")
    by_id = units.join(found, "unit").groupBy("vec_id").agg(F.max("links").alias("links"), F.min("label").alias("label"))
    rows = boxed(vectors, vec_id=F.col(f"`{vec_id}`").cast("long")).join(by_id, "vec_id", "left")
    label = F.coalesce("label", "vec_id")
    linked = unboxed(
        rows, vectors.columns, n_links=F.coalesce("links", F.lit(0)).cast("long"), component_id=label, kept=F.coalesce(label == F.col("vec_id"), F.lit(True))
    )
    return linked, audit


def link_vectors(vectors: DataFrame, **options) -> DataFrame:
    """The vectors of ``linked_and_audited`` alone."""
    return linked_and_audited(vectors, **options)[0]
