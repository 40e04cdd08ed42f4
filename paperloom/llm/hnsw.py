"""Hierarchical navigable small-world graphs in numpy, built and searched for many vectors at once."""

from __future__ import annotations

import io

import numpy as np

LINKS, BUILD_BEAM, INSERTED_AT_ONCE, SEARCHED_AT_ONCE, EXPANDED = 16, 48, 256, 512, 4


class Graph:
    """Unit vectors and, for each level, up to ``LINKS`` neighbours of each vector (-1 where none)."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray], entry: int):
        self.vectors, self.neighbours, self.entry = vectors, neighbours, entry
        self.near = vectors.astype(np.float32)

    def to_bytes(self) -> bytes:
        """Of each level only the vectors that have neighbours there, which are few in the upper ones."""
        out, levels = io.BytesIO(), {}
        for n, links in enumerate(self.neighbours):
            linked = np.flatnonzero((links >= 0).any(axis=1))
            levels |= {f"linked{n}": linked.astype(np.int32), f"level{n}": links[linked].astype(np.int32)}
        np.savez(out, vectors=self.vectors, entry=self.entry, **levels)
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> "Graph":
        kept = np.load(io.BytesIO(raw))
        vectors, levels = kept["vectors"], []
        for n in range((len(kept.files) - 2) // 2):
            some = kept[f"level{n}"]
            levels.append(np.full((len(vectors), some.shape[1]), -1, np.int64))
            levels[-1][kept[f"linked{n}"]] = some
        return Graph(vectors, levels, int(kept["entry"]))


def beam_search(near: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` vectors found for each query (indexes, -1 padded, and similarities, falling)."""
    count, beam = len(queries), max(beam, entries.shape[1])
    rows = np.arange(count)
    ids = np.full((count, beam), -1, np.int64)
    sims = np.full((count, beam), -np.inf, np.float32)
    ids[:, : entries.shape[1]] = entries
    sims[:, : entries.shape[1]] = np.where(entries >= 0, np.einsum("bed,bd->be", near[entries], queries), -np.inf)
    open_ = ids >= 0
    seen = np.zeros((count, len(near) + 1), bool)  # the last column stands for -1
    seen[rows[:, None], ids] = True
    while True:
        active = np.flatnonzero(open_.any(axis=1))
        if not len(active):
            break
        waiting = np.where(open_[active], sims[active], -np.inf)
        step = min(EXPANDED, beam)
        best = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
        chosen = np.where(np.take_along_axis(waiting, best, 1) > -np.inf, np.take_along_axis(ids[active], best, 1), -1)
        open_[active[:, None], best] = False
        found = np.where(chosen[:, :, None] >= 0, neighbours[chosen], -1).reshape(len(active), -1)
        found = np.sort(found, axis=1)
        fresh = (found >= 0) & ~seen[active[:, None], found]
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen[active[:, None], found] = True
        width = int(fresh.sum(axis=1).max())
        if not width:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        found = np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(found, order, 1), -1)
        new = np.where(found >= 0, np.einsum("bed,bd->be", near[found], queries[active]), -np.inf).astype(np.float32)
        all_ids, all_sims = np.hstack((ids[active], found)), np.hstack((sims[active], new))
        all_open = np.hstack((open_[active], found >= 0))
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
        open_[active] = np.take_along_axis(all_open, top, 1) & (ids[active] >= 0)
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def diverse(near: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Of candidates sorted by similarity, those closer to their vector than to any kept one; the nearest others fill up."""
    width = ids.shape[1]
    points = near[ids]
    between = np.einsum("bkd,bjd->bkj", points, points)
    kept = np.zeros(ids.shape, bool)
    for j in range(width):
        covered = (kept & (between[:, j, :] > sims[:, j, None])).any(axis=1)
        kept[:, j] = (ids[:, j] >= 0) & ~covered & (kept.sum(axis=1) < links)
    order = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :links]
    return np.pad(np.take_along_axis(ids, order, 1), ((0, 0), (0, max(0, links - width))), constant_values=-1)


def _link_back(near: np.ndarray, level: np.ndarray, new: np.ndarray) -> None:
    """Add the new vectors to their neighbours' lists, pruned as they overflow."""
    source, target = np.repeat(new, level.shape[1]), level[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    sim = np.einsum("ed,ed->e", near[source], near[target])
    order = np.lexsort((-sim, target))
    source, target = source[order], target[order]
    hosts, first, size = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, size)
    width = min(int(size.max()), 2 * LINKS) if len(size) else 0
    table = np.full((len(hosts), width), -1, np.int64)
    fits = rank < width
    table[np.repeat(np.arange(len(hosts)), size)[fits], rank[fits]] = source[fits]
    for at in range(0, len(hosts), 1024):
        some = hosts[at : at + 1024]
        ids = np.hstack((level[some], table[at : at + 1024]))
        ids = -np.sort(-ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = np.where(ids >= 0, np.einsum("bed,bd->be", near[ids], near[some]), -np.inf)
        order = np.argsort(-sims, axis=1)
        level[some] = diverse(near, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), LINKS)


def _all_reached(near: np.ndarray, level: np.ndarray, entry: int) -> np.ndarray:
    """The bottom level with a further link to every vector that no walk from the entry would reach."""
    while True:
        reached, front = np.zeros(len(near), bool), np.array([entry])
        while len(front):
            reached[front] = True
            front = np.unique(level[front])
            front = front[front >= 0]
            front = front[~reached[front]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return level
        hosts = np.empty(len(lost), np.int64)
        for at in range(0, len(lost), SEARCHED_AT_ONCE):
            some = lost[at : at + SEARCHED_AT_ONCE]
            hosts[at : at + len(some)] = beam_search(near, level, near[some], np.full((len(some), 1), entry), BUILD_BEAM)[0][:, 0]
        extra = np.full((len(near), 1), -1)
        extra[hosts, 0] = lost
        level = np.hstack((level, extra))


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    """A graph of unit vectors, inserted in a random order, some hundred at a time."""
    n, rng = len(vectors), np.random.default_rng(seed)
    near = vectors.astype(np.float32)
    height = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 5)
    order = rng.permutation(n)
    order = np.concatenate((order[np.argmax(height[order])][None], np.delete(order, np.argmax(height[order]))))
    top = int(height[order[0]])
    levels = [np.full((n, LINKS), -1, np.int64) for _ in range(top + 1)]
    entry, at = int(order[0]), 1
    while at < n:
        new = order[at : at + min(INSERTED_AT_ONCE, max(1, at))]
        at += len(new)
        entries = np.full((len(new), 1), entry)
        for level in range(top, -1, -1):
            ids, sims = beam_search(near, levels[level], near[new], entries, BUILD_BEAM if level <= height[new].max() else 1)
            mine = np.flatnonzero(height[new] >= level)
            if len(mine):
                members = new[mine]
                among = near[members] @ near[members].T
                np.fill_diagonal(among, -np.inf)
                closest = np.argsort(-among, axis=1)[:, :LINKS]
                every = np.hstack((ids[mine], members[closest]))
                scores = np.hstack((sims[mine], np.take_along_axis(among, closest, 1)))
                every[scores == -np.inf] = -1
                rank = np.argsort(-scores, axis=1)
                levels[level][members] = diverse(near, np.take_along_axis(every, rank, 1), np.take_along_axis(scores, rank, 1), LINKS)
                _link_back(near, levels[level], members)
            entries = ids[:, : min(4, ids.shape[1])]
    levels[0] = _all_reached(near, levels[0], entry)
    return Graph(vectors, levels, entry)


def nearest(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search from the top level down to the bottom."""
    near = queries.astype(np.float32)
    entries = np.full((len(queries), 1), graph.entry)
    for level in reversed(graph.neighbours[1:]):
        entries = beam_search(graph.near, level, near, entries, 4)[0][:, :4]
    return beam_search(graph.near, graph.neighbours[0], near, entries, beam)


def linked(graph: Graph, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector) index pairs of a cosine of at least ``threshold``, verified in double precision, and the full queries.

    A query is full if all of its beam may pass; it has no pairs here, as it may have any number of links.
    """
    pairs, full, size = [(np.zeros(0, np.int64),) * 2], [np.zeros(0, np.int64)], len(graph.vectors)
    step = max(1, SEARCHED_AT_ONCE * 32 // max(32, beam))
    for at in range(0, len(queries), step):
        ids, sims = nearest(graph, queries[at : at + step], min(beam, size))
        close = (sims >= threshold - 1e-3) & (ids >= 0)
        whole = close.all(axis=1) & (beam < size)
        full.append(at + np.flatnonzero(whole))
        q, k = np.nonzero(close & ~whole[:, None])
        vector = ids[q, k]
        sure = np.einsum("ed,ed->e", queries[at + q], graph.vectors[vector]) >= threshold
        pairs.append((at + q[sure], vector[sure]))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), np.concatenate(full)
