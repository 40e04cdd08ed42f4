"""Jaccard join, embedding links and components against brute force."""

import random
import re

import numpy as np
import pytest

from paperloom.llm import embedding_dedup, hnsw, jaccard_join
from paperloom.llm.embedding_dedup import link_vectors
from paperloom.llm.graphs import components


def roots(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    order = list(range(1, 200))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, 7)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(edges, {x for e in edges for x in e})
    assert out == {n: r for n, r in want.items() if n != 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows):
    sets = []
    for doc_id, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    keyed = [i for i, (d, _) in enumerate(rows) if d is not None]
    edges = [
        (rows[i][0], rows[j][0]) for i in keyed for j in keyed
        if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    label = roots(edges, {rows[i][0] for i in keyed})
    return sorted((d if d is not None else -1, len(s), label.get(d, -1)) for (d, _), s in zip(rows, sets))


def test_similar_documents_as_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows, passage = [], " ".join(rng.choice(vocabulary) for _ in range(40))
    for i in range(60):  # near copies of one text, some linked only through others
        w = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((len(rows) + 10, " ".join(w)))
    for i in range(40):  # a long passage that many texts share, which alone makes no link
        rows.append((len(rows) + 10, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 14, 40])))))
    rows += [(200, "a b c d e"), (201, "A b C d\te"), (202, "a b c"), (203, "a b\nc"), (204, ""), (205, None), (206, "  "), (None, "a b c d e"), (None, None)]
    rows += [(207, "z " * 200_000), (208, "z z z z z"), (3, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.similar_documents(docs).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out)
    assert got == brute(rows)
    extra = docs.union(docs.where("doc_id = 3")).selectExpr("doc_id", "text", "doc_id AS row_key", "'x' AS _key")
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each_group(extra).collect() if r.doc_id is not None)
    assert kept == sorted({d for d, _, label in brute(rows) if d == label and d >= 0})
    assert jaccard_join.similar_documents(docs.limit(0)).count() == 0


def test_bitmaps_never_underestimate_the_overlap():
    rng = np.random.default_rng(0)
    for size_a, size_b in ((1, 1), (40, 50), (500, 380), (5000, 5000)):
        both = rng.integers(0, 1 << 63, size_a + size_b, dtype=np.uint64)
        for shared in (0, min(size_a, size_b) // 2, min(size_a, size_b)):
            a = np.unique(both[:size_a])
            b = np.unique(np.concatenate((a[:shared], both[size_a : size_a + size_b - shared])))
            assert jaccard_join.most_common(jaccard_join.parities(a), len(a), jaccard_join.parities(b), len(b)) >= len(np.intersect1d(a, b))


def test_graph_search_finds_almost_all_links():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate((centres[rng.integers(0, 60, 900)] + 0.12 * rng.normal(size=(900, 24)), rng.normal(size=(900, 24))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, ids = hnsw.build(x), np.arange(len(x))
    q, v, full = hnsw.linked(graph, x, 0.95, 64)
    true = x @ x.T >= 0.95
    assert true[q, v].all() and not len(full) and len(q) >= 0.99 * true.sum()
    a, b = embedding_dedup.true_links(graph, x, ids, ids, 0.95)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted((i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(true))) if i != j)
    again = hnsw.Graph.from_bytes(hnsw.build(x[:50]).to_bytes())
    assert len(hnsw.linked(again, x[:50], 0.95, 8)[0]) + 8 * len(hnsw.linked(again, x[:50], 0.95, 8)[2]) >= 50


@pytest.mark.parametrize("noise", [0.02, 0.1, 0.3, 1.0])
def test_dense_groups_are_counted_as_by_brute_force(noise, monkeypatch):
    """Groups that lie close together, that reach over the threshold, and that hardly link at all."""
    monkeypatch.setattr(embedding_dedup, "DENSE_AT_ONCE", 5000)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(3, 16))
    x = centres[rng.integers(0, 3, 700)] + noise * rng.normal(size=(700, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors, queries, weights = x[:400], x[300:], rng.integers(1, 5, 400)
    counts, edges = embedding_dedup.dense_links(vectors, weights, queries, 0.95)
    true = queries @ vectors.T >= 0.95
    assert (counts == true @ weights).all()
    # Edges join what links join, and nothing else: vectors are 0 to 399, query i is 300 + i.
    want = roots([(300 + i, int(j)) for i, j in zip(*np.nonzero(true))], range(700))
    linked = roots([(300 + int(a), int(b) + (300 if kind == 0 else 0)) for kind, p, q in edges for a, b in zip(p, q)], range(700))
    together = roots([(300 + i, 300 + int(j)) for i in range(400) for j in np.flatnonzero(queries[i] @ queries.T >= 0.95)] + [(300 + i, int(j)) for i, j in zip(*np.nonzero(true))], range(700))
    groups = lambda label: {frozenset(n for n in label if label[n] == r) for r in label.values()}
    for n in range(700):
        assert linked[n] == linked[want[n]] or want[n] == n
    assert all(len({together[n] for n in g}) == 1 for g in groups(linked))


def rare_links():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 24))
    x[1::20] = x[::20] + 0.02 * rng.normal(size=(60, 24))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, unit, (unit @ unit.T >= 0.95).sum(axis=1) - 1


def test_an_audit_sees_that_only_matches_with_oneself_are_found(monkeypatch):
    _, unit, true = rare_links()
    ids, linked = np.arange(1200), hnsw.linked
    cell = (hnsw.build(unit), ids, np.ones(1200, np.int64), ids, unit)
    told = embedding_dedup._audit(*cell, 0.95, 32).to_pydict()
    assert told["links"] == [int(true.sum())] and told["found"][0] >= 0.99 * true.sum()

    def blind(graph, queries, threshold, beam):
        q, v, full = linked(graph, queries, threshold, beam)
        return q[q == v], v[q == v], full

    monkeypatch.setattr(hnsw, "linked", blind)
    assert embedding_dedup._audit(*cell, 0.95, 32).to_pydict() == {"links": [int(true.sum())], "found": [0]}


def test_recall_is_audited_and_reported(spark):
    x, _, true = rare_links()
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    linked, audit = embedding_dedup.linked_and_audited(rows, shard_bytes=60_000)
    got = {r.vec_id: r.n_links for r in linked.collect()}
    assert audit.links == true.sum() and audit.recall() >= 0.99 and 0.9 < audit.least_recall() <= audit.recall()
    assert sum(got.values()) >= 0.99 * true.sum() and all(got[i] <= n for i, n in enumerate(true))
    assert embedding_dedup.Audit(32, 0, 0).recall() == 1.0 and embedding_dedup.Audit(32, 0, 0).least_recall() == 0.0


def test_a_third_of_all_vectors_in_one_group(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0] + 0.05 * rng.normal(size=(1000, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in link_vectors(rows, shard_bytes=100_000).collect()}
    true = unit @ unit.T >= 0.95
    label = roots([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(true, 1)))], range(3000))
    assert [out[i].n_links for i in range(3000)] == (true.sum(axis=1) - 1).tolist()
    assert [out[i].component_id for i in range(3000)] == [label[i] for i in range(3000)]


def test_links_of_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((np.repeat(rng.normal(size=(20, 8)), 5, axis=0) + 0.08 * rng.normal(size=(100, 8)), rng.normal(size=(40, 8))))
    rows = [(i, [float(v) for v in r], "g") for i, r in enumerate(x)]
    rows += [(900, rows[0][1], "g"), (901, rows[0][1], "g"), (902, [2 * v for v in rows[0][1]], "g")]
    rows += [(910, None, "g"), (911, [0.0] * 8, "g"), (912, [None] + [1.0] * 7, "g"), (913, [float("nan")] + [1.0] * 7, "g"), (914, [1.0, 0.0], "g"),
             (915, [2.0, 0.0], "g"), (916, [], "g"), (None, rows[0][1], "g")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")
    out = {r.vec_id: r for r in link_vectors(frame).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i is not None and i not in (910, 911, 912, 913, 916)}
    edges = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.95]
    label, links = roots(edges, {i for i, _, _ in rows if i is not None}), {i: sum(i in e for e in edges) for i, _, _ in rows}
    for i, _, _ in rows:
        if i is not None:
            assert (out[i].n_links, out[i].component_id, out[i].kept) == (links[i], label[i], label[i] == i)
    assert out[None].n_links == 0 and out[None].component_id is None
    assert link_vectors(frame.limit(0)).count() == 0


def test_audits_and_lost_vectors_take_some_queries_at_a_time(monkeypatch):
    """A dense group's links are counted some queries at a time, and vectors that no walk reaches are searched some at a time."""
    rng = np.random.default_rng(3)
    x = np.vstack((np.ones(16) + rng.normal(size=(500, 16)) * 0.05, rng.normal(size=(300, 16))))
    x = x[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, ids = hnsw.build(x), np.arange(len(x))
    cell = (graph, ids, np.ones(len(x), np.int64), ids, x)
    near, level = graph.near, np.full((len(x), 4), -1, np.int64)
    want, reached = embedding_dedup._audit(*cell, 0.95, 16).to_pydict(), hnsw._all_reached(near, level.copy(), 0)
    true = x @ x.T >= 0.95
    np.fill_diagonal(true, False)
    assert want["links"] == [int(true.sum())] and 0 < want["found"][0] <= want["links"][0]
    sizes = []
    for module, name in ((embedding_dedup, "true_links"), (hnsw, "linked"), (hnsw, "beam_search")):
        monkeypatch.setattr(module, name, lambda a, b, c, *rest, real=getattr(module, name), queries=2 if name == "beam_search" else 1: sizes.append(len((a, b, c)[queries])) or real(a, b, c, *rest))
    monkeypatch.setattr(hnsw, "SEARCHED_AT_ONCE", 64)
    monkeypatch.setattr(embedding_dedup, "DENSE_AT_ONCE", 40 * len(x))
    assert embedding_dedup._audit(*cell, 0.95, 16).to_pydict() == want and max(sizes) <= 64
    assert (hnsw._all_reached(near, level.copy(), 0) == reached).all() and max(sizes) <= 64
    again = hnsw.Graph.from_bytes(graph.to_bytes())
    assert all((a == b).all() for a, b in zip(again.neighbours, graph.neighbours)) and len(again.neighbours) == len(graph.neighbours)
