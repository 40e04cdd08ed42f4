"""Stored graphs: commits, confidence of stored edges, provenance over several runs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.operators import triples as tp
from paperloom.plans import graph_merge as gm
from paperloom.sources.bucket_store import BucketStore, Table
from paperloom.streaming import papers as sp

TRIPLES = "paper string, subject string, predicate string, object string, confidence double, evidence string, ord long"


def test_commits_replace_add_and_repeat(spark, tmp_path):
    tables = {"a": Table("k long, v string", ("k",), 4), "b": Table("k long", ("k",), 2)}
    store = BucketStore(spark, str(tmp_path / "s"), tables)
    assert store.last_batch() == -1 and store.read("a").count() == 0
    rows = spark.createDataFrame([(i, "one") for i in range(20)], "k long, v string")
    store.commit(0, {"a": (rows, store.touched("a", rows))}, {"b": rows.select("k")})
    some = spark.createDataFrame([(3, "two")], "k long, v string")
    at = store.touched("a", some)
    kept = store.read("a", at).where("k <> 3").union(some)
    store.commit(1, {"a": (kept, at)}, {"b": some.select("k")})
    store.commit(1, {"a": (kept.limit(0), at)}, {"b": some.select("k")})  # again: changes nothing
    for seen in (store, BucketStore(spark, str(tmp_path / "s"), tables)):
        assert {r.k: r.v for r in seen.read("a").collect()} == {i: "two" if i == 3 else "one" for i in range(20)}
        assert seen.read("b").count() == 21 and seen.last_batch() == 1
    store.commit(2, {"a": (kept.limit(0), at)}, {})  # a bucket may become empty
    assert store.read("a", at).count() == 0 and store.read("a").count() == 20 - kept.count()


def test_decisions_follow_the_confidence_of_stored_edges(spark):
    """20,000 pairs, each a run of its own, against a sequential merge into edges with a confidence."""
    rng, rows, stored, expected = random.Random(3), [], [], {}
    for pair in range(20_000):
        subject, edges = f"s{pair}", {}
        for predicate in ("activates", "inhibits"):
            if rng.random() < 0.5:
                edges[predicate] = rng.choice([0.2, 0.69, 0.7, 0.95, None])
                stored.append((subject, predicate, "o", edges[predicate]))
        for _ in range(rng.randrange(1, 5)):
            n, predicate = len(rows), rng.choice(["activates", "inhibits"])
            rows.append((f"p{n}", subject, predicate, "o", rng.choice([0.7, 0.9]), f"e{n}", n))
            against = tp.OPPOSITES[predicate]
            if (edges.get(against) or 0.0) >= 0.7:
                expected[n] = ("contradiction", against)
            else:
                edges[predicate] = max(edges.get(predicate) or 0.0, rows[-1][4])
                expected[n] = ("merged", None)
    checked = spark.createDataFrame(rows, TRIPLES).withColumns({"valid": F.lit(True), "reason": F.lit(None).cast("string")})
    existing = spark.createDataFrame(stored, "subject string, predicate string, object string, confidence double")
    assert {r.ord: (r.status, r.existing_predicate) for r in tp.decide_triples(checked, existing).collect()} == expected


def sequential(rows, seeds):
    """The rule itself: one triple after the other into a dictionary of edges."""
    edges = {k: dict(v, papers=list(v["papers"])) for k, v in seeds.items()}
    for paper, s, p, o, confidence, evidence, _ in rows:
        against = edges.get((s, tp.OPPOSITES.get(p), o))
        if against and (against["confidence"] or 0.0) >= 0.7:
            continue
        old = edges.setdefault((s, p, o), {"papers": [], "confidence": None, "method": tp.METHOD})
        if paper not in old["papers"]:
            old["papers"].append(paper)
        old.update(confidence=max(old["confidence"] or 0.0, confidence), evidence=evidence, last=paper)
    return {k: (v["papers"][0] if v["papers"] else None, len(v["papers"]), v["confidence"], v["evidence"], v.get("last"), v["method"]) for k, v in edges.items()}


@pytest.mark.parametrize("cuts", [[], [1, 14, 150]])
def test_runs_give_what_one_run_gives(spark, tmp_path, cuts):
    rng = random.Random(8)
    rows, seen = [], set()
    for paper in range(200):
        for _ in range(rng.randrange(0, 4)):
            key = (f"p{paper}", rng.choice("AB"), rng.choice(["activates", "inhibits", "causes"]), rng.choice("CD"))
            if key not in seen:
                seen.add(key)
                rows.append((*key, rng.choice([0.7, 0.8, 0.9]), f"e{len(rows)}", len(rows)))
    seeds = {
        ("A", "inhibits", "C"): {"papers": ["p7"], "confidence": 0.3, "evidence": "x", "method": "m", "last": "p7"},
        ("B", "inhibits", "C"): {"papers": ["evidence:0", "evidence:1"], "confidence": 0.8, "evidence": "x", "method": "m", "last": "evidence:1"},
        ("Z", "causes", "Z"): {"papers": ["p0", "p9"], "confidence": None, "evidence": "x", "method": "m", "last": "p9"},
    }
    loaded = [
        ("A", "inhibits", "C", "INHIBITS", 4, 0.3, "x", None, None, "", "p7", "m", "t", None), ("B", "inhibits", "C", "INHIBITS", 2, 0.8, "x", None, None, "", "", "m", "t", None),
        ("Z", "causes", "Z", "CAUSES", 1, None, "x", None, None, "", "p1", "m", "t", ["p0", "p9"]),
    ]
    store = gm.graph_store(spark, str(tmp_path / "g"), buckets=3)
    gm.adopt_edges(store, spark.createDataFrame(loaded, f"{tp.EDGE_SCHEMA}, evidence_papers array<string>"))
    entities = spark.createDataFrame([(x, "Gene") for x in "ABCD"], "normalized_id string, label string")
    for batch, (low, high) in enumerate(zip([0, *cuts], [*cuts, 200]), start=1):
        part = [r for r in rows if low <= int(r[0][1:]) < high]
        gm.merge_batch(store, tp.validate_triples(spark.createDataFrame(part, TRIPLES), entities), batch, entities)
    got = {
        (r.subject, r.predicate, r.object): (r.first_paper, r.evidence_count, r.confidence, r.evidence, r.last_paper, r.extraction_method)
        for r in store.read("edges").collect()
    }
    assert got == sequential(rows, seeds)
    papers = store.read("evidence")
    assert papers.count() == papers.distinct().count() == sum(v[1] for v in got.values())
    nodes, links = store.read("nodes"), store.read("links")
    assert nodes.count() == nodes.select("label", "key").distinct().count() and links.where("rel_type = 'CONTRADICTS'").count() % 2 == 0
    assert {r.key: r.props for r in nodes.where("label = 'Gene'").collect()} == {x: {"hgnc_symbol": x} for x in "ABCD"}


def test_both_stored_predicates_sure_make_every_triple_a_contradiction(spark):
    existing = spark.createDataFrame([("A", "activates", "B", 0.9, "on"), ("A", "inhibits", "B", 0.8, "off")], "subject string, predicate string, object string, confidence double, evidence string")
    rows = [("p1", "A", "activates", "B", 0.9, "new on", 1), ("p2", "A", "inhibits", "B", 0.9, "new off", 2)]
    checked = spark.createDataFrame(rows, TRIPLES).withColumns({"valid": F.lit(True), "reason": F.lit(None).cast("string")})
    decided = tp.decide_triples(checked, existing)
    assert {r.ord: r.existing_predicate for r in decided.collect()} == {1: "inhibits", 2: "activates"}
    nodes, edges = tp.contradiction_records(decided, existing)
    texts = {r.key: r.props["description"] for r in nodes.where("label = 'Hypothesis'").collect()}
    assert texts == {"A inhibits B": "new off", "A activates B": "on"}  # what the last clash wrote
    assert edges.where("rel_type = 'CONTRADICTS'").count() == 2 and edges.where("rel_type = 'SUPPORTS'").count() == 2


def test_a_batch_killed_between_two_writes_counts_once(spark, tmp_path, monkeypatch):
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    (tmp_path / "landing").mkdir()
    sink = sp.ingest_writer(out, buckets=2)

    def land(n, text):
        pd.DataFrame({"doc_id": [n], "text": [text], "path": [f"/p/{n}.pdf"]}).to_parquet(f"{landing}/{n}.parquet")

    def poll():
        sp.poll_once(sp.stream_table(spark, landing, "*.parquet"), sink, mark)

    def state():
        graph = sp.ingest_graph(spark, out, buckets=2)
        return {name: sorted(map(repr, graph.read(name).drop("created").collect())) for name in ("edges", "evidence", "nodes", "links")}

    land(1, "PINK1 activates Parkin.")
    poll()
    before = state()
    land(2, "PINK1 inhibits Parkin. PINK1 activates Parkin. Idebenone activates Complex I.")
    frame, left = type(spark.range(1)), [1]
    create = frame.coalesce

    def killed(df, n):  # the manifest is the one thing that is written as a single file
        if left and left.pop():
            raise RuntimeError("killed")
        return create(df, n)

    monkeypatch.setattr(frame, "coalesce", killed)
    with pytest.raises(Exception, match="killed"):
        poll()
    assert state() == before and sp.ingested(spark, out, "triples").count() == 1 and sp.ingested(spark, out, "chunks").count() == 1
    poll()
    after = state()
    assert len(after["edges"]) == 2 and len(after["evidence"]) == 3 and len(after["links"]) == 3
    assert [r.evidence_count for r in sp.ingest_graph(spark, out, 2).read("edges").where("object = 'PRKN'").collect()] == [2]
    assert sp.ingested(spark, out, "triples").count() == 4 and sp.current_graph(spark, out).count() == 2
    poll()
    assert state() == after
