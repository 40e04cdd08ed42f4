import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import triples as tp


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_mentions_of_the_built_in_dictionary(spark):
    text = "The m.3243A>G variant causes MELAS and lowers Complex I; complex III and MT-ND4 stay."
    rows = tp.extract_mentions(texts(spark, text)).collect()
    assert [(r.mention, r.normalized_id) for r in rows] == [
        ("m.3243A>G", "m.3243A>G"), ("MELAS", "MONDO:0010789"), ("Complex I", "Complex I"), ("MT-ND4", "MT-ND4"),
    ]
    assert all(text[r.start : r.end] == r.mention for r in rows)


def test_longer_literals_win_and_self_overlap_is_refused(spark):
    aliases = (tp.Alias("a b", "1", "X"), tp.Alias("b c d", "2", "X"), tp.Alias("b", "3", "X"))
    rows = tp.extract_mentions(texts(spark, "a b c d b a b"), aliases).collect()
    assert [(r.start, r.end, r.normalized_id) for r in rows] == [(2, 7, "2"), (8, 9, "3"), (10, 13, "1")]
    with pytest.raises(ValueError):
        tp.extract_mentions(texts(spark, "x"), (tp.Alias("a b a", "1", "X"),))


def test_relation_rules(spark):
    docs = texts(
        spark, "ND4 is a subunit of Complex I. ND4 is a subunit of Complex I!", "The M.3243a>g variant leads to MELAS syndrome.",
        "PINK1 activates Parkin. Idebenone inhibits something.",
    )
    got = {(r.paper, r.subject, r.predicate, r.object, r.confidence) for r in tp.extract_triples(docs).collect()}
    assert got == {
        (0, "MT-ND4", "subunit_of", "Complex I", 0.91), (1, "m.3243A>G", "causes", "MONDO:0010789", 0.88), (2, "PINK1", "activates", "PRKN", 0.84),
    }


SCHEMA = "paper string, subject string, predicate string, object string, confidence double, evidence string, ord long"


def decided(spark, rows, known=("A", "B", "C"), existing=None):
    df = spark.createDataFrame(rows, SCHEMA)
    entities = spark.createDataFrame([(k,) for k in known], "normalized_id string")
    return tp.decide_triples(tp.validate_triples(tp.dedupe_triples(df), entities), existing)


def test_rejection_reasons(spark):
    rows = [("p", "A", "dances_with", "B", 0.1, "e", 1), ("p", "A", "causes", "B", 0.5, "e", 2), ("p", "A", "causes", "Z", 0.9, "e", 3)]
    reasons = {r.ord: r.reason for r in decided(spark, rows).collect()}
    assert reasons == {1: tp.BAD_PREDICATE, 2: tp.LOW_CONFIDENCE, 3: tp.UNRESOLVED}


def test_three_papers_give_three_ordered_evidence_papers(spark):
    rows = [(f"p{n}", "A", "causes", "B", 0.8 + n / 100, f"e{n}", n) for n in (2, 1, 3)]
    out = decided(spark, rows)
    edge = tp.merge_provenance(out).first()
    assert (edge.evidence_count, round(edge.confidence, 9), edge.evidence, edge.first_paper, edge.last_paper) == (3, 0.83, "e3", "p1", "p3")
    assert [r.paper for r in tp.evidence_papers(out).orderBy("first_seen").collect()] == ["p1", "p2", "p3"]


def test_opposite_predicates_become_one_contradiction(spark):
    rows = [("p1", "A", "activates", "B", 0.9, "on", 1), ("p2", "A", "inhibits", "B", 0.9, "off", 2)]
    out = decided(spark, rows)
    assert [r.status for r in out.orderBy("ord").collect()] == ["merged", "contradiction"]
    nodes, edges = tp.contradiction_records(out)
    labels = [r.label for r in nodes.collect()]
    assert labels.count("Contradiction") == 1 and labels.count("Hypothesis") == 2
    kinds = [r.rel_type for r in edges.collect()]
    assert kinds.count("CONTRADICTS") == 2 and kinds.count("SUPPORTS") == 1
    summary = tp.paper_kg_summary(out, spark.createDataFrame([("p1", 2), ("p2", 2)], "paper string, entities long"))
    lines = {r.paper: r.log_line for r in summary.collect()}
    assert lines["p1"] == "Ingested paper p1: +1 triples, +2 new entities, 0 contradiction detected"
    assert lines["p2"] == "Ingested paper p2: +0 triples, +0 new entities, 1 contradiction detected"


def test_existing_edges_come_first(spark):
    existing = spark.createDataFrame([("A", "inhibits", "B")], "subject string, predicate string, object string")
    out = decided(spark, [("p1", "A", "activates", "B", 0.9, "on", 1)], existing=existing).first()
    assert out.status == "contradiction" and out.existing_predicate == "inhibits"


def test_decisions_equal_a_sequential_merge(spark):
    rng = random.Random(7)
    rows = []
    for n in range(1500):
        predicate = rng.choice(["activates", "inhibits", "produces", "consumes", "causes"])
        rows.append((f"p{rng.randint(0, 200)}", rng.choice("ABC"), predicate, rng.choice("ABZ"), rng.choice([0.6, 0.8, 0.9]), f"e{n}", n))
    graph, expected, seen = {}, {}, set()
    for paper, s, p, o, c, _, n in rows:
        if (paper, s, p, o) in seen:
            continue
        seen.add((paper, s, p, o))
        if c < 0.7 or o == "Z":
            expected[n] = "rejected"
        elif tp.OPPOSITES.get(p) in graph.get((s, o), set()):
            expected[n] = "contradiction"
        else:
            graph.setdefault((s, o), set()).add(p)
            expected[n] = "merged"
    assert {r.ord: r.status for r in decided(spark, rows).collect()} == expected


def test_precision_and_conflicts(spark):
    triples = spark.createDataFrame([("A", "causes", "B"), ("A", "treats", "B")], "subject string, predicate string, object string")
    gold = spark.createDataFrame([("A", "causes", "B"), ("A", "causes", "B")], triples.schema)
    assert tp.triple_precision(triples, gold).first().precision == 0.5
    assert tp.triple_precision(triples.limit(0), gold).first().precision == 0.0
    one = spark.createDataFrame([("A", "activates", "B", "e1")], "subject string, predicate string, object string, evidence_id string")
    two = spark.createDataFrame([("A", "inhibits", "B", "e2"), ("A", "inhibits", "C", "e3")], one.schema)
    rows = tp.relation_conflicts(one, two).collect()
    assert {(r.side, r.evidence_id) for r in rows} == {("supporting", "e1"), ("contradicting", "e2")}
    assert rows[0].claim == "A has opposing activates/inhibits relations to B"


def test_paper_id_falls_back(spark):
    df = spark.createDataFrame([("1", "d", "e"), (None, "d", "e"), ("", "", "a")], "p string, d string, e string")
    got = [r[0] for r in df.select(tp.paper_id(F.col("p"), F.col("d"), F.col("e"))).collect()]
    assert got == ["1", "d", "86f7e437faa5a7fc"]


def test_winners_and_marks_are_stored_before_they_are_joined(spark):
    rows = [(str(n), "A", "activates" if n % 3 else "inhibits", "B", 0.9, "seen", n) for n in range(9)]
    triples = spark.createDataFrame(rows, "paper string, subject string, predicate string, object string, confidence double, evidence string, ord long")
    known = spark.createDataFrame([("A",), ("B",)], "normalized_id string")
    decided = tp.decide_triples(tp.validate_triples(triples, known))
    assert "min_by" not in decided._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.paper, r.status) for r in decided.collect()) == [(str(n), "contradiction" if n % 3 else "merged") for n in range(9)]
    none = spark.createDataFrame([], tp.EDGE_SCHEMA)
    edges, added = tp.merge_stored_provenance(decided, none, spark.createDataFrame([], "subject string, predicate string, object string, paper string"), F.lit("now"))
    for out in (edges, added):
        assert "max(struct" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.predicate, r.evidence_count, r.first_paper, r.last_paper) for r in edges.collect()] == [("inhibits", 3, "0", "6")]
    assert sorted(r.paper for r in added.collect()) == ["0", "3", "6"]
