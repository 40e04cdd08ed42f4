from pyspark.sql import functions as F

from paperloom.operators import graph as kg


def nodes_of(spark, *rows):
    return spark.createDataFrame(list(rows), "label string, key string, props map<string,string>, seq long")


def edges_of(spark, *rows):
    return spark.createDataFrame(
        [(*r[:5], r[5] if len(r) > 5 else {}, r[6] if len(r) > 6 else 1) for r in rows],
        "src_label string, src_key string, rel_type string, dst_label string, dst_key string, props map<string,string>, seq long",
    )


def test_upsert_is_property_wise_and_keeps_late_nulls(spark):
    old = nodes_of(spark, ("Gene", "A", {"name": "a", "site": "x"}, 1), ("Gene", "B", {"name": "b"}, 1))
    new = nodes_of(spark, ("Gene", "A", {"site": None, "kind": "k"}, 3), ("Gene", "A", {"site": "y"}, 2))
    got = {r.key: r.props for r in kg.merge_nodes(old, new).collect()}
    assert got == {"A": {"name": "a", "site": None, "kind": "k"}, "B": {"name": "b"}}
    edges = edges_of(spark, ("G", "a", "R", "G", "b"), ("G", "a", "R", "G", "b", {"w": "1"}, 2), ("G", "a", "R", "G", "c"))
    merged = {r.dst_key: r.props for r in kg.merge_edges(edges).collect()}
    assert merged == {"b": {"w": "1"}, "c": {}}


def variant_graph(spark):
    return edges_of(
        spark, ("Variant", "m.3243A>G", "ASSOCIATED_WITH", "Gene", "MT-TL1"), ("Gene", "MT-TL1", "PART_OF", "Complex", "Complex I"),
        ("Complex", "Complex I", "PARTICIPATES_IN", "Pathway", "OXPHOS"), ("Variant", "other", "ASSOCIATED_WITH", "Gene", "MT-ND4"),
        ("Protein", "P1", "ENCODED_BY", "Gene", "MT-TL1"), ("Gene", "MT-ND4", "ENCODED_BY", "Protein", "P2"),
        ("Protein", "P1", "LOCALIZES_TO", "SubMitoCompartment", "matrix"), ("Protein", "P2", "LOCALIZES_TO", "SubMitoCompartment", "matrix"),
        ("Protein", "P3", "LOCALIZES_TO", "SubMitoCompartment", "IMM"),
    )


def test_paths_and_localisation(spark):
    edges = variant_graph(spark)
    pattern = ["Variant", "ASSOCIATED_WITH", "Gene", "PART_OF", "Complex", "PARTICIPATES_IN", "Pathway"]
    assert [tuple(r) for r in kg.path_match(edges, pattern).collect()] == [("m.3243A>G", "MT-TL1", "Complex I", "OXPHOS")]
    assert kg.path_match(edges, pattern, {0: "other"}).count() == 0
    counts = kg.localized_counts(edges, ("Gene", "ENCODED_BY", "Protein"), ("Protein", "LOCALIZES_TO", "SubMitoCompartment"))
    assert {r.place: r.n for r in counts.collect()} == {"matrix": 2}


def test_checks(spark):
    nodes = nodes_of(spark, ("Gene", "a", {}, 1))
    bad = kg.dangling_edges(nodes, edges_of(spark, ("Gene", "a", "R", "Gene", "b"), ("Gene", "a", "R", "Gene", "a"))).collect()
    assert [(r.dst_key, r.side) for r in bad] == [("b", "dst")]
    raw = nodes_of(spark, ("Gene", "-", {"hgnc_symbol": "A"}, 1), ("Gene", "-", {"hgnc_symbol": "A"}, 1), ("Paper", "-", {}, 1))
    assert {(r.label, r.violation, r.n) for r in kg.constraint_violations(raw).collect()} == {("Gene", "duplicate", 2), ("Paper", "null", 1)}
    used = spark.createDataFrame([("causes",), ("dances_with",)], "predicate string")
    assert {r.predicate: r.rel_type for r in kg.check_predicates(used).collect()} == {"causes": "CAUSES", "dances_with": None}
    assert len(kg.KEY_PROPERTIES) == 15 and len(kg.PREDICATES) == 19


def test_records_mapping_explodes_and_skips_nulls(spark):
    table = spark.createDataFrame([("d1", ["h1", "h2"], None), ("d2", [], "t")], "id string, hpo array<string>, target string")
    nodes, edges = kg.graph_from_records(
        {"disease": table},
        [kg.NodeMap("disease", "Disease", "id", {"name": "id"}), kg.NodeMap("disease", "Phenotype", "item", {"hpo_id": "item"}, explode="hpo")],
        [kg.EdgeMap("disease", "Disease", "id", "HAS", "Phenotype", "item", explode="hpo"), kg.EdgeMap("disease", "Disease", "id", "HITS", "Complex", "target")],
    )
    assert nodes.count() == 4 and {(r.src_key, r.rel_type, r.dst_key) for r in edges.collect()} == {("d1", "HAS", "h1"), ("d1", "HAS", "h2"), ("d2", "HITS", "t")}


def test_annotation_goes_round_the_targets(spark):
    nodes = nodes_of(spark, *[("Protein", f"P{n}", {"name": "n"}, 1) for n in range(7)])
    out, links = kg.annotate_nodes(nodes, edges_of(spark, ("X", "x", "R", "X", "x")), "Protein", [("A", {"name": "A"}), ("B", {"name": "B"})], "Pathway", "PARTICIPATES_IN", "mark", first=3)
    got = {r.src_key: r.dst_key for r in links.where("rel_type = 'PARTICIPATES_IN'").collect()}
    assert got == {"P0": "B", "P1": "A", "P2": "B"}
    assert out.where("label = 'Protein' AND props['mark'] IS NOT NULL").count() == 3 and out.where("label = 'Pathway'").count() == 2


def test_lookups_and_subgraphs(spark):
    nodes = nodes_of(spark, ("Gene", "a", {"x": "1", "y": "2"}, 1), ("Gene", "b", {"x": "1"}, 1))
    asked = spark.createDataFrame([(1, "Gene", {"x": "1", "y": "2"}), (2, "Gene", {"x": "9"})], "request_id long, label string, wanted map<string,string>")
    assert [(r.request_id, r.key) for r in kg.find_nodes(nodes, asked).collect()] == [(1, "a")]
    shown = spark.createDataFrame([("a", "Alpha", "Gene", 2, "x"), ("b", "Beta", "Gene", 3, "x"), ("c", "Gamma", "Gene", 99, "y")], "id string, name string, type string, level int, category string")
    links = spark.createDataFrame([("a", "b", "near"), ("b", "c", "near")], "source string, target string, predicate string")
    kept, inside = kg.level_subgraph(shown, links, 2)
    assert {r.id for r in kept.collect()} == {"a", "b"} and inside.count() == 1
    names = {r.id: r.level_name for r in kg.level_subgraph(shown, links, 99)[0].collect()}
    assert names == {"c": "Unknown", "b": "TCA Cycle"}
    assert kg.category_subgraph(shown, links, "x")[1].count() == 1
    assert {(r.term, r.id) for r in kg.search_nodes(shown, ["ALPHA", "c", ""]).collect()} == {("alpha", "a"), ("c", "c")}
    assert kg.search_nodes(shown, [" "]).count() == 0
    stats = {(r.kind, r.name): r.n for r in kg.kg_stats(nodes, edges_of(spark, ("G", "a", "R", "G", "b")), {"Gene": ["x", "y"]}).collect()}
    assert stats == {("label", "Gene"): 2, ("type", "R"): 1, ("with_properties", "Gene: x, y"): 1}
    assert kg.find_edges(edges_of(spark, ("G", "a", "R", "G", "b")), edges_of(spark, ("G", "a", "R", "G", "z")).drop("props", "seq").withColumn("request_id", F.lit(1))).first().found is False


def test_every_table_is_read_once_for_all_of_its_entries(spark, tmp_path):
    for name in ("a", "b"):
        spark.createDataFrame([(1, [2, 3], None), (4, None, "x'y")], "id long, more array<long>, t string").write.parquet(str(tmp_path / name))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in ("a", "b")}
    nodes = [kg.NodeMap("a", "L'1", "id", {"p'q": "t"}), kg.NodeMap("a", "M", "item", explode="more"), kg.NodeMap("b", "L'1", "id + 10"), kg.NodeMap("a", "N", "t")]
    edges = [kg.EdgeMap("a", "L'1", "id", "HAS", "M", "item", {"n": "item"}, "more"), kg.EdgeMap("b", "L'1", "id", "IS", "N", "t")]
    found = kg.graph_from_records(tables, nodes, edges)
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in found] == [2, 2]
    assert sorted((r.label, r.key, r.props) for r in found[0].collect()) == [
        ("L'1", "1", {"p'q": None}), ("L'1", "11", {}), ("L'1", "14", {}), ("L'1", "4", {"p'q": "x'y"}), ("M", "2", {}), ("M", "3", {}), ("N", "x'y", {}),
    ]
    assert sorted((r.src_key, r.rel_type, r.dst_key, r.props) for r in found[1].collect()) == [("1", "HAS", "2", {"n": "2"}), ("1", "HAS", "3", {"n": "3"}), ("4", "IS", "x'y", {})]


def test_the_rarest_wanted_property_leads_a_lookup(spark):
    rows = [("Gene", str(i), {"kind": "x", "name": f"n{i % 50}", "gone": None}) for i in range(200)]
    nodes = spark.createDataFrame(rows, "label string, key string, props map<string,string>")
    asked = [(1, "Gene", {"kind": "x", "name": "n7"}), (2, "Gene", {"kind": "y", "name": "n7"}), (3, "Gene", {"kind": "x", "gone": None, "name": "n8"}), (4, "Drug", {"name": "n7"}),
             (5, "Gene", {"gone": None}), (5, "Gene", {"name": "n9"})]
    found = kg.find_nodes(nodes, spark.createDataFrame(asked, "request_id long, label string, wanted map<string,string>"))
    got = sorted((r.request_id, int(r.key)) for r in found.collect())
    assert got == sorted([(1, k) for k in (7, 57, 107, 157)] + [(3, k) for k in (8, 58, 108, 158)] + [(5, k) for k in (9, 59, 109, 159)])


def test_one_property_is_merged_as_with_all_others(spark):
    rows = spark.createDataFrame(
        [("A", "1", {"name": "old", "x": "y"}, 1), ("A", "1", {"name": "new"}, 2), ("A", "2", {"name": "was"}, 1), ("A", "2", {"name": None}, 3), ("A", "2", {"x": "z"}, 4), ("B", "1", {}, 1)],
        "label string, key string, props map<string,string>, seq long",
    )
    whole = {(r.label, r.key): r.props.get("name") for r in kg.merge_nodes(rows).collect()}
    one = kg.merged_property(rows, kg.NODE_KEY, "name")
    assert {(r.label, r.key): r.name for r in one.collect()} == whole == {("A", "1"): "new", ("A", "2"): None, ("B", "1"): None}
