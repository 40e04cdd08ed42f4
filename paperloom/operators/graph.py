"""Property graph as two tables: loading, upserts, checks, patterns and subgraphs.

Nodes are ``(label, key, props, seq)``; edges are ``(src_label, src_key, rel_type, dst_label,
dst_key, props, seq)``. ``props`` is map<string,string>; a larger ``seq`` was written later.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.ranking import numbered, ranked
from paperloom.operators.triples import PREDICATES
from paperloom.session import materialize

NODE_KEY = ["label", "key"]
EDGE_KEY = ["src_label", "src_key", "rel_type", "dst_label", "dst_key"]

# The unique key property of each node label.
KEY_PROPERTIES = {
    "Gene": "hgnc_symbol",
    "Protein": "uniprot_id",
    "Complex": "name",
    "Pathway": "name",
    "Metabolite": "chebi_id",
    "Reaction": "name",
    "Disease": "name",
    "Variant": "hgvs",
    "Drug": "name",
    "Phenotype": "hpo_id",
    "SubMitoCompartment": "name",
    "Paper": "pmid",
    "Claim": "text",
    "Contradiction": "id",
    "Hypothesis": "name",
}

# Explorer levels with name and focus terms.
LEVELS = (
    (1, "Whole Mitochondrion", "OMM, IMM, IMS, Matrix"),
    (2, "OXPHOS / ETC", "Complex I, Complex II, Complex III, Complex IV, Complex V"),
    (3, "TCA Cycle", "CS, ACO2, IDH3, OGDH, MDH2"),
    (4, "Fatty Acid Beta-Oxidation", "CPT1, CPT2, ACADM"),
    (5, "Dynamics", "MFN1, MFN2, OPA1, DRP1, PINK1, Parkin"),
    (6, "Import", "TOM, TIM23, TIM22, SAM, MCU"),
    (7, "Apoptosis", "BCL-2, BAX, Cytochrome c, mPTP"),
    (8, "Diseases", "MELAS, LHON, m.3243A>G, m.11778G>A"),
    (9, "Signaling", "UPRmt, ROS, FGF21, GDF15, ISR"),
    (10, "Therapeutics", "Idebenone, MitoQ, Urolithin A"),
)


# ---------------------------------------------------------------- loading


@dataclass(frozen=True)
class NodeMap:
    """Records of a table become nodes; ``props`` maps property names to SQL expressions.

    ``explode`` names an array expression whose elements are available as ``item``.
    """

    table: str
    label: str
    key: str
    props: dict[str, str] = field(default_factory=dict)
    explode: str | None = None


@dataclass(frozen=True)
class EdgeMap:
    """Records become edges between keys; a null on either side means no edge."""

    table: str
    src_label: str
    src_key: str
    rel_type: str
    dst_label: str
    dst_key: str
    props: dict[str, str] = field(default_factory=dict)
    explode: str | None = None


RECORD = "struct<loader:string,seq:bigint,src_label:string,src_key:string,rel_type:string,dst_label:string,dst_key:string,props:map<string,string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _record(entry: NodeMap | EdgeMap, seq: int, loader: str) -> str:
    """SQL of the record that a mapping entry makes of a row; a node has no relation type."""
    entries = ", ".join(f"{_quoted(name)}, CAST({sql} AS STRING)" for name, sql in entry.props.items())
    props = f"map({entries})" if entries else "CAST(map() AS map<string,string>)"
    if isinstance(entry, NodeMap):
        sides = (_quoted(entry.label), f"CAST({entry.key} AS STRING)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)")
    else:
        sides = (_quoted(entry.src_label), f"CAST({entry.src_key} AS STRING)", _quoted(entry.rel_type), _quoted(entry.dst_label), f"CAST({entry.dst_key} AS STRING)")
    return f"CAST(struct({_quoted(loader)}, {seq}L, {', '.join(sides)}, {props}) AS {RECORD})"


def _records(tables: dict[str, DataFrame], entries: list[tuple[int, str, NodeMap | EdgeMap]]) -> DataFrame:
    """Records of all mapping entries. Entries of one table make one array a row, so a table is read once for all of them."""
    none = f"CAST(array() AS array<{RECORD}>)"
    by_table: dict[str, list[str]] = {}
    for seq, loader, entry in entries:
        made = _record(entry, seq, loader)
        many = f"coalesce(transform({entry.explode}, item -> {made}), {none})" if entry.explode else f"array({made})"
        by_table.setdefault(entry.table, []).append(many)
    parts = [tables[name].select(F.inline_outer(F.expr(f"concat({', '.join([none, *some])})"))) for name, some in by_table.items()]
    return reduce(DataFrame.unionByName, parts).where("src_key IS NOT NULL AND (rel_type IS NULL OR dst_key IS NOT NULL)")


def _nodes_of(records: DataFrame) -> DataFrame:
    return records.where("rel_type IS NULL").select(F.col("src_label").alias("label"), F.col("src_key").alias("key"), "props", "seq")


def _edges_of(records: DataFrame) -> DataFrame:
    return records.where("rel_type IS NOT NULL").select("src_label", "src_key", "rel_type", "dst_label", "dst_key", "props", "seq")


def graph_from_records(
    tables: dict[str, DataFrame], nodes: list[NodeMap], edges: list[EdgeMap], seq: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Raw node and edge rows of record tables, without joins; each of the two reads every table that it maps once."""
    return (
        _nodes_of(_records(tables, [(seq, "", m) for m in nodes])),
        _edges_of(_records(tables, [(seq, "", m) for m in edges])),
    )


def _upsert(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest value per property, a null written last included.

    The first aggregate has partial results per (key, property), so a key that is
    written millions of times never gathers its writes in one place.
    """
    entries = rows.select(*keys, "seq", F.explode_outer(F.map_entries("props")).alias("e"))
    latest = entries.groupBy(*keys, F.col("e.key").alias("prop")).agg(
        F.max_by(F.struct(F.col("e.value").alias("value")), "seq").alias("last"),
        F.max("seq").alias("seq"),
    )
    pair = F.when(F.col("prop").isNotNull(), F.struct("prop", F.col("last.value").alias("value")))
    return latest.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("props"), F.max("seq").alias("seq")
    )


def merged_property(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The unique keys of ``rows`` with one merged property, null where it was never written; no other property is moved."""
    written = F.map_contains_key("props", F.lit(name))
    # A struct, so that a null written last counts.
    value = F.when(written, F.struct("seq", F.try_element_at("props", F.lit(name)).alias("value")))
    return rows.groupBy(*keys).agg(F.max(value)["value"].alias(name))


def merge_nodes(existing: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """Unique nodes per (label, key), merged property by property, last writer wins."""
    rows = existing if updates is None else existing.unionByName(updates)
    return _upsert(rows, NODE_KEY)


def merge_edges(existing: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """Unique edges per (source, type, target), merged property by property."""
    rows = existing if updates is None else existing.unionByName(updates)
    return _upsert(rows, EDGE_KEY)


def annotate_nodes(
    nodes: DataFrame,
    edges: DataFrame,
    label: str,
    annotations: list[tuple[str, dict[str, str]]],
    target_label: str,
    rel_type: str,
    prop: str,
    first: int | None = None,
    seq: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Link the nodes of a label, in the order of their keys, to annotation nodes in turn and mark them.

    ``annotations`` are ``(key, props)`` of the annotation nodes. With ``first``, only so
    many nodes are marked.
    """
    names = F.array(*[F.lit(key) for key, _ in annotations])
    chosen = numbered(nodes.where(F.col("label") == label).select("key"), "key", "n")
    if first is not None:
        chosen = chosen.where(F.col("n") <= first)
    chosen = chosen.withColumn("target", F.get(names, (F.col("n") % len(annotations)).cast("int")))
    mark = F.format_string("ANNOTATION-%04d", F.col("n"))
    marked = chosen.select(
        F.lit(label).alias("label"), "key", F.create_map(F.lit(prop), mark, F.lit(f"{prop}_target"), F.col("target")).alias("props"),
        F.lit(seq).cast("long").alias("seq"),
    )
    spark = nodes.sparkSession
    targets = spark.createDataFrame(
        [(target_label, key, props, seq) for key, props in annotations],
        "label string, key string, props map<string,string>, seq long",
    )
    links = chosen.select(
        F.lit(label).alias("src_label"), F.col("key").alias("src_key"), F.lit(rel_type).alias("rel_type"),
        F.lit(target_label).alias("dst_label"), F.col("target").alias("dst_key"),
        F.create_map(F.lit(prop), mark).alias("props"), F.lit(seq).cast("long").alias("seq"),
    )
    return merge_nodes(nodes, marked.unionByName(targets)), merge_edges(edges, links)


def load_all(
    tables: dict[str, DataFrame], loaders: list[tuple[str, list[NodeMap], list[EdgeMap]]]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All loaders in dependency order; returns nodes, edges and counts per loader.

    Every table is read once for all loaders; the records feed three results, so they are stored.
    """
    entries = [(seq, name, m) for seq, (name, nodes, edges) in enumerate(loaders, start=1) for m in (*nodes, *edges)]
    records = materialize(_records(tables, entries), "records")
    is_edge = F.col("rel_type").isNotNull()
    summary = records.groupBy("loader").agg(F.count_if(~is_edge).alias("nodes_loaded"), F.count_if(is_edge).alias("edges_loaded"))
    return merge_nodes(_nodes_of(records)), merge_edges(_edges_of(records)), summary


# ---------------------------------------------------------------- checks


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose start or end node is missing, marked by the missing ``side``."""

    def without(side: str) -> DataFrame:
        keys = nodes.select(F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key"))
        return edges.join(keys, [f"{side}_label", f"{side}_key"], "left_anti").select(
            *EDGE_KEY, F.lit(side).alias("side")
        )

    return without("src").unionByName(without("dst"))


def constraint_violations(raw_nodes: DataFrame, key_properties: dict[str, str] = KEY_PROPERTIES) -> DataFrame:
    """Duplicate or null key values per label in ``(label, props)``."""
    pairs = [x for item in key_properties.items() for x in (F.lit(item[0]), F.lit(item[1]))]
    prop = F.try_element_at(F.create_map(*pairs), F.col("label"))
    keyed = raw_nodes.where(F.col("label").isin(*key_properties)).select(
        "label", prop.alias("key_property"), F.try_element_at("props", prop).alias("value")
    )
    counted = keyed.groupBy("label", "key_property", "value").agg(F.count("*").alias("n"))
    return counted.where("value IS NULL OR n > 1").withColumn(
        "violation", F.when(F.col("value").isNull(), F.lit("null")).otherwise(F.lit("duplicate"))
    )


def check_predicates(edges: DataFrame) -> DataFrame:
    """Predicates in use with their relationship type; unknown ones have none."""
    used = edges.groupBy("predicate").agg(F.count("*").alias("n"))
    name = F.upper("predicate")
    fits = F.col("predicate").isin(*PREDICATES) & name.rlike("^[A-Z_][A-Z0-9_]*$")
    return used.select("predicate", "n", F.when(fits, name).alias("rel_type"), fits.alias("known"))


# ---------------------------------------------------------------- counts and lookups


def kg_stats(nodes: DataFrame, edges: DataFrame, required: dict[str, list[str]] | None = None) -> DataFrame:
    """``(kind, name, n)``: nodes by label, edges by type, nodes that have all given properties."""
    out = nodes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    out = out.unionByName(
        edges.groupBy(F.lit("type").alias("kind"), F.col("rel_type").alias("name")).agg(F.count("*").alias("n"))
    )
    for label, names in (required or {}).items():
        has_all = F.forall(F.array(*[F.lit(n) for n in names]), lambda p: F.map_contains_key("props", p))
        out = out.unionByName(
            nodes.where((F.col("label") == label) & has_all).agg(F.count("*").alias("n")).select(
                F.lit("with_properties").alias("kind"), F.lit(f"{label}: {', '.join(names)}").alias("name"), "n"
            )
        )
    return out


def find_nodes(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Nodes for each ``(request_id, label, wanted map)``: all wanted properties must be equal.

    The wanted property that the fewest nodes have leads the equi-join, the others are compared
    on the joined row; so a value that most nodes have is never joined if there is a rarer one. A request
    that wants nothing but nulls finds nothing.
    """
    same = ["label", "prop", "value"]
    asked = requests.select("request_id", "label", "wanted").withColumn("ask", F.to_json(F.array_sort(F.map_entries("wanted"))))
    entries = asked.select("request_id", "label", "ask", F.explode("wanted").alias("prop", "value")).where("value IS NOT NULL")
    offered = nodes.select("label", "key", "props", F.explode("props").alias("prop", "value"))
    offered = offered.join(entries.select(*same).distinct(), same, "left_semi")
    counts = offered.groupBy(*same).agg(F.count("*").alias("n"))
    lead = entries.join(counts, same, "left").groupBy("request_id", "label", "ask").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "prop", "value")).alias("lead"))
    led = asked.join(lead, ["request_id", "label", "ask"]).select("request_id", "label", "wanted", "lead.prop", "lead.value")
    rest = F.forall(F.map_entries("wanted"), lambda e: F.try_element_at(F.col("props"), e["key"]).eqNullSafe(e["value"]))
    return led.join(offered, same).where(rest).select("request_id", "label", "key", "props")


def find_edges(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Each ``(request_id, endpoints, rel_type)`` with ``found`` and the edge's properties."""
    hits = edges.select(*EDGE_KEY, "props", F.lit(True).alias("found"))
    return requests.join(hits, EDGE_KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))


# ---------------------------------------------------------------- patterns


def localized_counts(edges: DataFrame, near: tuple[str, str, str], far: tuple[str, str, str]) -> DataFrame:
    """Paths (A)-r1-(B)-r2->(C) counted per C; r1 may point either way.

    ``near`` is (label A, r1, label B), ``far`` (label B, r2, label C). Edges are counted per B
    before the join, so no path is ever a row.
    """
    a, r1, b = near
    _, r2, c = far
    along = edges.where((F.col("rel_type") == r1) & (F.col("src_label") == a) & (F.col("dst_label") == b))
    back = edges.where((F.col("rel_type") == r1) & (F.col("src_label") == b) & (F.col("dst_label") == a))
    touching = along.select(F.col("dst_key").alias("b")).unionByName(back.select(F.col("src_key").alias("b")))
    per_b = touching.groupBy("b").agg(F.count("*").alias("paths"))
    placed = edges.where((F.col("rel_type") == r2) & (F.col("src_label") == b) & (F.col("dst_label") == c)).select(
        F.col("src_key").alias("b"), F.col("dst_key").alias("place")
    )
    return placed.join(per_b, "b").groupBy("place").agg(F.sum("paths").alias("n"))


def path_match(edges: DataFrame, pattern: list[str], keys: dict[int, str] | None = None) -> DataFrame:
    """Directed fixed-length paths.

    ``pattern`` alternates labels and types: [label0, type1, label1, ...]; ``keys`` fixes the
    key of some positions. Every filter is applied to its hop before the joins.
    """
    keys = keys or {}
    out = None
    for hop in range(len(pattern) // 2):
        src, rel, dst = pattern[2 * hop : 2 * hop + 3]
        part = edges.where(
            (F.col("src_label") == src) & (F.col("rel_type") == rel) & (F.col("dst_label") == dst)
        ).select(F.col("src_key").alias(f"n{hop}"), F.col("dst_key").alias(f"n{hop + 1}"))
        for position in (hop, hop + 1):
            if position in keys:
                part = part.where(F.col(f"n{position}") == keys[position])
        out = part if out is None else out.join(part, f"n{hop}")
    return out.select(*[f"n{i}" for i in range(len(pattern) // 2 + 1)])


def one_hop(nodes: DataFrame, edges: DataFrame, rel_type: str, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
    """Edges of a type with the names of both ends."""
    kept = edges.where(F.col("rel_type") == rel_type)
    if src_label:
        kept = kept.where(F.col("src_label") == src_label)
    if dst_label:
        kept = kept.where(F.col("dst_label") == dst_label)

    def named(side: str) -> DataFrame:
        return nodes.select(
            F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key"),
            F.try_element_at("props", F.lit("name")).alias(f"{side}_name"),
        )

    return (
        kept.select(*EDGE_KEY)
        .join(named("src"), ["src_label", "src_key"])
        .join(named("dst"), ["dst_label", "dst_key"])
        .select("src_label", "src_key", "src_name", "rel_type", "dst_label", "dst_key", "dst_name")
    )


def pairs_with_prefix(edges: DataFrame, rel_type: str, label: str, prefix: str) -> DataFrame:
    """Pairs of one label whose keys both start with a prefix."""
    return edges.where(
        (F.col("rel_type") == rel_type) & (F.col("src_label") == label) & (F.col("dst_label") == label)
        & F.col("src_key").startswith(prefix) & F.col("dst_key").startswith(prefix)
    ).select(F.col("src_key").alias("a"), F.col("dst_key").alias("b"))


def members_per_group(edges: DataFrame, rel_type: str, src_label: str, dst_label: str) -> DataFrame:
    """Number of members of every group node."""
    return (
        edges.where((F.col("rel_type") == rel_type) & (F.col("src_label") == src_label) & (F.col("dst_label") == dst_label))
        .groupBy(F.col("dst_key").alias("group"))
        .agg(F.count("*").alias("members"))
    )


def first_members(edges: DataFrame, rel_type: str, src_label: str, dst_label: str, limit: int = 15) -> DataFrame:
    """The first members of every group by key (a top-n report)."""
    rows = edges.where(
        (F.col("rel_type") == rel_type) & (F.col("src_label") == src_label) & (F.col("dst_label") == dst_label)
    ).select(F.col("dst_key").alias("group"), F.col("src_key").alias("member"), F.lit(0).alias("_s"))
    return ranked(rows, ["group"], "_s", ["member"], limit).drop("_s")


# ---------------------------------------------------------------- subgraphs
# Explorer nodes are (id, name, type, level, category), links (source, target, predicate).


def level_names(spark) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level int, level_name string, focus string")


def induced_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with both ends among the nodes."""
    return links.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(
        nodes.select(F.col("id").alias("target")), "target", "left_semi"
    )


def level_subgraph(nodes: DataFrame, links: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of a level and their direct neighbours, with the links among them."""
    core = nodes.where(F.col("level") == level).select("id")
    after = links.join(core.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    before = links.join(core.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    wanted = core.unionByName(after).unionByName(before).distinct()
    kept = nodes.join(wanted, "id", "left_semi")
    named = (
        kept.join(F.broadcast(level_names(nodes.sparkSession)), "level", "left")
        .withColumn("level_name", F.coalesce("level_name", F.lit("Unknown")))
        .withColumn("focus", F.coalesce("focus", F.lit("")))
    )
    return named, induced_links(kept, links)


def category_subgraph(nodes: DataFrame, links: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    kept = nodes if category == "all" else nodes.where(F.col("category") == category)
    return kept, induced_links(kept, links)


def search_nodes(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """``(term, id, name)`` of nodes whose name (any case) or id contains the trimmed term."""
    wanted = [t.strip().lower() for t in terms if t.strip()]
    if not wanted:
        return nodes.select(F.lit("").alias("term"), "id", "name").limit(0)
    hits = F.filter(
        F.array(*[F.lit(t) for t in wanted]),
        lambda t: F.contains(F.lower(F.col("name")), t) | F.contains(F.col("id"), t),
    )
    return nodes.select(F.explode(hits).alias("term"), "id", "name")
