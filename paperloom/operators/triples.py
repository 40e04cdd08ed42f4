"""Mentions, relation extraction, triple validation, provenance and contradictions.

Triples are ``(paper, subject, predicate, object, confidence, evidence, ord)``. ``ord`` is any
orderable column (a number or a struct) that gives the order in which papers and
sentences are taken; no global row number is ever formed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.session import materialize

# Vocabulary, thresholds and reasons whose results must stay the same.
PREDICATES = (
    "encoded_by", "localizes_to", "part_of", "subunit_of", "participates_in", "catalyzes", "produces",
    "consumes", "regulates", "activates", "inhibits", "interacts_with", "causes", "treats", "associated_with",
    "mutated_in", "cited_by", "contradicts", "supports",
)
OPPOSITES = {
    "activates": "inhibits",
    "inhibits": "activates",
    "produces": "consumes",
    "consumes": "produces",
}
MIN_CONFIDENCE = 0.70
BAD_PREDICATE = "predicate not in Biolink whitelist"
LOW_CONFIDENCE = "confidence below threshold"
UNRESOLVED = "subject or object has no ontology match"
CONTRADICTS = "contradicts high-confidence existing triple"
OPPOSING = "opposing predicates for same entity pair"
METHOD = "heuristic_phase6"


class Alias(NamedTuple):
    literal: str
    entity_id: str
    label: str


class Rule(NamedTuple):
    """A relation pattern. Subject and object are a group number or a fixed entity id."""

    pattern: str
    subject: int | str
    predicate: str
    object: int | str
    confidence: float
    variant_subject: bool = False


# The built-in mention dictionary and relation rules.
MENTIONS = (
    Alias("Complex I", "Complex I", "Complex"),
    Alias("MELAS", "MONDO:0010789", "Disease"),
    Alias("m.3243A>G", "m.3243A>G", "Variant"),
    Alias("MT-ND4", "MT-ND4", "Gene"),
    Alias("ND4", "MT-ND4", "Gene"),
    Alias("PINK1", "PINK1", "Gene"),
    Alias("Parkin", "PRKN", "Gene"),
    Alias("PRKN", "PRKN", "Gene"),
    Alias("Idebenone", "DB09081", "Drug"),
)
ALIASES = MENTIONS + (
    Alias("ComplexI", "Complex I", "Complex"),
    Alias("MELAS syndrome", "MONDO:0010789", "Disease"),
    Alias("MONDO:0010789", "MONDO:0010789", "Disease"),
    Alias("HGNC:7460", "MT-ND4", "Gene"),
)
RULES = (
    Rule(r"(?id)\b(?:MT-)?ND4\b.*\bsubunit of\b.*\bComplex I\b", "MT-ND4", "subunit_of", "Complex I", 0.91),
    Rule(
        r"(?id)(m\.\d+[ACGT]>[ACGT]).{0,100}\b(?:causes?|associated with|leads to)\b"
        r".{0,100}\b(MELAS(?: syndrome)?)\b",
        1, "causes", "MONDO:0010789", 0.88, True,
    ),
    Rule(
        r"(?i)\b(PINK1|Parkin|PRKN|Idebenone)\b\s+activates\s+\b(PINK1|Parkin|PRKN|Complex I)\b",
        1, "activates", 2, 0.84,
    ),
    Rule(
        r"(?i)\b(PINK1|Parkin|PRKN|Idebenone)\b\s+inhibits\s+\b(PINK1|Parkin|PRKN|Complex I)\b",
        1, "inhibits", 2, 0.84,
    ),
)


# ---------------------------------------------------------------- mentions


def _quoted(literal: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c in " _") else c for c in literal)


def _branch(literal: str, longer: list[str]) -> str:
    """A literal as one branch of an alternation.

    Where it begins and ends in a letter or digit, a word must begin and end. It gives way to
    each of the ``longer`` literals that begins inside it and runs past its end.
    """
    low, gives_way = literal.lower(), ""
    for other in longer:
        for n in range(1, len(low)):
            if low[n:] == other.lower()[: len(low) - n] and not (low[n - 1].isalnum() and low[n].isalnum()):
                gives_way += f"(?!{_quoted(literal[:n])}{_branch(other, longer[: longer.index(other)])})"
    word = literal[0].isalnum() and literal[-1].isalnum()
    return gives_way + (f"\\b{_quoted(literal)}\\b" if word else _quoted(literal))


def _overlaps_itself(literal: str) -> bool:
    folded = literal.lower()
    return any(folded[:n] == folded[-n:] for n in range(1, len(folded))) and " " in literal


def extract_mentions(docs: DataFrame, aliases=MENTIONS, allow_self_overlap: bool = False) -> DataFrame:
    """Dictionary mentions with offsets; longer literals win over shorter ones that they overlap.

    All literals are one alternation, longest first, so a text is scanned as often for a
    thousand as for one; what a match means is looked up by its lower-cased text. Documents
    are never shuffled.
    """
    ordered = sorted(aliases, key=lambda a: -len(a.literal))
    literals = [a.literal for a in ordered]
    wrong = [x for x in literals if _overlaps_itself(x)]
    if wrong and not allow_self_overlap:
        raise ValueError(f"literals that can overlap themselves: {wrong}")
    first = {a.literal.lower(): a for a in reversed(ordered)}
    known = F.create_map(*[F.lit(x) for key, a in first.items() for x in (key, f"{a.label}\t{a.entity_id}")])
    pattern = "(?iu)(?:" + "|".join(_branch(x, literals[:n]) for n, x in enumerate(literals)) + ")"

    def meant(m: Column) -> Column:
        alias = F.split(F.element_at(known, F.lower(m["mention"])), "\t")
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["mention"].alias("mention"),
            F.get(alias, 0).alias("entity_type"), F.get(alias, 1).alias("normalized_id"),
        )

    found = F.transform(tx.match_spans(F.col("text"), pattern, {"mention": 0}), meant)
    return tx.inlined(docs.select("doc_id", "text"), ["doc_id"], found, "start")


def _lookup(aliases, field: str) -> Column:
    pairs = []
    for alias in aliases:
        pairs += [F.lit(alias.literal.lower()), F.lit(getattr(alias, field))]
    return F.create_map(*pairs)


def resolved(mention: Column, aliases=ALIASES, field: str = "entity_id") -> Column:
    """Entity id (or label) of a mention for a small built-in dictionary; null if unknown."""
    return F.try_element_at(_lookup(aliases, field), F.lower(tx.strip(mention)))


def link_entities(df: DataFrame, aliases: DataFrame, column: str = "mention") -> DataFrame:
    """Add ``normalized_id, label`` from an alias table ``(alias, normalized_id, label)``.

    Unresolved mentions stay. Spark broadcasts the alias table only if it is small.
    """
    key = F.lower(tx.strip(F.col(column)))
    return df.withColumn("alias", key).join(aliases, "alias", "left").drop("alias")


def mentioned_entities(text: Column, patterns: dict[str, tuple[str, str]]) -> Column:
    """Entities whose name occurs anywhere in the text: array<struct<mention,type,id>>."""
    low = F.lower(text)
    every = F.array(
        *[
            F.when(
                F.contains(low, F.lit(name.lower())),
                F.struct(F.lit(name).alias("mention"), F.lit(kind).alias("entity_type"), F.lit(key).alias("normalized_id")),
            )
            for name, (kind, key) in patterns.items()
        ]
    )
    return F.filter(every, lambda e: e.isNotNull())


# ---------------------------------------------------------------- extraction


def canonical_variant(value: Column) -> Column:
    """``M.3243a>g`` becomes ``m.3243A>G``; anything else stays."""
    form = r"(?i)^m\.(\d+)([ACGT])>([ACGT])"
    return F.when(
        value.rlike(form),
        F.concat(
            F.lit("m."), F.regexp_extract(value, form, 1), F.upper(F.regexp_extract(value, form, 2)),
            F.lit(">"), F.upper(F.regexp_extract(value, form, 3)),
        ),
    ).otherwise(value)


def extract_sentence_triples(docs: DataFrame, rules=RULES, aliases=ALIASES) -> DataFrame:
    """All rule hits: ``(doc_id, sentence, rule, subject, predicate, object, confidence, evidence)``.

    Each rule takes its first match per sentence. Groups must resolve to known entities.
    """
    rows = tx.exploded(docs, ["doc_id"], tx.sentences(F.col("text")), "evidence", position="sentence")

    def side(rule: Rule, which: int | str, variant: bool) -> Column:
        if isinstance(which, str):
            return F.lit(which)
        found = F.regexp_extract("evidence", rule.pattern, which)
        return canonical_variant(found) if variant else resolved(found, aliases)

    hits = F.array(
        *[
            F.when(
                F.col("evidence").rlike(rule.pattern),
                F.struct(
                    F.lit(n).alias("rule"),
                    side(rule, rule.subject, rule.variant_subject).alias("subject"),
                    F.lit(rule.predicate).alias("predicate"),
                    side(rule, rule.object, False).alias("object"),
                    F.lit(float(rule.confidence)).alias("confidence"),
                ),
            )
            for n, rule in enumerate(rules)
        ]
    )
    known = F.filter(hits, lambda h: h["subject"].isNotNull() & h["object"].isNotNull())
    return tx.inlined(rows, ["doc_id", "sentence", "evidence"], known, "rule")


def dedupe_triples(triples: DataFrame) -> DataFrame:
    """First triple per paper and (subject, predicate, object).

    The ``= 1`` filter keeps one row per group and task before the shuffle.
    """
    within = Window.partitionBy("paper", "subject", "predicate", "object").orderBy("ord")
    return triples.withColumn("_n", F.row_number().over(within)).where("_n = 1").drop("_n")


def extract_triples(docs: DataFrame, rules=RULES, aliases=ALIASES) -> DataFrame:
    """Triples per document, repeats removed, in the order of documents, sentences and rules."""
    found = extract_sentence_triples(docs, rules, aliases).select(
        F.col("doc_id").alias("paper"), "sentence", "rule", "subject", "predicate", "object",
        "confidence", "evidence", F.struct("doc_id", "sentence", "rule").alias("ord"),
    )
    return dedupe_triples(found)


# ---------------------------------------------------------------- decisions


def validate_triples(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Add ``valid, reason``; ``entities(normalized_id)`` are the known entities.

    The first failing test gives the reason. The predicate list is compiled into the plan.
    """
    known = entities.select("normalized_id").distinct()
    checked = (
        triples.join(known.select(F.col("normalized_id").alias("subject"), F.lit(True).alias("_s")), "subject", "left")
        .join(known.select(F.col("normalized_id").alias("object"), F.lit(True).alias("_o")), "object", "left")
    )
    reason = (
        F.when(~F.col("predicate").isin(*PREDICATES), F.lit(BAD_PREDICATE))
        .when(F.col("confidence") < MIN_CONFIDENCE, F.lit(LOW_CONFIDENCE))
        .when(F.col("_s").isNull() | F.col("_o").isNull(), F.lit(UNRESOLVED))
    )
    return checked.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_s", "_o")


def opposite(predicate: Column) -> Column:
    pairs = [F.lit(x) for item in OPPOSITES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), predicate)


def _pair(predicate: Column) -> Column:
    """One name for a predicate and its opposite."""
    return F.coalesce(F.least(predicate, opposite(predicate)), predicate)


def decide_triples(validated: DataFrame, existing: DataFrame | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Add ``status, reason``: rejected, merged or contradiction.

    Triples are taken in order. One contradicts if an edge with the opposite predicate is
    there whose confidence is at least ``min_confidence``; else it merges, and its edge then
    has that confidence. So of a (subject, object, predicate pair) the stored predicate that
    is sure from the beginning wins, without one the earliest accepted triple's, and where both are sure
    every triple contradicts. ``existing(subject, predicate, object, confidence)`` are the
    edges of earlier runs and other loaders; no confidence means zero, no such column sure edges.

    The winner is found by an aggregate with partial results, stored and joined back, so a pair that
    holds a third of all triples never has to pass through one window, and where the pairs are few, Spark
    knows before it would shuffle the triples.
    """
    accepted = validated.where("valid").withColumn("pair", _pair(F.col("predicate")))
    winners = accepted.groupBy("subject", "object", "pair").agg(
        F.min_by("predicate", "ord").alias("winner")
    )
    if existing is not None:
        # Only pairs that come up again matter, so the stored edges are cut down before grouping.
        winners = materialize(winners, "winners")
        sure = existing.where(F.col("confidence") >= min_confidence) if "confidence" in existing.columns else existing
        earlier = (
            sure.withColumn("pair", _pair(F.col("predicate")))
            .join(winners, ["subject", "object", "pair"], "left_semi")
            .groupBy("subject", "object", "pair")
            .agg(F.min("predicate").alias("least"), F.max("predicate").alias("most"))
        )
        both = F.lit("")  # no triple has this predicate, so all of them clash
        winners = winners.join(earlier, ["subject", "object", "pair"], "left").select(
            "subject", "object", "pair",
            F.when(F.col("least") != F.col("most"), both).otherwise(F.coalesce("least", "winner")).alias("winner"),
        )
    winners = materialize(winners, "winners")
    clash = F.col("predicate") != F.col("winner")
    decided = accepted.join(winners, ["subject", "object", "pair"]).select(
        *[c for c in validated.columns if c not in ("reason", "valid")],
        F.when(clash, F.lit("contradiction")).otherwise(F.lit("merged")).alias("status"),
        F.when(clash, F.lit(CONTRADICTS)).otherwise(F.lit("")).alias("reason"),
        F.when(clash, opposite(F.col("predicate"))).alias("existing_predicate"),
    )
    rejected = validated.where(~F.col("valid")).select(
        *[c for c in validated.columns if c not in ("reason", "valid")],
        F.lit("rejected").alias("status"),
        "reason",
        F.lit(None).cast("string").alias("existing_predicate"),
    )
    return decided.unionByName(rejected)


def paper_id(pmid: Column, doi: Column, evidence: Column) -> Column:
    """pmid, else doi, else sixteen digits of the evidence hash."""
    return F.coalesce(
        F.when(pmid != "", pmid), F.when(doi != "", doi), tx.hex_id(F.sha1(evidence), 16)
    )


def evidence_papers(decided: DataFrame) -> DataFrame:
    """Supporting papers of every merged edge, one row each, ordered by ``first_seen``.

    Kept as rows: an edge supported by most papers is still spread over all tasks.
    """
    return (
        decided.where("status = 'merged'")
        .groupBy("subject", "predicate", "object", "paper")
        .agg(F.min("ord").alias("first_seen"))
    )


EDGE_SCHEMA = (
    "subject string, predicate string, object string, rel_type string, evidence_count long, confidence double, evidence string, "
    "first_paper string, last_paper string, paper_doi string, paper_pmid string, extraction_method string, created string"
)
EDGE = ["subject", "predicate", "object"]


def merge_provenance(decided: DataFrame) -> DataFrame:
    """One row per merged edge: evidence count, best confidence, latest evidence and paper."""
    return _per_edge(_per_paper(decided)).drop("paper_doi", "paper_pmid").withColumn("rel_type", F.upper("predicate")).withColumn(
        "extraction_method", F.lit(METHOD)
    )


def _per_paper(decided: DataFrame) -> DataFrame:
    """One row per merged edge and paper, with what its last triple says."""
    told = [F.col(c) if c in decided.columns else F.lit("").alias(c) for c in ("paper_doi", "paper_pmid")]
    return (
        decided.where("status = 'merged'")
        .select(*EDGE, "paper", "confidence", "ord", "evidence", *told)
        .groupBy(*EDGE, "paper")
        .agg(
            F.max("confidence").alias("confidence"),
            F.max(F.struct("ord", "evidence", "paper_doi", "paper_pmid")).alias("last"),
            F.min("ord").alias("first"),
        )
    )


def _per_edge(per_paper: DataFrame, *more: Column) -> DataFrame:
    last = F.max_by(F.struct("last.evidence", "last.paper_doi", "last.paper_pmid", "paper"), "last.ord")
    found = per_paper.groupBy(*EDGE).agg(
        F.count("*").alias("evidence_count"), F.max("confidence").alias("confidence"), last.alias("last"), F.min_by("paper", "first").alias("first_paper"), *more
    )
    names = [c for c in found.columns if c not in (*EDGE, "last")]
    return found.select(
        *EDGE, *names, "last.evidence", F.col("last.paper").alias("last_paper"), F.coalesce("last.paper_doi", F.lit("")).alias("paper_doi"),
        F.coalesce("last.paper_pmid", F.lit("")).alias("paper_pmid"),
    )


def adopted_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of other loaders as stored ones, and their evidence papers as rows.

    ``evidence_papers`` is a list or null. Without a list an edge stands on its pmid, else its
    doi, else on as many unnamed papers as it counts.
    """
    named = F.coalesce(F.when(F.col("paper_pmid") != "", F.col("paper_pmid")), F.when(F.col("paper_doi") != "", F.col("paper_doi")))
    numbers = F.when(F.col("evidence_count") > 0, F.sequence(F.lit(0).cast("long"), F.col("evidence_count") - 1))
    unnamed = F.transform(numbers, lambda i: F.concat(F.lit("evidence:"), i.cast("string")))
    none = F.array().cast("array<string>")
    listed = F.array_distinct(F.coalesce("evidence_papers", F.when(named.isNotNull(), F.array(named)), unnamed, none))
    told = edges.withColumn("evidence_papers", listed)
    kept = told.withColumns({
        "evidence_count": F.size("evidence_papers").cast("long"), "first_paper": F.get("evidence_papers", F.lit(0)),
        "last_paper": F.get("evidence_papers", F.size("evidence_papers") - 1),
    }).drop("evidence_papers")
    return kept, told.select(*EDGE, F.explode("evidence_papers").alias("paper"))


def merge_stored_provenance(decided: DataFrame, existing: DataFrame, papers: DataFrame, created: Column) -> tuple[DataFrame, DataFrame]:
    """Stored edges with the merged triples of a run, and the evidence papers that the run adds.

    ``existing`` has the columns of ``EDGE_SCHEMA``; ``papers(subject, predicate, object,
    paper)`` are the stored evidence papers, or those among them that the run names again. A
    count grows by the papers that are new to the edge, the best confidence stays, evidence,
    doi and pmid are those of the last triple, first paper, method and time of creation
    those of the first. Edges without new triples come back as they are. So runs one after
    the other give what one run over all their triples gives, wherever it is cut between papers.
    """
    # Both results need it, so it is stored.
    marked = materialize(
        _per_paper(decided).join(papers.select(*EDGE, "paper").distinct().withColumn("known", F.lit(True)), [*EDGE, "paper"], "left"), "marked"
    )
    new = _per_edge(marked, F.count_if(F.col("known").isNull()).alias("added")).drop("evidence_count")
    both = existing.alias("o").join(new.alias("n"), EDGE, "full")

    def later(column):
        return F.coalesce(F.col(f"n.{column}"), F.col(f"o.{column}")).alias(column)

    def earlier(column, otherwise):
        return F.coalesce(F.col(f"o.{column}"), otherwise).alias(column)

    edges = both.select(
        *EDGE, earlier("rel_type", F.upper("predicate")), (F.coalesce("o.evidence_count", F.lit(0)) + F.coalesce("n.added", F.lit(0))).alias("evidence_count"),
        F.greatest("o.confidence", "n.confidence").alias("confidence"), later("evidence"), earlier("first_paper", F.col("n.first_paper")), later("last_paper"),
        later("paper_doi"), later("paper_pmid"), earlier("extraction_method", F.lit(METHOD)), earlier("created", created),
    )
    return edges, marked.where("known IS NULL").select(*EDGE, "paper")


def disputed_pairs(validated: DataFrame) -> DataFrame:
    """``(subject, object, pair)`` that valid triples claim a predicate and its opposite of."""
    claimed = validated.where("valid").withColumn("pair", _pair(F.col("predicate")))
    both = claimed.groupBy("subject", "object", "pair").agg(F.min("predicate").alias("least"), F.max("predicate").alias("most"))
    return both.where("least <> most").select("subject", "object", "pair")


def hypothesis(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat_ws(" ", subject, F.lower(predicate), obj)


def contradiction_records(decided: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that model every contradiction.

    ``existing(subject, predicate, object, evidence)`` are stored edges, whose evidence
    describes an old hypothesis that no triple of this run had renewed before the clash.

    Nodes ``(label, key, props)``: both disputed hypotheses and the contradiction itself.
    Edges ``(src_label, src_key, rel_type, dst_label, dst_key, props)``: the two
    hypotheses contradict each other and the new one is supported by the paper.
    """
    clashes = decided.where("status = 'contradiction'").select(
        "subject", "object", "predicate", "existing_predicate", "evidence", "paper", "ord",
        hypothesis(F.col("subject"), F.col("predicate"), F.col("object")).alias("new_name"),
        hypothesis(F.col("subject"), F.col("existing_predicate"), F.col("object")).alias("old_name"),
    )
    # The old hypothesis tells the evidence that was current at the last clash.
    last = materialize(clashes.groupBy("subject", "object", "existing_predicate", "old_name").agg(F.max("ord").alias("until")), "last")
    merged = decided.where("status = 'merged'").select(
        "subject", "object", F.col("predicate").alias("existing_predicate"), "evidence", "ord"
    )
    disputed = ["subject", "object", "existing_predicate"]
    renewed = F.col("ord") < F.col("until")
    old = last.join(merged, disputed).where(renewed).groupBy("old_name", "until").agg(F.max_by("evidence", "ord").alias("description"))
    old = old.withColumnRenamed("until", "at")
    if existing is not None:
        stored = existing.select("subject", "object", F.col("predicate").alias("existing_predicate"), F.col("evidence").alias("stored"))
        named = last.join(stored, disputed, "left").select("old_name", F.col("until").alias("at"), "stored")
        old = named.join(old.drop("at"), "old_name", "left").select("old_name", F.coalesce("description", "stored", F.lit("")).alias("description"), "at")
    new = clashes.groupBy("new_name").agg(F.max_by("evidence", "ord").alias("description"), F.max("ord").alias("at"))
    # Where both predicates were sure, a hypothesis may be the new one of one clash and the old one of another: the last clash tells.
    told = new.withColumnRenamed("new_name", "name").unionByName(old.withColumnRenamed("old_name", "name"))
    told = told.groupBy("name").agg(F.max_by("description", "at").alias("description"))

    def node(df, label, key, **props):
        entries = [x for name, value in props.items() for x in (F.lit(name), value.cast("string"))]
        return df.select(F.lit(label).alias("label"), key.alias("key"), F.create_map(*entries).alias("props"))

    hypotheses = node(told, "Hypothesis", F.col("name"), name=F.col("name"), description=F.col("description"), status=F.lit("disputed"))
    clash_id = tx.hex_id(F.sha1(F.concat_ws("|", "new_name", "old_name", "evidence")), 16)
    clash_rows = (
        clashes.withColumn("id", clash_id)
        .groupBy("id", "subject", "object", "predicate", "existing_predicate", "evidence")
        .agg(F.max_by("paper", "ord").alias("paper"))
    )
    contradictions = node(
        clash_rows, "Contradiction", F.col("id"), id=F.col("id"), subject_id=F.col("subject"),
        object_id=F.col("object"), new_predicate=F.col("predicate"), existing_predicate=F.col("existing_predicate"),
        evidence=F.col("evidence"), paper_doi=F.col("paper"),
    )
    nodes = hypotheses.unionByName(contradictions)

    pairs = clashes.select("new_name", "old_name")
    pairs = pairs.union(pairs.select("old_name", "new_name")).distinct()
    reason = F.create_map(F.lit("reason"), F.lit(OPPOSING))

    def edge(df, src, rel, dst_label, dst, props):
        return df.select(
            F.lit("Hypothesis").alias("src_label"), F.col(src).alias("src_key"), F.lit(rel).alias("rel_type"),
            F.lit(dst_label).alias("dst_label"), F.col(dst).cast("string").alias("dst_key"), props.alias("props"),
        )

    support = clashes.groupBy("new_name", "paper").agg(F.max_by("evidence", "ord").alias("evidence"))
    edges = (
        edge(pairs, "new_name", "CONTRADICTS", "Hypothesis", "old_name", reason)
        .unionByName(edge(support, "new_name", "SUPPORTS", "Paper", "paper", F.create_map(F.lit("evidence"), F.col("evidence"))))
    )
    return nodes, edges


def new_entities(decided: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(paper, new_entities)``: entities first seen in an accepted triple of the paper."""
    taken = decided.where("status <> 'rejected'")
    seen = taken.select("paper", F.explode(F.array("subject", "object")).alias("entity"), "ord")
    first = seen.groupBy("entity").agg(F.min_by("paper", "ord").alias("paper"))
    if existing is not None:
        first = first.join(existing.select("entity"), "entity", "left_anti")
    return first.groupBy("paper").agg(F.count("*").alias("new_entities"))


def paper_kg_summary(
    decided: DataFrame, entities: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Counts and the log line per paper; ``entities(paper, entities)`` are mention counts."""
    counts = decided.groupBy("paper").agg(
        F.count("*").alias("triples"),
        *[
            F.count_if(F.col("status") == status).alias(name)
            for status, name in (
                ("merged", "triples_merged"), ("rejected", "triples_rejected"), ("contradiction", "contradictions_detected"),
            )
        ],
    )
    out = (
        counts.join(entities, "paper", "full")
        .join(new_entities(decided, existing), "paper", "left")
        .fillna(0, ["triples", "triples_merged", "triples_rejected", "contradictions_detected", "entities", "new_entities"])
    )
    line = F.format_string(
        "Ingested paper %s: +%s triples, +%s new entities, %s contradiction detected",
        F.col("paper").cast("string"), F.col("triples_merged"), F.col("new_entities"), F.col("contradictions_detected"),
    )
    return out.withColumn("log_line", line)


def triple_precision(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of predicted triples that are in the gold set; zero if nothing was predicted."""
    keys = ["subject", "predicate", "object"]
    marked = predicted.select(*keys).join(
        gold.select(*keys).distinct().withColumn("hit", F.lit(1.0)), keys, "left"
    )
    return marked.agg(
        F.count("*").alias("predicted"),
        F.count("hit").alias("correct"),
        F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)).alias("precision"),
    )


def relation_conflicts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates against assertions with the opposite predicate over the same pair.

    Both are ``(subject, predicate, object, evidence_id)``. A conflict is the pair of a
    candidate relation and its opposite; its evidence ids are rows marked ``supporting`` or
    ``contradicting`` (n + m rows instead of n x m pairs, nothing lost).
    """
    keys = ["subject", "object", "predicate"]
    relations = candidates.select(*keys).distinct().withColumn("other", opposite(F.col("predicate")))
    stated = existing.select("subject", "object", F.col("predicate").alias("other")).distinct()
    conflicts = relations.where("other IS NOT NULL").join(stated, ["subject", "object", "other"])
    supporting = candidates.join(conflicts, keys).select(
        "subject", "object", "predicate", "other", F.lit("supporting").alias("side"), "evidence_id"
    )
    against = existing.withColumnRenamed("predicate", "other").join(conflicts, ["subject", "object", "other"]).select(
        "subject", "object", "predicate", "other", F.lit("contradicting").alias("side"), "evidence_id"
    )
    return supporting.unionByName(against).withColumn(
        "claim",
        F.concat_ws(
            " ", "subject", F.lit("has opposing"), F.concat_ws("/", "predicate", "other"), F.lit("relations to"), "object"
        ),
    )
