"""Registered mention and triple queries over documents and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.registry import register, table, with_ctes
from paperloom.functions import text as tx
from paperloom.functions.ranking import shown
from paperloom.operators import mentions as mn
from paperloom.operators import triples as tp
from paperloom.plans import graph_merge as gm
from paperloom.session import fresh_folder, materialize

ORDER = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()
# The same expressions run in Spark and in the SQL twin.
TRIPLE_EXPRESSIONS = (
    "CAST(l_orderkey AS STRING) AS paper",
    "'S' || CAST(l_suppkey % 10 AS STRING) AS subject",
    "CASE WHEN l_linenumber = 7 THEN 'dances_with' WHEN l_returnflag = 'A' THEN 'activates' "
    "WHEN l_returnflag = 'R' THEN 'inhibits' ELSE 'subunit_of' END AS predicate",
    "'P' || CAST(l_partkey % 50 AS STRING) AS object",
    "round(1 - 4 * l_discount, 2) AS confidence",
)
EVIDENCE = "concat_ws(' ', subject, predicate, object)"
RAW = f"""raw AS (
  SELECT *, {EVIDENCE} AS evidence FROM (
    SELECT {', '.join(TRIPLE_EXPRESSIONS)}, row_number() OVER (ORDER BY {', '.join(ORDER)}) AS seq FROM lineitem))"""
FIRST = """firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper, subject, predicate, object ORDER BY seq) AS n FROM raw) WHERE n = 1)"""
PREDICATE_SQL = ", ".join(f"'{p}'" for p in tp.PREDICATES)
VALID = f"""checked AS (
  SELECT *, CASE WHEN predicate NOT IN ({PREDICATE_SQL}) THEN '{tp.BAD_PREDICATE}' WHEN confidence < 0.7 THEN '{tp.LOW_CONFIDENCE}'
    WHEN CAST(substr(object, 2) AS INT) >= 48 THEN '{tp.UNRESOLVED}' END AS fault FROM firsts)"""
DECIDED = f"""accepted AS (
  SELECT *, CASE predicate WHEN 'inhibits' THEN 'activates' WHEN 'produces' THEN 'consumes' ELSE predicate END AS pair FROM checked WHERE fault IS NULL),
won AS (SELECT *, first(predicate) OVER (PARTITION BY subject, object, pair ORDER BY seq) AS winner FROM accepted),
decided AS (
  SELECT paper, subject, predicate, object, confidence, evidence, seq,
    CASE WHEN winner <> predicate THEN 'contradiction' ELSE 'merged' END AS status,
    CASE WHEN winner <> predicate THEN '{tp.CONTRADICTS}' ELSE '' END AS reason,
    CASE WHEN winner <> predicate THEN winner END AS existing_predicate FROM won
  UNION ALL
  SELECT paper, subject, predicate, object, confidence, evidence, seq, 'rejected', fault, NULL FROM checked WHERE fault IS NOT NULL)"""
CHAIN = (RAW, FIRST, VALID, DECIDED)


def raw_triples(spark, folder):
    """lineitem as triples; the order of all columns stands for the order of sentences."""
    columns = [F.expr(part) for part in TRIPLE_EXPRESSIONS]
    lines = table(spark, folder, "lineitem").select(F.struct(*ORDER).alias("ord"), *columns)
    return lines.withColumn("evidence", F.expr(EVIDENCE))


def known_entities(spark):
    """Ten subjects and forty-eight objects; objects 48 and 49 stay unknown."""
    subjects = spark.range(10).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("normalized_id"), F.lit("Gene").alias("label"))
    objects = spark.range(48).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("normalized_id"), F.lit("Complex").alias("label"))
    return subjects.unionByName(objects)


def decided_triples(spark, folder, stored=False):
    """Decisions over stored validated triples, stored in turn for the stages that share them."""
    firsts = tp.dedupe_triples(raw_triples(spark, folder))
    validated = materialize(tp.validate_triples(firsts, known_entities(spark)), "validated")
    decided = tp.decide_triples(validated)
    return materialize(decided, "decided") if stored else decided


CORPUS_ALIASES = (
    tp.Alias("attion to", "C:attion", "Complex"),
    tp.Alias("of the", "C:of-the", "Complex"),
    tp.Alias("in the", "C:in-the", "Complex"),
    tp.Alias("the and", "D:the-and", "Disease"),
    tp.Alias("that", "G:that", "Gene"),
    tp.Alias("the", "G:the", "Gene"),
    tp.Alias("und", "V:und", "Variant"),
    tp.Alias("que", "V:que", "Variant"),
    tp.Alias("was", "R:was", "Drug"),
)


def mention_ctes() -> str:
    """Literal matches, checked for word ends, each kept if no longer literal covers part of it."""
    parts, kept = [], []
    for n, a in enumerate(sorted(CORPUS_ALIASES, key=lambda a: -len(a.literal))):
        size = len(a.literal)
        clash = " ".join(
            f"AND NOT EXISTS (SELECT 1 FROM m{k} o WHERE o.doc_id = x.doc_id AND x.start < o.start + {s} AND x.start + {size} > o.start)"
            for k, s in kept
        )
        parts.append(f"""p{n} AS (
  SELECT doc_id, generate_subscripts(q, 1) AS i, unnest(q) AS piece, len(q) AS n FROM (
    SELECT doc_id, string_split_regex(text, '(?i){a.literal}') AS q FROM documents)),
m{n} AS (
  SELECT x.doc_id, x.start, x.start + {size} AS stop, substr(d.text, CAST(x.start AS BIGINT) + 1, {size}) AS mention, '{a.label}' AS entity_type, '{a.entity_id}' AS normalized_id
  FROM (SELECT doc_id, i, n, CAST(sum(length(piece) + {size}) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - {size} AS start FROM p{n}) x
  JOIN documents d ON d.doc_id = x.doc_id
  WHERE i < n AND NOT regexp_matches(substr(d.text, x.start, CASE WHEN x.start > 0 THEN 1 ELSE 0 END), '[\\p{{L}}\\p{{N}}_]')
    AND NOT regexp_matches(substr(d.text, x.start + {size} + 1, 1), '[\\p{{L}}\\p{{N}}_]') {clash})""")
        kept.append((n, size))
    union = " UNION ALL ".join(f"SELECT * FROM m{n}" for n, _ in kept)
    return ",\n".join(parts) + f",\nmentions AS ({union})"


@register("entity_mentions", "E17", with_ctes(mention_ctes(), select="""
SELECT doc_id, start, stop AS "end", mention, entity_type, normalized_id FROM mentions"""))
def entity_mentions(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text")
    found = tp.extract_mentions(docs, CORPUS_ALIASES)
    return found.withColumns({n: F.col(n).cast("long") for n in ("start", "end")})


@register("dictionary_mentions", "E17", r"""
WITH dictionary AS (
  SELECT DISTINCT lower(w) AS low FROM (
    SELECT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) FROM conversations)),
pieces AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS l FROM documents)),
placed AS (SELECT doc_id, w, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM pieces)
SELECT doc_id, stop - length(w) AS start, stop AS "end", w AS mention, CASE WHEN length(low) > 6 THEN 'Long' ELSE 'Short' END AS entity_type, 'W:' || low AS normalized_id
FROM placed JOIN dictionary ON lower(w) = low""")
def dictionary_mentions(spark, folder):
    """Every word of questions and conversations as a dictionary of the documents."""
    texts = table(spark, folder, "benchmark").select("text").unionByName(table(spark, folder, "conversations").select("text"))
    words = tx.exploded(texts, [], F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), "w").select(F.lower("w").alias("alias")).distinct()
    aliases = words.select("alias", F.when(F.length("alias") > 6, "Long").otherwise("Short").alias("entity_type"), F.concat(F.lit("W:"), "alias").alias("normalized_id"))
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text")
    return mn.dictionary_mentions(docs, aliases).withColumns({n: F.col(n).cast("long") for n in ("start", "end")})


@register("entity_linking", "E18", """
WITH m AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN '  ' || lower('S' || l_suppkey % 10) || ' ' ELSE 'P' || l_partkey % 50 END AS mention FROM lineitem)
SELECT mention, count(*) AS n, CASE WHEN mention LIKE 'P%' AND CAST(substr(mention, 2) AS INT) >= 48 THEN NULL ELSE upper(trim(mention)) END AS normalized_id,
  CASE WHEN mention LIKE 'P%' THEN CASE WHEN CAST(substr(mention, 2) AS INT) < 48 THEN 'Complex' END ELSE 'Gene' END AS label
FROM m GROUP BY mention""")
def entity_linking(spark, folder):
    mentions = table(spark, folder, "lineitem").select(
        F.expr(
            "CASE WHEN l_linenumber % 2 = 0 THEN '  ' || lower('S' || CAST(l_suppkey % 10 AS STRING)) || ' ' "
            "ELSE 'P' || CAST(l_partkey % 50 AS STRING) END"
        ).alias("mention")
    )
    aliases = known_entities(spark).withColumn("alias", F.lower("normalized_id"))
    counted = mentions.groupBy("mention").agg(F.count("*").alias("n"))
    return tp.link_entities(counted, aliases).select("mention", "n", "normalized_id", "label")


SENTENCES = r"""sents AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence, s FROM (
    SELECT doc_id, generate_subscripts(l, 1) AS i, trim(unnest(l), ' ' || chr(10) || chr(9)) AS s FROM (
      SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents)) WHERE s <> '')"""


@register("sentences", "E19", with_ctes(SENTENCES, select="SELECT doc_id, sentence, md5(s) AS text_md5 FROM sents"))
def sentences(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text")
    rows = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sentence", "s"))
    return rows.select("doc_id", F.col("sentence").cast("long").alias("sentence"), F.md5("s").alias("text_md5"))


CORPUS_RULES = (
    tp.Rule(r"(?i)(?:^|\s)(the|that)\s+(?:and|of)\s+(the|that)(?:$|\s)", 1, "activates", 2, 0.84),
    tp.Rule(r"(?i)(?:^|\s)(was|that|und)\s+(the|que|was)(?:$|\s)", 1, "inhibits", 2, 0.84),
    tp.Rule(r"(?i)(?:^|\s)of\s+the(?:$|\s)", "C:of-the", "subunit_of", "G:the", 0.91),
    tp.Rule(r"(?i)(?:^|\s)(la|the)\s+(que|and)(?:$|\s)", 1, "causes", "D:the-and", 0.88),
)


def rule_sql() -> str:
    known = ", ".join(f"'{a.literal}': '{a.entity_id}'" for a in CORPUS_ALIASES)

    def side(rule, which):
        if isinstance(which, str):
            return f"'{which}'"
        return f"(MAP {{{known}}})[lower(trim(regexp_extract(s, '{rule.pattern}', {which})))]"

    arms = " UNION ALL ".join(
        f"SELECT doc_id, sentence, {n} AS rule, {side(r, r.subject)} AS subject, '{r.predicate}' AS predicate, {side(r, r.object)} AS object, "
        f"{r.confidence}::DOUBLE AS confidence, s AS evidence FROM sents WHERE regexp_matches(s, '{r.pattern}')"
        for n, r in enumerate(CORPUS_RULES)
    )
    return f"hits AS (SELECT * FROM ({arms}) WHERE subject IS NOT NULL AND object IS NOT NULL)"


@register("relation_extraction", "E20", with_ctes(SENTENCES, rule_sql(), select="""
SELECT doc_id, sentence, rule::BIGINT AS rule, subject, predicate, object, confidence, md5(evidence) AS evidence_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, subject, predicate, object ORDER BY sentence, rule) AS n FROM hits) WHERE n = 1"""))
def relation_extraction(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text")
    found = tp.extract_triples(docs, CORPUS_RULES, CORPUS_ALIASES)
    return found.select(
        F.col("paper").alias("doc_id"), F.col("sentence").cast("long").alias("sentence"), F.col("rule").cast("long").alias("rule"),
        "subject", "predicate", "object", "confidence", F.md5("evidence").alias("evidence_md5"),
    )


@register("triple_dedupe", "E21", with_ctes(RAW, FIRST, select="SELECT paper, subject, predicate, object, confidence FROM firsts"))
def triple_dedupe(spark, folder):
    return tp.dedupe_triples(raw_triples(spark, folder)).select("paper", "subject", "predicate", "object", "confidence")


@register("triple_validation", "E22", with_ctes(RAW, FIRST, VALID, select="""
SELECT paper, subject, predicate, object, fault IS NULL AS valid, coalesce(fault, '') AS reason FROM checked"""))
def triple_validation(spark, folder):
    firsts = tp.dedupe_triples(raw_triples(spark, folder))
    out = tp.validate_triples(firsts, known_entities(spark))
    return out.select("paper", "subject", "predicate", "object", "valid", F.coalesce("reason", F.lit("")).alias("reason"))


@register("triple_decisions", "E23", with_ctes(*CHAIN, select="""
SELECT paper, subject, predicate, object, status, reason, existing_predicate FROM decided"""))
def triple_decisions(spark, folder):
    return decided_triples(spark, folder).select(
        "paper", "subject", "predicate", "object", "status", "reason", "existing_predicate"
    )


@register("edge_provenance", "E24", with_ctes(*CHAIN, select="""
SELECT subject, predicate, object, upper(predicate) AS rel_type, count(DISTINCT paper) AS evidence_count, max(confidence) AS confidence,
  arg_max(evidence, seq) AS evidence, arg_min(paper, seq) AS first_paper, arg_max(paper, seq) AS last_paper
FROM decided WHERE status = 'merged' GROUP BY 1, 2, 3"""))
def edge_provenance(spark, folder):
    return tp.merge_provenance(decided_triples(spark, folder)).drop("extraction_method")


@register("evidence_papers", "E24", with_ctes(*CHAIN, select="""
SELECT DISTINCT subject, predicate, object, paper FROM decided WHERE status = 'merged'"""))
def evidence_papers(spark, folder):
    return tp.evidence_papers(decided_triples(spark, folder)).drop("first_seen")


CLASH = """clash AS (
  SELECT *, concat_ws(' ', subject, predicate, object) AS new_name, concat_ws(' ', subject, existing_predicate, object) AS old_name
  FROM decided WHERE status = 'contradiction')"""


@register("contradiction_edges", "E25", with_ctes(*CHAIN, CLASH, select=f"""
SELECT 'Hypothesis' AS src_label, new_name AS src_key, 'CONTRADICTS' AS rel_type, 'Hypothesis' AS dst_label, old_name AS dst_key, 'reason={tp.OPPOSING}' AS props
FROM (SELECT DISTINCT new_name, old_name FROM clash)
UNION ALL SELECT 'Hypothesis', old_name, 'CONTRADICTS', 'Hypothesis', new_name, 'reason={tp.OPPOSING}' FROM (SELECT DISTINCT new_name, old_name FROM clash)
UNION ALL SELECT 'Hypothesis', new_name, 'SUPPORTS', 'Paper', paper, 'evidence=' || arg_max(evidence, seq) FROM clash GROUP BY new_name, paper"""))
def contradiction_edges(spark, folder):
    _, edges = tp.contradiction_records(decided_triples(spark, folder, stored=True))
    return edges.withColumn("props", flat_props(F.col("props")))


def flat_props(props):
    """A property map as one sorted ``key=value`` text, nulls shown as nothing."""
    entries = F.array_sort(F.map_entries(props))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";"
    )


@register("contradiction_nodes", "E25", with_ctes(*CHAIN, CLASH, select="""
SELECT 'Hypothesis' AS label, new_name AS key, 'description=' || arg_max(evidence, seq) || ';name=' || new_name || ';status=disputed' AS props FROM clash GROUP BY new_name
UNION ALL
SELECT 'Hypothesis', old_name, 'description=' || arg_max(d.evidence, d.seq) || ';name=' || old_name || ';status=disputed'
FROM (SELECT old_name, subject, object, existing_predicate, max(seq) AS until FROM clash GROUP BY ALL) c
JOIN decided d ON d.status = 'merged' AND d.subject = c.subject AND d.object = c.object AND d.predicate = c.existing_predicate AND d.seq < c.until GROUP BY old_name
UNION ALL
SELECT 'Contradiction', id, 'evidence=' || evidence || ';existing_predicate=' || existing_predicate || ';id=' || id || ';new_predicate=' || predicate
  || ';object_id=' || object || ';paper_doi=' || arg_max(paper, seq) || ';subject_id=' || subject
FROM (SELECT *, substr(sha1(new_name || '|' || old_name || '|' || evidence), 1, 16) AS id FROM clash) GROUP BY id, evidence, existing_predicate, predicate, object, subject"""))
def contradiction_nodes(spark, folder):
    nodes, _ = tp.contradiction_records(decided_triples(spark, folder, stored=True))
    return nodes.withColumn("props", flat_props(F.col("props")))


NEW = """seen AS (SELECT unnest([subject, object]) AS entity, paper, seq FROM decided WHERE status <> 'rejected'),
fresh AS (SELECT paper, count(*) AS new_entities FROM (SELECT entity, arg_min(paper, seq) AS paper FROM seen GROUP BY 1) GROUP BY 1)"""


@register("new_entities", "E26", with_ctes(*CHAIN, NEW, select="SELECT paper, new_entities FROM fresh"))
def new_entities(spark, folder):
    return tp.new_entities(decided_triples(spark, folder))


SUMMARY = """ents AS (SELECT paper, count(DISTINCT e) AS entities FROM (SELECT paper, unnest([subject, object]) AS e FROM raw) GROUP BY 1),
paper_summary AS (
  SELECT paper, entities, count(*) AS triples, count(*) FILTER (status = 'merged') AS triples_merged, count(*) FILTER (status = 'rejected') AS triples_rejected,
    count(*) FILTER (status = 'contradiction') AS contradictions_detected, coalesce(any_value(new_entities), 0) AS new_entities
  FROM decided JOIN ents USING (paper) LEFT JOIN fresh USING (paper) GROUP BY 1, 2)"""


def entity_counts(spark, folder):
    sides = raw_triples(spark, folder).select("paper", F.explode(F.array("subject", "object")).alias("entity"))
    return sides.distinct().groupBy("paper").agg(F.count("*").alias("entities"))


@register("paper_kg_summary", "E27", with_ctes(*CHAIN, NEW, SUMMARY, select="""
SELECT *, 'Ingested paper ' || paper || ': +' || triples_merged || ' triples, +' || new_entities || ' new entities, ' || contradictions_detected || ' contradiction detected' AS log_line
FROM paper_summary"""))
def paper_kg_summary(spark, folder):
    return tp.paper_kg_summary(decided_triples(spark, folder, stored=True), entity_counts(spark, folder))


@register("triple_precision", "E28", with_ctes(RAW, FIRST, select="""
SELECT count(*) AS predicted, count(g.subject) AS correct, round(count(g.subject)::DOUBLE / count(*), 6) AS precision
FROM firsts f LEFT JOIN (
  SELECT DISTINCT 'S' || o_custkey % 10 AS subject, CASE o_orderstatus WHEN 'F' THEN 'activates' WHEN 'O' THEN 'inhibits' ELSE 'subunit_of' END AS predicate,
    'P' || o_orderkey % 50 AS object FROM orders) g USING (subject, predicate, object)"""))
def triple_precision(spark, folder):
    gold = table(spark, folder, "orders").selectExpr(
        "'S' || CAST(o_custkey % 10 AS STRING) AS subject",
        "CASE o_orderstatus WHEN 'F' THEN 'activates' WHEN 'O' THEN 'inhibits' ELSE 'subunit_of' END AS predicate",
        "'P' || CAST(o_orderkey % 50 AS STRING) AS object",
    )
    out = tp.triple_precision(tp.dedupe_triples(raw_triples(spark, folder)), gold)
    return out.withColumn("precision", shown("precision"))


@register("relation_conflicts", "E29", with_ctes(RAW, FIRST, """cand AS (
  SELECT subject, predicate, object, 'a' || paper AS evidence_id FROM firsts WHERE confidence >= 0.7),
have AS (SELECT subject, predicate, object, 'b' || paper AS evidence_id FROM firsts WHERE confidence < 0.7),
conf AS (
  SELECT DISTINCT c.subject, c.object, c.predicate, h.predicate AS other FROM cand c JOIN have h USING (subject, object)
  WHERE (c.predicate = 'activates' AND h.predicate = 'inhibits') OR (c.predicate = 'inhibits' AND h.predicate = 'activates'))""", select="""
SELECT subject, object, predicate, other, 'supporting' AS side, evidence_id, subject || ' has opposing ' || predicate || '/' || other || ' relations to ' || object AS claim
FROM cand JOIN conf USING (subject, object, predicate)
UNION ALL
SELECT h.subject, h.object, c.predicate, other, 'contradicting', evidence_id, h.subject || ' has opposing ' || c.predicate || '/' || other || ' relations to ' || h.object
FROM have h JOIN conf c ON c.subject = h.subject AND c.object = h.object AND c.other = h.predicate"""))
def relation_conflicts(spark, folder):
    firsts = tp.dedupe_triples(raw_triples(spark, folder))

    def assertions(where, mark):
        return firsts.where(where).select(
            "subject", "predicate", "object", F.concat(F.lit(mark), F.col("paper")).alias("evidence_id")
        )

    return tp.relation_conflicts(assertions("confidence >= 0.7", "a"), assertions("confidence < 0.7", "b"))


# Edges that other loaders left: one for each relation between customers and orders, of sure, unsure and no confidence.
SEED_EXPRESSIONS = (
    "'S' || CAST(o_custkey % 10 AS STRING) AS subject",
    "CASE o_orderstatus WHEN 'F' THEN 'activates' WHEN 'O' THEN 'inhibits' ELSE 'subunit_of' END AS predicate",
    "'P' || CAST(o_orderkey % 50 AS STRING) AS object",
)
SEED = f"""seed AS (
  SELECT subject, predicate, object, CASE WHEN least_key % 2 = 0 THEN CAST(least_key AS STRING) ELSE '' END AS pmid,
    CASE least_key % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS confidence, n
  FROM (SELECT subject, predicate, object, min(o_orderkey) AS least_key, count(*) AS n FROM (SELECT o_orderkey, {', '.join(SEED_EXPRESSIONS)} FROM orders) GROUP BY 1, 2, 3))"""
STORED_DECIDED = DECIDED.replace("won AS (SELECT *, first(predicate)", """sure AS (
  SELECT subject, object, CASE predicate WHEN 'inhibits' THEN 'activates' ELSE predicate END AS pair, min(predicate) AS least, max(predicate) AS most
  FROM seed WHERE confidence >= 0.7 GROUP BY 1, 2, 3),
won AS (SELECT a.*, CASE WHEN least <> most THEN '' ELSE coalesce(least, first_one) END AS winner FROM (SELECT *, first(predicate)""").replace(
    "ORDER BY seq) AS winner FROM accepted)", "ORDER BY seq) AS first_one FROM accepted) a LEFT JOIN sure s ON s.subject = a.subject AND s.object = a.object AND s.pair = a.pair)"
).replace("THEN winner END AS existing_predicate", "THEN CASE predicate WHEN 'activates' THEN 'inhibits' ELSE 'activates' END END AS existing_predicate")
STORED_CHAIN = (RAW, FIRST, VALID, SEED, STORED_DECIDED)


def seed_edges(spark, folder):
    """The same edges, as another loader stores them: without a list of evidence papers."""
    named = table(spark, folder, "orders").select("o_orderkey", *[F.expr(e) for e in SEED_EXPRESSIONS])
    found = named.groupBy("subject", "predicate", "object").agg(F.min("o_orderkey").alias("least_key"), F.count("*").alias("evidence_count"))
    third, empty = F.col("least_key") % 3, F.lit("")
    return found.select(
        "subject", "predicate", "object", F.upper("predicate").alias("rel_type"), "evidence_count",
        F.when(third == 0, 0.9).when(third == 1, 0.5).alias("confidence"), F.lit("loaded").alias("evidence"),
        F.lit(None).cast("string").alias("first_paper"), F.lit(None).cast("string").alias("last_paper"), empty.alias("paper_doi"),
        F.when(F.col("least_key") % 2 == 0, F.col("least_key").cast("string")).otherwise(empty).alias("paper_pmid"),
        F.lit("curated").alias("extraction_method"), F.lit("2024-01-01").alias("created"), F.lit(None).cast("array<string>").alias("evidence_papers"),
    )


@register("stored_decisions", "E23", with_ctes(*STORED_CHAIN, select="""
SELECT paper, subject, predicate, object, status, reason, existing_predicate FROM decided""").replace("STRING", "VARCHAR"))
def stored_decisions(spark, folder):
    firsts = tp.dedupe_triples(raw_triples(spark, folder))
    validated = materialize(tp.validate_triples(firsts, known_entities(spark)), "validated")
    return tp.decide_triples(validated, seed_edges(spark, folder)).select(
        "paper", "subject", "predicate", "object", "status", "reason", "existing_predicate"
    )


def merged_in_runs(spark, folder, runs=4):
    """The store after the lines of the orders have come in ``runs`` batches, in ranges of their order keys."""
    store = gm.graph_store(spark, fresh_folder(spark, "graph"), buckets=8)
    gm.adopt_edges(store, seed_edges(spark, folder), batch_id=0)
    firsts = tp.dedupe_triples(raw_triples(spark, folder))
    key = F.col("paper").cast("long")
    last = raw_triples(spark, folder).agg(F.max(key)).first()[0] or 0
    # Each run reads its own folder.
    number = sum((key > last * run // runs).cast("int") for run in range(1, runs)).alias("run")
    validated, path = tp.validate_triples(firsts, known_entities(spark)).select("*", number), fresh_folder(spark, "validated")
    validated.write.partitionBy("run").parquet(path)
    validated = spark.read.schema(validated.schema).parquet(path)
    for run in range(runs):
        gm.merge_batch(store, validated.where(F.col("run") == run).drop("run"), run + 1, known_entities(spark))
    return store


@register("stored_provenance", "E24", with_ctes(*STORED_CHAIN, """
merged AS (
  SELECT subject, predicate, object, max(confidence) AS confidence, arg_max(evidence, seq) AS evidence, arg_min(paper, seq) AS first_paper, arg_max(paper, seq) AS last_paper,
    count(DISTINCT d.paper) FILTER (d.paper IS DISTINCT FROM s.pmid) AS added
  FROM decided d LEFT JOIN (SELECT subject AS s, predicate AS p, object AS o, pmid FROM seed) s ON s.s = subject AND s.p = predicate AND s.o = object
  WHERE status = 'merged' GROUP BY 1, 2, 3)""", select="""
SELECT subject, predicate, object, upper(predicate) AS rel_type, CASE WHEN s.n IS NULL THEN 0 WHEN pmid <> '' THEN 1 ELSE s.n END + coalesce(added, 0) AS evidence_count,
  greatest(m.confidence, s.confidence) AS confidence, coalesce(m.evidence, 'loaded') AS evidence,
  CASE WHEN s.n IS NULL THEN first_paper WHEN pmid <> '' THEN pmid ELSE 'evidence:0' END AS first_paper,
  coalesce(last_paper, CASE WHEN pmid <> '' THEN pmid ELSE 'evidence:' || (s.n - 1) END) AS last_paper,
  CASE WHEN s.n IS NULL THEN 'heuristic_phase6' ELSE 'curated' END AS extraction_method
FROM merged m FULL JOIN seed s USING (subject, predicate, object)""").replace("STRING", "VARCHAR"))
def stored_provenance(spark, folder):
    return merged_in_runs(spark, folder).read("edges").drop("paper_doi", "paper_pmid", "created")
