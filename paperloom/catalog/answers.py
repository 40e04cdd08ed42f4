"""Registered question-answering queries: user turns of conversations asked over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.graph import raw_graph
from paperloom.catalog import literature as papers
from paperloom.catalog.registry import register, table, with_ctes
from paperloom.catalog.retrieval import (
    BM25, LENGTHS, LIBRARY, POSTINGS, STATS, TOK, TOKEN_SQL, corpus, library, overlap_ctes,
)
from paperloom.catalog.triples import known_entities, raw_triples
from paperloom.functions import text as tx
from paperloom.functions.ranking import shown
from paperloom.operators import answers as qa
from paperloom.operators import graph as kg
from paperloom.operators import literature as lit
from paperloom.operators import retrieval as rt
from paperloom.operators import triples as tp
from paperloom.plans.answers import answer_questions, search_and_answer
from paperloom.plans.literature import literature_search
from paperloom.session import materialize

# The same expressions run in Spark and in the SQL twin.
QUESTION_SQL = """CASE (conv_id * 7 + turn) % 9
    WHEN 0 THEN 'What recent papers cover ' || text || '?' WHEN 1 THEN 'Which drug treats MELAS and ' || text || '??'
    WHEN 2 THEN 'Which disease causes ' || text WHEN 3 THEN 'How does mPTP in complex I ' || text || '?'
    WHEN 4 THEN 'Which protocol can ' || text || '?' WHEN 5 THEN 'Count matrix proteins near ' || text || '?'
    WHEN 6 THEN 'What is mitochondria?' WHEN 7 THEN 'Do the PINK1 signals of the transition pore ' || text ELSE text END"""
ANSWER_SQL = """text || ' [PMID:' || CAST(99990 + conv_id AS STRING) || '] and [doi:10.' || CAST(1000 + turn AS STRING) || '/x.' || CAST(conv_id AS STRING) || ']'
    || CASE WHEN turn % 3 = 0 THEN ' or [PMID:12] [doi:11.1/x]' ELSE '' END"""
DEFINITIONS = {
    "what is mitochondria": "Mitochondria are the organelles that make most of a cell's ATP.",
    "what are mitochondria": "REUSE:what is mitochondria",
}
RULES = qa.CONTROVERSIES + (
    qa.ContradictionRule(("pink1", "papers"), "the", ("and the", "that"), ("of the", "attion"), "word order is disputed", "Both orders occur."),
)
KNOWN_FIXED = ("12345678", "20510199", "25613900")


def asked(spark, folder):
    turns = table(spark, folder, "conversations").where("role = 'user'")
    return turns.selectExpr("conv_id * 1000 + turn AS query_id", f"{QUESTION_SQL} AS query_text")


QUESTIONS = f"questions AS (SELECT conv_id * 1000 + turn AS query_id, {QUESTION_SQL} AS query_text FROM conversations WHERE role = 'user')"


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def type_case() -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(query_text), '{t}')" for t in terms) + f" THEN '{name}'" for name, terms in qa.QUERY_TYPES
    )
    return f"CASE {arms} ELSE 'factual' END"


CLASSES = f"""classes AS (
  SELECT *, CASE WHEN query_type IN ('disease', 'therapeutics') THEN 'disease' WHEN query_type = 'mechanistic' THEN 'mitophysiology' ELSE 'direct' END AS route
  FROM (SELECT *, {type_case()} AS query_type FROM questions))"""


@register("query_types", "F1", with_ctes(QUESTIONS, CLASSES, select="SELECT query_id, query_type, route FROM classes"))
def query_types(spark, folder):
    return qa.classify_queries(asked(spark, folder)).select("query_id", "query_type", "route")


@register("query_type_counts", "F1", with_ctes(QUESTIONS, CLASSES, select="SELECT query_type, count(*) AS n FROM classes GROUP BY 1"))
def query_type_counts(spark, folder):
    return qa.classify_queries(asked(spark, folder)).groupBy("query_type").agg(F.count("*").alias("n"))


TEMPLATES = "templates AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{kind}', {n}, '{end}')" for kind, ends in qa.SUB_QUERIES.items() for n, end in enumerate(ends)
) + ") v(query_type, sub_id, tail))"


@register("sub_queries", "F2", with_ctes(QUESTIONS, CLASSES, TEMPLATES, select=r"""
SELECT query_id, sub_id::BIGINT AS sub_id, regexp_replace(trim(query_text, ' ' || chr(10) || chr(9)), '\?+$', '') || ' ' || tail AS sub_query FROM classes JOIN templates USING (query_type)"""))
def sub_queries(spark, folder):
    return longs(qa.plan_sub_queries(qa.classify_queries(asked(spark, folder))), "sub_id")


QTOK = f"""qtok AS (
  SELECT query_id, pos, lower(t) AS term FROM (
    SELECT query_id, generate_subscripts(l, 1) AS pos, unnest(l) AS t
    FROM (SELECT query_id, regexp_extract_all(query_text, '{TOKEN_SQL}') AS l FROM questions)))"""
CHUNKS = (QUESTIONS, TOK, QTOK, LENGTHS, POSTINGS, STATS, BM25, LIBRARY, overlap_ctes("SELECT query_id, query_text FROM questions"), """web AS (
  SELECT query_id, 'web-' || doc_id AS doc_id, text, (200000 + doc_id)::VARCHAR AS paper_id, 'Web > semantic_scholar' AS section_path, score, rank,
    '[PMID:' || (200000 + doc_id) || ']' AS citation, 'Study of ' || source || ' number ' || doc_id AS title, 'semantic_scholar' AS source_api, (1990 + doc_id % 35)::VARCHAR AS year
  FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 8),
local AS (
  SELECT query_id, 'local-' || rank || '-' || paper_id AS doc_id, text, paper_id, 'Body' AS section_path, score, rank, citation, '' AS title, '' AS source_api, '' AS year FROM overlap)""")


# What answers and lists of sources show of a text has no more characters.
SHOWN = 320


def beginning(text):
    return tx.beginning(text, SHOWN)


def local_chunks(spark, folder, text=lambda text: text, kept=None):
    """The best chunks of the library with ``text`` of their texts; with ``kept`` they are scored as evidence, of which ``kept`` remains."""
    queries, chunks = asked(spark, folder), library(spark, folder)
    found, texts = rt.overlap_ranking(queries, chunks), rt.overlap_texts(chunks)
    if kept is None:
        return local_of(found.join(texts.withColumn("text", text(F.col("text"))), "doc_id"))
    return local_of(qa.with_scored_texts(found, queries, texts, kept, text=text(F.col("text"))), "kept", "lexical")


def local_of(found, *more):
    return found.select(
        "query_id", F.concat_ws("-", F.lit("local"), F.col("rank").cast("string"), "paper_id").alias("doc_id"), "text", "paper_id",
        F.lit("Body").alias("section_path"), "score", "rank", "citation", F.lit("").alias("title"), F.lit("").alias("source_api"), F.lit("").alias("year"), *more,
    )


def web_chunks(spark, folder, text=lambda text: text, kept=None):
    """The best documents as chunks of the web; ``text`` and ``kept`` as above."""
    queries = asked(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    found = rt.bm25_search(queries, corpus(spark, folder), 8)
    if kept is None:
        found = found.join(docs.withColumn("text", text(F.col("text"))), "doc_id")
    else:
        found = qa.with_scored_texts(found, queries, docs, kept, text=text(F.col("text")))
    number = (F.col("doc_id") + 200000).cast("string")
    return found.select(
        "query_id", F.concat(F.lit("web-"), F.col("doc_id").cast("string")).alias("doc_id"), "text", number.alias("paper_id"),
        F.lit("Web > semantic_scholar").alias("section_path"), "score", "rank", F.concat(F.lit("[PMID:"), number, F.lit("]")).alias("citation"),
        F.concat(F.lit("Study of "), "source", F.lit(" number "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("semantic_scholar").alias("source_api"), (1990 + F.col("doc_id") % 35).cast("string").alias("year"), *([] if kept is None else ["kept", "lexical"]),
    )


ENTITY_VALUES = "names AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{kind}', '{key}')" for m, (kind, key) in qa.QUESTION_ENTITIES.items()
) + ") v(mention, entity_type, normalized_id))"


@register("question_entities", "F3", with_ctes(*CHUNKS, ENTITY_VALUES, """hay AS (
  SELECT query_id, lower(query_text || coalesce(' ' || t, '')) AS h FROM questions LEFT JOIN (
    SELECT query_id, string_agg(text, ' ' ORDER BY side, rank) AS t FROM (SELECT query_id, 0 AS side, rank, text FROM local UNION ALL SELECT query_id, 1, rank, text FROM web) GROUP BY 1) USING (query_id))""", select="""
SELECT query_id, mention, entity_type, normalized_id FROM hay, names WHERE contains(h, lower(mention))"""))
def question_entities(spark, folder):
    return qa.question_entities(asked(spark, folder), local_chunks(spark, folder, qa._named_part), web_chunks(spark, folder, qa._named_part))


def topic_summaries(spark, folder):
    """One summary row per topic, computed from the graph."""
    nodes, edges = raw_graph(spark, folder)
    placed = kg.localized_counts(edges, ("Order", "PLACED_BY", "Customer"), ("Customer", "LOCATED_IN", "Nation")).where("place = '7'")
    paths = kg.path_match(edges, ["Order", "PLACED_BY", "Customer", "LOCATED_IN", "Nation", "PART_OF", "Region"], {3: "2"})
    supplies = kg.one_hop(kg.merge_nodes(nodes), kg.merge_edges(edges.where("rel_type = 'SUPPLIES' AND dst_key = '1'")), "SUPPLIES")
    members = kg.members_per_group(edges, "LOCATED_IN", "Customer", "Nation").where("group = '3'")
    some = kg.first_members(edges, "LOCATED_IN", "Customer", "Nation", 2).where("group = '4'").agg(F.min("member").alias("a"), F.max("member").alias("b"))
    disputed = tp.disputed_pairs(tp.validate_triples(raw_triples(spark, folder), known_entities(spark))).agg(F.count("*").alias("n"))
    names = supplies.agg(F.min("src_name").alias("a"), F.max("src_name").alias("b"))

    def row(topic, df, summary):
        return df.select(F.lit(topic).alias("topic"), summary.alias("summary"))

    return (
        row("matrix_count", placed, F.concat(F.col("n").cast("string"), F.lit(" orders are placed from nation 7.")))
        .unionByName(row("variant_path", paths.agg(F.count("*").alias("n")), F.concat(F.col("n").cast("string"), F.lit(" order paths lead to region 2."))))
        .unionByName(row("drug_targets", names, F.concat(F.lit("Suppliers of part 1 include "), "a", F.lit(" and "), "b", F.lit("."))))
        .unionByName(row("complex", members, F.concat(F.lit("Nation 3 has "), F.col("members").cast("string"), F.lit(" customers in the KG."))))
        .unionByName(row("pathway_members", some, F.concat(F.lit("Nation 4 has customers such as "), "a", F.lit(" and "), "b", F.lit("."))))
        .unionByName(row("controversy", disputed, F.concat(F.col("n").cast("string"), F.lit(" relations are modeled as contradictory."))))
    )


CONTEXT = """summaries AS (
  SELECT 'matrix_count' AS topic, count(*) || ' orders are placed from nation 7.' AS summary FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7
  UNION ALL SELECT 'variant_path', count(*) || ' order paths lead to region 2.' FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2
  UNION ALL SELECT 'drug_targets', 'Suppliers of part 1 include ' || min(s_name) || ' and ' || max(s_name) || '.' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = 1
  UNION ALL SELECT 'complex', 'Nation 3 has ' || count(*) || ' customers in the KG.' FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT 'pathway_members', 'Nation 4 has customers such as ' || min(k) || ' and ' || max(k) || '.' FROM (SELECT c_custkey::VARCHAR AS k FROM customer WHERE c_nationkey = 4 ORDER BY k LIMIT 2)
  UNION ALL SELECT 'controversy', count(*) || ' relations are modeled as contradictory.' FROM (
    SELECT l_suppkey % 10, l_partkey % 50 FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag IN ('A', 'R') AND round(1 - 4 * l_discount, 2) >= 0.7 AND l_partkey % 50 < 48
    GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = 2)),
context AS (
  SELECT query_id, t.topic, coalesce(summary, '') AS summary FROM (
    SELECT query_id, CASE WHEN contains(q, 'matrix') AND contains(q, 'count') THEN 'matrix_count' WHEN contains(q, 'm.3243') OR contains(q, 'melas') THEN 'variant_path'
      WHEN contains(q, 'drug') OR contains(q, 'therapeutic') OR contains(q, 'idebenone') THEN 'drug_targets' WHEN contains(q, 'mptp') THEN 'controversy'
      WHEN contains(q, 'complex i') THEN 'complex' ELSE 'pathway_members' END AS topic FROM (SELECT query_id, lower(query_text) AS q FROM questions)) t
  LEFT JOIN summaries USING (topic))"""


@register("kg_context", "F4", with_ctes(QUESTIONS, CONTEXT, select="SELECT query_id, topic, summary FROM context"))
def kg_context(spark, folder):
    return qa.kg_context(asked(spark, folder), topic_summaries(spark, folder))


SPECIALIST_SQL = " UNION ALL ".join(
    f"SELECT query_id, '{s.evidence_id}', '{s.text}', '{s.source}', {s.score}::DOUBLE, '', '{s.section_path}', '{s.citation}', {1001 + n} FROM questions"
    for n, s in enumerate(qa.SPECIALISTS)
)
EVIDENCE = (*CHUNKS, CONTEXT, f"""fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (10 + rank), 9) DESC, side, rank) AS frank
  FROM (SELECT 0 AS side, * FROM local UNION ALL SELECT 1, * FROM web)),
fpool AS (SELECT * FROM fused WHERE frank <= 50),
fwords AS (SELECT DISTINCT query_id, doc_id, lower(unnest(regexp_extract_all(text, '{TOKEN_SQL}'))) AS term FROM fpool),
fwn AS (SELECT query_id, doc_id, count(*) AS nd FROM fwords GROUP BY 1, 2),
fq AS (SELECT DISTINCT query_id, term FROM qtok),
fqn AS (SELECT query_id, count(*) AS nq FROM fq GROUP BY 1),
fphrase AS (SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS phrase FROM qtok GROUP BY 1),
fshared AS (
  SELECT w.query_id, w.doc_id, count(*) AS n, bool_or(contains(term, '-') OR starts_with(term, 'mt')) AS gene FROM fwords w JOIN fq USING (query_id, term) GROUP BY 1, 2),
fscored AS (
  SELECT p.*, coalesce(s.n, 0) / nq::DOUBLE + 0.5::DOUBLE * coalesce(s.n, 0) / (nq + coalesce(nd, 0) - coalesce(s.n, 0))
    + CASE WHEN contains(lower(text), phrase) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN coalesce(gene, false) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS rscore
  FROM fpool p JOIN fqn USING (query_id) JOIN fphrase USING (query_id) LEFT JOIN fwn USING (query_id, doc_id) LEFT JOIN fshared s USING (query_id, doc_id)),
freranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rscore, 9) DESC, frank) AS rrank FROM fscored) WHERE rrank <= 15),
eall(query_id, evidence_id, text, source, score, paper_id, section_path, citation, place) AS (
  SELECT query_id, doc_id, text, 'bge_reranker', rscore, paper_id, section_path, citation, rrank FROM freranked
  UNION ALL
  SELECT c.query_id, 'kg-subgraph', summary, 'kg_cypher', 0.99::DOUBLE, coalesce(l.paper_id, r.paper_id), 'Knowledge Graph', '[PMID:12345678]', 1000
  FROM context c LEFT JOIN (SELECT query_id, paper_id FROM local WHERE rank = 1) l USING (query_id)
  LEFT JOIN (SELECT query_id, paper_id FROM freranked WHERE rrank = 1) r USING (query_id) WHERE summary <> ''
  UNION ALL {SPECIALIST_SQL}),
evidence AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place) AS rank FROM eall) WHERE rank <= 15)""")


def nothing_of(text):
    return F.lit(None).cast("string")


def evidence_of(spark, folder, kept):
    """Evidence rows with ``kept`` of their texts."""
    queries = asked(spark, folder)
    context = qa.kg_context(queries, topic_summaries(spark, folder))
    local, web = [materialize(f(spark, folder, nothing_of, kept), name) for f, name in ((local_chunks, "local"), (web_chunks, "web"))]
    return qa.fuse_evidence(queries, local, web, context, kept=kept)


@register("fused_evidence", "F5", with_ctes(*EVIDENCE, select="""
SELECT query_id, evidence_id, md5(text) AS text_md5, source, round(score, 6) AS score, paper_id, section_path, citation, rank FROM evidence"""))
def fused_evidence(spark, folder):
    out = evidence_of(spark, folder, F.md5)
    return longs(out.withColumn("text_md5", F.col("text")).withColumn("score", shown("score")).drop("text"), "rank")


@register("claims", "F6", with_ctes(*EVIDENCE, select=r"""
SELECT query_id, rank, claim, evidence_id, round(least(0.95::DOUBLE, greatest(0.3::DOUBLE, score)), 6) AS confidence FROM (
  SELECT *, trim(string_split(trim(text, ' ' || chr(10) || chr(9)), '.')[1], ' ' || chr(10) || chr(9)) AS claim FROM evidence WHERE rank <= 8) WHERE claim <> ''"""))
def claims(spark, folder):
    return longs(qa.extract_claims(evidence_of(spark, folder, qa.leading_claim)).withColumn("confidence", shown("confidence")), "rank")


def any_of(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in terms) + ")"


DISPUTES = "disputes AS (" + " UNION ALL ".join(f"""
  SELECT query_id, {n} AS rule, '{r.claim}' AS claim, '{r.summary}' AS summary,
    string_agg(evidence_id, ',' ORDER BY rank) FILTER (contains(t, '{r.subject}') AND {any_of('t', r.one_side)}) AS supporting,
    string_agg(evidence_id, ',' ORDER BY rank) FILTER (contains(t, '{r.subject}') AND {any_of('t', r.other_side)}) AS contradicting
  FROM (SELECT e.*, lower(text) AS t, lower(query_text) AS q FROM evidence e JOIN questions USING (query_id)) WHERE {any_of('q', r.question_terms)}
  GROUP BY 1 HAVING supporting IS NOT NULL AND contradicting IS NOT NULL""" for n, r in enumerate(RULES)) + ")"


@register("evidence_contradictions", "F7", with_ctes(*EVIDENCE, DISPUTES, select="""
SELECT query_id, rule::BIGINT AS rule, claim, supporting, contradicting FROM disputes"""))
def evidence_contradictions(spark, folder):
    out = qa.evidence_contradictions(asked(spark, folder), evidence_of(spark, folder, qa.disputed_terms(RULES)), RULES)
    return longs(out, "rule").select(
        "query_id", "rule", "claim", F.array_join("supporting", ",").alias("supporting"), F.array_join("contradicting", ",").alias("contradicting")
    )


def short(expr: str, n: int) -> str:
    flat = f"replace(trim({expr}, ' ' || chr(10) || chr(9)), chr(10), ' ')"
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE regexp_replace(left({flat}, {n - 1}), '(?s) [^ ]*$', '') || '…' END"


STOP = ", ".join(f"'{w}'" for w in tx.QUESTION_STOP_WORDS)


def item_ctes(source: str, out: str) -> str:
    return rf"""{out}_raw AS (
  SELECT *, coalesce(nullif(citation, ''), nullif(title, '')) AS item_key FROM (
    SELECT query_id, rank, citation, coalesce(nullif(title, ''), {short('text', 80)}) AS title, {short('text', 320)} AS snippet FROM {source})),
{out} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, item_key ORDER BY rank) AS take FROM {out}_raw WHERE item_key IS NOT NULL) WHERE take = 1) WHERE pos <= 12),
{out}_hit AS (
  SELECT i.*, n_words = 0 OR len(list_filter(words, lambda w: contains(lower(title || ' ' || snippet), w))) > 0 OR {any_of("lower(title || ' ' || snippet)", qa.DOMAIN_WORDS)} AS hit
  FROM {out} i JOIN (SELECT query_id, words, len(words) AS n_words FROM (
    SELECT query_id, list_filter(regexp_extract_all(lower(query_text), '[a-zA-Z][a-zA-Z\-]{{2,}}'), lambda w: NOT list_contains([{STOP}], w)) AS words FROM questions)) USING (query_id)),
{out}_kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS p FROM (
    SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM {out}_hit) WHERE hit OR NOT any_hit) WHERE p <= 8)"""


def item_rows(df):
    items = F.transform("items", lambda x, i: F.struct((i + 1).cast("long").alias("p"), x["citation"].alias("citation"), x["title"].alias("title"), x["snippet"].alias("snippet")))
    return df.select("query_id", F.inline(items))


@register("relevant_items", "F8", with_ctes(*CHUNKS, item_ctes("local", "items"), select="SELECT query_id, p, citation, title, snippet FROM items_kept"))
def relevant_items(spark, folder):
    items = qa.collect_evidence_items(local_chunks(spark, folder, beginning))
    return item_rows(qa.filter_evidence(asked(spark, folder), items))


@register("evidence_items", "F9", with_ctes(*CHUNKS, item_ctes("web", "items"), select="SELECT query_id, pos AS p, citation, title, snippet FROM items"))
def evidence_items(spark, folder):
    return item_rows(qa.collect_evidence_items(web_chunks(spark, folder, beginning)))


HINTS = " ".join(f"WHEN contains(lower(query_text), '{h}') THEN '{label}'" for h, label in qa.TOPIC_HINTS)
HEAD = r"regexp_extract(trim(snippet), '(?s)^(.*?[.!?])\s+[A-Z0-9]', 1)"
NL = "chr(10)"


def bullets(alias: str, title: str) -> str:
    return f"CASE WHEN {alias} IS NOT NULL THEN {title} || {NL} || {alias} END"


ASSEMBLY = rf"""both_items AS (
  SELECT 0 AS side, query_id, p, citation, title, snippet FROM l_kept UNION ALL SELECT 1, query_id, p, citation, title, snippet FROM w_kept),
sized AS (SELECT query_id, query_text, count(*) FILTER (side = 0) AS nl, count(*) FILTER (side = 1) AS nw FROM questions LEFT JOIN both_items USING (query_id) GROUP BY 1, 2),
said AS (
  SELECT *, CASE WHEN head = '' THEN '' WHEN citation <> '' AND NOT contains(head, citation) THEN head || ' ' || citation ELSE head END AS sentence,
    (side = 0) = (nl > 0) AS main, CASE WHEN (side = 0) = (nl > 0) THEN p ELSE 100 + p END AS place
  FROM (SELECT b.*, nl, regexp_replace(CASE WHEN {HEAD} <> '' THEN {HEAD} ELSE trim(snippet) END, '\.+$', '') AS head FROM both_items b JOIN sized USING (query_id))),
mech AS (
  SELECT query_id, string_agg('- ' || sentence || '.', {NL} ORDER BY place) FILTER (sentence <> '') AS lines FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM said WHERE main AND {any_of('lower(snippet)', qa.MECHANISM_WORDS)}) WHERE n <= 3 GROUP BY 1),
clin AS (
  SELECT query_id, string_agg('- ' || sentence || '.', {NL} ORDER BY place) FILTER (sentence <> '') AS lines FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM said WHERE main AND {any_of('lower(snippet)', qa.CLINICAL_WORDS)}) WHERE n <= 3 GROUP BY 1),
refs AS (
  SELECT query_id, string_agg('- ' || citation || ' — ' || title, {NL} ORDER BY place) AS lines FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, citation ORDER BY place) AS take FROM said WHERE citation <> '') WHERE take = 1) WHERE n <= 8 GROUP BY 1),
texts AS (
  SELECT query_id,
    string_agg(sentence || '.', ' ' ORDER BY place) FILTER (main AND p <= 3 AND sentence <> '') AS lead,
    string_agg(citation, ' ' ORDER BY place) FILTER (main AND p <= 3 AND citation <> '') AS lead_cites,
    string_agg('- ' || sentence || '.', {NL} ORDER BY place) FILTER (side = 0 AND p <= 4 AND sentence <> '') AS own,
    string_agg('- ' || title || CASE WHEN citation <> '' AND NOT contains('- ' || title, citation) THEN ' ' || citation ELSE '' END, {NL} ORDER BY place) FILTER (side = 1 AND p <= 5) AS recent,
    string_agg(citation, ' ' ORDER BY place) FILTER (main AND p <= 2 AND citation <> '') AS two_cites,
    arg_min(citation, place) FILTER (citation <> '') AS one_cite
  FROM said GROUP BY 1),
dlines AS (
  SELECT d.query_id, string_agg('- ' || summary || coalesce(' ' || two_cites, ''), {NL} ORDER BY rule) AS lines FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rule) AS n FROM disputes) d LEFT JOIN texts USING (query_id) WHERE n <= 2 GROUP BY 1),
parts AS (
  SELECT s.query_id, nl, nw, regexp_replace(query_text, '\?+$', '') AS bare, CASE {HINTS} ELSE 'this topic' END AS topic,
    CASE WHEN regexp_replace(regexp_replace(trim(lower(query_text)), '\?+$', ''), '\.+$', '') IN ('what is mitochondria', 'what are mitochondria') THEN '{DEFINITIONS["what is mitochondria"].replace("'", "''")}' END AS definition,
    CASE WHEN nl > 0 THEN nl ELSE nw END AS nfirst, t.*, m.lines AS mlines, c.lines AS clines, r.lines AS rlines, d.lines AS dlines, summary
  FROM sized s LEFT JOIN texts t USING (query_id) LEFT JOIN mech m USING (query_id) LEFT JOIN clin c USING (query_id) LEFT JOIN refs r USING (query_id)
  LEFT JOIN dlines d USING (query_id) LEFT JOIN context USING (query_id)),
answers AS (
  SELECT query_id, trim(concat_ws({NL} || {NL},
    CASE WHEN definition IS NOT NULL THEN concat_ws({NL} || {NL}, '**Answering: ' || trim(bare) || '**' || {NL} || {NL} || definition, {bullets('own', "'**From your ingested PDFs.**'")}, CASE WHEN nl < 4 THEN {bullets('recent', "'**Recent peer-reviewed literature.**'")} END)
    ELSE concat_ws({NL} || {NL},
      CASE WHEN nl >= 4 THEN '{qa.BANNER_LOCAL.replace("%s", "' || nl || '")}' WHEN nl > 0 THEN '{qa.BANNER_MIXED.replace("%s", "' || nl || '")}' ELSE '{qa.BANNER_WEB}' END,
      CASE WHEN nfirst = 0 THEN bare || ': synthesizing current literature on ' || topic || '.'
        ELSE '**Answering: ' || trim(bare) || '**' || {NL} || {NL} || 'Current peer-reviewed literature on ' || topic || ' establishes the following. ' || coalesce(lead, 'See cited references ' || coalesce(lead_cites, '') || '.') END,
      {bullets('mlines', "'**Mechanistic context - ' || topic || '.**'")}, {bullets('clines', "'**Clinical / translational evidence.**'")},
      CASE WHEN nl < 4 THEN {bullets('recent', "'**Recent peer-reviewed literature.**'")} END) END,
    {bullets('dlines', "'**Open questions and contradictions.**'")},
    CASE WHEN coalesce(summary, '') <> '' THEN '**Knowledge graph grounding.** ' || summary || coalesce(' ' || one_cite, '') END,
    {bullets('rlines', "'**References used.**'")}), ' ' || {NL}) AS answer FROM parts)"""
ANSWERS = (*EVIDENCE, DISPUTES, item_ctes("local", "l"), item_ctes("web", "w"), ASSEMBLY)


@register("assembled_answers", "F10", with_ctes(*ANSWERS, select="SELECT query_id, answer FROM answers"))
def assembled_answers(spark, folder):
    queries = asked(spark, folder)
    terms = qa.disputed_terms(RULES)
    local, web = [materialize(f(spark, folder, beginning, terms), name) for f, name in ((local_chunks, "local"), (web_chunks, "web"))]
    context = qa.kg_context(queries, topic_summaries(spark, folder))
    evidence = materialize(qa.fuse_evidence(queries, local, web, context, kept=terms), "evidence")
    items = [qa.filter_evidence(queries, qa.collect_evidence_items(c)) for c in (local, web)]
    return qa.assemble_answers(
        queries, *items, context,
        qa.evidence_contradictions(queries, evidence, RULES), evidence.groupBy("query_id").agg(F.count("*").alias("n")), DEFINITIONS,
    )


def given_answers(spark, folder):
    turns = table(spark, folder, "conversations").where("role = 'assistant'")
    return turns.selectExpr("conv_id * 1000 + turn AS query_id", f"{ANSWER_SQL} AS answer")


def citation_ctes(source: str, lenient: bool = False) -> str:
    pmid, doi = (r"\[PMID:([^\]]+)\]", r"(?i)\[doi:([^\]]+)\]") if lenient else (r"\[PMID:(\d{5,9})\]", r"(?i)\[doi:(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\]")
    return rf"""cites AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY side, i) - 1 AS n, marker, citation_type, value,
    CASE WHEN side = 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || value || '/' ELSE 'https://doi.org/' || value END AS url
  FROM (SELECT query_id, 0 AS side, 'pmid' AS citation_type, generate_subscripts(m, 1) AS i, unnest(m) AS marker, unnest(v) AS value FROM (
          SELECT query_id, regexp_extract_all(answer, '{pmid}') AS m, regexp_extract_all(answer, '{pmid}', 1) AS v FROM {source})
        UNION ALL
        SELECT query_id, 1, 'doi', generate_subscripts(m, 1), unnest(m), unnest(v) FROM (
          SELECT query_id, regexp_extract_all(answer, '{doi}') AS m, regexp_extract_all(answer, '{doi}', 1) AS v FROM {source})))"""


GIVEN = f"given AS (SELECT conv_id * 1000 + turn AS query_id, {ANSWER_SQL} AS answer FROM conversations WHERE role = 'assistant')"


@register("answer_citations", "F11", with_ctes(GIVEN, citation_ctes("given"), select="SELECT * FROM cites"))
def answer_citations(spark, folder):
    return longs(qa.extract_citations(given_answers(spark, folder)), "n")


def known_papers(spark, folder):
    """Papers at hand: the library, most web papers and the specialists' own."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    own = docs.select((F.col("doc_id") + 100000).cast("string").alias("pmid"))
    web = docs.where("lang <> 'es'").select((F.col("doc_id") + 200000).cast("string").alias("pmid"))
    fixed = spark.createDataFrame([(p,) for p in KNOWN_FIXED], "pmid string")
    return own.unionByName(web).unionByName(fixed)


KNOWN = "known AS (SELECT (100000 + doc_id)::VARCHAR AS pmid FROM documents UNION ALL SELECT (200000 + doc_id)::VARCHAR FROM documents WHERE lang <> 'es' UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in KNOWN_FIXED) + "))"


def audit_cte(source: str) -> str:
    return rf"""audited AS (
  SELECT c.*, CASE WHEN citation_type = 'pmid' AND NOT regexp_matches(value, '^\d{{5,9}}$') THEN 'invalid PMID format' WHEN citation_type = 'pmid' AND k.pmid IS NULL THEN 'PMID not in local cache'
    WHEN citation_type = 'doi' AND NOT regexp_matches(value, '^10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+$') THEN 'invalid DOI format' ELSE '' END AS reason
  FROM cites c LEFT JOIN (SELECT DISTINCT pmid FROM known) k ON citation_type = 'pmid' AND k.pmid = value),
audit AS (
  SELECT query_id, count(value) AS citations, count(*) FILTER (reason <> '') AS invalid FROM {source} LEFT JOIN audited USING (query_id) GROUP BY 1)"""


AUDIT_SHOW = """query_id, citations, invalid, invalid = 0 AND citations > 0 AS citations_valid, invalid > 0 AS retry,
  CASE WHEN d.query_id IS NOT NULL THEN 0.62::DOUBLE WHEN invalid = 0 AND citations > 0 THEN 0.86::DOUBLE ELSE 0.78::DOUBLE END AS confidence"""


@register("citation_audit", "F12", with_ctes(GIVEN, citation_ctes("given", True), KNOWN, audit_cte("given"), select="""
SELECT query_id, n, marker, reason, reason = '' AS valid FROM audited"""))
def citation_audit(spark, folder):
    audited = qa.audit_citations(qa.extract_citations(given_answers(spark, folder), lenient=True), known_papers(spark, folder))
    return longs(audited.select("query_id", "n", "marker", "reason", "valid"), "n")


@register("answer_audit", "F12", with_ctes(GIVEN, citation_ctes("given"), KNOWN, audit_cte("given"), select=f"""
SELECT {AUDIT_SHOW.replace('query_id,', 'a.query_id AS query_id,', 1)} FROM audit a LEFT JOIN (SELECT conv_id * 1000 + turn AS query_id FROM conversations WHERE role = 'assistant' AND text LIKE '% the %') d ON d.query_id = a.query_id"""))
def answer_audit(spark, folder):
    answers = given_answers(spark, folder)
    disputed = answers.where("answer LIKE '% the %'").select("query_id")
    return qa.audit_answers(answers, known_papers(spark, folder), disputed)


SOURCES = f"""spool AS (
  SELECT *, coalesce(nullif(citation, ''), nullif(title, '')) AS item_key FROM (
    SELECT query_id, side, rank, score, citation, coalesce(nullif(title, ''), {short('text', 90)}) AS title, coalesce(nullif(source_api, ''), bucket) AS source,
      CASE WHEN regexp_matches(year, '^[0-9]+$') THEN year::BIGINT END AS year, {short('text', 280)} AS snippet
    FROM (SELECT 0 AS side, 'web_chunks' AS bucket, * FROM web UNION ALL SELECT 1, 'local_chunks', * FROM local))),
sbest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_key ORDER BY round(score, 9) DESC, side, rank) AS take,
    min(side * 1000 + rank) OVER (PARTITION BY query_id, item_key) AS seen FROM spool WHERE item_key IS NOT NULL) WHERE take = 1),
sources AS (
  SELECT *, CASE WHEN starts_with(citation, '[PMID:') THEN substr(citation, 7, length(citation) - 7) END AS pmid, CASE WHEN starts_with(citation, '[doi:') THEN substr(citation, 6, length(citation) - 6) END AS doi
  FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rank FROM sbest) WHERE rank <= 12)"""


@register("source_papers", "F13", with_ctes(*CHUNKS, SOURCES, select="""
SELECT query_id, rank, round(score, 6) AS score, citation, title, source, year, snippet, pmid, doi,
  coalesce('https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/', 'https://doi.org/' || doi) AS url FROM sources"""))
def source_papers(spark, folder):
    out = qa.source_papers(web_chunks(spark, folder, beginning), local_chunks(spark, folder, beginning))
    return longs(out.withColumn("score", shown("score")), "rank", "year")


@register("answer_questions", "F14", with_ctes(*ANSWERS, citation_ctes("answers"), KNOWN, audit_cte("answers"), CLASSES, SOURCES, select=f"""
SELECT a.query_id AS query_id, query_type, answer || CASE WHEN invalid > 0 THEN '{qa.RETRY_NOTE}' ELSE '' END AS answer, citations, invalid,
  CASE WHEN d.query_id IS NOT NULL THEN 0.62::DOUBLE WHEN invalid = 0 AND citations > 0 THEN 0.86::DOUBLE ELSE 0.78::DOUBLE END AS confidence, coalesce(n_sources, 0) AS n_sources
FROM answers a JOIN audit u ON u.query_id = a.query_id JOIN classes c ON c.query_id = a.query_id LEFT JOIN (SELECT DISTINCT query_id FROM disputes) d ON d.query_id = a.query_id
LEFT JOIN (SELECT query_id, count(*) AS n_sources FROM sources GROUP BY 1) s ON s.query_id = a.query_id"""))
def answered(spark, folder):
    terms = qa.disputed_terms(RULES)
    out = answer_questions(
        asked(spark, folder), local_chunks(spark, folder, beginning, terms), web_chunks(spark, folder, beginning, terms), topic_summaries(spark, folder),
        known_papers(spark, folder), DEFINITIONS, RULES, kept=terms,
    )
    sources = out.sources.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    return (
        out.answers.join(out.audit.select("query_id", "citations", "invalid", "confidence"), "query_id")
        .join(out.classified.select("query_id", "query_type"), "query_id")
        .join(sources, "query_id", "left")
        .fillna(0, ["n_sources"])
    )


# The whole pipeline: a hundred documents are what the services answer to the sub-questions of one question.
WHOLE_SQL = """CASE number % 6 WHEN 0 THEN 'Which drug treats MELAS and ' || text || '??' WHEN 1 THEN 'How does mPTP in complex I ' || text || '?'
    WHEN 2 THEN 'What recent papers cover ' || text || '?' WHEN 3 THEN 'Which protocol can ' || text WHEN 4 THEN 'Count matrix proteins near ' || text || '?' ELSE text END"""
WHOLE = f"questions AS (SELECT number AS query_id, {WHOLE_SQL} AS query_text FROM (SELECT DISTINCT doc_id // 100 AS number FROM documents), benchmark, (SELECT count(*) AS n FROM benchmark) WHERE item_id = number % n)"
SUBS = r"""subs AS (
  SELECT query_id * 10 + sub_id::BIGINT AS query_id, regexp_replace(trim(query_text, ' ' || chr(10) || chr(9)), '\?+$', '') || ' ' || tail AS query_text FROM classes JOIN templates USING (query_type)),
asked AS (SELECT query_id, query_text FROM subs)"""


def of_sub_questions(part: str) -> str:
    """The literature chain with sub-questions as its questions: answers of the landed payload n belong to sub-question n % 5 of question n // 5."""
    part = part.replace("doc_id // 20 AS query_id", "doc_id // 100 * 10 + doc_id // 20 % 5 AS query_id").replace("query_id // 5 AS parent", "query_id // 10 AS parent")
    return part.replace("web AS (", "lit AS (").replace("FROM web)", "FROM lit)")


FOUND = (
    *[of_sub_questions(part) for part in papers.MERGED if part is not papers.ASKED],
    """web AS (
  SELECT parent AS query_id, chunk_id AS doc_id, text, coalesce(pmid, doi, chunk_id) AS paper_id, 'Web > ' || source AS section_path, score, rank,
    coalesce('[PMID:' || pmid || ']', '[doi:' || doi || ']', '[PMID:12345678]') AS citation, title, source AS source_api, coalesce(year::VARCHAR, '') AS year FROM merged)""",
)
WHOLE_CHUNKS = (
    WHOLE, CLASSES, TEMPLATES, SUBS, *FOUND, TOK, QTOK, LENGTHS, POSTINGS, STATS, BM25, LIBRARY, overlap_ctes("SELECT query_id, query_text FROM questions"),
    "local AS (" + CHUNKS[-1].split("local AS (")[1],
)
# Only questions whose sub-questions found something have web evidence; the chain of evidence, answers and audits is the same.
WHOLE_ANSWERS = (*WHOLE_CHUNKS, *ANSWERS[len(CHUNKS):], ENTITY_VALUES, r"""hay AS (
  SELECT query_id, lower(query_text || coalesce(' ' || t, '')) AS h FROM questions LEFT JOIN (
    SELECT query_id, string_agg(text, ' ' ORDER BY side, rank) AS t FROM (SELECT query_id, 0 AS side, rank, text FROM local UNION ALL SELECT query_id, 1, rank, text FROM web) GROUP BY 1) USING (query_id)),
entities AS (SELECT query_id, count(*) AS n_entities FROM hay, names WHERE contains(h, lower(mention)) GROUP BY 1),
claimed AS (SELECT query_id, count(*) AS n_claims FROM evidence WHERE rank <= 8 AND trim(string_split(trim(text, ' ' || chr(10) || chr(9)), '.')[1], ' ' || chr(10) || chr(9)) <> '' GROUP BY 1),
counted AS (SELECT query_id // 10 AS query_id, count(*) AS n_sub_queries FROM subs GROUP BY 1),
found_web AS (SELECT query_id, count(*) AS n_web FROM web GROUP BY 1)""", citation_ctes("answers"), KNOWN, audit_cte("answers"), SOURCES)


@register("answer_pipeline", "F14", with_ctes(*WHOLE_ANSWERS, select=f"""
SELECT a.query_id AS query_id, query_type, route, n_sub_queries, coalesce(n_web, 0) AS n_web, coalesce(n_entities, 0) AS n_entities, coalesce(n_claims, 0) AS n_claims,
  answer || CASE WHEN invalid > 0 THEN '{qa.RETRY_NOTE}' ELSE '' END AS answer, citations, invalid, invalid > 0 AS repaired,
  CASE WHEN d.query_id IS NOT NULL THEN 0.62::DOUBLE WHEN invalid = 0 AND citations > 0 THEN 0.86::DOUBLE ELSE 0.78::DOUBLE END AS confidence, coalesce(n_sources, 0) AS n_sources
FROM answers a JOIN audit u ON u.query_id = a.query_id JOIN classes c ON c.query_id = a.query_id JOIN counted k ON k.query_id = a.query_id
LEFT JOIN found_web f ON f.query_id = a.query_id LEFT JOIN entities e ON e.query_id = a.query_id LEFT JOIN claimed m ON m.query_id = a.query_id
LEFT JOIN (SELECT DISTINCT query_id FROM disputes) d ON d.query_id = a.query_id LEFT JOIN (SELECT query_id, count(*) AS n_sources FROM sources GROUP BY 1) s ON s.query_id = a.query_id"""))
def answer_pipeline(spark, folder):
    texts = table(spark, folder, "benchmark")
    count = texts.agg(F.count("*").alias("n")).scalar()
    numbers = table(spark, folder, "documents").selectExpr("doc_id div 100 AS number").distinct()
    queries = numbers.withColumn("item_id", F.col("number") % count).join(texts, "item_id").selectExpr("number AS query_id", f"{WHOLE_SQL} AS query_text")
    landed = F.expr("query_id div 5 * 10 + query_id % 5")
    payloads = papers.payload_table(spark, folder).withColumn("query_id", landed)
    articles = lit.parse_articles(papers.article_xml(spark, folder))
    notes = lit.flatten_annotations(papers.annotation_payloads(spark, folder))

    def search(subs):
        return literature_search(payloads, subs, articles, notes, papers.START, papers.END)

    found = search_and_answer(
        queries, lambda asked: local_of(rt.overlap_topk(asked, library(spark, folder))), search, topic_summaries(spark, folder), known_papers(spark, folder),
        DEFINITIONS, RULES,
    )
    counts = [
        df.groupBy("query_id").agg(F.count("*").alias(name))
        for name, df in (("n_sub_queries", found.sub_queries), ("n_web", found.web), ("n_entities", found.entities), ("n_claims", found.claims), ("n_sources", found.sources))
    ]
    out = found.answers.join(found.audit.select("query_id", "citations", "invalid", F.col("retry").alias("repaired"), "confidence"), "query_id")
    out = out.join(found.classified.select("query_id", "query_type", "route"), "query_id")
    for counted in counts:
        out = out.join(counted, "query_id", "left")
    return out.fillna(0, ["n_sub_queries", "n_web", "n_entities", "n_claims", "n_sources"])
