"""Registered retrieval queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.registry import register, table, with_ctes
from paperloom.functions import text as tx
from paperloom.functions.ranking import shown
from paperloom.operators import retrieval as rt
from paperloom.plans import hybrid
from paperloom.session import materialize

TOKEN_SQL = "[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*"

TOK = f"""tok AS (
  SELECT doc_id, pos, lower(t) AS term FROM (
    SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS t
    FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS l FROM documents)))"""
QTOK = f"""qtok AS (
  SELECT query_id, pos, lower(t) AS term FROM (
    SELECT query_id, generate_subscripts(l, 1) AS pos, unnest(l) AS t
    FROM (SELECT item_id AS query_id, regexp_extract_all(text, '{TOKEN_SQL}') AS l FROM benchmark)))"""
LENGTHS = """lengths AS (
  SELECT d.doc_id, count(t.term) AS doc_len FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1)"""
POSTINGS = """postings AS (
  SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2)"""
STATS = """stats AS (
  SELECT term, count(*) AS df, (SELECT count(*) FROM lengths) AS n_docs, (SELECT avg(doc_len) FROM lengths) AS avgdl
  FROM postings GROUP BY 1),
idfs AS (SELECT *, ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM stats)"""
BM25 = """bm25_all AS (
  SELECT q.query_id, p.doc_id,
    sum(idf * p.tf * 2.5 / (p.tf + 1.5 * (1.0 - 0.75 + 0.75 * l.doc_len / s.avgdl))) AS score
  FROM qtok q JOIN postings p USING (term) JOIN idfs s USING (term) JOIN lengths l ON l.doc_id = p.doc_id
  GROUP BY 1, 2),
bm25 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
    FROM bm25_all WHERE score > 0) WHERE rank <= 100)"""


def hashed_ctes(prefix: str, source: str, key: str, salt: str, dimension: int = 768) -> str:
    """Unit-length hashed vectors of an already tokenised source, named ``<prefix>``."""
    return f"""{prefix}_terms AS (
  SELECT {key}, term FROM {source}
  UNION ALL
  SELECT {key}, term || ' ' || nxt FROM (
    SELECT {key}, term, lead(term) OVER (PARTITION BY {key} ORDER BY pos) AS nxt FROM {source}) WHERE nxt IS NOT NULL),
{prefix}_raw AS (
  SELECT {key}, CAST(('0x' || substr(sha256('{salt}:' || term), 1, 8))::UBIGINT % {dimension} AS BIGINT) AS bucket,
    CAST(count(*) AS DOUBLE) AS weight FROM {prefix}_terms GROUP BY 1, 2),
{prefix} AS (
  SELECT {key}, bucket, weight / sqrt(sum(weight * weight) OVER (PARTITION BY {key})) AS w FROM {prefix}_raw)"""


def sparse_ctes(name: str, salt: str) -> str:
    return (
        hashed_ctes(f"{name}_d", "tok", "doc_id", salt)
        + ",\n"
        + hashed_ctes(f"{name}_q", "qtok", "query_id", salt)
        + f""",
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
    FROM (SELECT q.query_id, d.doc_id, sum(q.w * d.w) AS score
          FROM {name}_q q JOIN {name}_d d USING (bucket) GROUP BY 1, 2)
    WHERE score > 0) WHERE rank <= 100)"""
    )


RRF = """rrf_all AS (
  SELECT query_id, doc_id, sum(1.0::DOUBLE / (rrf_k + rank)) AS score,
    min(position * 1000 + rank) AS first_seen,
    max(CASE WHEN position = 0 THEN rank END) AS bm25_rank,
    max(CASE WHEN position = 1 THEN rank END) AS bio_rank,
    max(CASE WHEN position = 2 THEN rank END) AS gen_rank
  FROM (SELECT 0 AS position, * FROM bm25 UNION ALL SELECT 1, * FROM bio UNION ALL SELECT 2, * FROM gen),
    (SELECT CASE WHEN count(*) < 1000 THEN 10 ELSE 60 END AS rrf_k FROM documents)
  GROUP BY 1, 2),
rrf AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_seen, doc_id) AS rank
  FROM rrf_all)"""


def rerank_ctes(pool: str, out: str, k: int, extra: str = "") -> str:
    """Lexical rerank of ``pool(query_id, doc_id, rank{extra})`` with texts from documents."""
    return f"""{out}_sets AS (
  SELECT DISTINCT doc_id, term FROM tok),
{out}_qsets AS (
  SELECT query_id, term FROM qtok GROUP BY 1, 2),
{out}_qn AS (
  SELECT query_id, count(*) AS nq FROM {out}_qsets GROUP BY 1),
{out}_dn AS (
  SELECT doc_id, count(*) AS nd FROM {out}_sets GROUP BY 1),
{out}_phrase AS (
  SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS phrase FROM qtok GROUP BY 1),
{out}_shared AS (
  SELECT p.query_id, p.doc_id, count(*) AS n,
    bool_or(contains(q.term, '-') OR starts_with(q.term, 'mt')) AS gene
  FROM {pool} p JOIN {out}_qsets q USING (query_id) JOIN {out}_sets d ON d.doc_id = p.doc_id AND d.term = q.term
  GROUP BY 1, 2),
{out}_scored AS (
  SELECT p.query_id, p.doc_id, p.rank AS earlier_rank{extra},
    coalesce(s.n, 0) / nq::DOUBLE
      + 0.5::DOUBLE * coalesce(s.n, 0) / (nq + coalesce(nd, 0) - coalesce(s.n, 0))
      + CASE WHEN contains(lower(d.text), f.phrase) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN coalesce(s.gene, false) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM {pool} p JOIN documents d USING (doc_id) JOIN {out}_qn USING (query_id) JOIN {out}_phrase f USING (query_id)
  LEFT JOIN {out}_dn dn ON dn.doc_id = p.doc_id
  LEFT JOIN {out}_shared s ON s.query_id = p.query_id AND s.doc_id = p.doc_id),
{out} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, earlier_rank) AS rank
    FROM {out}_scored) WHERE rank <= {k})"""


BASE = (TOK, QTOK, LENGTHS, POSTINGS, STATS, BM25)
LISTS = (*BASE, sparse_ctes("bio", "bio"), sparse_ctes("gen", "general"), RRF)
SHOW_RANKED = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM "


def questions(spark, folder):
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def corpus(spark, folder):
    return table(spark, folder, "documents", spread="doc_id").select("doc_id", "text")


def show_ranked(df):
    return df.select("query_id", "doc_id", shown("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@register("token_profile", "C1", with_ctes(TOK, """firsts AS (SELECT doc_id, term, min(pos) AS pos FROM tok GROUP BY 1, 2)""",
select="""
SELECT d.doc_id, coalesce(a.n, 0) AS n_tokens, coalesce(b.n, 0) AS n_distinct,
  md5(coalesce(a.s, '')) AS tokens_md5, md5(coalesce(b.s, '')) AS distinct_md5
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(term, ' ' ORDER BY pos) AS s FROM tok GROUP BY 1) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(term, ' ' ORDER BY pos) AS s FROM firsts GROUP BY 1) b USING (doc_id)"""))
def token_profile(spark, folder):
    words = corpus(spark, folder).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return words.select("doc_id", "t", F.array_distinct("t").alias("u")).select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size("u").cast("long").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"),
        F.md5(F.array_join("u", " ")).alias("distinct_md5"),
    )


@register("postings", "C2", with_ctes(TOK, LENGTHS, POSTINGS, select="""
SELECT term, p.doc_id, tf, doc_len FROM postings p JOIN lengths l ON l.doc_id = p.doc_id"""))
def postings(spark, folder):
    return rt.build_postings(corpus(spark, folder))


@register("corpus_stats", "C3", with_ctes(TOK, LENGTHS, POSTINGS, STATS, select="""
SELECT term, df, n_docs, round(avgdl, 6) AS avgdl, round(idf, 6) AS idf FROM idfs"""))
def corpus_stats(spark, folder):
    stats = rt.corpus_stats(rt.build_index(corpus(spark, folder)))
    return stats.select("term", "df", "n_docs", shown("avgdl").alias("avgdl"), shown("idf").alias("idf"))


@register("bm25_topk", "C4", with_ctes(*BASE, select=SHOW_RANKED + "bm25"))
def bm25_topk(spark, folder):
    return show_ranked(rt.bm25_search(questions(spark, folder), corpus(spark, folder)))


@register("bm25_after_append", "C5", with_ctes(*BASE, select=SHOW_RANKED + "bm25"))
def bm25_after_append(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text", "lang")
    index = rt.build_index(docs.where("lang = 'en'"))
    grown = rt.append_index(index, rt.build_index(docs.where("lang <> 'en' OR lang IS NULL")))
    return show_ranked(rt.bm25_topk(questions(spark, folder), grown))


@register("hashed_embedding", "C6", """
WITH cut AS (SELECT doc_id, list_transform(regexp_extract_all(text, '""" + TOKEN_SQL + """'), lambda t: lower(t)) AS t FROM documents),
terms AS (SELECT doc_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM cut),
counted AS (
  SELECT doc_id, CAST(CAST('0x' || substr(sha256('bio:' || term), 1, 8) AS BIGINT) % 768 AS BIGINT) AS bucket, CAST(count(*) AS DOUBLE) AS weight FROM terms GROUP BY 1, 2)
SELECT doc_id, bucket, weight, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS unit_weight FROM counted""")
def hashed_embedding(spark, folder):
    unit = rt.normalize_sparse(rt.hash_embed(corpus(spark, folder), "bio"), raw="given")
    return unit.select("doc_id", "bucket", F.col("given").alias("weight"), shown("weight").alias("unit_weight"))


@register("cosine_pairs", "C7", """
SELECT a.vec_id AS left_id, b.vec_id AS right_id,
  round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
    / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)))
    / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    pairs = vectors.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    return rt.cosine_pairs(pairs, vectors).withColumn("cosine", shown("cosine"))


@register("dense_topk", "C8", """
WITH parts AS (
  SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
centre AS (SELECT label AS query_id, i, round(avg(x), 6) AS x FROM parts GROUP BY 1, 2),
unit_q AS (SELECT query_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM centre),
vec AS (SELECT vec_id AS doc_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
unit_d AS (SELECT doc_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM vec),
scored AS (SELECT query_id::BIGINT AS query_id, doc_id, sum(q.x * d.x) AS score FROM unit_q q JOIN unit_d d USING (i) GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM scored WHERE score > 0) WHERE rank <= 100""")
def dense_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    centres = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
        .groupBy(F.col("label").cast("long").alias("query_id"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
        .select("query_id", F.col("p.x").alias("embedding"))
    )
    return show_ranked(rt.dense_topk(centres, vectors, 64))


@register("sparse_topk", "C9", with_ctes(TOK, QTOK, sparse_ctes("bio", "bio"), sparse_ctes("gen", "general"), select="""
SELECT 'pubmedbert' AS source, query_id, doc_id, round(score, 6) AS score, rank FROM bio
UNION ALL SELECT 'nomic', query_id, doc_id, round(score, 6), rank FROM gen"""))
def sparse_topk(spark, folder):
    found = rt.sparse_lists(questions(spark, folder), corpus(spark, folder), hybrid.SALTS)
    return found.select(
        F.col("vector").alias("source"), "query_id", "doc_id", shown("score").alias("score"), F.col("rank").cast("long").alias("rank")
    )


@register("rank_fusion", "C10", with_ctes(*LISTS, select="""
SELECT query_id, doc_id, round(score, 6) AS score, rank, bm25_rank, bio_rank, gen_rank FROM rrf"""))
def rank_fusion(spark, folder):
    docs = corpus(spark, folder)
    fused = hybrid.fuse_lists(hybrid.three_lists(questions(spark, folder), docs), docs)
    per_source = {"bm25_rank": "bm25", "bio_rank": hybrid.BIOMEDICAL, "gen_rank": hybrid.GENERAL}
    return fused.select(
        "query_id",
        "doc_id",
        shown("score").alias("score"),
        F.col("rank").cast("long").alias("rank"),
        *[F.col("source_scores")[source]["rank"].alias(name) for name, source in per_source.items()],
    )


HYBRID = (*LISTS, "pool AS (SELECT query_id, doc_id, rank FROM rrf WHERE rank <= 50)", rerank_ctes("pool", "final", 15))


@register("hybrid_retrieval", "C11", with_ctes(*HYBRID, select="SELECT query_id, doc_id, round(score, 6) AS score, rank FROM final"))
def hybrid_retrieval(spark, folder):
    return show_ranked(hybrid.hybrid_retrieve(questions(spark, folder), corpus(spark, folder)))


@register("lexical_rerank", "C12", with_ctes(*BASE, rerank_ctes("bm25", "final", 15), select="""
SELECT query_id, doc_id, earlier_rank, round(score, 6) AS score, rank FROM final"""))
def lexical_rerank(spark, folder):
    queries, docs = questions(spark, folder), corpus(spark, folder)
    pool = rt.bm25_search(queries, docs).drop("score")
    out = rt.lexical_rerank(pool, queries, docs)
    return out.select(
        "query_id", "doc_id", F.col("earlier_rank").cast("long").alias("earlier_rank"),
        shown("score").alias("score"), F.col("rank").cast("long").alias("rank"),
    )


EDGES = """edges AS (
  SELECT DISTINCT l_orderkey % n AS src, l_partkey % n AS dst FROM lineitem, (SELECT count(*) AS n FROM documents)
  WHERE l_orderkey % n <> l_partkey % n)"""
EXPAND = (
    TOK, QTOK, LENGTHS, POSTINGS, STATS, BM25, EDGES,
    "top10 AS (SELECT query_id, doc_id AS paper FROM bm25 WHERE rank <= 10)",
    """side AS (
  SELECT 0 AS way, src AS paper, dst AS doc_id FROM edges UNION ALL SELECT 1, dst, src FROM edges),
near AS (
  SELECT paper, doc_id FROM (
    SELECT s.*, row_number() OVER (PARTITION BY way, paper ORDER BY n_chars DESC, doc_id) AS n
    FROM side s JOIN documents USING (doc_id)) WHERE n <= 5),
reached AS (SELECT DISTINCT query_id, doc_id FROM top10 JOIN near USING (paper)),
ctext AS (
  SELECT doc_id, n_chars, trim('Study of ' || source || ' number ' || doc_id || chr(10) || text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents)""",
    f"""ctok AS (
  SELECT doc_id, pos, lower(t) AS term FROM (
    SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS t
    FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS l FROM ctext)))""",
    hashed_ctes("cd", "ctok", "doc_id", "citation_traversal"),
    hashed_ctes("cq", "qtok", "query_id", "citation_traversal"),
    """cscore AS (
  SELECT r.query_id, r.doc_id, sum(q.w * d.w) AS score
  FROM reached r JOIN cq q ON q.query_id = r.query_id JOIN cd d ON d.doc_id = r.doc_id AND d.bucket = q.bucket GROUP BY 1, 2),
expanded AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, n_chars DESC, doc_id) AS rank
  FROM cscore JOIN ctext USING (doc_id) WHERE round(score, 9) >= 0.3)""",
)


def citation_inputs(spark, folder):
    documents = table(spark, folder, "documents")
    count = documents.agg(F.count("*").alias("n")).scalar()
    edges = (
        table(spark, folder, "lineitem")
        .select((F.col("l_orderkey") % count).alias("src"), (F.col("l_partkey") % count).alias("dst"))
        .where("src <> dst")
        .distinct()
    )
    papers = documents.select(
        "doc_id",
        F.concat(F.lit("Study of "), "source", F.lit(" number "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("abstract"),
        F.col("n_chars").alias("citation_count"),
    )
    top = rt.bm25_search(questions(spark, folder), corpus(spark, folder))
    return questions(spark, folder), top, edges, papers


@register("citation_expand", "C13", with_ctes(*EXPAND, select=SHOW_RANKED + "expanded"))
def citation_expand(spark, folder):
    return show_ranked(rt.citation_expand(*citation_inputs(spark, folder), threshold=0.3))


@register("expand_and_rerank", "C14", with_ctes(*EXPAND,
    """enlarged AS (
  SELECT query_id, doc_id, rank, 'pool' AS kind, text FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 100
  UNION ALL SELECT query_id, doc_id, rank + 1000000, 'citation', text FROM expanded),
esets AS (SELECT DISTINCT doc_id, 'pool' AS kind, term FROM tok UNION ALL SELECT DISTINCT doc_id, 'citation', term FROM ctok),
edn AS (SELECT doc_id, kind, count(*) AS nd FROM esets GROUP BY 1, 2),
eq AS (SELECT DISTINCT query_id, term FROM qtok),
eqn AS (SELECT query_id, count(*) AS nq FROM eq GROUP BY 1),
ephrase AS (SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS phrase FROM qtok GROUP BY 1),
eshared AS (
  SELECT p.query_id, p.doc_id, p.kind, count(*) AS n, bool_or(contains(q.term, '-') OR starts_with(q.term, 'mt')) AS gene
  FROM enlarged p JOIN eq q USING (query_id) JOIN esets d ON d.doc_id = p.doc_id AND d.kind = p.kind AND d.term = q.term
  GROUP BY 1, 2, 3),
escored AS (
  SELECT p.query_id, p.doc_id, p.kind, p.rank AS earlier_rank,
    coalesce(s.n, 0) / nq::DOUBLE + 0.5::DOUBLE * coalesce(s.n, 0) / (nq + coalesce(nd, 0) - coalesce(s.n, 0))
      + CASE WHEN contains(lower(p.text), f.phrase) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN coalesce(s.gene, false) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM enlarged p JOIN eqn USING (query_id) JOIN ephrase f USING (query_id)
  LEFT JOIN edn ON edn.doc_id = p.doc_id AND edn.kind = p.kind
  LEFT JOIN eshared s ON s.query_id = p.query_id AND s.doc_id = p.doc_id AND s.kind = p.kind)""",
    select="""
SELECT query_id, doc_id, kind, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, earlier_rank) AS rank
  FROM escored) WHERE rank <= 15"""))
def expand_and_rerank(spark, folder):
    out = rt.expand_and_rerank(*citation_inputs(spark, folder), corpus(spark, folder), threshold=0.3)
    return out.select(
        "query_id", "doc_id", "kind", shown("score").alias("score"), F.col("rank").cast("long").alias("rank")
    )


STOP_SQL = ", ".join(f"'{w}'" for w in tx.RANKING_STOP_WORDS)


def overlap_ctes(question_sql: str, k: int = 8) -> str:
    """``overlap`` ranking of library chunks for ``question_sql`` (query_id, query_text)."""
    return f"""ov_q AS (
  SELECT DISTINCT query_id, word FROM (
    SELECT query_id, lower(unnest(regexp_extract_all(query_text, '[A-Za-z][A-Za-z0-9\\-]{{2,}}'))) AS word FROM ({question_sql}))
  WHERE word NOT IN ({STOP_SQL})),
ov_qn AS (SELECT query_id, count(*) AS n FROM ov_q GROUP BY 1),
ov_d AS (
  SELECT doc_id, word FROM (
    SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]{{2,}}'))) AS word
    FROM documents WHERE length(text) > 80)
  WHERE word NOT IN ({STOP_SQL})),
ov_dn AS (SELECT doc_id, count(*) AS len FROM ov_d GROUP BY 1),
ov_du AS (SELECT DISTINCT doc_id, word FROM ov_d),
ov_scored AS (
  SELECT query_id, doc_id, count(*) * ln(1.0::DOUBLE + any_value(n)) / ln(2.0::DOUBLE + any_value(len)) AS score
  FROM ov_q JOIN ov_du USING (word) JOIN ov_qn USING (query_id) JOIN ov_dn USING (doc_id) GROUP BY 1, 2),
overlap AS (
  SELECT query_id, doc_id, paper_id, left(text, 1200) AS text, score, rank,
    CASE WHEN starts_with(paper_id, '10.') THEN '[doi:' || paper_id || ']' ELSE '[' || paper_id || ']' END AS citation
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ov_scored)
  JOIN library USING (doc_id) WHERE rank <= {k})"""


LIBRARY = """library AS (
  SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'PMID:' || (100000 + doc_id) WHEN 1 THEN '10.1000/d' || doc_id ELSE 'PMC' || doc_id END AS paper_id
  FROM documents)"""


def library(spark, folder):
    """Documents as library chunks with one of three kinds of paper id."""
    n = F.col("doc_id")
    return table(spark, folder, "documents", spread="doc_id").select(
        "doc_id",
        "text",
        F.when(n % 3 == 0, F.concat(F.lit("PMID:"), (n + 100000).cast("string")))
        .when(n % 3 == 1, F.concat(F.lit("10.1000/d"), n.cast("string")))
        .otherwise(F.concat(F.lit("PMC"), n.cast("string")))
        .alias("paper_id"),
    )


@register("overlap_topk", "C15", with_ctes(LIBRARY, overlap_ctes("SELECT item_id AS query_id, text AS query_text FROM benchmark"), select="""
SELECT query_id, doc_id, paper_id, md5(text) AS text_md5, round(score, 6) AS score, rank, citation FROM overlap"""))
def overlap_topk(spark, folder):
    out = rt.overlap_topk(questions(spark, folder), library(spark, folder))
    return out.select(
        "query_id", "doc_id", "paper_id", F.md5("text").alias("text_md5"),
        shown("score").alias("score"), F.col("rank").cast("long").alias("rank"), "citation",
    )


@register("recall_at_k", "C16", with_ctes(*LISTS, """truth AS (
  SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))""", select="""
SELECT query_id, count(*) AS relevant, count(b.doc_id) AS bm25_found, count(f.doc_id) AS fused_found,
  round(count(b.doc_id)::DOUBLE / count(*), 6) AS bm25_recall, round(count(f.doc_id)::DOUBLE / count(*), 6) AS fused_recall
FROM truth t
LEFT JOIN (SELECT query_id, doc_id FROM bm25 WHERE rank <= 15) b USING (query_id, doc_id)
LEFT JOIN (SELECT query_id, doc_id FROM rrf WHERE rank <= 15) f USING (query_id, doc_id)
GROUP BY 1"""))
def recall_at_k(spark, folder):
    queries, docs = questions(spark, folder), corpus(spark, folder)
    lists = materialize(hybrid.three_lists(queries, docs), "lists")
    truth = materialize(rt.passage_truth(queries, docs), "truth")
    single = rt.recall_at_k(lists.where("source = 'bm25'"), truth)
    fused = rt.recall_at_k(hybrid.fuse_lists(lists, docs), truth)
    return single.select(
        "query_id", "relevant", F.col("found").alias("bm25_found"), shown("recall").alias("bm25_recall")
    ).join(
        fused.select("query_id", F.col("found").alias("fused_found"), shown("recall").alias("fused_recall")),
        "query_id",
    )
