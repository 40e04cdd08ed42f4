"""Registered literature queries: documents serialised as answers of four sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.registry import register, table, with_ctes
from paperloom.catalog.retrieval import TOKEN_SQL, hashed_ctes, questions
from paperloom.functions.ranking import shown
from paperloom.operators import literature as lit
from paperloom.plans import literature as plan
from paperloom.session import fresh_folder
from paperloom.sources import tables

START, END = "2024-02-01", "2025-01-15"
# The same expressions run in Spark and (with // for div) in the SQL twin.
BASE_COLUMNS = (
    "doc_id", "lang", "doc_id div 20 AS query_id",
    "CASE doc_id % 4 WHEN 0 THEN 'pubmed' WHEN 1 THEN 'semantic_scholar' WHEN 2 THEN 'europe_pmc' ELSE 'biorxiv' END AS src",
    "CASE WHEN doc_id % 3 <> 0 THEN CAST(100000 + doc_id div 2 AS STRING) END AS pmid",
    "'10.1/D' || CAST(doc_id div 2 AS STRING) AS doi",
    "'Study of ' || source || ' number ' || CAST(doc_id AS STRING) AS title",
    "CASE WHEN doc_id % 5 <> 0 THEN text ELSE '' END AS abstract",
    "1990 + doc_id % 35 AS year", "n_chars",
    "CASE WHEN doc_id % 8 = 3 THEN 'medrxiv' END AS server",
    "CASE WHEN doc_id % 2 = 1 THEN 'Cell Biology' ELSE 'Genetics' END AS category",
    "'J' || CAST(doc_id % 11 AS STRING) AS journal",
)
DAY = "CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INT) AS STRING) AS day"
BASE = f"lp AS (SELECT {', '.join(BASE_COLUMNS).replace(' div ', ' // ')}, {DAY} FROM documents)"


def base(spark, folder):
    return table(spark, folder, "documents", spread="doc_id").selectExpr(
        *BASE_COLUMNS, "CAST(date_add(DATE '2024-01-01', CAST(doc_id % 400 AS INT)) AS STRING) AS day"
    )


def payload_table(spark, folder):
    """One answer per (question, source) in the form the four services give."""
    year = F.col("year").cast("string")
    item = {
        "semantic_scholar": F.struct(
            F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paperId"), "title", "abstract", "year",
            F.col("n_chars").alias("citationCount"),
            F.create_map(F.lit("DOI"), F.col("doi"), F.lit("PMID"), F.col("pmid")).alias("externalIds"),
        ),
        "europe_pmc": F.struct(
            F.concat(F.lit("E"), F.col("doc_id").cast("string")).alias("id"), F.lit("MED").alias("source"), "title",
            F.col("abstract").alias("abstractText"),
            F.when(F.col("doc_id") % 7 == 2, F.lit("n.d.")).otherwise(year).alias("pubYear"), "doi", "pmid",
            F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), F.col("journal").alias("journalTitle"),
            F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit(" Ada A"), F.col("doc_id").cast("string"), F.lit(", Bo B"))).alias("authorString"),
        ),
        "biorxiv": F.struct("doi", "title", "abstract", F.col("day").alias("date"), "server", "category"),
    }
    rows = base(spark, folder)
    out = None
    for source, struct in item.items():
        items = rows.where(F.col("src") == source).groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("doc_id", F.to_json(struct).alias("x")))).alias("l")
        )
        head, tail = {
            "semantic_scholar": ('{"data":[', "]}"),
            "europe_pmc": ('{"resultList":{"result":[', "]}}"),
            "biorxiv": ('{"collection":[', "]}"),
        }[source]
        payload = F.concat(F.lit(head), F.array_join("l.x", ","), F.lit(tail))
        part = items.select(F.lit(source).alias("source"), "query_id", payload.alias("payload"))
        out = part if out is None else out.unionByName(part)
    ids = rows.where("src = 'pubmed' AND pmid IS NOT NULL").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "pmid"))).alias("l")
    )
    found = F.struct(F.struct(F.col("l.pmid").alias("idlist")).alias("esearchresult"))
    return out.unionByName(ids.select(F.lit("pubmed").alias("source"), "query_id", F.to_json(found).alias("payload")))


def of(spark, folder, source):
    return payload_table(spark, folder).where(F.col("source") == source)


def asked(spark, folder):
    """Every question number asks one of the benchmark texts."""
    texts = questions(spark, folder).select(F.col("query_id").alias("item"), "query_text")
    count = texts.agg(F.count("*").alias("n")).scalar()
    numbers = table(spark, folder, "documents").selectExpr("doc_id div 20 AS query_id").distinct()
    return numbers.select("query_id", (F.col("query_id") % count).alias("item")).join(texts, "item").drop("item")


def article_xml(spark, folder):
    """Article XML of every PubMed record but those in Spanish."""

    def clean(c):
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(mark), F.lit(entity))
        return c

    text = clean(F.col("abstract"))
    rows = base(spark, folder).where("src = 'pubmed' AND pmid IS NOT NULL AND lang <> 'es'")
    parts = [
        '<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">', F.col("pmid"),
        "</PMID><Article><Journal><JournalIssue><PubDate><Year>",
        F.when(F.col("doc_id") % 7 == 2, F.lit("n.d.")).otherwise(F.col("year").cast("string")),
        "</Year></PubDate></JournalIssue><Title>", F.col("journal"), "</Title></Journal><ArticleTitle>", F.col("title"),
        '</ArticleTitle><Abstract><AbstractText Label="BODY">', text, "</AbstractText><AbstractText>closing words</AbstractText></Abstract>",
        "<AuthorList><Author><LastName>A", F.col("doc_id").cast("string"), "</LastName><ForeName>Ada</ForeName></Author>"
        "<Author><LastName>B</LastName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList>"
        '<ArticleId IdType="pubmed">', F.col("pmid"), '</ArticleId><ArticleId IdType="doi">', F.col("doi"),
        "</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>",
    ]
    return rows.select("pmid", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("payload"))


ARTICLES = r"""articles AS (
  SELECT pmid, title, CASE WHEN tabs = '' THEN 'closing words' ELSE tabs || ' closing words' END AS abstract, journal,
    CASE WHEN doc_id % 7 <> 2 THEN year END AS year, doi, 'Ada A' || doc_id || '|B' AS authors
  FROM (SELECT *, trim(abstract, ' ' || chr(10) || chr(9)) AS tabs FROM lp WHERE src = 'pubmed' AND pmid IS NOT NULL AND lang <> 'es'))"""
ASKED = """asked AS (
  SELECT query_id, text AS query_text FROM (SELECT DISTINCT doc_id // 20 AS query_id FROM documents), benchmark, (SELECT count(*) AS n FROM benchmark)
  WHERE item_id = query_id % n)"""
PREPRINTS = f"""pre AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS pos, doi, title, abstract, day AS date, coalesce(server, 'biorxiv') AS server, category
  FROM lp WHERE src = 'biorxiv'),
pre_hit AS (
  SELECT p.*, len(words) = 0 OR len(list_filter(words, lambda w: contains(lower(title || ' ' || abstract || ' ' || category), w))) > 0 AS hit
  FROM pre p JOIN (SELECT query_id, list_filter(string_split_regex(lower(query_text), '\\s+'), lambda w: w <> '') AS words FROM asked) a USING (query_id)
  WHERE date BETWEEN '{START}' AND '{END}'),
pre_kept AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM (
    SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM pre_hit) WHERE hit OR NOT any_hit),
preprints AS (SELECT * FROM pre_kept WHERE rank <= 20)"""
RESULTS = """s2 AS (
  SELECT query_id, 1 AS source_order, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS pos, 'semantic_scholar' AS source, 'p' || doc_id AS id,
    title, abstract, pmid, doi, year, n_chars AS citation_count FROM lp WHERE src = 'semantic_scholar'),
pubmed AS (
  SELECT query_id, 0 AS source_order, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS pos, 'pubmed' AS source, pmid AS id,
    '' AS title, '' AS abstract, pmid, NULL::VARCHAR AS doi, NULL::BIGINT AS year, 0 AS citation_count FROM lp WHERE src = 'pubmed' AND pmid IS NOT NULL),
epmc AS (
  SELECT query_id, 2 AS source_order, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS pos, 'europe_pmc' AS source, 'E' || doc_id AS id,
    title, abstract, coalesce(pmid, 'E' || doc_id) AS pmid, doi, CASE WHEN doc_id % 7 <> 2 THEN year END AS year, 0 AS citation_count FROM lp WHERE src = 'europe_pmc'),
results AS (
  SELECT * FROM pubmed UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM epmc
  UNION ALL SELECT query_id, 3, pos, server, doi, title, abstract, NULL, doi, CAST(substr(date, 1, 4) AS BIGINT), 0 FROM preprints)"""
RANK_SQL = "score_hint + CASE WHEN abstract <> '' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN coalesce(pmid, '') <> '' OR coalesce(doi, '') <> '' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END"
CANDIDATES = f"""cand AS (
  SELECT *, {RANK_SQL} AS rank_value FROM (
    SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - idx * 0.01::DOUBLE) + CASE WHEN source = 'semantic_scholar' THEN least(citation_count / 10000.0::DOUBLE, 0.2::DOUBLE) ELSE 0.0::DOUBLE END AS score_hint,
      coalesce('doi:' || lower(doi), 'pmid:' || pmid, id) AS key
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_order, pos) - 1 AS idx FROM results)))"""


def dedupe_cte(source: str, out: str) -> str:
    return f"""{out} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank_value, 9) DESC, first_index) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY round(rank_value, 9) DESC, idx) AS take, min(idx) OVER (PARTITION BY query_id, key) AS first_index FROM {source}) WHERE take = 1)"""


FILLED = f"""filled AS (
  SELECT *, {RANK_SQL} AS rank_value FROM (
    SELECT d.query_id, d.position AS idx, d.source, d.pmid, d.score_hint,
      CASE WHEN a.pmid IS NOT NULL THEN a.title ELSE d.title END AS title, CASE WHEN a.pmid IS NOT NULL THEN a.abstract ELSE d.abstract END AS abstract,
      CASE WHEN a.pmid IS NOT NULL THEN a.doi ELSE d.doi END AS doi, CASE WHEN a.pmid IS NOT NULL THEN a.year ELSE d.year END AS year,
      CASE WHEN a.pmid IS NOT NULL THEN 'doi:' || lower(a.doi) ELSE d.key END AS key
    FROM deduped d LEFT JOIN articles a ON d.source = 'pubmed' AND a.pmid = d.pmid WHERE d.position <= 30))"""
CHAIN = (BASE, ASKED, PREPRINTS, RESULTS, CANDIDATES, dedupe_cte("cand", "deduped"))
HYDRATED = (*CHAIN, ARTICLES, FILLED, dedupe_cte("filled", "papers"))


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@register("payload_scan", "A3", with_ctes(BASE, select="""
SELECT src AS source, query_id, count(*) AS items FROM lp WHERE src <> 'pubmed' OR pmid IS NOT NULL GROUP BY 1, 2"""))
def payload_scan(spark, folder):
    landing = fresh_folder(spark, "landing")
    stamped = payload_table(spark, folder).withColumn("fetched_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    tables.write_payloads(stamped, landing)
    read = tables.read_payloads(spark, landing)
    parsed = [
        lit.parse_pubmed_search(read.where("source = 'pubmed'")),
        lit.parse_s2(read.where("source = 'semantic_scholar'")),
        lit.parse_europe_pmc(read.where("source = 'europe_pmc'")),
        lit.preprint_results(lit.parse_preprints(read.where("source = 'biorxiv'"))).withColumn("source", F.lit("biorxiv")),
    ]
    out = None
    for part in parsed:
        counted = part.groupBy("source", "query_id").agg(F.count("*").alias("items"))
        out = counted if out is None else out.unionByName(counted)
    return out


@register("manifest_refresh", "A6", with_ctes(BASE, """m AS (
  SELECT lang, pmid, 'PMC' || doc_id AS pmcid, doi, regexp_replace(trim(title), '\\.+$', '') AS title,
    CASE WHEN doc_id % 7 = 2 THEN 'n.d.' ELSE CAST(year AS VARCHAR) END AS year, journal, CASE WHEN doc_id % 9 > 0 THEN 'Ada A' || doc_id END AS first_author, 'MED' AS source
  FROM lp WHERE src = 'europe_pmc')""", select="SELECT * EXCLUDE (lang), true AS changed, false AS changed_again FROM m"))
def manifest_refresh(spark, folder):
    new = lit.normalize_manifest(lit.europe_pmc_items(of(spark, folder, "europe_pmc")))
    old = new.where("year <> 'n.d.'")
    manifest, changed = lit.refresh_manifest(new, old)
    again = lit.refresh_manifest(new, new)[1]
    return manifest.select("*", changed.scalar().alias("changed"), again.scalar().alias("changed_again"))


@register("pubmed_search", "D1", with_ctes(BASE, RESULTS.split("epmc AS")[0].rstrip().rstrip(","), select="SELECT query_id, pos, pmid FROM pubmed"))
def pubmed_search(spark, folder):
    return longs(lit.parse_pubmed_search(of(spark, folder, "pubmed")).select("query_id", "pos", "pmid"), "pos")


@register("citation_links", "D1", with_ctes(BASE, """links AS (
  SELECT pmid, x, min(i) AS i FROM (
    SELECT '1' || doc_id AS pmid, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT doc_id, [doc_id + 1, doc_id + 2, doc_id + 1, doc_id + 7, doc_id + 2, doc_id + 9] AS l FROM lp)) GROUP BY 1, 2)""", select="""
SELECT pmid, row_number() OVER (PARTITION BY pmid ORDER BY i) - 1 AS pos, x::VARCHAR AS linked_pmid FROM links"""))
def citation_links(spark, folder):
    def payload(*steps):
        links = F.array(*[(F.col("doc_id") + s).cast("string") for s in steps])
        sets = F.array(F.struct(F.array(F.struct(links.alias("links"))).alias("linksetdbs")))
        return F.to_json(F.struct(sets.alias("linksets")))

    rows = base(spark, folder).select(
        F.concat(F.lit("1"), F.col("doc_id").cast("string")).alias("pmid"),
        F.array(payload(1, 2, 1), F.lit('{"linksets":[{}]}'), payload(7, 2, 9)).alias("payloads"),
    )
    return longs(lit.parse_citation_links(rows), "pos")


@register("pubmed_articles", "D1", with_ctes(BASE, ARTICLES, select="""
SELECT pmid, title, md5(abstract) AS abstract_md5, journal, year, doi, authors FROM articles"""))
def pubmed_articles(spark, folder):
    out = lit.parse_articles(article_xml(spark, folder))
    return out.select(
        "pmid", "title", F.md5("abstract").alias("abstract_md5"), "journal", F.col("year").cast("long").alias("year"), "doi",
        F.array_join("authors", "|").alias("authors"),
    )


SHOW = "query_id, pos, id, title, md5(abstract) AS abstract_md5, pmid, doi, year"


def shown_results(df):
    out = df.select("query_id", "pos", "id", "title", F.md5("abstract").alias("abstract_md5"), "pmid", "doi", "year")
    return longs(out, "pos", "year")


S2_ONLY = RESULTS.split("pubmed AS")[0].rstrip().rstrip(",")


@register("semantic_scholar_papers", "D2", with_ctes(BASE, S2_ONLY, select=f"SELECT {SHOW}, citation_count FROM s2 WHERE year BETWEEN 1995 AND 2015"))
def semantic_scholar_papers(spark, folder):
    papers = lit.parse_s2(of(spark, folder, "semantic_scholar"), (1995, 2015))
    keep = papers.select("query_id", "pos", F.col("citation_count").cast("long").alias("citation_count"))
    return shown_results(papers).join(longs(keep, "pos"), ["query_id", "pos"])


@register("semantic_scholar_references", "D2", with_ctes(BASE, S2_ONLY, select=f"SELECT {SHOW} FROM s2"))
def semantic_scholar_references(spark, folder):
    inside = F.transform(F.from_json("payload", f"data array<{lit.S2_PAPER}>")["data"], lambda p: F.struct(p.alias("citedPaper")))
    wrapped = of(spark, folder, "semantic_scholar").select("query_id", F.to_json(F.struct(inside.alias("data"))).alias("payload"))
    return shown_results(lit.parse_s2(wrapped, inside="citedPaper"))


@register("europe_pmc_papers", "D3", with_ctes(BASE, ASKED, PREPRINTS, RESULTS, select=f"SELECT {SHOW} FROM epmc"))
def europe_pmc_papers(spark, folder):
    return shown_results(lit.parse_europe_pmc(of(spark, folder, "europe_pmc")))


@register("preprint_filter", "D4", with_ctes(BASE, ASKED, PREPRINTS, select="""
SELECT query_id, pos, doi, title, date, server, category, rank FROM preprints"""))
def preprint_filter(spark, folder):
    rows = lit.parse_preprints(of(spark, folder, "biorxiv"))
    out = lit.filter_preprints(rows, asked(spark, folder), START, END)
    return longs(out.select("query_id", "pos", "doi", "title", "date", "server", "category", "rank"), "pos", "rank")


def annotation_payloads(spark, folder):
    def note(text, kind, key, places):
        infons = F.struct(*([F.lit("Gene").alias("type"), F.lit(key).alias("identifier")] if kind == "type" else [F.lit("Species").alias("biotype")]))
        return F.struct(text.alias("text"), infons.alias("infons"), places.alias("locations"))

    at = F.struct((F.col("doc_id") % 100).cast("string").alias("offset"), F.lit("4").alias("length"))
    open_end = F.struct((F.col("doc_id") % 50).cast("string").alias("offset"), F.lit(None).cast("string").alias("length"))
    none = F.array().cast("array<struct<offset:string,length:string>>")
    passages = F.array(
        F.struct(F.array(F.to_json(note(F.col("src"), "type", "G1", F.array(at))), F.to_json(note(F.col("lang"), "biotype", "", none))).alias("n")),
        F.struct(F.array(F.to_json(note(F.col("title"), "type", "", F.array(open_end)))).alias("n")),
    )
    body = F.array_join(F.transform(passages, lambda p: F.concat(F.lit('{"annotations":['), F.array_join(p["n"], ","), F.lit("]}"))), ",")
    document = F.concat(F.lit('{"id":"'), F.col("pmid"), F.lit('","passages":['), body, F.lit("]}"))
    payload = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"documents":['), document, F.lit("]}"))).otherwise(
        F.concat(F.lit("["), document, F.lit("]"))
    )
    return base(spark, folder).where("pmid IS NOT NULL").select(payload.alias("payload"))


NOTES = """notes AS (
  SELECT pmid, 0 AS passage, 0 AS n, src AS text, 'Gene' AS entity_type, 'G1' AS identifier, doc_id % 100 AS start, doc_id % 100 + 4 AS stop FROM lp WHERE pmid IS NOT NULL
  UNION ALL SELECT pmid, 0, 1, lang, 'Species', NULL, NULL, NULL FROM lp WHERE pmid IS NOT NULL
  UNION ALL SELECT pmid, 1, 0, title, 'Gene', NULL, doc_id % 50, doc_id % 50 FROM lp WHERE pmid IS NOT NULL)"""


@register("annotation_rows", "D5", with_ctes(BASE, NOTES, select="""
SELECT pmid, passage::BIGINT AS passage, n::BIGINT AS n, text, entity_type, identifier, start, stop AS "end" FROM notes"""))
def annotation_rows(spark, folder):
    return longs(lit.flatten_annotations(annotation_payloads(spark, folder)), "passage", "n", "start", "end")


def candidates(spark, folder):
    return plan.literature_candidates(payload_table(spark, folder), asked(spark, folder), START, END)


@register("candidate_scores", "D6", with_ctes(*CHAIN, select="""
SELECT query_id, idx AS index, source, CASE WHEN source = 'pubmed' AND false THEN id ELSE key END AS key, round(score_hint, 6) AS score_hint, round(rank_value, 6) AS rank_value FROM cand"""))
def candidate_scores(spark, folder):
    out = candidates(spark, folder).select(
        "query_id", "index", "source", "key", shown("score_hint").alias("score_hint"), shown("rank_value").alias("rank_value")
    )
    return longs(out, "index")


@register("source_dedupe", "D7", with_ctes(*CHAIN, select="""
SELECT query_id, key, source, id, position, round(rank_value, 6) AS rank_value FROM deduped"""))
def source_dedupe(spark, folder):
    out = lit.dedupe_papers(candidates(spark, folder))
    return longs(out.select("query_id", "key", "source", "id", "position", shown("rank_value").alias("rank_value")), "position")


@register("hydrated_papers", "D8", with_ctes(*HYDRATED, select="""
SELECT query_id, key, source, title, md5(abstract) AS abstract_md5, pmid, doi, year, position FROM papers"""))
def hydrated_papers(spark, folder):
    out = plan.hydrated_papers(candidates(spark, folder), lit.parse_articles(article_xml(spark, folder)))
    return longs(
        out.select("query_id", "key", "source", "title", F.md5("abstract").alias("abstract_md5"), "pmid", "doi", "year", "position"),
        "year", "position",
    )


@register("attached_annotations", "D9", with_ctes(*HYDRATED, NOTES, select="""
SELECT query_id, key, coalesce(a.texts, '') AS annotations FROM papers p
LEFT JOIN (SELECT pmid, string_agg(text, '|' ORDER BY passage, n, text) AS texts FROM notes GROUP BY 1) a USING (pmid)"""))
def attached_annotations(spark, folder):
    papers = plan.hydrated_papers(candidates(spark, folder), lit.parse_articles(article_xml(spark, folder)))
    notes = lit.flatten_annotations(annotation_payloads(spark, folder))
    return lit.attach_annotations(papers, notes).select("query_id", "key", F.array_join("annotations", "|").alias("annotations"))


SCORED = (*HYDRATED, r"""wtext AS (
  SELECT *, query_id || '|' || key AS ck, CASE WHEN abstract <> '' THEN trim(title || chr(10) || chr(10) || abstract, ' ' || chr(10) || chr(9)) ELSE title END AS text FROM papers)""",
    f"""wtok AS (SELECT ck, pos, lower(t) AS term FROM (SELECT ck, generate_subscripts(l, 1) AS pos, unnest(l) AS t FROM (SELECT ck, regexp_extract_all(text, '{TOKEN_SQL}') AS l FROM wtext))),
wqtok AS (SELECT query_id, pos, lower(t) AS term FROM (SELECT query_id, generate_subscripts(l, 1) AS pos, unnest(l) AS t FROM (SELECT query_id, regexp_extract_all(query_text, '{TOKEN_SQL}') AS l FROM asked)))""",
    hashed_ctes("wd", "wtok", "ck", "web-pubmedbert"), hashed_ctes("wq", "wqtok", "query_id", "web-pubmedbert"),
    """wsim AS (SELECT t.ck, sum(q.w * d.w) AS sim FROM wtext t JOIN wq q ON q.query_id = t.query_id JOIN wd d ON d.ck = t.ck AND d.bucket = q.bucket GROUP BY 1),
web AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position) AS rank FROM (
    SELECT t.*, 'web-' || replace(key, ':', '-') AS chunk_id, coalesce(sim, 0.0::DOUBLE) + score_hint AS score FROM wtext t LEFT JOIN wsim USING (ck)))""")


def searched(spark, folder):
    return plan.literature_search(
        payload_table(spark, folder), asked(spark, folder), lit.parse_articles(article_xml(spark, folder)),
        lit.flatten_annotations(annotation_payloads(spark, folder)), START, END,
    )


@register("abstract_scores", "D10", with_ctes(*SCORED, select="SELECT query_id, chunk_id, source, round(score, 6) AS score, rank FROM web"))
def abstract_scores(spark, folder):
    out = searched(spark, folder).select("query_id", "chunk_id", "source", shown("score").alias("score"), "rank")
    return longs(out, "rank")


MERGED = (*SCORED, """merged_all AS (
  SELECT *, query_id // 5 AS parent, coalesce('doi:' || lower(doi), 'pmid:' || pmid, chunk_id) AS merge_key FROM web),
merged_one AS (
  SELECT *, row_number() OVER (PARTITION BY parent, merge_key ORDER BY round(score, 9) DESC, query_id, rank) AS take,
    min(query_id * 100000 + rank) OVER (PARTITION BY parent, merge_key) AS first_seen FROM merged_all),
merged AS (
  SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY parent ORDER BY round(score, 9) DESC, first_seen) AS rank FROM merged_one WHERE take = 1)""")


def merged(spark, folder):
    found = searched(spark, folder).withColumnRenamed("query_id", "sub_id")
    return lit.merge_subquery_results(found.withColumn("query_id", F.expr("sub_id div 5")))


@register("subquery_merge", "D11", with_ctes(*MERGED, select="""
SELECT parent AS query_id, query_id AS sub_id, chunk_id, source, round(score, 6) AS score, rank FROM merged"""))
def subquery_merge(spark, folder):
    return longs(merged(spark, folder).select("query_id", "sub_id", "chunk_id", "source", shown("score").alias("score"), "rank"), "rank")


@register("web_evidence", "D12", with_ctes(*MERGED, NOTES, select="""
SELECT parent AS query_id, chunk_id AS doc_id, md5(text) AS text_md5, coalesce(pmid, doi, chunk_id) AS paper_id, 'Web > ' || source AS section_path, round(score, 6) AS score, rank,
  coalesce('[PMID:' || pmid || ']', '[doi:' || doi || ']', '[PMID:12345678]') AS citation, title, source AS source_api, coalesce(year::VARCHAR, '') AS year, coalesce(texts, '') AS annotations
FROM merged LEFT JOIN (SELECT pmid, string_agg(text, '|' ORDER BY passage, n, text) AS texts FROM notes GROUP BY 1) a USING (pmid)"""))
def web_evidence(spark, folder):
    out = lit.to_ranked(merged(spark, folder))
    out = out.withColumns({"text_md5": F.md5("text"), "score": shown("score"), "annotations": F.array_join("annotations", "|")})
    return longs(out.drop("text"), "rank")


def request_log(spark, folder):
    events = table(spark, folder, "events")
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("retmode"), F.lit("json"))
    return events.select(
        lit.request_key(F.lit("pubmed"), F.col("event_type"), params).alias("request_key"),
        F.col("ts").cast("timestamp_ntz").alias("fetched_at"),
        F.col("event_id").cast("string").alias("payload"),
    )


@register("payload_freshness", "D13", """
WITH log AS (
  SELECT 'pubmed:' || event_type || '?[["retmode","json"],["user","' || user_id || '"]]' AS request_key, ts AS fetched_at, event_id::VARCHAR AS payload FROM events),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY fetched_at DESC, payload DESC) AS n FROM log
    WHERE fetched_at BETWEEN TIMESTAMP '2024-01-25' - INTERVAL 86400 SECOND AND TIMESTAMP '2024-01-25') WHERE n = 1)
SELECT request_key, strftime(fetched_at, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at, payload, payload IS NULL AS refetch
FROM (SELECT DISTINCT request_key FROM log) LEFT JOIN latest USING (request_key)""")
def payload_freshness(spark, folder):
    log = request_log(spark, folder)
    out = lit.fresh_payloads(log, log, "2024-01-25 00:00:00", 86400)
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def paced_log(spark, folder):
    since = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, folder, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), since.alias("at"))


@register("request_pacing", "D15", """
WITH log AS (SELECT user_id AS client, event_id AS request_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS "at", 1000000.0::DOUBLE / (1.0::DOUBLE / 14400.0::DOUBLE) AS step FROM events),
numbered AS (
  SELECT *, row_number() OVER w AS n, "at" - lag("at") OVER w AS gap FROM log WINDOW w AS (PARTITION BY client ORDER BY "at", request_id)),
granted AS (
  SELECT *, n * step + max("at" - n * step) OVER (PARTITION BY client ORDER BY "at", request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS granted_at FROM numbered)
SELECT client, request_id, "at", round(granted_at, 0) AS granted_at, round(granted_at - "at", 0) AS wait, coalesce(gap < step, false) AS too_early FROM granted""")
def request_pacing(spark, folder):
    out = lit.pace_requests(paced_log(spark, folder), 1.0 / 14400.0)
    return out.select(
        "client", "request_id", "at", F.round("granted_at", 0).alias("granted_at"),
        F.round("wait", 0).alias("wait"), "too_early",
    )
