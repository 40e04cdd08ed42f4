"""Registered structuring queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.registry import register, table, with_ctes
from paperloom.operators import structure as st
from paperloom.sources import tables

# Fixed values throughout: the twins repeat layout words, label patterns and break marks, whose matches must be the same.

# The same expression runs in Spark and in the SQL twin.
PAPER_TEXT_SQL = """
  concat_ws(chr(10),
    'Study of ' || source || ' number ' || CAST(doc_id AS STRING),
    'Ada A' || CAST(doc_id % 7 AS STRING) || ', Bo B' || CAST(doc_id % 5 AS STRING),
    'Journal: J' || CAST(doc_id % 11 AS STRING),
    CASE WHEN doc_id % 3 <> 0 THEN 'DOI: 10.' || CAST(1000 + doc_id % 9000 AS STRING) || '/X.' || CAST(doc_id AS STRING) END,
    'Keywords: k' || CAST(doc_id % 3 AS STRING) || '; k' || CAST(doc_id % 4 AS STRING),
    'MeSH Terms: m' || CAST(doc_id % 5 AS STRING) || '; m' || CAST(doc_id % 6 AS STRING),
    'Published ' || CAST(1990 + doc_id % 35 AS STRING),
    CASE WHEN doc_id % 5 <> 0 THEN concat_ws(chr(10),
      'Abstract', substr(replace(text, chr(10), ' '), 1, 300),
      '1 Introduction', substr(replace(text, chr(10), ' '), 301, 600),
      'Results', 'Etc Activity', substr(replace(text, chr(10), ' '), 901),
      'Figure 1: panel for ' || CAST(doc_id AS STRING),
      'Table 2. values for ' || CAST(doc_id AS STRING),
      'References', '1. A. Title. 2001.', 'continued here', '2. B. Title.')
    ELSE replace(text, chr(10), ' ') END)"""
PATH_SQL = """'/papers/' || source || '/' ||
    CASE doc_id % 4 WHEN 0 THEN 'PMC' || CAST(doc_id AS STRING) WHEN 1 THEN 'PMID_' || CAST(doc_id AS STRING)
      ELSE 'paper' || CAST(doc_id AS STRING) END || '.pdf'"""
PAPER = f"paper AS (SELECT doc_id, {PAPER_TEXT_SQL} AS text, {PATH_SQL} AS path FROM documents)"


def paper_texts(spark, folder):
    return table(spark, folder, "documents", spread="doc_id").selectExpr(
        "doc_id", f"{PAPER_TEXT_SQL} AS text", f"{PATH_SQL} AS path"
    )


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@register("corpus_scan", "A1", "SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents")
def corpus_scan(spark, folder):
    docs = tables.read_corpus(spark, f"{folder}/documents.parquet")
    return docs.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


@register("paper_folder", "A2")
def paper_folder(spark, folder):
    accepted, rejected = tables.list_papers(spark, folder, "parquet")
    return accepted.unionByName(rejected)


NORMAL = r"""norm AS (
  SELECT doc_id, trim(string_agg(trim(regexp_replace(line, '\s+', ' ', 'g')), chr(10) ORDER BY i), ' ' || chr(10)) AS text
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
        FROM (SELECT doc_id, string_split(replace(text, chr(0), ''), chr(10)) AS l FROM documents)) GROUP BY 1)"""


@register("normalized_text", "B1", with_ctes(NORMAL, select="""
SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM norm"""))
def normalized_text(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text")
    return st.normalize_text(docs).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5")
    )


PAGES = """pg AS (
  SELECT conv_id AS doc_id, turn, text, row_number() OVER w AS page,
    sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(text) - 2 AS start
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
spans AS (SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS "end", page FROM pg),
joined AS (SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS text_md5 FROM pg GROUP BY 1)"""


def conversation_pages(spark, folder):
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )


@register("joined_pages", "B2", with_ctes(PAGES, select="""
SELECT doc_id, page, start, "end", text_md5 FROM spans JOIN joined USING (doc_id)"""))
def joined_pages(spark, folder):
    joined = st.join_pages(conversation_pages(spark, folder))
    out = joined.select("doc_id", F.md5("text").alias("text_md5"), F.inline("spans"))
    return longs(out, "page", "start", "end")


@register("paper_metadata", "B3", with_ctes(PAPER, r"""l80 AS (
  SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> '')[1:80] AS lines,
    regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS stem FROM paper),
titled AS (
  SELECT *, coalesce(list_filter(lines[1:15], lambda l: NOT regexp_matches(lower(l), '^(doi|abstract|keywords|journal|source)')
      AND NOT regexp_matches(l, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b') AND length(l) >= 8)[1], stem) AS title,
    nullif(lower(regexp_replace(regexp_extract(text, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b'), '[.,;)\]}]+$', '')), '') AS doi FROM l80),
fields AS (
  SELECT *, lines[list_position(lines, title) + 1] AS second,
    trim(regexp_extract(list_filter(lines, lambda l: regexp_matches(l, '(?i)\b(?:journal|source)\s*[:\-]\s*(.+)$'))[1], '(?i)\b(?:journal|source)\s*[:\-]\s*(.+)$', 1)) AS journal,
    trim(regexp_extract(list_filter(lines, lambda l: regexp_matches(l, '(?i)\bkeywords?\s*[:\-]\s*(.+)$'))[1], '(?i)\bkeywords?\s*[:\-]\s*(.+)$', 1)) AS kw,
    trim(regexp_extract(list_filter(lines, lambda l: regexp_matches(l, '(?i)\bMeSH(?:\s+terms?)?\s*[:\-]\s*(.+)$'))[1], '(?i)\bMeSH(?:\s+terms?)?\s*[:\-]\s*(.+)$', 1)) AS mh
  FROM titled)""", select=r"""
SELECT doc_id, title, doi, journal, CAST(nullif(regexp_extract(text, '\b(19[5-9]\d|20[0-4]\d)\b', 1), '') AS BIGINT) AS year,
  CASE WHEN NOT regexp_matches(lower(second), '^(abstract|doi|journal|source)') AND regexp_matches(second, '[,;]| and ')
    THEN array_to_string(list_filter(list_transform(list_filter(string_split_regex(second, '\s*[;,]\s*|\s+\|\s+'), lambda t: trim(t) <> ''),
      lambda t: regexp_replace(trim(t), '\.+$', '')), lambda t: length(t) > 1), '|') ELSE '' END AS authors,
  array_to_string(list_transform(list_filter(string_split_regex(kw, '\s*[;,]\s*|\s+\|\s+'), lambda t: trim(t) <> ''), lambda t: regexp_replace(trim(t), '\.+$', '')), '|') AS keywords,
  array_to_string(list_transform(list_filter(string_split_regex(mh, '\s*[;,]\s*|\s+\|\s+'), lambda t: trim(t) <> ''), lambda t: regexp_replace(trim(t), '\.+$', '')), '|') AS mesh_terms,
  coalesce(doi, 'file:' || substr(sha256(path), 1, 16)) AS paper_id,
  coalesce(nullif(regexp_extract(stem, '^(PMC\d+)', 1), ''), 'PMID:' || nullif(regexp_extract(stem, '(?i)^PMID[_-]?(\d+)', 1), ''), doi, 'file:' || substr(sha256(path), 1, 16)) AS library_id
FROM fields"""))
def paper_metadata(spark, folder):
    papers = st.extract_papers(paper_texts(spark, folder))
    return papers.select(
        "doc_id", "title", "doi", "journal", F.col("year").cast("long").alias("year"),
        *[F.array_join(c, "|").alias(c) for c in ("authors", "keywords", "mesh_terms")],
        "paper_id", "library_id",
    )


MAIN_SQL = ", ".join(f"'{h}'" for h in st.MAIN_HEADINGS)
HEADINGS = r"""hl AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM paper)),
hoff AS (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS line_start,
    trim(line, ' ' || chr(9)) AS s FROM hl),
hlabel AS (
  SELECT *, trim(regexp_replace(s, ':+$', '')) AS label FROM hoff WHERE s <> ''),
hnum AS (
  SELECT *, regexp_extract(label, '^(\d+(?:\.\d+)*)\.?\s+(.+)$', 1) AS number,
    regexp_replace(trim(regexp_extract(label, '^(\d+(?:\.\d+)*)\.?\s+(.+)$', 2)), ':+$', '') AS tail,
    lower(trim(regexp_replace(trim(regexp_replace(label, '^:+|:+$', '', 'g')), '\s+', ' ', 'g'))) AS lkey,
    string_split_regex(trim(regexp_replace(label, '\s+', ' ', 'g')), ' ') AS words FROM hlabel),
hkind AS (
  SELECT *, (number <> '' AND tail <> '' AND len(string_split_regex(trim(tail), '\s+')) <= 14 AND NOT ends_with(tail, '.')) AS numbered,
    (lkey IN (""" + MAIN_SQL + r""")) AS main,
    (label <> '' AND len(words) <= 14 AND NOT ends_with(label, '.') AND NOT regexp_matches(lower(label), '^(doi|figure|fig\.|table|journal|keywords)')
      AND NOT regexp_matches(label, '[;,=±]') AND len(list_filter(words, lambda w: regexp_matches(w, '^\p{Lu}'))) >= greatest(1, len(words) // 2)) AS sub
  FROM hnum),
hcand AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n,
    line_start + instr(line, s) - 1 AS start, line_start + instr(line, s) - 1 + length(s) AS body_start,
    CASE WHEN numbered THEN least(length(number) - length(replace(number, '.', '')) + 1, 6) WHEN main THEN 1 END AS fixed_level,
    CASE WHEN numbered THEN tail ELSE label END AS heading FROM hkind WHERE numbered OR main OR sub),
hwalk AS (
  SELECT doc_id, 0::BIGINT AS n, []::STRUCT(l INT, h VARCHAR)[] AS stack, NULL::INT AS level, NULL::VARCHAR AS heading,
    NULL::BIGINT AS start, NULL::BIGINT AS body_start, []::VARCHAR[] AS parents FROM paper
  UNION ALL
  SELECT doc_id, n, CASE WHEN level IS NULL THEN stack
      WHEN lower(trim(heading)) IN ('references', 'bibliography') THEN list_filter(stack, lambda x: x.l < level)
      ELSE list_append(list_filter(stack, lambda x: x.l < level), {'l': level, 'h': heading}) END,
    level, heading, start, body_start, list_transform(list_filter(stack, lambda x: x.l < level), lambda x: x.h)
  FROM (SELECT c.doc_id, c.n, w.stack, c.heading, c.start::BIGINT AS start, c.body_start::BIGINT AS body_start,
          CAST(coalesce(c.fixed_level, CASE WHEN len(w.stack) > 0 THEN least(w.stack[len(w.stack)].l + 1, 6) END) AS INT) AS level
        FROM hwalk w JOIN hcand c ON c.doc_id = w.doc_id AND c.n = w.n + 1)),
headings AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n, heading, level::BIGINT AS level, start, body_start,
    array_to_string(list_append(parents, heading), ' > ') AS section_path, lower(trim(heading)) AS hkey
  FROM hwalk WHERE level IS NOT NULL)"""
BODIES = """raw_bodies AS (
  SELECT h.*, coalesce(lead(start) OVER (PARTITION BY h.doc_id ORDER BY n), length(text)) AS char_end, text AS full_text
  FROM headings h JOIN paper USING (doc_id)),
kinds AS (
  SELECT doc_id, n, CASE WHEN hkey IN ('abstract', 'summary') THEN 'abstract' WHEN hkey IN ('references', 'bibliography') THEN 'references' ELSE 'section' END AS kind,
    heading, level, section_path, body_start AS char_start, char_end,
    trim(substr(full_text, body_start + 1, char_end - body_start), ' ' || chr(10) || chr(9)) AS text FROM raw_bodies),
bodies AS (
  SELECT * FROM kinds
  UNION ALL
  SELECT doc_id, (SELECT count(*) FROM kinds k WHERE k.doc_id = p.doc_id), 'section', 'Full Text', 1, 'Full Text', 0, length(text), trim(text, ' ' || chr(10) || chr(9))
  FROM paper p WHERE trim(text, ' ' || chr(10) || chr(9)) <> '' AND NOT EXISTS (SELECT 1 FROM kinds k WHERE k.doc_id = p.doc_id AND k.kind = 'section'))"""


@register("headings", "B4", with_ctes(PAPER, HEADINGS, select="SELECT doc_id, n, heading, level, start, body_start FROM headings"))
def headings(spark, folder):
    return longs(st.detect_headings(paper_texts(spark, folder)), "n", "level", "start", "body_start")


@register("section_tree", "B5", with_ctes(PAPER, HEADINGS, select="SELECT doc_id, n, level, section_path FROM headings"))
def section_tree(spark, folder):
    out = st.section_tree(paper_texts(spark, folder)).select("doc_id", "n", "level", "section_path")
    return longs(out, "n", "level")


@register("section_bodies", "B6", with_ctes(PAPER, HEADINGS, BODIES, select="""
SELECT doc_id, n, kind, heading, section_path, char_start, char_end, md5(text) AS text_md5 FROM bodies"""))
def section_bodies(spark, folder):
    out = st.section_bodies(paper_texts(spark, folder)).select(
        "doc_id", "n", "kind", "heading", "section_path", "char_start", "char_end", F.md5("text").alias("text_md5")
    )
    return longs(out, "n", "char_start", "char_end")


@register("reference_list", "B7", with_ctes(PAPER, HEADINGS, BODIES, r"""rlines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, trim(unnest(l)) AS line FROM (
    SELECT doc_id, string_split(arg_max(text, n), chr(10)) AS l FROM bodies WHERE kind = 'references' GROUP BY 1)),
rgroups AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, '^(\[\d+\]|\d+\.|\d+\))\s+') OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 AS first FROM rlines WHERE line <> ''))""", select="""
SELECT doc_id, CAST(g - 1 AS BIGINT) AS n, string_agg(line, ' ' ORDER BY i) AS reference FROM rgroups GROUP BY 1, 2"""))
def reference_list(spark, folder):
    return longs(st.split_references(paper_texts(spark, folder)), "n")


def caption_ctes(kind: str, pattern: str) -> str:
    return f"""{kind}_m AS (
  SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', 1) AS lab,
    regexp_extract_all(text, '{pattern}', 2) AS cap, string_split_regex(text, '{pattern}') AS pieces FROM paper),
{kind}_x AS (
  SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS m, trim(unnest(lab)) AS label, trim(unnest(cap)) AS caption, unnest(pieces[1:len(m)]) AS piece FROM {kind}_m),
{kind}_s AS (
  SELECT *, CAST(sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS char_end FROM {kind}_x),
{kind} AS (SELECT doc_id, label, caption, char_end - length(m) AS char_start, char_end FROM {kind}_s WHERE length(caption) >= 8)"""


CAPTIONS = (
    caption_ctes("figs", r"(?i)\b(Fig(?:ure)?\.?\s*\d+[A-Za-z]?)[:.\s]+(.+)"),
    caption_ctes("tabs", r"(?i)\b(Table\s*\d+[A-Za-z]?)[:.\s]+(.+)"),
)


@register("captions", "B8", with_ctes(PAPER, *CAPTIONS, select="""
SELECT doc_id, 'figure' AS kind, label, caption, char_start, char_end FROM figs
UNION ALL SELECT doc_id, 'table', label, caption, char_start, char_end FROM tabs"""))
def captions(spark, folder):
    return longs(st.extract_captions(paper_texts(spark, folder)), "char_start", "char_end")


@register("page_of_offset", "B9", with_ctes(PAGES, """items AS (
  SELECT doc_id, 'end-' || page AS item_id, "end" AS "offset" FROM spans UNION ALL SELECT doc_id, 'gap-' || page, "end" + 1 FROM spans
  UNION ALL SELECT doc_id, 'mid-' || page, (start + "end") // 2 FROM spans)""", select="""
SELECT i.doc_id, item_id, "offset", coalesce(min(CASE WHEN "offset" BETWEEN s.start AND s."end" THEN page END), max(page)) AS page
FROM items i JOIN spans s USING (doc_id) GROUP BY ALL"""))
def page_of_offset(spark, folder):
    spans = st.page_spans(st.join_pages(conversation_pages(spark, folder)))

    def item(kind, offset):
        return spans.select(
            "doc_id", F.concat(F.lit(f"{kind}-"), F.col("page").cast("string")).alias("item_id"), offset.alias("offset")
        )

    items = item("end", F.col("end")).unionByName(item("gap", F.col("end") + 1)).unionByName(
        item("mid", F.floor((F.col("start") + F.col("end")) / 2).cast("int"))
    )
    return longs(st.page_for_offset(items, spans), "offset", "page")


def split_ctes(source: str, size: int = 1500, overlap: int = 200) -> str:
    """Recursive twin of the overlapping split over ``source(k, t)`` with trimmed texts."""
    marks = [r"\n\n", r"\n", r"\. ", "; ", ", "]
    tests = " ".join(
        f"WHEN length(w) > 0 AND regexp_matches(w, '(?s)^.*{m}') AND length(regexp_extract(w, '(?s)^(.*){m}', 1)) >= greatest(80, length(w) // 2) "
        f"THEN a + length(regexp_extract(w, '(?s)^(.*){m}', 1)) + {n}"
        for m, n in zip(marks, (2, 1, 2, 2, 2))
    )
    ws = "' ' || chr(10) || chr(9)"
    return f"""cutter AS (
  SELECT k, t, 0::BIGINT AS nxt, NULL::BIGINT AS lo, NULL::BIGINT AS hi, false AS done FROM {source} WHERE t <> ''
  UNION ALL
  SELECT k, t, greatest(hi - {overlap}, a + 1), lo, hi, stop >= length(t) FROM (
    SELECT k, t, a, stop, stop - length(ltrim(substr(t, a + 1, stop - a), {ws})) AS lo, a + length(rtrim(substr(t, a + 1, stop - a), {ws})) AS hi FROM (
      SELECT k, t, a, CASE WHEN length(t) <= {size} THEN length(t) WHEN a + {size} >= length(t) THEN length(t) {tests} ELSE a + {size} END AS stop FROM (
        SELECT k, t, nxt AS a, substr(t, nxt + 1, {size}) AS w FROM cutter WHERE NOT done)))),
cuts AS (SELECT k, lo, hi, substr(t, lo + 1, hi - lo) AS piece FROM cutter WHERE lo < hi)"""


@register("overlapping_split", "B10", with_ctes(
    "src AS (SELECT doc_id AS k, trim(text, ' ' || chr(10) || chr(9)) AS t FROM documents)", split_ctes("src"),
    select="SELECT k AS doc_id, lo AS piece_start, hi AS piece_end, md5(piece) AS piece_md5 FROM cuts"))
def overlapping_split(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text")
    out = st.split_text(docs).select("doc_id", "piece_start", "piece_end", F.md5("piece").alias("piece_md5"))
    return longs(out, "piece_start", "piece_end")


CHUNKS = (PAPER, HEADINGS, BODIES, *CAPTIONS,
    "src AS (SELECT {'d': doc_id, 'n': n} AS k, text AS t FROM bodies WHERE kind = 'section')", split_ctes("src"),
    r"""pid AS (
  SELECT doc_id, path, text, coalesce(nullif(lower(regexp_replace(regexp_extract(text, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b'), '[.,;)\]}]+$', '')), ''),
    'file:' || substr(sha256(path), 1, 16)) AS paper_id FROM paper),
abstracts AS (SELECT doc_id, arg_max(text, n) AS a FROM bodies WHERE kind = 'abstract' GROUP BY 1),
parts AS (
  SELECT b.doc_id, 'text' AS chunk_type, b.section_path, b.char_start + lo AS char_start, b.char_start + hi AS char_end, piece AS text
  FROM cuts c JOIN bodies b ON b.doc_id = c.k.d AND b.n = c.k.n
  UNION ALL SELECT doc_id, 'figure', label, char_start, char_end, caption FROM figs
  UNION ALL SELECT doc_id, 'table', label, char_start, char_end, caption FROM tabs
  UNION ALL SELECT doc_id, 'abstract', 'Abstract', greatest(instr(p.text, a) - 1, 0), greatest(instr(p.text, a) - 1, 0) + length(a), a
  FROM abstracts JOIN paper p USING (doc_id) WHERE a <> ''),
chunks AS (
  SELECT doc_id, paper_id, path, 'chunk:' || substr(sha256(concat_ws('|', paper_id, section_path, chunk_type, char_start, char_end, x.text)), 1, 20) AS chunk_id,
    section_path, chunk_type, char_start, char_end, x.text AS text FROM parts x JOIN pid USING (doc_id))""")


@register("paper_chunks", "B11", with_ctes(*CHUNKS, select="""
SELECT doc_id, paper_id, section_path, chunk_type, char_start, char_end, md5(text) AS text_md5 FROM chunks"""))
def paper_chunks(spark, folder):
    out = st.chunk_papers(paper_texts(spark, folder)).select(
        "doc_id", "paper_id", "section_path", "chunk_type", "char_start", "char_end", F.md5("text").alias("text_md5")
    )
    return longs(out, "char_start", "char_end")


@register("chunk_ids", "B12", with_ctes(*CHUNKS, select="SELECT doc_id, chunk_id, char_start FROM chunks"))
def chunk_ids(spark, folder):
    out = st.chunk_papers(paper_texts(spark, folder)).select("doc_id", "chunk_id", "char_start")
    return longs(out, "char_start")


@register("ingest_summary", "B13", with_ctes(*CHUNKS, select="""
SELECT c.paper_id, 'Study of ' || any_value(source) || ' number ' || c.doc_id AS title, c.path AS source_path, count(*) AS chunk_count,
  count(*) FILTER (chunk_type = 'abstract') AS abstract_chunks, count(*) FILTER (chunk_type = 'text') AS text_chunks,
  count(*) FILTER (chunk_type = 'figure') AS figure_chunks, count(*) FILTER (chunk_type = 'table') AS table_chunks,
  count(*) FILTER (chunk_type = 'equation') AS equation_chunks, CAST(sum(length(c.text)) AS BIGINT) AS chunk_chars
FROM chunks c JOIN documents USING (doc_id) GROUP BY c.doc_id, c.paper_id, c.path"""))
def ingest_summary(spark, folder):
    return st.ingest_summary(st.chunk_papers(paper_texts(spark, folder)))
