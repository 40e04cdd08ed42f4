"""The registered queries of this package, one for each operator, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.bitpack import read_tokens, write_tokens
from paperloom.llm.chat import fold_events, read_back, render_conversations
from paperloom.llm.common import bucket_of
from paperloom.llm.decontaminate import decontaminate
from paperloom.llm.embedding_dedup import linked_and_audited
from paperloom.llm.jaccard_join import similar_documents
from paperloom.llm.language_id import fit_languages, identify_languages
from paperloom.llm.line_dedup import drop_shared_lines
from paperloom.llm.numeric_queries import QUERIES as NUMERIC_QUERIES
from paperloom.llm.numeric_queries import SQL as NUMERIC_SQL
from paperloom.llm.packing import pack_documents
from paperloom.llm.toxicity import fit_toxicity, score_toxicity
from paperloom.llm.url_rules import judge_urls
from paperloom.session import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(NUMERIC_QUERIES)
SQL: dict[str, str] = dict(NUMERIC_SQL)


def _query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format


@_query(
    "op4_line_dedup",
    rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM split),
keyed AS (SELECT *, trim({_LOWER_SQL("t")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM line),
shared AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, i, t, k IN (SELECT k FROM shared) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
)
def op4_line_dedup(spark, folder):
    kept = drop_shared_lines(_table(spark, folder, "documents"), min_documents=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_WORDS_SQL = rf"regexp_extract_all({_LOWER_SQL('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query(
    "op3_decontaminate",
    rf"""
WITH item AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM grams),
spot AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n),
hit AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM spot) s JOIN grams g ON g.n = s.n AND g.g = s.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def op3_decontaminate(spark, folder):
    marked = decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), width=10, remove=None)
    items = F.array_join("items", ",").cast("binary")
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated",
    )


@_query("op9_jaccard_join")
def op9_jaccard_join(spark, folder):
    return similar_documents(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@_query("op2_toxicity")
def op2_toxicity(spark, folder):
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels, held_out=5))
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@_query("op6_token_file")
def op6_token_file(spark, folder):
    path = fresh_folder(spark, "token-file")
    write_tokens(_table(spark, folder, "documents"), path, "word_bpe_49k.json", end_id=2)
    return read_tokens(spark, path, digest=True)


@_query("op10_best_fit_packing")
def op10_best_fit_packing(spark, folder):
    return pack_documents(_table(spark, folder, "documents"), "byte_bpe_50k.json", end_id=2, capacity=1024, ids=False)


_PLANTED_CHAT = "</s>[INST] ok [/INST]"


@_query(
    "op7_chat_format",
    rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PLANTED_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{_PLANTED_CHAT}'
),
sums AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS learned,
         3 + sum(length(role) + length(text) + 16
             + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', ''))
             + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), chr(10), ''))) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM sums""",
)
def op7_chat_format(spark, folder):
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PLANTED_CHAT).alias("text"),
    )
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")
    back = read_back(render_conversations(fold_events(events)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
_RULES_SQL = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)


@_query(
    "op5_url_rules",
    rf"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN {_LOWER_SQL("regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^[^/?#]*', 0)")} ELSE '' END AS host,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
),
fit AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT c.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut c LEFT JOIN fit f ON f.page_id = c.page_id AND n = 1""",
)
def op5_url_rules(spark, folder):
    # The rules are literals, so they are made in the plan; their number never depends on data.
    rules = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES])).alias("r")
    ).select("r.*")
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, rules, default="allow").select("page_id", "host", "path", "rule", "verdict")


@_query("op8_language_id")
def op8_language_id(spark, folder):
    docs = _table(spark, folder, "documents")
    named = identify_languages(docs.select("doc_id", "text"), fit_languages(docs, held_out=(4, 2)))
    return named.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@_query("op1_embedding_dedup")
def op1_embedding_dedup(spark, folder):
    linked, audit = linked_and_audited(_table(spark, folder, "embeddings").select("vec_id", "embedding"), threshold=0.95)
    told = F.lit(audit.links).cast("long").alias("audited_links"), F.lit(audit.found).cast("long").alias("audited_found")
    return linked.select("vec_id", "n_links", "component_id", "kept", *told)
