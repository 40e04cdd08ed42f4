"""Questions to cited, audited answers as one batch plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators import answers as qa
from paperloom.operators import literature as lit
from paperloom.session import materialize


class FoundAnswers(NamedTuple):
    """What every stage of the whole pipeline gives."""

    classified: DataFrame
    sub_queries: DataFrame
    local: DataFrame
    web: DataFrame
    entities: DataFrame
    context: DataFrame
    evidence: DataFrame
    claims: DataFrame
    contradictions: DataFrame
    answers: DataFrame
    audit: DataFrame
    sources: DataFrame


# Sub-question n of a question is asked under the number 10 * query_id + n; there are six at most.
SUBS = 10


def search_and_answer(
    queries: DataFrame,
    local_search: Callable[[DataFrame], DataFrame],
    literature_search: Callable[[DataFrame], DataFrame],
    summaries: DataFrame,
    known: DataFrame,
    definitions: dict[str, str] | None = None,
    rules=qa.CONTROVERSIES,
    all_specialists: bool = True,
) -> FoundAnswers:
    """Questions ``(query_id, query_text)`` to cited, audited answers, sub-questions and literature search included.

    Questions are classified and fan out to sub-questions. The questions go to
    ``local_search``, the sub-questions ``(query_id, query_text)`` to ``literature_search``, whose scored chunks come
    together again, the best one a paper. Entities, graph context, evidence, claims and
    contradictions follow; answers are assembled and audited. Only answers that fail the
    audit are assembled a second time, with the repair note, and that is the last time, as their citations would fail again.

    Rankings, literature and evidence feed several stages each, so they are stored once.
    """
    classified = qa.classify_queries(queries)
    subs = materialize(qa.plan_sub_queries(classified), "sub-queries")
    asked = subs.select((F.col("query_id") * SUBS + F.col("sub_id")).alias("query_id"), F.col("sub_query").alias("query_text"))
    local = materialize(local_search(queries), "local")
    found = literature_search(asked).withColumnRenamed("query_id", "sub_id")
    web = materialize(lit.to_ranked(lit.merge_subquery_results(found.withColumn("query_id", F.expr(f"sub_id div {SUBS}")))).drop("annotations"), "web")
    context = qa.kg_context(queries, summaries)
    evidence = materialize(qa.fuse_evidence(queries, local, web, context, None if all_specialists else classified), "evidence")
    contradictions = materialize(qa.evidence_contradictions(queries, evidence, rules), "contradictions")
    items = [qa.filter_evidence(queries, qa.collect_evidence_items(chunks)) for chunks in (local, web)]
    counts = evidence.groupBy("query_id").agg(F.count("*").alias("n"))

    def assembled(rows: DataFrame, retry=None) -> DataFrame:
        return qa.assemble_answers(rows, *items, context, contradictions, counts, definitions, retry)

    first = materialize(assembled(queries), "answers")
    audit = materialize(qa.audit_answers(first, known, contradictions), "audit")
    failed = audit.where("retry").select("query_id")
    repaired = assembled(queries.join(failed, "query_id", "left_semi"), F.lit(True))
    answers = first.join(failed, "query_id", "left_anti").unionByName(repaired)
    return FoundAnswers(
        classified, subs, local, web, qa.question_entities(queries, local, web), context, evidence, qa.extract_claims(evidence), contradictions, answers, audit,
        qa.source_papers(web, local),
    )


class AnswerTables(NamedTuple):
    classified: DataFrame
    context: DataFrame
    evidence: DataFrame
    contradictions: DataFrame
    answers: DataFrame
    audit: DataFrame
    sources: DataFrame


def answer_questions(
    queries: DataFrame,
    local: DataFrame,
    web: DataFrame,
    summaries: DataFrame,
    known: DataFrame,
    definitions: dict[str, str] | None = None,
    rules=qa.CONTROVERSIES,
    all_specialists: bool = True,
    kept: Callable[[Column], Column] = qa.text_as_is,
) -> AnswerTables:
    """Every stage for a table of questions. ``local`` and ``web`` may be scored already, with ``kept`` of their texts (``qa.with_scored_texts``).

    Evidence feeds four later stages, so it is written once to the shared folder; all
    other stages stay in one plan. An answer whose citations fail the audit is assembled
    again with the repair note, as the bounded repair pass does.
    """
    local, web = materialize(local, "local"), materialize(web, "web")
    classified = qa.classify_queries(queries)
    context = qa.kg_context(queries, summaries)
    evidence = materialize(
        qa.fuse_evidence(queries, local, web, context, None if all_specialists else classified, kept), "evidence"
    )
    contradictions = qa.evidence_contradictions(queries, evidence, rules)
    items = [qa.filter_evidence(queries, qa.collect_evidence_items(chunks)) for chunks in (local, web)]
    counts = evidence.groupBy("query_id").agg(F.count("*").alias("n"))

    def assembled(rows: DataFrame, retry=None) -> DataFrame:
        return qa.assemble_answers(rows, *items, context, contradictions, counts, definitions, retry)

    first = materialize(assembled(queries), "answers")
    audit = qa.audit_answers(first, known, contradictions)
    note = F.when(F.col("retry"), F.lit(qa.RETRY_NOTE)).otherwise("")
    final = first.join(audit.select("query_id", "retry"), "query_id").select(
        "query_id", F.concat("answer", note).alias("answer")
    )
    return AnswerTables(classified, context, evidence, contradictions, final, audit, qa.source_papers(web, local))
