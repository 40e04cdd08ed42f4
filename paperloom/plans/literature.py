"""Cross-source literature search over landed payloads, as one plan for all questions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paperloom.operators import literature as lit


def literature_candidates(payloads: DataFrame, queries: DataFrame, start: str, end: str) -> DataFrame:
    """All sources of ``payloads(source, query_id, payload)`` as scored candidates."""

    def of(source: str) -> DataFrame:
        return payloads.where(payloads["source"] == source)

    preprints = lit.filter_preprints(lit.parse_preprints(of("biorxiv")), queries, start, end)
    return lit.score_candidates(
        [
            lit.parse_pubmed_search(of("pubmed")),
            lit.parse_s2(of("semantic_scholar")),
            lit.parse_europe_pmc(of("europe_pmc")),
            lit.preprint_results(preprints),
        ]
    )


def hydrated_papers(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Dedupe, fill from articles, and dedupe again because filled rows get new keys."""
    first = lit.dedupe_papers(candidates)
    filled = lit.hydrate(first, articles)
    again = filled.drop("index", "first_index").withColumnRenamed("position", "index")
    return lit.dedupe_papers(again)


def literature_search(
    payloads: DataFrame, queries: DataFrame, articles: DataFrame, annotations: DataFrame, start: str, end: str
) -> DataFrame:
    """Scored, deduplicated and annotated chunks per question."""
    papers = hydrated_papers(literature_candidates(payloads, queries, start, end), articles)
    return lit.score_abstracts(queries, lit.attach_annotations(papers, annotations))
