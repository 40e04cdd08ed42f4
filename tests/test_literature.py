import json
import random

import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions import vectors as vx
from paperloom.operators import literature as lit
from paperloom.plans.literature import hydrated_papers


def payloads(spark, *bodies):
    return spark.createDataFrame([(n, b if isinstance(b, str) else json.dumps(b)) for n, b in enumerate(bodies)], "query_id long, payload string")


def test_search_answers(spark):
    found = lit.parse_pubmed_search(payloads(spark, {"esearchresult": {"idlist": ["1", "2"]}}, {"esearchresult": {}}, "[]")).collect()
    assert [(r.query_id, r.pos, r.pmid) for r in found] == [(0, 0, "1"), (0, 1, "2")]
    s2 = {"paperId": "p", "title": "T", "abstract": None, "year": 2020, "citationCount": 7, "externalIds": {"DOI": "10.1/X", "PMID": 5, "MAG": None}}
    row = lit.parse_s2(payloads(spark, {"data": [s2]})).first()
    assert (row.doi, row.pmid, row.year, row.citation_count, row.abstract) == ("10.1/X", "5", 2020, 7, "")
    assert lit.parse_s2(payloads(spark, {"data": [s2]}), (2021, 2022)).count() == 0
    assert lit.parse_s2(payloads(spark, {"data": [{"citingPaper": s2}, {"citingPaper": None}]}), inside="citingPaper").count() == 1
    epmc = {"resultList": {"result": [{"id": "77", "title": "T", "pubYear": "x", "doi": ""}]}}
    row = lit.parse_europe_pmc(payloads(spark, epmc)).first()
    assert (row.pmid, row.doi, row.year) == ("77", None, None)


def test_links_and_articles(spark):
    body = json.dumps({"linksets": [{"linksetdbs": [{"links": ["3", "4", "3"]}]}]})
    rows = spark.createDataFrame([("1", [body, "{}", body])], "pmid string, payloads array<string>")
    assert [r.linked_pmid for r in lit.parse_citation_links(rows).orderBy("pos").collect()] == ["3", "4"]
    xml = (
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>9</PMID><Article><Journal><Title> J </Title><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue></Journal>"
        "<ArticleTitle>On X</ArticleTitle><Abstract><AbstractText>One.</AbstractText><AbstractText Label='B'>Two.</AbstractText></Abstract>"
        "<AuthorList><Author><ForeName>Ada</ForeName><LastName>L</LastName></Author></AuthorList></Article></MedlineCitation>"
        "<PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/z</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"
    )
    rows = spark.createDataFrame([("9", xml), ("8", "<PubmedArticleSet></PubmedArticleSet>")], "pmid string, payload string")
    full, bare = lit.parse_articles(rows).collect()
    assert (full.title, full.abstract, full.journal, full.year, full.doi, full.authors) == ("On X", "One. Two.", "J", 2019, "10.1/z", ["Ada L"])
    assert (bare.pmid, bare.title, bare.abstract, bare.authors) == ("8", "", "", [])


def test_annotations_both_layouts(spark):
    document = {"id": "5", "passages": [{"annotations": [{"text": "ND4", "infons": {"biotype": "Gene"}, "locations": [{"offset": 4, "length": 3}]}, {"text": "x", "infons": {"type": "T", "identifier": "i"}}]}]}
    for body in ({"documents": [document]}, [document]):
        a, b = lit.flatten_annotations(payloads(spark, body)).orderBy("n").collect()
        assert (a.entity_type, a.start, a.end, a.identifier) == ("Gene", 4, 7, None) and (b.entity_type, b.start, b.identifier) == ("T", None, "i")


def test_preprints_fall_back_to_all(spark):
    items = [{"doi": f"10.1/{n}", "title": "alpha" if n == 3 else "beta", "date": "2024-05-01"} for n in range(30)]
    rows = lit.parse_preprints(payloads(spark, {"collection": items}))
    ask = lambda q: spark.createDataFrame([(0, q)], "query_id long, query_text string")
    assert [r.pos for r in lit.filter_preprints(rows, ask("ALPHA zz"), "2024-01-01", "2024-12-31").collect()] == [3]
    assert lit.filter_preprints(rows, ask("nothing"), "2024-01-01", "2024-12-31").count() == 20
    assert lit.filter_preprints(rows, ask("beta"), "2023-01-01", "2023-12-31").count() == 0


def test_dedupe_prefers_best_and_rededupes_after_hydration(spark):
    pubmed = lit.parse_pubmed_search(payloads(spark, {"esearchresult": {"idlist": ["1", "2"]}}))
    s2 = lit.parse_s2(payloads(spark, {"data": [{"paperId": "p", "title": "T", "abstract": "A", "citationCount": 5000, "externalIds": {"DOI": "10.1/A"}}]}))
    epmc = lit.parse_europe_pmc(payloads(spark, {"resultList": {"result": [{"id": "e", "title": "E", "pmid": "2", "doi": "10.1/a"}]}}))
    cand = lit.score_candidates([pubmed, s2, epmc])
    first = {r.key: r for r in lit.dedupe_papers(cand).collect()}
    assert set(first) == {"pmid:1", "pmid:2", "doi:10.1/a"} and first["doi:10.1/a"].source == "semantic_scholar" and first["doi:10.1/a"].position == 1
    articles = spark.createDataFrame([("2", "full", "text", "10.1/A", 2020)], "pmid string, title string, abstract string, doi string, year int")
    final = {r.key: r.source for r in hydrated_papers(cand, articles).collect()}
    assert final == {"pmid:1": "pubmed", "doi:10.1/a": "semantic_scholar"}


def test_freshness(spark):
    schema = "request_key string, fetched_at timestamp_ntz, payload string"
    rows = spark.sql("SELECT 'a' request_key, TIMESTAMP_NTZ '2024-01-09 00:00:00' fetched_at, 'old' payload UNION ALL SELECT 'a', TIMESTAMP_NTZ '2024-01-10 00:00:00', 'new' UNION ALL SELECT 'b', TIMESTAMP_NTZ '2024-01-01 00:00:00', 'stale'")
    assert schema and {(r.request_key, r.payload, r.refetch) for r in lit.fresh_payloads(rows, rows, "2024-01-10 12:00:00", 7 * 86400).collect()} == {("a", "new", False), ("b", None, True)}


def test_pacing_equals_a_sequential_limiter_also_for_one_hot_client(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), n, rng.randint(0, 40_000_000)) for n in range(800)]
    log = spark.createDataFrame(rows, "client long, request_id long, at long")
    expected, last = {}, {}
    for client, request, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        granted = at if client not in last else max(at, last[client] + 1_000_000 / 3)
        last[client] = expected[request] = granted
    for r in lit.pace_requests(log, 3.0, bucket_micros=1_000_000).collect():
        assert abs(r.granted_at - expected[r.request_id]) < 1e-3 and r.wait >= -1e-3


def test_manifest_change_counts_duplicates(spark):
    items = spark.createDataFrame([("1", None, "", " Title. ", "2020", "J", " Ada B, C", "MED")] * 2, "pmid string, pmcid string, doi string, title string, pubYear string, journalTitle string, authorString string, source string")
    rows = lit.normalize_manifest(items)
    first = rows.first()
    assert (first.title, first.first_author, first.doi) == ("Title", "Ada B", None)
    assert lit.refresh_manifest(rows, rows)[1].first().changed is False
    assert lit.refresh_manifest(rows, rows.limit(1))[1].first().changed is True


def test_texts_are_compared_a_few_rows_at_a_time(spark, monkeypatch):
    """The cosine of two texts is that of their buckets, and a batch of any size never becomes one matrix."""
    texts = ["", None, "a", "a bb a bb", "x-y Ünit KELVIN Kelvin", "bb a a bb c"] * 50
    pairs = [(n, t, texts[(n * 7 + 3) % len(texts)]) for n, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "n long, l string, r string")
    rows = df.select("n", vx.buckets(F.col("l"), "s").alias("l"), vx.buckets(F.col("r"), "s").alias("r")).orderBy("n").toPandas()
    want = (vx.count_matrix(rows["l"], vx.DIMENSION) * vx.count_matrix(rows["r"], vx.DIMENSION)).sum(axis=1)
    assert [r.x for r in df.select("n", vx.text_cosine("s")("l", "r").alias("x")).orderBy("n").collect()] == want.tolist()
    seen, own = [], vx._unit_rows
    monkeypatch.setattr(vx, "_unit_rows", lambda counts: seen.append(len(counts)) or own(counts))
    monkeypatch.setattr(vx, "ROWS_AT_ONCE", 16)
    sides = [pd.Series([p[i] for p in pairs]) for i in (1, 2)]
    assert vx.text_cosine("s").func(*sides).tolist() == want.tolist() and max(seen) <= 16


def test_unasked_texts_are_not_moved(spark):
    """Merging sub-questions for their ranks alone shuffles no text."""
    schema = "sub_id long, query_id long, rank int, score double, doi string, pmid string, chunk_id string, text string"
    rows = spark.createDataFrame([(0, 0, 1, 0.5, "10.1/A", None, "c1", "long"), (1, 0, 1, 0.9, "10.1/a", None, "c2", "other"), (1, 0, 2, 0.9, None, "7", "c3", "third")], schema)
    merged = lit.merge_subquery_results(rows)
    assert [(r.chunk_id, r.rank) for r in merged.orderBy("rank").collect()] == [("c2", 1), ("c3", 2)]
    plan = merged.select("query_id", "chunk_id", "rank")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.split("LogicalRDD")[0]
