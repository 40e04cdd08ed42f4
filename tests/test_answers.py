from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import answers as qa
from paperloom.plans.answers import answer_questions, search_and_answer

CHUNK = "query_id long, doc_id string, text string, paper_id string, section_path string, score double, rank int, citation string, title string, source_api string, year string"


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def chunks(spark, *rows):
    return spark.createDataFrame(
        [(q, i, t, p, "Body", s, r, c, "", "", "") for q, i, t, p, s, r, c in rows], CHUNK
    )


LOCAL = (
    (0, "l1", "Complex I contains 45 subunits, including seven ND subunits.", "PMID:33174596", 0.97, 1, "[PMID:33174596]"),
    (0, "l2", "One disputed model proposes the mPTP is formed by ATP synthase dimers. More text.", "PMID:37336870", 0.88, 2, "[PMID:37336870]"),
    (0, "l3", "Contradictory synthase-null evidence supports non-ATP-synthase mPTP opening.", "PMID:37607939", 0.87, 3, "[PMID:37607939]"),
)
WEB = ((0, "w1", "Idebenone is approved in Europe for patients with LHON.", "PMID:26988832", 0.81, 1, "[PMID:26988832]"),)
SUMMARIES = [("controversy", "mPTP hypotheses are modeled as contradictory."), ("pathway_members", "KG context.")]


def test_types_routes_and_plans(spark):
    rows = qa.classify_queries(ask(
        spark, "What is ATP?", "Which disease does this cause?", "Is there a drug?", "How does PINK1 work?", "recent papers", "Which assay?", "network of excited states"
    ))
    got = [(r.query_type, r.route) for r in rows.orderBy("query_id").collect()]
    assert got == [
        ("factual", "direct"), ("disease", "disease"), ("therapeutics", "disease"), ("mechanistic", "mitophysiology"), ("citation", "direct"), ("methods", "direct"), ("citation", "direct"),
    ]
    bounded = qa.classify_queries(ask(spark, "network of excited states"), bounded=True).first()
    assert bounded.query_type == "factual"
    sizes = [r["count"] for r in qa.plan_sub_queries(rows).groupBy("query_id").count().collect()]
    assert all(3 <= n <= 7 for n in sizes)
    assert qa.plan_sub_queries(qa.classify_queries(ask(spark, " Why?? "))).orderBy("sub_id").first().sub_query == "Why mechanism molecular basis"


def run(spark, question, local=LOCAL, web=WEB, known=("33174596", "37336870", "37607939", "26988832", "12345678", "20510199", "25613900"), definitions=None):
    pmids = spark.createDataFrame([(k,) for k in known], "pmid string")
    summaries = spark.createDataFrame(SUMMARIES, "topic string, summary string")
    return answer_questions(ask(spark, question), chunks(spark, *local), chunks(spark, *web), summaries, pmids, definitions)


def test_answer_with_controversy(spark):
    out = run(spark, "What forms the mPTP?")
    answer = out.answers.first().answer
    assert answer.startswith("**Source: local PDFs + web fallback.** 2 local passages found")
    assert "**Open questions and contradictions.**" in answer and "**Knowledge graph grounding.** mPTP hypotheses" in answer
    assert answer.count("[PMID:") >= 3 and "**Clinical" not in answer
    audit = out.audit.first()
    assert audit.citations_valid and audit.confidence == 0.62 and not audit.retry
    evidence = {r.evidence_id: r.score for r in out.evidence.collect()}
    assert evidence["kg-subgraph"] == 0.99 and {"specialist-mitophysiology", "specialist-disease-therapeutics"} <= set(evidence)
    sources = out.sources.orderBy("rank").collect()
    assert [r.citation for r in sources] == ["[PMID:33174596]", "[PMID:37336870]", "[PMID:37607939]", "[PMID:26988832]"]
    assert sources[0].url == "https://pubmed.ncbi.nlm.nih.gov/33174596/" and sources[0].source == "local_chunks"


def test_unknown_citation_is_repaired_once(spark):
    out = run(spark, "What is Complex I?", known=("33174596",))
    assert out.audit.first().retry and out.answers.first().answer.endswith(qa.RETRY_NOTE)


def test_fallback_and_definition(spark):
    empty = spark.createDataFrame([], CHUNK)
    none = spark.createDataFrame([], "query_id long, summary string, n long, rule int, claim string, items array<struct<citation:string,title:string,snippet:string>>")
    args = (none, none, none, none, none)
    assert qa.assemble_answers(ask(spark, "Why?"), *args).first().answer == qa.FALLBACK % "Why"
    known = {"what is x": "X is a letter.", "what are x": "REUSE:what is x"}
    assert qa.assemble_answers(ask(spark, "What are X?"), *args, definitions=known).first().answer == "**Answering: What are X**\n\nX is a letter."
    assert empty.count() == 0


def test_kg_row_alone_when_nothing_was_found(spark):
    empty = spark.createDataFrame([], CHUNK)
    context = spark.createDataFrame([(0, "t", "summary")], "query_id long, topic string, summary string")
    ids = {r.evidence_id for r in qa.fuse_evidence(ask(spark, "q"), empty, empty, context).collect()}
    assert ids == {"kg-subgraph", "specialist-mitophysiology", "specialist-disease-therapeutics"}
    routed = spark.createDataFrame([(0, "disease")], "query_id long, route string")
    ids = {r.evidence_id for r in qa.fuse_evidence(ask(spark, "q"), empty, empty, context, routed).collect()}
    assert ids == {"kg-subgraph", "specialist-disease-therapeutics"}


def test_texts_of_a_question_meet_once(spark):
    """One join, with the words asked; ranks are windows over it, so no text is joined back to its rank."""
    context = spark.createDataFrame([(0, "t", "summary")], "query_id long, topic string, summary string")
    out = qa.fuse_evidence(ask(spark, "Complex I subunits of mPTP"), chunks(spark, *LOCAL), chunks(spark, *WEB), context)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    rows = {r.evidence_id: r for r in out.collect()}
    assert set(rows) == {"l1", "l2", "l3", "w1", "kg-subgraph", "specialist-mitophysiology", "specialist-disease-therapeutics"}
    assert rows["kg-subgraph"].paper_id == "PMID:33174596" and sorted(r.rank for r in rows.values()) == list(range(1, 8))


def test_texts_are_cut_to_what_can_hold_a_name(spark):
    texts = ["x" * 500 + " Complex", "I " + "y" * 500 + " mt-nd4 " + "z" * 500 + " pin", None, "k1", "", "Parkin"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", qa._named_part(F.col("text")).alias("part"))
    parts = [r.part for r in rows.orderBy("i").collect()]
    assert all(part is None or len(part) < 60 for part in parts) and parts[2] is None and parts[4:] == ["", "Parkin"]
    local = chunks(spark, *[(0, f"l{i}", t, "p", 1.0, i, "c") for i, t in enumerate(texts[:3])])
    web = chunks(spark, (0, "w", "idebeno", "p", 1.0, 1, "c"), (0, "v", "ne", "p", 1.0, 2, "c"))
    found = qa.question_entities(ask(spark, "q"), local, web)
    assert {r.mention for r in found.collect()} == {"Complex I", "MT-ND4"}


def test_claims_and_entities(spark):
    rows = spark.createDataFrame([(0, "e1", " The m.3243A>G variant. More", 1.5, 1), (0, "e2", " . x", 0.1, 2), (0, "e3", "Low", 0.1, 3)], "query_id long, evidence_id string, text string, score double, rank int")
    assert [(r.claim, r.confidence) for r in qa.extract_claims(rows).orderBy("rank").collect()] == [("The m", 0.95), ("Low", 0.3)]
    assert qa.extract_claims(rows, whole_sentences=True).orderBy("rank").first().claim == "The m.3243A>G variant."
    found = qa.question_entities(ask(spark, "PINK1 and idebenone?"), chunks(spark, *LOCAL), chunks(spark, *WEB))
    assert {r.normalized_id for r in found.collect()} == {"PINK1", "DB09081", "Complex I", "mPTP"}


def test_citation_forms(spark):
    df = spark.createDataFrame([(0, "a [doi:10.1000/x] b [PMID:12345] c [PMID:12] [DOI:10.1000/Y(1)]")], "query_id long, answer string")
    assert [r.value for r in qa.extract_citations(df).orderBy("n").collect()] == ["12345", "10.1000/x", "10.1000/Y(1)"]
    known = spark.createDataFrame([("12345",)], "pmid string")
    reasons = [r.reason for r in qa.audit_citations(qa.extract_citations(df, lenient=True), known).orderBy("n").collect()]
    assert reasons == ["", "invalid PMID format", "", ""]
    audit = qa.audit_answers(df, known, df.limit(0)).first()
    assert (audit.citations, audit.invalid, audit.citations_valid, audit.confidence) == (3, 0, True, 0.86)
    assert F is not None


def test_the_whole_pipeline_repairs_only_answers_that_fail(spark):
    queries = spark.createDataFrame([(1, "Which drug treats MELAS?"), (2, "What recent papers cover fusion?"), (3, "nothing found")], "query_id long, query_text string")
    chunk = "query_id long, doc_id string, text string, paper_id string, section_path string, score double, rank int, citation string, title string, source_api string, year string"
    local = spark.createDataFrame(
        [(1, "a", "Idebenone treats MELAS well.", "PMID:111111", "Body", 1.0, 1, "[PMID:111111]", "", "", ""), (2, "b", "OPA1 drives fusion.", "PMID:222222", "Body", 1.0, 1, "[PMID:222222]", "", "", "")],
        chunk,
    )
    asked = []

    def literature(subs):
        asked.extend(sorted((r.query_id, r.query_text) for r in subs.collect()))
        found = [(10 * q + n, f"web-{q}", f"paper of {q}", f"p{q}", None, "pubmed", 2020, "title", 0.5 + n / 10, 1) for q in (1, 2) for n in (0, 1)]
        return spark.createDataFrame(found, "query_id long, chunk_id string, text string, pmid string, doi string, source string, year int, title string, score double, rank int").withColumn(
            "annotations", F.array().cast("array<string>")
        )

    summaries = spark.createDataFrame([("drug_targets", "Idebenone targets Complex I.")], "topic string, summary string")
    known = spark.createDataFrame([("111111",), ("p1",)], "pmid string")
    out = search_and_answer(queries, lambda q: local, literature, summaries, known)
    subs = sorted((10 * r.query_id + r.sub_id, r.sub_query) for r in out.sub_queries.collect())
    assert asked == subs and {n // 10 for n, _ in subs} == {1, 2, 3}
    web = {r.query_id: (r.doc_id, r["rank"], round(r.score, 6)) for r in out.web.collect()}
    assert web == {1: ("web-1", 1, 0.6), 2: ("web-2", 1, 0.6)}  # the best of the sub-questions, one a paper
    audit = {r.query_id: r.retry for r in out.audit.collect()}
    answers = {r.query_id: r.answer for r in out.answers.collect()}
    assert set(answers) == {1, 2, 3} and audit[2] and answers[2].endswith(qa.RETRY_NOTE)
    assert {q for q, a in answers.items() if a.endswith(qa.RETRY_NOTE)} == {q for q, again in audit.items() if again}
    assert {r.query_id for r in out.entities.where("normalized_id IS NOT NULL").collect()} and {r.query_id for r in out.claims.collect()} >= {1, 2}


def test_scored_chunks_give_the_same_evidence(spark):
    """Chunks scored where they meet their texts, whose texts stay behind, against chunks that bring them along."""
    texts = ["mPTP is formed by ATP synthase. More", "Complex I subunits of mPTP hold mt-nd4.", None, "", "the the the. complex i", "non-ATP mPTP Ünit"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    questions = ask(spark, "Complex I subunits of mPTP", "mt-nd4 mPTP", "??", "the complex I", None)
    questions = questions.unionByName(questions.where("query_id = 3"))  # a question that comes twice
    pairs = [(q, (q + n) % 6, 1.0 - n / 10, n + 1) for q in range(5) for n in range(6)] + [(7, 0, 1.0, 1)]
    found = spark.createDataFrame(pairs, "query_id long, doc_id long, score double, rank int")
    context = spark.createDataFrame([(0, "t", "summary of mPTP. x"), (3, "t", "s")], "query_id long, topic string, summary string")

    def as_chunks(df, name, *more):
        about = {"section_path": "Body", "citation": "c", "title": "", "source_api": "", "year": ""}
        df = df.withColumn("paper_id", F.concat(F.lit(name), F.col("doc_id").cast("string")))
        return df.withColumn("doc_id", F.col("paper_id")).select(
            "query_id", "doc_id", "text", "paper_id", "score", "rank", *[F.lit(v).alias(c) for c, v in about.items()], *more
        )

    kinds = {"md5": F.md5, "claim": qa.leading_claim, "terms": qa.disputed_terms()}
    plain = [as_chunks(found.join(docs, "doc_id"), name) for name in "lw"]
    evidence = qa.fuse_evidence(questions, *plain, context)
    for name, kept in kinds.items():
        scored = [as_chunks(qa.with_scored_texts(found, questions, docs, kept, text=F.lit(None).cast("string")), name, "kept", "lexical") for name in "lw"]
        short = qa.fuse_evidence(questions, *scored, context, kept=kept)

        def rows(df):
            columns = [c for c in evidence.columns if c not in ("text", "score")]
            return sorted(map(str, df.select(*columns, F.round("score", 12).alias("s"), "text").collect()))

        assert rows(short) == rows(evidence.withColumn("text", kept(F.col("text")))), name
        assert "full" not in short.columns
    # The last of the kinds is all that the rules look at.
    disputes = [sorted(map(str, qa.evidence_contradictions(questions, e).collect())) for e in (evidence, short)]
    assert disputes[0] == disputes[1] and len(disputes[0]) > 0


def test_beginnings_are_shortened_like_whole_texts(spark):
    texts = [" " * 9 + "word " * 200, "x" * 330, "x" * 320 + " y", "x" * 321 + " ", "a b", "", None, "w " * 159 + "ab", "w\n" * 160 + " " * 50 + "z", "é " * 161]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for n in (80, 90, 280, 320):
        cut = rows.select(tx.shorten(F.col("text"), n).alias("whole"), tx.shorten(tx.beginning(F.col("text"), 320), n).alias("cut")).collect()
        assert all(r.whole == r.cut for r in cut)
