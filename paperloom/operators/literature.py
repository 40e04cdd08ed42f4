"""Literature payloads: parsing API answers, merging them across sources, freshness, pacing.

Search results of every source share one layout, so one plan merges them all:
``(query_id, source_order, pos, source, id, title, abstract, pmid, doi, year, citation_count)``.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions import vectors as vx
from paperloom.functions.ranking import SCORE_DECIMALS, ranked

# Answer layouts, score weights and fallbacks whose results must stay the same.
ESEARCH = "esearchresult struct<idlist:array<string>>"
ELINK = "linksets array<struct<linksetdbs:array<struct<links:array<string>>>>>"
S2_PAPER = (
    "struct<paperId:string,title:string,abstract:string,year:string,citationCount:string,"
    "externalIds:map<string,string>,embedding:struct<vector:array<double>>>"
)
EUROPE_PMC = (
    "resultList struct<result:array<struct<id:string,source:string,title:string,abstractText:string,"
    "pubYear:string,doi:string,pmid:string,pmcid:string,journalTitle:string,authorString:string>>>"
)
PREPRINTS = (
    "collection array<struct<doi:string,title:string,abstract:string,date:string,posted:string,"
    "server:string,category:string,authors:string>>"
)
BIOC_DOCUMENT = (
    "struct<id:string,passages:array<struct<annotations:array<struct<text:string,"
    "infons:struct<type:string,biotype:string,identifier:string>,"
    "locations:array<struct<offset:string,length:string>>>>>>>"
)
ARTICLE_XML = (
    "PubmedArticle array<struct<"
    "MedlineCitation:struct<PMID:struct<_VALUE:string,_Version:string>,Article:struct<ArticleTitle:string,"
    "Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>,"
    "AuthorList:struct<Author:array<struct<ForeName:string,LastName:string>>>>>,"
    "PubmedData:struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>>>"
)
SOURCE_ORDER = {"pubmed": 0, "semantic_scholar": 1, "europe_pmc": 2, "biorxiv": 3}
FALLBACK_PREFIX = {"pubmed": "pubmed", "semantic_scholar": "s2", "europe_pmc": "europe_pmc"}
DEFAULT_CITATION = "[PMID:12345678]"
WEB_SALT = "web-pubmedbert"
HYDRATED = 30
PREPRINT_LIMIT = 20
PAYLOAD_TTL_SECONDS = 7 * 24 * 60 * 60
RESULT = (
    "query_id", "source_order", "pos", "source", "id", "title", "abstract", "pmid", "doi", "year", "citation_count",
)


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def _whole(value: Column) -> Column:
    """A number given as digits; anything else is null."""
    return F.when(value.rlike(r"^\d+$"), value.cast("int"))


def _layout(df: DataFrame, origin: str, /, **columns: Column) -> DataFrame:
    known = {
        "source": F.lit(origin), "title": F.lit(""), "abstract": F.lit(""), "pmid": F.lit(None).cast("string"),
        "doi": F.lit(None).cast("string"), "year": F.lit(None).cast("int"), "citation_count": F.lit(0),
        "source_order": F.lit(SOURCE_ORDER[origin]), **columns,
    }
    return df.select("query_id", "pos", *[v.alias(k) for k, v in known.items()]).select(*RESULT)


# ---------------------------------------------------------------- parsing


def parse_pubmed_search(payloads: DataFrame) -> DataFrame:
    """Search answers to one row per id."""
    rows = payloads.select("query_id", F.from_json("payload", ESEARCH).alias("j")).select(
        "query_id", F.posexplode("j.esearchresult.idlist").alias("pos", "pmid")
    )
    return _layout(rows, "pubmed", id=F.col("pmid"), pmid=F.col("pmid"))


def parse_citation_links(payloads: DataFrame) -> DataFrame:
    """Link answers ``(pmid, payloads array)`` to ordered distinct linked ids.

    The payloads of one paper (cited-in, then references) are given as an array in order.
    """
    sets = F.transform("payloads", lambda p: F.from_json(p, ELINK)["linksets"])
    flat = F.flatten(
        F.transform(
            F.flatten(F.filter(sets, lambda s: s.isNotNull())),
            lambda s: F.flatten(
                F.transform(F.coalesce(s["linksetdbs"], F.array()), lambda d: F.coalesce(d["links"], F.array()))
            ),
        )
    )
    return payloads.select("pmid", F.posexplode(F.array_distinct(flat)).alias("pos", "linked_pmid"))


def parse_articles(payloads: DataFrame) -> DataFrame:
    """Article XML ``(pmid, payload)`` to title, joined abstract, journal, year, doi, authors."""
    parsed = payloads.select(
        F.col("pmid").alias("asked"), F.from_xml(F.col("payload"), ARTICLE_XML).alias("x")
    ).select("asked", F.get("x.PubmedArticle", 0).alias("a"))
    article = F.col("a.MedlineCitation.Article")
    parts = F.transform(article["Abstract"]["AbstractText"], lambda p: tx.strip(p["_VALUE"]))
    ids = F.filter("a.PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == "doi")
    names = F.transform(
        article["AuthorList"]["Author"],
        lambda w: F.concat_ws(" ", _filled(tx.strip(w["ForeName"])), _filled(tx.strip(w["LastName"]))),
    )
    return parsed.select(
        F.coalesce(_filled(tx.strip(F.col("a.MedlineCitation.PMID._VALUE"))), "asked").alias("pmid"),
        _text(tx.strip(article["ArticleTitle"])).alias("title"),
        _text(F.array_join(F.filter(parts, lambda p: p != ""), " ")).alias("abstract"),
        _text(tx.strip(article["Journal"]["Title"])).alias("journal"),
        _whole(tx.strip(article["Journal"]["JournalIssue"]["PubDate"]["Year"])).alias("year"),
        tx.strip(F.get(ids, 0)["_VALUE"]).alias("doi"),
        F.coalesce(F.filter(names, lambda n: n != ""), F.array()).cast("array<string>").alias("authors"),
    )


def parse_s2(payloads: DataFrame, years: tuple[int, int] | None = None, inside: str | None = None) -> DataFrame:
    """Paper rows of search answers, or of reference (``citedPaper``) and citation
    (``citingPaper``) answers with ``inside``; optional inclusive year range."""
    element = f"struct<{inside}:{S2_PAPER}>" if inside else S2_PAPER
    rows = payloads.select("query_id", F.from_json("payload", f"data array<{element}>").alias("j")).select(
        "query_id", F.posexplode("j.data").alias("pos", "p")
    )
    if inside:
        rows = rows.select("query_id", "pos", F.col(f"p.{inside}").alias("p")).where("p IS NOT NULL")
    ids = F.col("p.externalIds")
    out = _layout(
        rows, "semantic_scholar", id=_text(F.col("p.paperId")), title=_text(F.col("p.title")),
        abstract=_text(F.col("p.abstract")), pmid=F.try_element_at(ids, F.lit("PMID")),
        doi=F.try_element_at(ids, F.lit("DOI")), year=_whole(F.col("p.year")),
        citation_count=F.coalesce(_whole(F.col("p.citationCount")), F.lit(0)),
    )
    return out.where(F.col("year").between(*years)) if years else out


def europe_pmc_items(payloads: DataFrame) -> DataFrame:
    """Search answer items with their fields as they are."""
    return payloads.select("query_id", F.from_json("payload", EUROPE_PMC).alias("j")).select(
        "query_id", F.inline("j.resultList.result")
    )


def parse_europe_pmc(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("query_id", F.from_json("payload", EUROPE_PMC).alias("j")).select(
        "query_id", F.posexplode("j.resultList.result").alias("pos", "p")
    )
    return _layout(
        rows, "europe_pmc", id=_text(F.col("p.id")), title=_text(F.col("p.title")), abstract=_text(F.col("p.abstractText")),
        pmid=F.coalesce(_filled(F.col("p.pmid")), _filled(F.col("p.id"))), doi=_filled(F.col("p.doi")),
        year=_whole(F.col("p.pubYear")),
    )


def parse_preprints(payloads: DataFrame, server: str = "biorxiv") -> DataFrame:
    """Preprint rows ``(query_id, pos, doi, title, abstract, date, server, category, authors)``."""
    return (
        payloads.select("query_id", F.from_json("payload", PREPRINTS).alias("j"))
        .select("query_id", F.posexplode("j.collection").alias("pos", "p"))
        .select(
            "query_id", "pos", _text(F.col("p.doi")).alias("doi"), _text(F.col("p.title")).alias("title"),
            _text(F.col("p.abstract")).alias("abstract"),
            F.coalesce(_filled(F.col("p.date")), F.col("p.posted"), F.lit("")).alias("date"),
            F.coalesce(_filled(F.col("p.server")), F.lit(server)).alias("server"),
            _text(F.col("p.category")).alias("category"), _text(F.col("p.authors")).alias("authors"),
        )
    )


def filter_preprints(
    preprints: DataFrame,
    queries: DataFrame,
    start: str | None = None,
    end: str | None = None,
    category: str | None = None,
    limit: int = PREPRINT_LIMIT,
) -> DataFrame:
    """First ``limit`` preprints of a date window that hold any word of the question.

    A question without any match falls back to its whole window (default: the last 365
    days). Matches and others are cut to the limit before the shuffle; only those few
    rows per question decide about the fallback.
    """
    last = date.fromisoformat(end) if end else date.today()
    end, start = last.isoformat(), start or (last - timedelta(days=365)).isoformat()
    words = F.filter(F.split(F.lower("query_text"), f"{tx.SPACE}+"), lambda w: w != "")
    asked = queries.select("query_id", words.alias("words"))
    haystack = F.lower(F.concat_ws(" ", "title", "abstract", "category"))
    inside = preprints.where(F.col("date").between(start, end)).join(asked, "query_id")
    # An array of one, so that a text is put into lower case once and not for every word.
    fits = (F.size("words") == 0) | F.exists(F.array(haystack), lambda text: F.exists("words", lambda w: F.contains(text, w)))
    if category:
        fits = fits & (F.lower("category") == category.lower())
    marked = inside.withColumn("hit", fits).drop("words").withColumn("_s", F.lit(0))
    first = ranked(marked, ["query_id", "hit"], "_s", ["pos"], limit)
    any_hit = F.bool_or("hit").over(Window.partitionBy("query_id"))
    return first.withColumn("any_hit", any_hit).where("hit OR NOT any_hit").drop("hit", "any_hit", "_s")


def preprint_results(preprints: DataFrame) -> DataFrame:
    """Preprints in the common layout; the year is the date prefix."""
    return _layout(
        preprints, "biorxiv", source=F.col("server"), id=F.col("doi"), title=F.col("title"),
        abstract=F.col("abstract"), doi=_filled(F.col("doi")), year=_whole(F.substring("date", 1, 4)),
    )


def flatten_annotations(payloads: DataFrame) -> DataFrame:
    """Annotation answers to rows; a payload is an object with ``documents`` or a bare list."""
    wrapped = F.from_json("payload", f"documents array<{BIOC_DOCUMENT}>")["documents"]
    bare = F.from_json("payload", f"array<{BIOC_DOCUMENT}>")
    listed = F.when(F.ltrim("payload").startswith("["), bare).otherwise(wrapped)
    rows = (
        payloads.select(F.explode(listed).alias("d"))
        .select(_text(F.col("d.id")).alias("pmid"), F.posexplode("d.passages").alias("passage", "p"))
        .select("pmid", "passage", F.posexplode("p.annotations").alias("n", "a"))
    )
    place = F.get("a.locations", 0)
    start = _whole(place["offset"])
    return rows.select(
        "pmid",
        "passage",
        "n",
        _text(F.col("a.text")).alias("text"),
        F.coalesce(_filled(F.col("a.infons.type")), F.col("a.infons.biotype"), F.lit("")).alias("entity_type"),
        _filled(F.col("a.infons.identifier")).alias("identifier"),
        start.alias("start"),
        (start + F.coalesce(_whole(place["length"]), F.lit(0))).alias("end"),
    )


# ---------------------------------------------------------------- merging


def paper_key(doi: Column, pmid: Column, fallback: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("doi:"), F.lower(_filled(doi))), F.concat(F.lit("pmid:"), _filled(pmid)), fallback
    )


def _fallback_key() -> Column:
    prefix = F.lit("biorxiv")
    for source, short in FALLBACK_PREFIX.items():
        prefix = F.when(F.col("source") == source, F.lit(short)).otherwise(prefix)
    return F.concat_ws(":", prefix, "id")


def candidate_rank() -> Column:
    return (
        F.col("score_hint")
        + F.when(F.col("abstract") != "", 0.1).otherwise(0.0)
        + F.when((_text(F.col("pmid")) != "") | (_text(F.col("doi")) != ""), 0.05).otherwise(0.0)
    )


def score_candidates(results: list[DataFrame]) -> DataFrame:
    """Candidates with key, position in the fan-out order, score hint and rank value."""
    order = Window.partitionBy("query_id").orderBy("source_order", "pos")
    rows = reduce(DataFrame.unionByName, results).withColumn("index", F.row_number().over(order) - 1)
    hint = F.greatest(F.lit(0.0), 1.0 - F.col("index") * 0.01) + F.when(
        F.col("source") == "semantic_scholar", F.least(F.col("citation_count") / 10000.0, F.lit(0.2))
    ).otherwise(0.0)
    return (
        rows.withColumn("key", paper_key(F.col("doi"), F.col("pmid"), _fallback_key()))
        .withColumn("score_hint", hint)
        .withColumn("rank_value", candidate_rank())
    )


def dedupe_papers(candidates: DataFrame) -> DataFrame:
    """Best candidate per (question, key), in order of rank.

    Equal candidates: the first one wins; equal keys in the order they first came up.
    """
    same = Window.partitionBy("query_id", "key")
    order = same.orderBy(F.round("rank_value", SCORE_DECIMALS).desc(), "index")
    best = candidates.withColumns({"_take": F.row_number().over(order), "first_index": F.min("index").over(same)})
    return ranked(best.where("_take = 1").drop("_take"), ["query_id"], "rank_value", ["first_index"], rank="position")


def hydrate(candidates: DataFrame, articles: DataFrame, n: int = HYDRATED) -> DataFrame:
    """Fill the first ``n`` candidates per question: PubMed rows take the article's fields.

    A missing article leaves the candidate as it is; a filled one gets its key anew.
    """
    found = articles.select(
        F.col("pmid").alias("wanted"), F.col("title").alias("a_title"), F.col("abstract").alias("a_abstract"),
        F.col("doi").alias("a_doi"), F.col("year").alias("a_year"), F.lit(True).alias("a_found"),
    )
    # Other sources get keys of their own that match nothing, so they spread instead of piling up on null.
    wanted = F.when((F.col("source") == "pubmed") & F.col("pmid").isNotNull(), F.col("pmid")).otherwise(
        F.concat_ws(" ", F.lit("-"), "query_id", "key")
    )
    mine = candidates.where(F.col("position") <= n).withColumn("wanted", wanted).join(found, "wanted", "left")
    filled = F.col("a_found").isNotNull()
    for name in ("title", "abstract", "doi", "year"):
        mine = mine.withColumn(name, F.when(filled, F.col(f"a_{name}")).otherwise(F.col(name)))
    new_key = paper_key(F.col("doi"), F.col("pmid"), F.concat(F.lit("pubmed:"), "pmid"))
    mine = mine.withColumn("key", F.when(filled, new_key).otherwise(F.col("key")))
    return mine.select(candidates.columns).withColumn("rank_value", candidate_rank())


def attach_annotations(papers: DataFrame, annotations: DataFrame) -> DataFrame:
    """Add ``annotations`` per pmid in reading order (empty where there are none)."""
    grouped = annotations.groupBy("pmid").agg(
        F.array_sort(F.collect_list(F.struct("passage", "n", "text", "entity_type", "identifier", "start", "end"))).alias("found")
    )
    joined = papers.join(grouped, "pmid", "left")
    texts = F.transform("found", lambda a: a["text"])
    return joined.withColumn("annotations", F.coalesce(texts, F.array().cast("array<string>"))).drop("found")


def chunk_text() -> Column:
    return F.when(
        F.col("abstract") != "", tx.strip(F.concat(F.col("title"), F.lit("\n\n"), F.col("abstract")))
    ).otherwise(F.col("title"))


def score_abstracts(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cosine of question and title + abstract, plus the score hint.

    Question and candidate meet by an equi-join and their texts are compared on the row.
    """
    asked = queries.select("query_id", F.col("query_text").alias("asked"))
    scored = candidates.withColumn("text", chunk_text()).join(asked, "query_id")
    scored = scored.withColumn("score", vx.text_cosine(WEB_SALT)("asked", "text") + F.col("score_hint")).drop("asked")
    scored = scored.withColumn("chunk_id", F.concat(F.lit("web-"), F.replace(F.col("key"), F.lit(":"), F.lit("-"))))
    return ranked(scored, ["query_id"], "score", ["position"])


def merge_subquery_results(results: DataFrame) -> DataFrame:
    """Best-scored chunk per paper over all sub-queries of a question.

    ``results`` has ``query_id, sub_id, rank`` and the chunk's fields; ties keep the
    earlier sub-query, then the better rank.
    """
    keyed = results.withColumn("merge_key", paper_key(F.col("doi"), F.col("pmid"), F.col("chunk_id")))
    same = Window.partitionBy("query_id", "merge_key")
    order = same.orderBy(F.round("score", SCORE_DECIMALS).desc(), "sub_id", "rank")
    best = keyed.withColumns({"_take": F.row_number().over(order), "_first": F.min(F.struct("sub_id", "rank")).over(same)})
    best = best.where("_take = 1").drop("_take", "merge_key", "rank")
    return ranked(best, ["query_id"], "score", ["_first.sub_id", "_first.rank"]).drop("_first")


def web_citation(pmid: Column, doi: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("[PMID:"), _filled(pmid), F.lit("]")), F.concat(F.lit("[doi:"), _filled(doi), F.lit("]"))
    )


def to_ranked(chunks: DataFrame) -> DataFrame:
    """Ranked evidence with paper id, citation and section path."""
    return chunks.select(
        "query_id",
        F.col("chunk_id").alias("doc_id"),
        "text",
        F.coalesce(_filled(F.col("pmid")), _filled(F.col("doi")), "chunk_id").alias("paper_id"),
        F.concat(F.lit("Web > "), "source").alias("section_path"),
        "score",
        "rank",
        F.coalesce(web_citation(F.col("pmid"), F.col("doi")), F.lit(DEFAULT_CITATION)).alias("citation"),
        "title",
        F.col("source").alias("source_api"),
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"),
        "annotations",
    )


# ---------------------------------------------------------------- manifest


def normalize_manifest(items: DataFrame) -> DataFrame:
    """Cleaned manifest rows; empty fields become null."""
    return items.select(
        *[_filled(F.col(c)).alias(c) for c in ("pmid", "pmcid", "doi")],
        F.regexp_replace(tx.strip(_text(F.col("title"))), r"\.+$", "").alias("title"),
        _filled(F.col("pubYear")).alias("year"),
        _filled(F.col("journalTitle")).alias("journal"),
        _filled(tx.strip(F.get(F.split(_text(F.col("authorString")), ","), 0))).alias("first_author"),
        _filled(F.col("source")).alias("source"),
    )


def refresh_manifest(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new manifest in fixed order, and a one-row table ``changed``.

    Rows are compared as multisets by counting, in one shuffle over both versions.
    """
    order = [_text(F.col(c)) for c in ("pmid", "doi", "title")]
    sides = new.withColumn("side", F.lit(1)).unionByName(old.withColumn("side", F.lit(-1)))
    uneven = sides.groupBy(*new.columns).agg(F.sum("side").alias("balance")).where("balance <> 0")
    changed = uneven.agg((F.count("*") > 0).alias("changed"))
    return new.orderBy(*order), changed


# ---------------------------------------------------------------- freshness and pacing


def request_key(namespace: Column, url: Column, params: Column) -> Column:
    """Cache key of a request: parameters sorted by name, as JSON."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.array(e["key"], e["value"]))
    return F.concat(namespace, F.lit(":"), url, F.lit("?"), F.to_json(pairs))


def fresh_payloads(
    requests: DataFrame, payloads: DataFrame, as_of: str, ttl_seconds: int = PAYLOAD_TTL_SECONDS
) -> DataFrame:
    """Latest payload per request key inside the lifetime; others are marked ``refetch``.

    The as-of rule is a range filter on the payloads followed by one partial aggregate per key.
    """
    end = F.lit(as_of).cast("timestamp_ntz")
    begin = end - F.make_dt_interval(secs=F.lit(ttl_seconds))
    valid = payloads.where(F.col("fetched_at").cast("timestamp_ntz").between(begin, end))
    latest = valid.groupBy("request_key").agg(F.max(F.struct("fetched_at", "payload")).alias("last"))
    return (
        requests.select("request_key").distinct()
        .join(latest, "request_key", "left")
        .select("request_key", "last.fetched_at", "last.payload", F.col("last").isNull().alias("refetch"))
    )


def pace_requests(log: DataFrame, rate_per_second: float, bucket_micros: int = 3_600_000_000) -> DataFrame:
    """Earliest grant time per request so that grants of a client keep the interval.

    ``log(client, request_id, at)`` with ``at`` in microseconds. With n the request's number in
    its client, grant = n*step + running max(at - n*step). Both the number and the running
    maximum are formed inside (client, time bucket) and carried over a small bucket
    table, so one client that sends most requests still uses many tasks.
    """
    if rate_per_second <= 0:
        raise ValueError("rate_per_second must be positive")
    step = 1_000_000.0 / rate_per_second
    place = ["client", "bucket"]
    inside = Window.partitionBy(*place).orderBy("at", "request_id")
    before = Window.partitionBy("client").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("bucket", F.floor(F.col("at") / bucket_micros))
    sizes = rows.groupBy(*place).agg(F.count("*").alias("size"), F.max("at").alias("last_at"))
    sizes = sizes.select(
        *place,
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.max("last_at").over(before).alias("earlier_at"),
    )
    numbered = (
        rows.withColumn("local", F.row_number().over(inside))
        .withColumn("previous", F.lag("at").over(inside))
        .join(sizes, place)
        .withColumn("n", F.col("offset") + F.col("local"))
        .withColumn("slack", F.col("at") - F.col("n") * step)
    )
    peaks = numbered.groupBy(*place).agg(F.max("slack").alias("peak"))
    peaks = peaks.select(*place, F.max("peak").over(before).alias("earlier_peak"))
    running = F.max("slack").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    granted = (
        numbered.withColumn("running", running)
        .join(peaks, place)
        .withColumn("granted_at", F.col("n") * step + F.greatest("running", "earlier_peak"))
    )
    gap = F.col("at") - F.coalesce("previous", "earlier_at")
    return granted.select(
        "client", "request_id", "at", "granted_at",
        (F.col("granted_at") - F.col("at")).alias("wait"),
        F.coalesce(gap < step, F.lit(False)).alias("too_early"),
    )
