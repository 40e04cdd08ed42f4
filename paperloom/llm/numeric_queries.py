"""Registered queries of centroid clustering, source mixing and vector codes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.llm.mixing import mix_sources
from paperloom.llm.simplex_clusters import cluster_vectors
from paperloom.llm.vector_codes import compress_vectors, with_label_errors


def _steps(*steps: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in (step.split(" := ", 1) for step in steps))


_FINITE_SQL = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOOR_MEAN_SQL = "CAST((sum({0}) - (sum({0}) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT)".format


def _apart_sql(a: str, b: str, width: int) -> str:
    return f"list_sum(list_transform(range(1, {width + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _cluster_sql(clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> str:
    def nearest(n):
        apart = _apart_sql("p.v", "c.v", width)
        return f"""a{n} := SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(k, d * 64 + k) AS k
          FROM (SELECT p.n, p.vec_id, p.v, c.k, CAST({apart} AS BIGINT) AS d FROM kept p, c{n} c) GROUP BY n"""

    def means(n):
        return f"""c{n + 1} := SELECT k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
          SELECT k, list(x ORDER BY i) AS v FROM (
            SELECT k, i, {_FLOOR_MEAN_SQL('x')} AS x FROM (SELECT k, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{n}) GROUP BY k, i) GROUP BY k) m USING (k)"""

    steps = [
        f"""kept := SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE len(embedding) = {width} AND {_FINITE_SQL}""",
        f"""c0 := SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS k, v FROM (
          SELECT vec_id, v, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h, vec_id LIMIT {clusters})""",
    ]
    for n in range(rounds):
        steps += [nearest(n), means(n)]
    steps.append(nearest(rounds))
    return _steps(*steps) + f"""
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (k)"""


def op11_centroid_clusters(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return cluster_vectors(vectors, clusters=40, rounds=5, width=64, scale=256, seed=2).drop("compared")


def _codes_sql(parts: int = 4, part: int = 16, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    def nearest(n):
        apart = _apart_sql("x.v", "b.v", part)
        return f"""a{n} := SELECT n, p, any_value(x_v) AS v, min(d) AS d, arg_min(e, d * 256 + e) AS e
          FROM (SELECT x.n, x.p, x.v AS x_v, b.e, CAST({apart} AS BIGINT) AS d FROM cut x JOIN b{n} b ON b.p = x.p) GROUP BY n, p"""

    def means(n):
        return f"""b{n + 1} := SELECT p, e, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN (
          SELECT p, e, list(x ORDER BY i) AS v FROM (
            SELECT p, e, i, {_FLOOR_MEAN_SQL('x')} AS x FROM (SELECT p, e, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{n}) GROUP BY p, e, i)
          GROUP BY p, e) m USING (p, e)"""

    steps = [
        f"""kept := SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE len(embedding) = {parts * part} AND {_FINITE_SQL}""",
        f"cut := SELECT n, vec_id, p, v[p * {part} + 1:(p + 1) * {part}] AS v FROM kept, range({parts}) r(p)",
        f"""b0 := SELECT p, e, v FROM cut JOIN (SELECT n, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT n, vec_id FROM kept ORDER BY vec_id LIMIT {entries}))
          USING (n)""",
    ]
    for n in range(rounds):
        steps += [nearest(n), means(n)]
    steps += [
        nearest(rounds),
        f"found := SELECT n, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY n",
        f"""told := SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}""",
    ]
    return _steps(*steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM found JOIN kept USING (n), told"""


def op13_vector_codes(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding")
    codes, books = compress_vectors(vectors, width=64, parts=4, entries=256, rounds=4, scale=1024)
    return with_label_errors(codes).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


def _mix_sql(weights: tuple = (1, 2, 3), most: int = 3, passes: int = 3, seed: int = 1) -> str:
    """The mix with copies by the square root of the size; rounds of sharing out end long before the recursion does."""
    arms = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    copies = f"round(CASE WHEN rate IS NULL THEN {most}.0::DOUBLE ELSE least({most}.0::DOUBLE, rate * pow(size::DOUBLE, 0.5)) END, 9)"

    def taking(k):
        before = f"(c{k - 1}.rank, c{k - 1}.tie)" if k else None
        after = f"JOIN c{k - 1} ON c{k - 1}.key = o.key WHERE (o.rank, o.tie) > {before} AND size <= c{k - 1}.room" if k else "JOIN rooms r ON r.key = o.key WHERE size <= r.room"
        room = f"c{k - 1}.room" if k else "r.room"
        last = f"c{k - 1}" if k else "rooms"
        kept = f"{last}.rank, {last}.tie" if k else "-1.0::DOUBLE, 0"
        return [
            f"""r{k} := SELECT key, rank, tie, sum(words) OVER (PARTITION BY key ORDER BY rank, tie) AS reached, room FROM (
              SELECT o.key, o.rank, o.tie, sum(size) AS words, any_value({room}) AS room FROM odds o {after} GROUP BY 1, 2, 3)""",
            f"""c{k} := SELECT {last}.key, {last}.room - coalesce(f.reached, 0) AS room, {last}.room AS largest, {", ".join(
                f"coalesce(f.{name}, {old})" + f" AS {name}" for name, old in zip(("rank", "tie"), kept.split(", ")))}
              FROM {last} LEFT JOIN (SELECT key, max(reached) AS reached, arg_max(rank, reached) AS rank, arg_max(tie, reached) AS tie FROM r{k}
                WHERE reached <= room GROUP BY key) f USING (key)""",
        ]

    steps = [
        rf"""sized := SELECT doc_id, coalesce('s' || source, 'n') AS key, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
          md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents""",
        """facts := SELECT doc_id, key, source, size, (CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS draw,
          CAST('0x' || substr(h, 14, 13) AS BIGINT) AS tie FROM sized""",
        f"""src := SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} {arms} END AS weight
          FROM (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM facts GROUP BY key)""",
        f"""levels(i, level) := SELECT 0, sum(source_size)::DOUBLE / sum(weight) FROM src
          UNION ALL SELECT i + 1, (SELECT (sum(source_size)::DOUBLE - coalesce(sum({most} * source_size) FILTER ({most} * source_size < weight * l.level), 0))
            / sum(weight) FILTER ({most} * source_size >= weight * l.level) FROM src) FROM levels l WHERE i < 30""",
        f"""targets := SELECT key, source_size, CASE WHEN {most} * source_size < weight * level THEN ({most} * source_size)::DOUBLE ELSE weight * level END AS target
          FROM src, (SELECT arg_max(level, i) AS level FROM levels)""",
        """hist := SELECT key, size, count(*) AS n FROM facts WHERE size > 0 GROUP BY 1, 2""",
        f"""rates := SELECT t.key, source_size, target, rate FROM targets t LEFT JOIN (
          SELECT key, arg_max(rate, size) AS rate FROM (
            SELECT key, size, (target - {most} * longer) / weighed AS rate FROM (
              SELECT key, size, target, sum(size * n) OVER (PARTITION BY key ORDER BY size DESC) - size * n AS longer,
                sum(size * n * pow(size::DOUBLE, 0.5)) OVER (PARTITION BY key ORDER BY size) AS weighed FROM hist JOIN targets USING (key)))
          WHERE rate * pow(size::DOUBLE, 0.5) <= {most} GROUP BY key) f USING (key)""",
        f"""asked := SELECT doc_id, key, size, draw, tie, source_size, target, {copies} AS e FROM facts JOIN rates USING (key)""",
        """odds := SELECT *, draw * (1 - p) / (draw * (1 - p) + p * (1 - draw)) AS rank FROM (SELECT *, round(e - floor(e), 9) AS p FROM asked)
          WHERE p > 0 AND size > 0""",
        """rooms := SELECT r.key, r.target - coalesce(certain, 0) AS room FROM rates r
          LEFT JOIN (SELECT key, CAST(sum(floor(e) * size) AS BIGINT) AS certain FROM asked GROUP BY key) USING (key)""",
    ]
    for k in range(passes):
        steps += taking(k)
    chosen = " OR ".join(f"(size <= c{k}.largest AND (rank, o.tie) <= (c{k}.rank, c{k}.tie))".replace("(rank,", "(o.rank,") for k in range(passes))
    joins = " ".join(f"JOIN c{k} ON c{k}.key = o.key" for k in range(passes))
    return _steps(*steps).replace("levels(i, level) AS MATERIALIZED", "levels(i, level) AS") + f""",
more AS (SELECT o.key, o.doc_id, o.size, o.tie, {chosen} AS more FROM odds o {joins})
SELECT a.doc_id, a.size, source_size, target, CAST(CASE WHEN a.size = 0 THEN 0 ELSE (floor(e) + CASE WHEN more THEN 1 ELSE 0 END) * a.size END AS BIGINT) AS taken
FROM asked a LEFT JOIN (SELECT DISTINCT * FROM more) m ON m.key = a.key AND m.doc_id IS NOT DISTINCT FROM a.doc_id AND m.size = a.size AND m.tie = a.tie"""


def op12_source_mix(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, weights=(1, 2, 3), share=1.0, most=3).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op11_centroid_clusters": op11_centroid_clusters, "op12_source_mix": op12_source_mix, "op13_vector_codes": op13_vector_codes}
SQL = {"op11_centroid_clusters": _cluster_sql(), "op12_source_mix": _mix_sql(), "op13_vector_codes": _codes_sql()}
