"""Centroid clusters, vector codes and mixing against brute force, with rows at every edge."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import integers, mixing, numeric_queries, simplex_clusters, vector_codes


def vector_rows(seed, many=300):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    x = (centres[rng.integers(0, 12, many)] + 0.3 * rng.normal(size=(many, 64))).astype(np.float32)
    rows = [(i * 7 % 1009, [float(v) for v in r], int(i % 5) if i % 11 else None) for i, r in enumerate(x)]
    rows += [(2000 + i, rows[3][1], 1) for i in range(150)]  # a third are copies of one vector
    rows += [rows[5], rows[5], (3000, [0.0] * 64, 2), (3001, [-0.25] * 64, 2), (3002, [1000.5] + [-300.25] * 63, None)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    return rows, [(4000 + i, v, 3) for i, v in enumerate(bad)]


def frame(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")
    return table.withColumns({"cluster": F.lit("x"), "ints": F.lit(1), "error": F.lit(None).cast("string")})


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.register("given", pa.Table.from_pylist([dict(zip(columns.names, r)) for r in rows], columns))
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int64())])
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())])


def alike(df, columns, rows):
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("width,size", [(16, 10), (16, 27), (64, 27), (1, 30), (1000, 24), (4, 0)])
def test_limbs_give_exact_products(width, size):
    rng = np.random.default_rng(width + size)
    a, b = (rng.integers(-(1 << size), (1 << size) + 1, (9, width)) for _ in range(2))
    a[0], b[0] = -(1 << size), 1 << size
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert vector_codes.exact_products(a, b).tolist() == want
    bits = vector_codes.limb_bits(width)
    parts = vector_codes.limbs(a, bits)
    assert (sum(p.astype(np.int64) << (bits * i) for i, p in enumerate(parts)) == a).all()
    assert width * max(np.abs(p).max() for p in parts) ** 2 < 2**53 or len(parts) == 1


def test_the_first_of_equally_near_entries_is_taken():
    book = np.array([[5, 5], [0, 2], [2, 0], [0, 2]])
    entry, error = vector_codes.nearest_entries(np.array([[0, 0], [5, 5], [1, 1]]), book)
    assert entry.tolist() == [1, 0, 1] and error.tolist() == [4, 0, 2]


def test_codes_as_by_brute_force(spark):
    rows, bad = vector_rows(1)
    table = frame(spark, rows + bad)
    codes, books = vector_codes.compress_vectors(table, rounds=4)
    shown = vector_codes.with_label_errors(codes).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
    # Equal ids hold equal vectors here, so any order among them gives the same books.
    alike(shown, *by_sql(numeric_queries.SQL["op13_vector_codes"], embeddings=(VECTORS, rows + bad)))
    back = {r.vec_id: r.embedding for r in vector_codes.decode_vectors(codes, books).collect()}
    errors = {r.vec_id: r.error for r in codes.collect()}
    for vec_id, vector, _ in rows[:20]:
        whole = np.floor(1024 * np.float32(vector).astype(float)) - (np.array(back[vec_id]) * 1024 - 0.5)
        assert round(float(whole @ whole)) == errors[vec_id]


def test_codes_of_few_odd_and_no_rows(spark):
    few = [(None, [0.5] * 4, 1), (7, [0.25] * 4, None), (7, [0.125] * 4, None), (9, [3e30] * 4, 1)]
    codes, books = vector_codes.compress_vectors(frame(spark, few), width=4, parts=2, entries=8)
    out = {(r.vec_id, r.label): bytes(r.code) for r in codes.collect()}
    assert books.books.shape == (2, 2, 2) and set(out) == {(None, 1), (7, None)}  # 3e30 is out of range
    none, empty = vector_codes.compress_vectors(frame(spark, []), width=4, parts=2)
    assert none.count() == 0 and empty.books.size == 0 and vector_codes.with_label_errors(none).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(frame(spark, few), width=5, parts=2)


def test_apexes_bound_every_distance():
    rng = np.random.default_rng(2)
    points = rng.integers(-3000, 3000, (60, 64))
    points[30:] = points[30] + rng.integers(-3, 4, (30, 64))
    for some in (points, points[30:], np.repeat(points[:1], 9, axis=0), points[:1], np.zeros((4, 64), np.int64)):
        simplex = simplex_clusters.spanned(some)
        apexes = simplex.apexes(some)
        for x, a in zip(some, apexes):
            true = np.sqrt(simplex_clusters.squared_distances(some, x).astype(float))
            size = np.linalg.norm(a) + np.linalg.norm(apexes, axis=1)
            level = np.square(apexes[:, :-1] - a[:-1]).sum(axis=1)
            assert (np.sqrt(level + (apexes[:, -1] - a[-1]) ** 2) <= true + simplex.slack * size).all()
            assert (np.sqrt(level + (apexes[:, -1] + a[-1]) ** 2) >= true - simplex.slack * size).all()


def test_clusters_as_by_brute_force(spark):
    rows, bad = vector_rows(3)
    out = simplex_clusters.cluster_vectors(frame(spark, rows + bad))
    alike(out.drop("compared"), *by_sql(numeric_queries.SQL["op11_centroid_clusters"], embeddings=(VECTORS, rows + bad)))
    compared = out.agg(F.avg("compared")).first()[0]
    assert compared < 20  # of 40 centroids


def test_clusters_of_few_odd_and_no_rows(spark):
    few = [(None, [0.5] * 4, 1), (7, [0.25] * 4, None), (7, [0.25] * 4, None), (8, [0.0] * 4, None), (9, [3e30] * 4, 1)]
    out = simplex_clusters.cluster_vectors(frame(spark, few), clusters=2, width=4)
    ends = sorted((r.vec_id is None, r.vec_id, r.distance) for r in out.collect())
    assert [e[:2] for e in ends] == [(False, 7), (False, 7), (False, 8), (True, None)]
    assert simplex_clusters.cluster_vectors(frame(spark, few[:1]), width=4).count() == 0  # no vector with an id
    assert simplex_clusters.cluster_vectors(frame(spark, []), width=4).count() == 0
    assert integers.component_bits(64) == 27


def text_rows(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(int(2 ** rng.uniform(0, 9)))), rng.choice(["a", "b", "é", "\U0001d11e", "￮", "hot", "hot", "hot", None])) for i in range(400)]
    rows += [(1000 + i, "same words here again", "hot") for i in range(200)]
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, " \t\n ", None), (2003, "x " * 30_000, "b"), (2004, None, "empty"), (2005, "one word", ""), (None, "no id", "a"), (None, None, None)]
    return rows + [rows[0], rows[0]]


def test_mix_as_by_brute_force(spark):
    rows = text_rows(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "key": F.lit(1), "d": F.lit(2), "rate": F.lit(3), "Target": F.lit(0)})
    out = mixing.mix_sources(docs)
    assert out.columns == ["doc_id", "text", "source", "size", "key", "d", "rate", "Target", "source_size", "copies", "taken"]
    shown = out.select("doc_id", "size", "source_size", F.col("Target").alias("target"), "taken")
    alike(shown, *by_sql(numeric_queries.SQL["op12_source_mix"], documents=(DOCUMENTS, rows)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets_and_agrees_with_itself(spark):
    rng = random.Random(5)
    rows = [(i, "w " * int(2 ** rng.uniform(0, 10)), f"s{i % 3 if i % 3 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for power in (0.0, 0.5, 1.0):
        out = mixing.mix_sources(docs.repartition(7), length_power=power)
        sums = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("copies")).collect()
        assert all(abs(r.taken - r.target) <= 0.005 * r.target and r.copies <= 3 for r in sums)
        assert abs(sum(r.target for r in sums) - sum(len(t) / 2 for _, t, _ in rows)) < 1e-6
        again = mixing.mix_sources(docs.repartition(3, "source"), length_power=power)
        assert sorted(out.select("doc_id", "taken").collect()) == sorted(again.select("doc_id", "taken").collect())
    copies = mixing.repeated(out)
    assert copies.count() == out.agg(F.sum("copies")).first()[0]


def test_pareto_order_takes_likelier_documents_more_often(spark):
    # Documents of 100 words ask for ten times the copies of documents of one word, at power 0.5.
    rows = [(i, "w " * (100 if i % 2 else 1), "s" if i < 4000 else "t") for i in range(8000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3))
    share = {r["size"]: r.copies for r in out.where("source = 's'").groupBy("size").agg(F.avg("copies").alias("copies")).collect()}
    assert 7 < share[100] / share[1] < 14


def test_shares_beyond_the_bound_are_divided_again(spark):
    sizes = spark.createDataFrame([("a", "a", 10), ("b", "b", 1000), ("c", "c", 5), ("n", None, 100), ("e", "e", 0)], "key string, source string, source_size long")
    targets = {r.key: r.target for r in mixing.source_targets(sizes, (1, 2, 3), 3, 1.0).collect()}
    # Weights a 1, b 2, c 3, e 1, null 2: a, c and e stop at 30, 15 and 0, then null at 300, and b has the rest.
    assert targets == {"a": 30.0, "b": 770.0, "c": 15.0, "e": 0.0, "n": 300.0}
