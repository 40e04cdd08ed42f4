import random

import numpy as np

from paperloom.operators import monitoring as mon


def test_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else "b", round(rng.expovariate(0.05), 1)) for _ in range(700)] + [("c", 2.0)]
    df = spark.createDataFrame(rows, "stage string, ms double")
    for r in mon.stage_latency(df).collect():
        values = [v for s, v in rows if s == r.stage]
        assert abs(r.p50_ms - np.quantile(values, 0.5)) < 1e-9 and abs(r.p95_ms - np.quantile(values, 0.95)) < 1e-9
        assert r.n == len(values)


def test_quantiles_over_many_groups_and_magnitudes(spark):
    rng = random.Random(2)
    rows = [(f"g{rng.randrange(300)}", 10 ** rng.uniform(-4, 5) * rng.choice([1, -1])) for _ in range(6000)]
    rows += [("hot", rng.choice([1e-9, 5.0, 5.0 + 1e-12, 1e300, -1e300])) for _ in range(3000)] + [("one", 7.0), (None, 1.0), (None, 3.0), ("nan", float("nan")), ("nan", None)]
    shares = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}
    got = {r.k: r for r in mon.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), "k", "x", shares, buckets=16).collect()}
    assert set(got) == {k for k, _ in rows} - {"nan"}
    for k, r in got.items():
        values = [x for g, x in rows if g == k]
        for name, share in shares.items():
            low, part = divmod((len(values) - 1) * share, 1)
            a, b = (sorted(values)[min(int(low) + n, len(values) - 1)] for n in (0, 1 if part else 0))
            assert r[name] == a + (b - a) * part


def test_library(spark):
    papers = spark.createDataFrame([("PMC1", "Alpha"), ("2", "Beta"), ("3", "Gamma")], "id string, title string")
    assert [r.id for r in mon.search_library(papers, " pmc ").collect()] == ["PMC1"] and mon.search_library(papers, " ").count() == 3
    chunks = spark.createDataFrame([("PMC1", 4), ("2", 1)], "id string, chunks long")
    summary = spark.createDataFrame([("PMC1", 3, 2, 2), ("2", 1, 0, 1)], "id string, entities long, triples_merged long, triples long")
    got = {r.id: (r.status, r.triples) for r in mon.library_records(papers, chunks, summary).collect()}
    assert got == {"PMC1": ("indexed", 2), "2": ("needs-review", 0), "3": ("processing", 0)}
