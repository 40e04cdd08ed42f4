import gzip
import os
import time
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.catalog import streams
from paperloom.sources import tables
from paperloom.streaming import papers as sp


def test_new_file_is_taken_once_and_old_ones_can_be_skipped(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    os.makedirs(landing)
    (tmp_path / "landing" / "old.txt").write_text("old paper")
    old = time.time() - 3600
    os.utime(tmp_path / "landing" / "old.txt", (old, old))
    (tmp_path / "landing" / "new.txt").write_text("new paper\nsecond line")
    (tmp_path / "landing" / "other.csv").write_text("x")
    started = datetime.now() - timedelta(minutes=10)

    def poll():
        sp.poll_once(sp.stream_papers(spark, landing, started=started), sp.keyed_writer(out), mark)
        return sorted(r.text for r in spark.read.parquet(out).collect())

    assert poll() == ["new paper\nsecond line"]
    assert poll() == ["new paper\nsecond line"]
    (tmp_path / "landing" / "third.txt").write_text("third")
    assert poll() == ["new paper\nsecond line", "third"]
    every = sp.stream_papers(spark, landing, include_existing=True)
    sp.poll_once(every, sp.keyed_writer(out + "2"), mark + "2")
    assert spark.read.parquet(out + "2").count() == 3
    accepted, rejected = tables.list_papers(spark, landing, "txt")
    assert [r.name for r in accepted.collect()] == ["new.txt", "old.txt", "third.txt"] and rejected.first().name == "other.csv"
    assert tables.read_whole_files(spark, landing, "texts").where("request = 'third'").first().payload == "third"


def test_a_stored_table_is_one_file_or_a_folder_of_files(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    spark.range(4).toPandas().to_parquet(tmp_path / "one.parquet")
    for name, count in (("many", 6), ("one", 4)):
        out = f"{tmp_path}/{name}"
        for _ in range(2):
            sp.poll_once(sp.stream_table(spark, str(tmp_path), f"{name}.parquet"), sp.keyed_writer(out + "-out"), out + "-mark")
        assert sorted(r.id for r in spark.read.parquet(out + "-out").collect()) == list(range(count))


def test_one_broken_file_holds_up_no_other_and_is_tried_again(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    for name in ("a", "b 1+2%", "é"):
        (landing / f"{name}.txt").write_text(f"text of {name}")
    (landing / "broken.txt.gz").write_bytes(b"no archive")
    (landing / "lost.txt.gz").write_bytes(b"none either")
    folder = sp.PaperFolder(spark, str(landing), str(tmp_path / "work"), "*.txt*", max_tries=3)

    def poll():
        folder.poll(sp.keyed_writer(out))
        tries = {os.path.basename(r.path).split(".")[0]: (r.tries, r.delivered) for r in folder.tries().collect()}
        return sorted(r.text for r in spark.read.parquet(out).collect()), tries

    three = ["text of a", "text of b 1+2%", "text of é"]
    assert poll() == (three, {"broken": (2, False), "lost": (2, False)})  # as a new file and in the round of retries
    with gzip.open(landing / "broken.txt.gz", "wt") as mended:
        mended.write("mended")
    (landing / "late.txt").write_text("late")
    assert poll() == (["late", "mended", *three], {"broken": (2, True), "lost": (3, False)})
    assert poll() == (["late", "mended", *three], {"broken": (2, True), "lost": (3, False)})  # given up, and reported


def test_failed_batch_is_tried_again(spark, tmp_path):
    landing, mark = str(tmp_path / "landing"), str(tmp_path / "mark")
    os.makedirs(landing)
    (tmp_path / "landing" / "a.txt").write_text("a")
    seen = []

    def failing(batch, batch_id):
        seen.append(batch_id)
        if len(seen) == 1:
            raise RuntimeError("first try fails")
        assert batch.count() == 1

    stream = lambda: sp.stream_papers(spark, landing, include_existing=True)
    try:
        sp.poll_once(stream(), failing, mark)
        raise AssertionError("no failure")
    except Exception as error:
        assert "first try fails" in str(error)
    sp.poll_once(stream(), failing, mark)
    assert seen == [0, 0]


def test_ingest_sink_keeps_contradictions_across_batches(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    os.makedirs(landing)
    sink = sp.ingest_writer(out)

    def land(n, text):
        pd.DataFrame({"doc_id": [n], "text": [text], "path": [f"/p/{n}.pdf"]}).to_parquet(f"{landing}/{n}.parquet")
        sp.poll_once(sp.stream_table(spark, landing, "*.parquet"), sink, mark)

    land(1, "PINK1 activates Parkin.")
    land(2, "PINK1 inhibits Parkin. PINK1 activates Parkin.")
    rows = spark.read.parquet(f"{out}/triples")
    assert {(r.paper, r.predicate, r.status) for r in rows.collect()} == {(1, "activates", "merged"), (2, "inhibits", "contradiction"), (2, "activates", "merged")}
    assert sp.current_graph(spark, out).count() == 1 and spark.read.parquet(f"{out}/chunks").count() == 2


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 4, 6]])
def test_repeats_pass_again_after_the_lifetime(spark, tmp_path, cuts):
    """The same rows pass whether the log arrives as one file or as several in time order."""
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    os.makedirs(landing)
    log = [("k", 1, 1), ("k", 1, 2), ("z", 2, 3), ("k", 8, 4), ("k", 9, 5), ("z", 9, 6), ("k", 17, 7)]
    schema = pd.DataFrame(log, columns=["key", "day", "n"])
    schema["at"] = pd.to_datetime(schema["day"].map(lambda d: f"2024-01-{d:02d}")).dt.tz_localize("UTC")
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(log)])):
        schema.iloc[a:b].drop(columns="day").to_parquet(f"{landing}/{number}.parquet", coerce_timestamps="us")
        stream = sp.dedupe_stream(sp.stream_table(spark, landing, "*.parquet"), ["key"], "at", timedelta(days=7), "n")
        sp.poll_once(stream, sp.keyed_writer(out), mark)
    # k passes on days 1, 9 (8 is exactly seven days later) and 17, z on day 2 only.
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 3, 5, 7]


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 4, 6]])
def test_rounds_of_least_times_let_the_same_rows_through(spark, tmp_path, cuts):
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    os.makedirs(landing)
    log = [("k", 1, 2), ("k", 1, 1), ("k", 1, 1), ("z", 2, 3), ("k", 8, 4), ("k", 9, 5), ("z", 9, 6), (None, 9, 8), ("k", 17, 7)]
    table = pd.DataFrame(log, columns=["key", "day", "n"])
    table["at"] = pd.to_datetime(table["day"].map(lambda d: f"2024-01-{d:02d}")).dt.tz_localize("UTC")
    sink = sp.lifetime_writer(out, ["key"], "at", timedelta(days=7), "n", buckets=2)
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(log)])):
        table.iloc[a:b].drop(columns="day").to_parquet(f"{landing}/{number}.parquet", coerce_timestamps="us")
        sp.poll_once(sp.stream_table(spark, landing, "*.parquet"), sink, mark)
    # The first of equal times passes: 1, unless 2 came in an earlier batch.
    first = 2 if 1 in cuts else 1
    rows = sp.passed(spark, out, 2)
    assert sorted(r.n for r in rows.collect()) == sorted([first, 3, 5, 7, 8]) and rows.columns[:3] == ["key", "n", "at"]


@pytest.mark.parametrize("lateness, passed", [(None, "abcef"), (timedelta(days=30), "abcdef")])
def test_late_rows_and_equal_times_of_other_keys_pass(spark, tmp_path, lateness, passed):
    """One file a batch: c is late by less than the lifetime, d by more, e ties with the newest time; the late a is a repeat."""
    landing, out, mark = (str(tmp_path / n) for n in ("landing", "out", "mark"))
    os.makedirs(landing)
    for number, (key, day) in enumerate([("a", 20), ("b", 21), ("c", 15), ("d", 2), ("e", 21), ("a", 18), ("b", 28), ("f", 28)]):
        row = pd.DataFrame({"key": [key], "at": pd.to_datetime([f"2024-01-{day:02d}"]).tz_localize("UTC"), "n": [number]})
        row.to_parquet(f"{landing}/{number}.parquet", coerce_timestamps="us")
        stream = sp.dedupe_stream(sp.stream_table(spark, landing, "*.parquet"), ["key"], "at", timedelta(days=7), "n", lateness)
        sp.poll_once(stream, sp.keyed_writer(out), mark)
    assert "".join(sorted(r.key for r in spark.read.parquet(out).collect())) == passed


def test_a_round_joins_no_row_back(spark, tmp_path):
    """The row that goes through comes out of the least value by key itself, also where the tie is not known."""
    rows = spark.sql("SELECT 'a' AS request_key, TIMESTAMP '2024-01-01 00:00:00' AS fetched_at, id AS event_id FROM VALUES (CAST(NULL AS BIGINT)), (7L), (3L) t(id) UNION ALL SELECT 'b', TIMESTAMP '2024-01-02 00:00:00', CAST(NULL AS BIGINT)")
    sp.lifetime_writer(str(tmp_path), ["request_key"], "fetched_at", timedelta(days=7), "event_id", buckets=2)(rows, 0)
    got = sp.passed(spark, str(tmp_path), buckets=2).select("request_key", "event_id").collect()
    assert sorted((r.request_key, r.event_id) for r in got) == [("a", 3), ("b", None)]


def test_landed_documents_are_dealt_over_the_cores(spark, tmp_path):
    """Ids of one range lie in one stored file, whose texts one task would read alone."""
    rows = [(n, f"It was the {n}th of the days. That and the end of the year.", "en", "s", 10) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("landing-*"))
    streams.streamed_graph(spark, str(tmp_path), files=2)
    (landing,) = set(shared.glob("landing-*")) - before
    landed = spark.read.parquet(str(landing)).select((F.col("doc_id") >= 20).alias("late"), F.input_file_name().alias("file"))
    files = landed.groupBy("late").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n")).collect()
    assert sorted((r.late, r.n) for r in files) == [(False, 20), (True, 20)] and all(r.files > 1 for r in files)
