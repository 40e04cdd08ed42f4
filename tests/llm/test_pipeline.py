"""The pipeline on a small folder: each stage's decisions take effect."""

import random

import corpus_pipeline


def test_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(7)
    words = [a + b for a in ("lan", "mor", "tel", "sib", "kan") for b in ("dis", "kop", "run", "ves", "tum", "gar")]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(i, prose(60) + "\nShared line of all\n" + prose(20)) for i in range(30)]
    item = prose(15)
    rows[3] = (3, "you idiot, " + rows[3][1])
    rows[5] = (5, rows[4][1])
    rows[7] = (7, rows[6][1].replace("\n", " added\n", 1))
    rows[9] = (9, rows[9][1] + " " + item)
    rows[10] = (10, None)
    folder = str(tmp_path)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == frame.columns
        kept.append({r.doc_id for r in docs.collect()})
    everyone = set(range(30))
    assert kept == [everyone - {3}, everyone - {3}, everyone - {3, 5, 7}, everyone - {3, 5, 7, 9}]
    assert all("Shared line" not in r.text and r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == kept[-1]
    assert all(len(r.ids) == 4 * r.length for r in pieces)
