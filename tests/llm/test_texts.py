"""Line dedup, decontamination, toxicity, languages: small cases and brute force."""

import random
import re

import pytest

from paperloom.llm import language_id, toxicity
from paperloom.llm.decontaminate import decontaminate
from paperloom.llm.line_dedup import drop_shared_lines

DOCS = "doc_id long, text string, n_lines string, row int, key string"


def test_lines_shared_by_enough_documents_go(spark):
    texts = [f"own {i}\n  Same Line\t\n\nend {i}" for i in range(3)] + ["same line", "SAME LINE\nsame line", None, "", "x\n" * 20_000, "own 0\n", "own 0\n"]
    docs = spark.createDataFrame([(i if i else None, t, "given", i, "k") for i, t in enumerate(texts)], DOCS)
    out = {r.row: r for r in drop_shared_lines(docs, min_documents=5).collect()}
    assert [out[i].text for i in range(10)] == ["own 0\n\nend 0", "own 1\n\nend 1", "own 2\n\nend 2", "", "", "", "", "x\n" * 20_000, "own 0\n", "own 0\n"]
    assert [(out[i].n_lines, out[i].n_dropped) for i in (0, 4, 5, 7)] == [(4, 1), (2, 2), (1, 0), (20_001, 0)]
    assert out[0].key == "k" and out[0].doc_id is None
    assert drop_shared_lines(docs.limit(0)).count() == 0


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, f"shared\nown {i}") for i in range(9)] + [(2, "shared"), (3, "other\nshared"), (4, "other"), (None, "other"), (None, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least, gone in ((3, {"shared", "other"}), (4, {"other"}), (5, set())):
        out = drop_shared_lines(docs, min_documents=least).collect()
        want = sorted("\n".join(line for line in t.split("\n") if line not in gone) for _, t in rows)
        assert sorted(r.text for r in out) == want
    alone = drop_shared_lines(docs.select("text"), min_documents=11).collect()
    assert sum(r.n_dropped for r in alone) == 11  # without ids every row counts


def test_windows_are_found_as_by_brute_force(spark):
    long_item = " ".join(f"w{i}" for i in range(14))
    items = [(1, long_item), (2, "Only Four words é"), (3, None), (4, "--"), (None, "a b c d e f g h i j"), (5, long_item)]
    texts = [
        f"start {long_item.upper()} end", " ".join(f"w{i}" for i in range(9)), "x only, four WORDS é! y", None, "", "a b c d e f g h i j k",
        " ".join(f"w{i}" for i in range(3, 14)) + "\nonly four words é", "x " * 600_000 + long_item, "w0 w1", "w0 w1", "only four words É",
    ]
    docs = spark.createDataFrame([(i, t, "given", i, "k") for i, t in enumerate(texts)], DOCS.replace("n_lines", "n_hit"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {}
    for i, t in enumerate(texts):
        doc, hit, found = words_of(t), set(), set()
        for key, text in items:
            item = words_of(text)
            n = min(10, len(item))
            windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
            for k in range(len(doc) - n + 1):
                if n and tuple(doc[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add("null" if key is None else str(key))
        expected[i] = (len(doc), len(hit), sorted(found))
    for at_once in (2_000_000, 3):
        out = decontaminate(docs, bench, remove=None, windows_per_pass=at_once).collect()
        assert {r.row: (r.n_words, r.n_hit, r["items"]) for r in out} == expected
    kept = {r.row for r in decontaminate(docs, bench).collect()}
    assert kept == {i for i, (_, n, _) in expected.items() if not n}
    cut = {r.row: r.text for r in decontaminate(docs, bench, remove="spans").collect()}
    assert cut[0] == "start  end" and cut[2] == "x ! y" and cut[6] == "" and cut[3] is None
    assert decontaminate(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize(
    "symbols,found",
    [
        ([toxicity.INSULT], ["plain insult"]),
        ([toxicity.TARGET, toxicity.OTHER, toxicity.INSULT], ["aimed insult"]),
        ([toxicity.INSULT, toxicity.TARGET], ["plain insult", "aimed insult"]),
        ([toxicity.TARGET, toxicity.NEGATION, toxicity.OTHER, toxicity.INSULT], ["negated insult"]),
        ([toxicity.NEGATION] + [toxicity.OTHER] * 4 + [toxicity.INSULT], ["plain insult"]),
        ([toxicity.TARGET, toxicity.REPORT, toxicity.TARGET, toxicity.INSULT], ["reported insult"]),
        ([toxicity.THREAT, toxicity.TARGET], ["plain threat", "aimed threat"]),
    ],
)
def test_grammar_marks_what_a_clause_does(symbols, found):
    assert [toxicity.PATTERNS[p] for p in toxicity.clause_patterns(symbols)] == found


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(1)
    filler = [a + b + c for a in ("lan", "mor", "tel", "sib") for b in ("dis", "kop", "run") for c in ("a", "ed", "ing", "s", "um")]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(filler, k=20)
        if i % 4 == 0:
            words[5], words[9], words[15] = (f"zorg{rng.choice(filler)}" for _ in range(3))
        text = " ".join(words)
        rows.append((i, text))
        labels.append((i, 1 if i % 4 == 0 else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    asked = spark.createDataFrame(
        [(1, "landisa zorgnew moruns", "x"), (2, "landisa telkopum", "x"), (3, None, "x"), (None, "", "x"), (5, "you idiot", "x"), (5, "you idiot", "x"),
         (6, "he said you idiot", "x"), (7, "lan " * 300_000, "x")],
        "doc_id long, text string, score string",
    )
    out = toxicity.score_toxicity(asked, model).collect()
    assert [r.predicted for r in out] == [1, 0, 0, 0, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 for r in out) and out[4].score == out[5].score
    bare = toxicity.fit_toxicity(docs.limit(0), marks.limit(0))
    assert [r.predicted for r in toxicity.score_toxicity(asked, bare).collect()][4] == 1
    assert toxicity.score_toxicity(asked.limit(0), bare).count() == 0


def test_languages_are_told_apart(spark):
    base = {"en": "the quick house and this other thing", "de": "das schöne haus und der andere tisch", "fr": "la maison était très belle où"}
    rows = [(i, f"{text} {i}", lang) for i, (lang, text) in enumerate(list(base.items()) * 30)]
    docs = spark.createDataFrame(rows + [(1000, "unlabelled", None), (1001, None, "xx"), (1002, "123", "yy")], "doc_id long, text string, lang string")
    model = language_id.fit_languages(docs)
    assert model.languages == ["de", "en", "fr"] and (model.weights == 0).mean() > 0.5
    asked = spark.createDataFrame(
        [(1, "this house", "a"), (2, "der tisch", "a"), (3, "où était", "a"), (4, None, "a"), (5, "12 !?", "a"), (6, "", "a"), (7, "this house " * 60_000, "a"), (7, "this house", "a")],
        "doc_id long, text string, lang_pred string",
    )
    out = language_id.identify_languages(asked, model).collect()
    assert [r.lang_pred for r in out] == ["en", "de", "fr", "und", "und", "und", "en", "en"]
    assert all(0 <= r.score <= 1 for r in out)
    nothing = language_id.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify_languages(asked, nothing).collect()} == {"und"}
