"""Scores, predictions and the pipeline's middle stages against plain versions, on random texts."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from test_pairs import brute as similar

import corpus_pipeline
from paperloom.llm import language_id, toxicity
from paperloom.llm.words import ALNUM, word_blocks

FOLD = {c: c + 32 for c in range(65, 91)}


# ---------------------------------------------------------------- toxicity


def classes_of(word, known):
    """The class of a word: its own, else that of its longest known beginning."""
    data, w = next(word_blocks(pa.array([word]), ALNUM))
    units = toxicity._units(data, w.start, w.end, w.hash)[0].tolist()
    order = [units[0], *units[1:]]
    return next((known[u] for u in order if u and u in known), toxicity.OTHER)


def marks_of(symbols):
    """Patterns of one clause, by the rules one after the other."""
    negated = [s in toxicity.HOSTILE and not all(x != toxicity.NEGATION for x in symbols[max(0, i - 3) : i]) for i, s in enumerate(symbols)]
    found, target, last = [], 0, None
    reported = False
    for i, s in enumerate(symbols):
        before, last = last, None
        if s == toxicity.REPORT:
            reported = True
        kind = {toxicity.INSULT: "insult", toxicity.THREAT: "threat", toxicity.DOUBTFUL: "doubtful insult"}.get(s)
        if kind and negated[i]:
            found.append(f"negated {kind}")
            target = max(0, target - 1)
        elif kind and reported:
            found.append(f"reported {kind}")
            target = max(0, target - 1)
        elif kind:
            found.append(f"{'aimed' if target else 'plain'} {kind}")
            last, target = kind, 0
        elif s == toxicity.TARGET:
            if before:
                found.append(f"aimed {before}")
            target = 4
        else:
            target = max(0, target - 1)
    return found


def toxic_score(text, model):
    known = dict(zip(model.codes.tolist(), model.classes.tolist()))
    counts, words = dict.fromkeys(toxicity.PATTERNS, 0), 0
    for clause in re.split("[.,;:!?\n\r]", text or ""):
        symbols = [classes_of(w, known) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", clause)]
        words += len(symbols)
        for pattern in marks_of(symbols):
            counts[pattern] += 1
    found = [counts[p] for p in toxicity.PATTERNS]
    dense = [math.log1p(100 * (found[at] + found[at + 1]) / max(words, 1)) for at in (0, len(found) - 4)]
    x = [1.0, *map(math.log1p, found), *dense]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))


def toxic_texts(rng, n):
    vocabulary = [w for words in toxicity.SEEDS.values() for w in words] + ["table", "grün", "Zorgan", "zorgans", "zorgel", "a", "über", "zor"]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ", ", ". ", "\n", "-", "? "]) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def test_scores_as_by_rules_one_after_the_other(spark):
    rng = random.Random(3)
    base = toxicity._seed_units()
    data, w = next(word_blocks(pa.array(["zorgan"]), ALNUM))
    units = toxicity._units(data, w.start, w.end, w.hash)[0].tolist()
    base |= {units[1]: toxicity.DOUBTFUL, units[3]: toxicity.INSULT}  # beginnings of four and of six letters
    codes = np.array(sorted(base), np.uint64)
    weights = toxicity.PRIOR + np.arange(len(toxicity.PRIOR)) / 10
    model = toxicity.Model(codes, np.array([base[int(c)] for c in codes], np.int8), weights)
    texts = [*toxic_texts(rng, 300), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(docs, model).collect()}
    for n, text in enumerate(texts):
        want = toxic_score(text, model)
        assert abs(got[n][0] - want) < 1e-9 and (got[n][1] == (want >= 0.5) or abs(want - 0.5) < 1e-9)


# ---------------------------------------------------------------- languages


def gram_code(gram):
    x = 0
    for c in gram:
        x = (x * 0x110000 + (ord(c) if c.isalpha() else 0)) % 2**64
    x = (x + (len(gram) << 60)) % 2**64
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 29
    return x >> 49


def language_of(text, model):
    if text is None or not any(c.isalpha() for c in text) or not model.languages:
        return "und", 0.0
    flat = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    counts = {}
    for order in (1, 2, 3):
        for k in range(len(flat) - order + 1):
            code = gram_code(flat[k : k + order])
            counts[code] = counts.get(code, 0) + 1
    value = {c: math.log1p(n) * model.rarity[c] for c, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    logits = [sum(v / norm * model.weights[c, k] for c, v in value.items()) / model.temperature for k in range(len(model.languages))]
    odds = [math.exp(z - max(logits)) for z in logits]
    best = max(range(len(odds)), key=lambda k: (odds[k], -k))
    return model.languages[best], odds[best] / sum(odds)


def test_languages_as_gram_by_gram(spark):
    rng = random.Random(4)
    letters = {"xx": "aeioutnrs", "yy": "äöüßzkwqe", "zz": "абвгдежз"}

    def prose(lang, n):
        return "".join(rng.choice(letters[lang] + "  ,.1") for _ in range(n))

    rows = [(i, prose(lang, 80), lang) for i, lang in enumerate(list(letters) * 40)]
    model = language_id.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [prose(rng.choice(list(letters)), rng.randrange(1, 300)) for _ in range(120)] + ["", None, "12", "A", "mixed вгд äöü text"]
    out = language_id.identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in out:
        lang, score = language_of(texts[r.doc_id], model)
        assert abs(r.score - score) < 1e-9 and r.lang_pred == lang


# ---------------------------------------------------------------- pipeline


def without_shared_lines(rows):
    def key(line):
        return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(FOLD)

    holders = {}
    for doc_id, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            holders.setdefault(k, set()).add(doc_id)
    return [(d, "\n".join(line for line in (t or "").split("\n") if not key(line) or len(holders[key(line)]) < 10)) for d, t in rows]


def contaminated(text, items):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))
    for item in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", item.translate(FOLD))
        n = min(10, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        if any(tuple(words[k : k + n]) in windows for k in range(len(words) - n + 1)):
            return True
    return False


def folder_of(spark, path, rows, labels, items):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_middle_stages_as_by_brute_force(spark, tmp_path):
    """Hot lines, chains and a large group of near copies, benchmark passages across stages."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [" ".join(prose(12)), " ".join(prose(30)), "four words only here"]
    base, rows = prose(50), []
    for i in range(140):
        w = base[:] if i % 3 == 0 else prose(40)
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        lines = [" ".join(w)] + ["A hot line "] * (i % 2) + [f"line of {i % 20}"] + [rng.choice(items)] * (i % 11 == 0)
        if i % 13 == 5:
            lines.append("you idiot. you moron, you scum")
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, "")]
    folder_of(spark, str(tmp_path), rows, [(1, 0, 0)], items)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    wanted = [
        lambda now: [(d, t) for d, t in now if toxic_score(t, model) < 0.5],
        without_shared_lines,
        lambda now: [(d, t) for d, t in now if (d, True) in {(row[0], row[0] == row[2]) for row in similar(now)}],
        lambda now: [(d, t) for d, t in now if not contaminated(t, items)],
    ]
    sizes = [len(kept)]
    for (_, stage), step in zip(corpus_pipeline.STAGES, wanted):
        docs, kept = stage(spark, docs, str(tmp_path)), step(kept)
        assert sorted(map(repr, ((r.doc_id, r.text) for r in docs.collect()))) == sorted(map(repr, kept))
        sizes.append(len(kept))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 20


def test_the_pipeline_of_empty_tables_and_of_repeated_ids(spark, tmp_path):
    folder_of(spark, str(tmp_path / "none"), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    folder_of(spark, str(tmp_path / "twice"), [(1, "one two three four five six")] * 3 + [(1, "another text of the same id"), (None, "no id")], [], [])
    out = corpus_pipeline.run(spark, str(tmp_path / "twice"))
    assert {r.doc_id for r in out.collect()} <= {1, None} and out.count() >= 2
