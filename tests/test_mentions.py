"""Mentions of large dictionaries against a greedy that takes one literal after the other."""

import random
import re

import pyarrow as pa
import pytest

from paperloom.operators import mentions as mn
from paperloom.operators import triples as tp


def greedy(text, aliases):
    """Longest literals first, each from the left to the right, none over a place that is taken."""
    taken, out = [], []
    for literal in sorted(set(aliases), key=lambda a: (-len(a), a)):
        quoted = re.escape(literal)
        word = literal[0].isalnum() and literal[-1].isalnum()
        for m in re.finditer(rf"(?i)\b{quoted}\b" if word else f"(?i){quoted}", text):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                out.append((m.start(), m.end(), literal.lower()))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_dictionary_as_by_a_greedy(spark, shard_bytes):
    rng = random.Random(5)
    words = ["mt-nd4", "nd4", "complex", "i", "complex i", "a b", "b c d", "b", "ÉCole", "m.3243a>g", ">g", "x_y", "the the", "-", "a a a"]
    aliases = words + [" ".join(rng.sample(words, 2)) for _ in range(15)]
    texts = [rng.choice(["", " "]).join(rng.choice([w, w.upper(), " ", ", ", "z", "_"]) for w in rng.choices(words, k=rng.randint(0, 30))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    table = spark.createDataFrame([(a, "T", a.lower()) for a in aliases] + [("", "T", "x"), (None, "T", "x")], "alias string, entity_type string, normalized_id string")
    got = {}
    for r in mn.dictionary_mentions(docs, table, shard_bytes).collect():
        assert texts[r.doc_id][r.start : r.end] == r.mention
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.normalized_id))
    want = {n: found for n, t in enumerate(texts) if (found := greedy(t, [a.lower() for a in aliases]))}
    assert {n: sorted(set(v)) for n, v in got.items()} == want
    assert mn.dictionary_mentions(docs, table.limit(0)).count() == 0 and mn.dictionary_mentions(docs.limit(0), table).count() == 0


def test_small_dictionaries_agree_with_the_compiled_one(spark):
    docs = spark.createDataFrame([(1, "The m.3243A>G variant causes melas; MT-ND4 and PARKIN in complex i."), (2, "ND4 PRKN nd4x")], "doc_id long, text string")
    table = spark.createDataFrame([(a.literal, a.label, a.entity_id) for a in tp.MENTIONS], "alias string, entity_type string, normalized_id string")
    columns = ["doc_id", "start", "end", "mention", "entity_type", "normalized_id"]
    assert sorted(mn.dictionary_mentions(docs, table).select(columns).collect()) == sorted(tp.extract_mentions(docs).select(columns).collect())


def test_no_literal_of_a_large_dictionary_is_in_the_plan(spark):
    aliases = spark.range(100_000).selectExpr("concat('name', id, ' of ', id % 7) AS alias", "'T' AS entity_type", "CAST(id AS STRING) AS normalized_id")
    docs = spark.createDataFrame([(1, "here is name4711 of 0, name4711 of 00 and NAME99999 OF 4.")], "doc_id long, text string")
    found = mn.dictionary_mentions(docs, aliases)
    assert len(found._jdf.queryExecution().toString()) < 20_000
    assert sorted((r.start, r.normalized_id) for r in found.collect()) == [(8, "4711"), (42, "99999")]


def test_hits_of_a_frequent_word_stay_or_are_spread(spark):
    """Every document says one word: its hits aren't shuffled, or not by the word alone where meanings outgrow a shard."""
    docs = spark.range(400).selectExpr("id AS doc_id", "'the end' AS text")
    table = spark.createDataFrame([("the", "T", f"m{n}" * 9) for n in range(3)] + [("end", "T", "x")], "alias string, entity_type string, normalized_id string")
    for shard_bytes, spread in ((1 << 20, False), (40, True)):
        found = mn.dictionary_mentions(docs, table, shard_bytes)
        assert found.count() == 1600 and found.groupBy("doc_id").count().where("count <> 4").count() == 0
        plan = found._jdf.queryExecution().toString()
        assert not re.search(r"hashpartitioning\(literal#\d+, \d+\)", plan) and ("part#" in plan) == spread


def test_a_batch_hands_on_its_hits_in_pieces(monkeypatch):
    monkeypatch.setattr(mn, "HITS_AT_ONCE", 5)
    rows = [[(0, 3, 1, "the")] * n for n in (0, 2, 3, 0, 9, 1, 0)]
    parts = list(mn._pieces(pa.array(range(7), pa.int64()), iter(rows)))
    assert [len(p) for p in parts] == [3, 2, 2]
    got = [(r["doc_id"], len(r["hits"])) for p in parts for r in p.to_pylist()]
    assert got == [(n, len(hits)) for n, hits in enumerate(rows)] and parts[0].to_pylist()[1]["hits"][0] == {"start": 0, "end": 3, "literal": 1, "mention": "the"}
    assert mn._batch(pa.array([8], pa.int64()), [[]]).to_pylist() == [{"doc_id": 8, "hits": []}]


def test_words_are_looked_up_where_no_gap_is_in_them():
    """Literals of one run of word characters need no automaton, and are found where an automaton of all finds them."""
    literals = list(enumerate(["the", "The", "other", "x_y", "ÉCole", "a1", "complex i", ">g", "_x", "i", "ια", "complex"]))
    machine = mn.automaton(literals)
    assert machine.words == {"the": 0, "other": 2, "x_y": 3, "école": 4, "a1": 5, "i": 9, "ια": 10, "complex": 11} and len(machine.others) == 3
    by_automaton = mn.automaton([])
    by_automaton.others = machine.all
    rng = random.Random(6)
    pieces = ["the", "THE", "other", "x_y", "_x", "école", "É", "a1", "complex i", "m>g", " ", " ", ",", "_", "\u0345α", "ι", "α", "ß", "İ", ""]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        hits = list(mn.occurrences(machine, text))
        assert sorted(hits) == sorted(mn.occurrences(by_automaton, text)), text
        free = [h for h in hits if not any(a != h and a[0] < h[1] and h[0] < a[1] for a in hits)]
        assert set(free) <= set(mn.longest_first(hits)) and (len(free) < len(hits) or mn.longest_first(hits) == sorted(hits))
