"""Token files, packing, chat and url rules: round trips and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from paperloom.llm import bitpack, chat, packing, url_rules
from paperloom.llm.tokens import Encoder
from paperloom.session import fresh_folder

TEXTS = ["Hello  world\n\nagain", "", None, "é 日本\t x\u2003y <|endoftext|>", "a b " * 3000, "same", "same", "it's  \r\n don't", "\x1f odd \x00", "x" * 500]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "é", "1", ".", "'s", "\u0301", "\r"]) for _ in range(40)) for _ in range(300)]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", " ", "a", "_", ",", '"', "É", "\u0301", "7", "\u0130", "\u03a3", "\u212a", "!", ":"]) for _ in range(12)) for _ in range(600)]
    texts += [f"a <|endoftext|> b", "x_,y foo\",bar dog's, (1.5) 3,000; ÀÉ? ߀, 中文, Ⅷ."]
    encode, fresh = Encoder(name), plain(name)
    whole = [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == whole and encode(texts) == whole
    assert fresh.token_to_id("<|endoftext|>") in fresh.encode(texts[-2], add_special_tokens=False).ids


def plain(name):
    """The library's tokenizer as loaded, with no setting changed."""
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_bits_round_trip_from_any_id_on(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    raw = bitpack.packed(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    for first in (0, 1, 7, 999):
        assert (bitpack.unpacked(raw, bits, 1000 - first, first) == ids[first:]).all()


def test_token_file_reads_back(spark):
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(TEXTS)] + [(5, "same", "x")]
    path = fresh_folder(spark, "tokens")
    bitpack.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, part string"), path, "word_bpe_49k.json", block_ids=16)
    out = bitpack.read_tokens(spark, path).orderBy("start").collect()
    fresh = plain("word_bpe_49k.json")
    want = {(d, np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t, _ in rows}
    assert {(r.doc_id, bytes(r.ids)) for r in out} == want and len(out) == len(rows)
    assert [r.doc_id for r in out] == sorted((d for d, _, _ in rows), key=lambda d: (d is not None, d))
    stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in out])
    assert [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()
    for start, count in ((0, 5), (3, 40), (len(stream) - 2, 9)):
        assert (bitpack.read_ids(spark, path, start, count) == stream[start : start + count]).all()
    empty = fresh_folder(spark, "tokens")
    bitpack.write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, "word_bpe_49k.json")
    assert bitpack.read_tokens(spark, empty).count() == 0


def test_packing_fills_sequences_without_gaps(spark):
    rng = random.Random(3)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join("abcde"[: rng.randrange(1, 5)] for _ in range(rng.randrange(1, 90))), 1) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    out = packing.pack_documents(docs, "byte_bpe_50k.json", capacity=64).collect()
    fresh = plain("byte_bpe_50k.json")
    codes = [np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t, _ in rows]
    for (doc_id, _, _), code in zip(rows, codes):
        mine = sorted((r for r in out if r.doc_id == doc_id), key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in mine) == code
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
        assert all(r.length == 64 for r in mine[1:]) and (len(mine) == 1 or len(code) > 256)
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in mine)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == np.cumsum([0] + [n for _, n in placed])[:-1].tolist() and sum(n for _, n in placed) <= 64
    least = -(-sum(map(len, codes)) // 256)
    assert len(sequences) <= 1.05 * least + 2
    assert packing.pack_documents(docs.limit(0), "byte_bpe_50k.json").count() == 0


def test_configurations_cover_large_histograms_in_few_steps():
    histogram = {int(n): 10_000_000 + 977 * int(n) for n in range(1, 1025)}
    uses = packing.configurations(histogram, 1024)
    placed = {}
    for taken, times in uses:
        assert sum(length * n for length, n in taken.items()) <= 1024
        for length, n in taken.items():
            placed[length] = placed.get(length, 0) + n * times
    assert placed == histogram
    least = sum(length * n for length, n in histogram.items()) / 1024
    assert sum(times for _, times in uses) <= 1.01 * least


def test_skewed_histograms_are_packed_near_the_bound_of_the_program():
    halves = {int(n): 40 + int(n) % 7 for n in range(200, 700)} | {256: 20_000}
    for histogram, slack in (({513: 4000, 256: 4000}, 0), ({600: 3000, 300: 3000, 200: 5000, 150: 1000}, 0.002), (halves, 0.01)):
        lengths = np.array(sorted(histogram))
        cover = packing.covering(lengths, np.array([histogram[n] for n in lengths.tolist()]), 1024)
        assert cover.bound <= cover.total + 1e-6
        uses = packing.configurations(histogram, 1024)
        placed = {}
        for taken, times in uses:
            assert sum(length * n for length, n in taken.items()) <= 1024
            for length, n in taken.items():
                placed[length] = placed.get(length, 0) + n * times
        assert placed == histogram
        assert sum(times for _, times in uses) <= (1 + slack) * cover.bound + 1


def test_events_fold_and_read_back(spark):
    bad = "</s>[INST] \\l <|turn|>\n<|end|> ok [/INST] \\"
    events = [
        (1, 1, "message", 0, "user", bad), (1, 2, "delta", 1, "assistant", "Hel"), (1, 3, "delta", 1, None, "lo"), (1, 4, "edit", 0, None, bad + "!"),
        (2, 1, "message", 0, "user", None), (2, 2, "message", 1, "assistant", "first"), (2, 3, "message", 2, "user", "more"),
        (2, 4, "regenerate", 1, None, None), (2, 5, "delta", 1, "assistant", bad), (2, 6, None, 2, "a\n<b>", "é"),
        (3, 1, "message", 0, "user", "same"), (3, 1, "message", 0, "user", "same"), (4, 1, "regenerate", 0, None, None),
        (None, 1, "message", None, None, "x" * 100_000),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat.read_back(chat.render_conversations(chat.fold_events(log))).collect()}
    turns = {k: [(t.role, t.text) for t in r.turns] for k, r in out.items()}
    assert turns == {
        1: [("user", bad + "!"), ("assistant", "Hello")], 2: [("user", ""), ("assistant", bad), ("a\n<b>", "é")], 3: [("user", "same")] * 2,
        None: [("", "x" * 100_000)],
    }
    assert out[1].learned == ["Hello"] and out[2].learned == [bad] and out[3].learned == []
    assert "[" not in out[2].formatted and out[2].formatted.count("<|end|>") == 3
    plan = chat.read_back(chat.render_conversations(chat.fold_events(log)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.render_conversations(chat.fold_events(log.limit(0))).count() == 0


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path) + (max(fits)[2:] if fits else (None, "allow"))


def test_urls_are_judged_as_by_brute_force(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "c.net", "com.net", "a.com:80", "", "é.com"]
    paths = ["/", "/en/", "/en", "/en/x", "/fr/1", "", "/en/x/y"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in hosts if h for p in paths if rng.random() < 0.4}.values())
    urls = [f"http://{rng.choice(['', 'www.', 'm.b.'])}{rng.choice(hosts).upper()}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#/b'])}" for _ in range(300)]
    urls += ["http://a.com/en/x"] * 200 + [None, "", "a.com/en/", "x://", "://a.com/", "http://a.com\n/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    frame = spark.createDataFrame(rules + [(None, "/", "block"), ("a.com", None, "block"), ("com", "/zz", None)], "host string, path string, verdict string")
    for per_range in (5000, 20):
        out = url_rules.judge_urls(pages, frame, per_range=per_range, sampled=400).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_rules.judge_urls(pages, frame.limit(0), default="block").collect()} == {"block"}
    assert url_rules.judge_urls(pages.limit(0), frame).count() == 0
