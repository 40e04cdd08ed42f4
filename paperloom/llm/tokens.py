"""Token ids of whole texts by a public tokenizer file, with the ids of frequent pieces kept in each worker.

A tokenizer never joins what lies on both sides of a blank (it may join the blank with what
follows), nor a Latin letter or digit with the punctuation behind it. So a text is cut there,
and most pieces are looked up instead of being encoded again. Where a text holds a special
token, unusual white space or control characters it is encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from paperloom.llm.common import worker_state

# Ids kept per worker, the longest piece that is kept, and how many new ones are encoded at once.
PIECES_KEPT, PIECE_LENGTH, AT_ONCE = 600_000, 32, 400
BORDER = "<|endoftext|>"  # fixed value: a special token of both vocabulary files
MARK = "<|"  # fixed value: how special tokens begin
# White space that is no blank, tab or line break, and ASCII control characters.
UNUSUAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0 ᠎ -‏    ⁠　﻿]")
# Pieces; the one Latin letter left out, U+0130, ends in a combining mark when it is lower-cased.
PIECES = re.compile(r" ?[^ \t\r\n.,;:!?]++(?![^ \t\r\n])| ?\w*[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f](?=[.,;:!?])| ?[^ \t\r\n]+|[ \t\r\n]+(?![^ \t\r\n])|[ \t\r\n]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the tokenizer does without adding special tokens."""

    def __init__(self, name: str, pieces_kept: int = PIECES_KEPT):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.border = self.tokenizer.token_to_id(BORDER)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not all(t.startswith(MARK) for t in specials):
            raise ValueError(f"{name} has special tokens that don't begin with {MARK}")
        # Where the tokenizer lower-cases anyway, pieces that differ in that alone are kept once.
        self.lowers = self.tokenizer.encode("Az", add_special_tokens=False).ids == self.tokenizer.encode("az", add_special_tokens=False).ids
        self.kept: dict[str, bytes] = {}
        self.pieces_kept = pieces_kept

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]):
        """(piece, ids) of each piece. The special token is the border between many pieces of one call; no piece holds it."""
        for at in range(0, len(pieces), AT_ONCE):
            group = pieces[at : at + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([BORDER.join(group)], add_special_tokens=False)[0].ids, "<u4")
            borders = np.flatnonzero(ids == self.border)
            raw, ends = ids.tobytes(), [*(4 * borders).tolist(), 4 * len(ids)]
            yield from zip(group, (raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)))

    def _cut(self, text: str) -> list[str] | None:
        if MARK in text or UNUSUAL.search(text):
            return None
        return PIECES.findall(text.encode().translate(_LOWER).decode() if self.lowers else text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        kept = self.kept
        cut = [self._cut(t) for t in texts]
        codes = [None if pieces is None else list(map(kept.get, pieces)) for pieces in cut]
        holes = [[i for i, code in enumerate(found) if code is None] if found and None in found else () for found in codes]
        rare = dict(self._new(list({pieces[i] for pieces, gaps in zip(cut, holes) for i in gaps})))
        out = []
        for text, pieces, found, gaps in zip(texts, cut, codes, holes):
            for i in gaps:
                found[i] = rare[pieces[i]]
            out.append(self._encoded([text])[0] if pieces is None else b"".join(found))
        for piece, code in rare.items():  # frequent pieces come early, so a full table is left as it is
            if len(kept) >= self.pieces_kept:
                break
            if len(piece) <= PIECE_LENGTH:
                kept[piece] = code
        return out


def encoder(name: str, pieces_kept: int = PIECES_KEPT) -> Encoder:
    return worker_state(f"encoder {name} {pieces_kept}", lambda: Encoder(name, pieces_kept))


def encoded_rows(texts: pa.Array, name: str, block: int = 1 << 20, pieces_kept: int = PIECES_KEPT):
    """The ids of each text, in blocks of about a million characters; a null is an empty text.

    ``pieces_kept`` bounds what a worker keeps (some 200 bytes a piece); it changes the time, not the ids.
    """
    encode, waiting, held = encoder(name, pieces_kept), [], 0
    for text in texts:
        waiting.append(text.as_py() or "")
        held += len(waiting[-1])
        if held >= block:
            yield from encode(waiting)
            waiting, held = [], 0
    yield from encode(waiting)


def vocabulary_size(name: str) -> int:
    return encoder(name).tokenizer.get_vocab_size(with_added_tokens=True)
