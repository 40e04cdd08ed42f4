"""Hashed bag-of-terms vectors and cosine similarity."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import RANKING_STOP_WORDS, TOKEN, WORD, tokens

DIMENSION = 768
_PASSED_OVER = frozenset(RANKING_STOP_WORDS)
# Rows that are compared at once.
ROWS_AT_ONCE = 256


def terms(text: Column) -> Column:
    """Tokens followed by the pairs of neighbouring tokens."""
    words = tokens(text)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def bucket(term: Column, salt: str, dimension: int = DIMENSION) -> Column:
    """First four digest bytes of ``salt:term`` modulo the dimension."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), term), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimension).cast("int")


def bucket_with(salt: str, dimension: int = DIMENSION):
    """``bucket`` of one salt, for use on arrays of terms."""

    def of(term: Column) -> Column:
        return bucket(term, salt, dimension)

    return of


def buckets(text: Column, salt: str, dimension: int = DIMENSION) -> Column:
    """One bucket number per term, repeats kept: the vector in its most compact lossless form."""
    return F.transform(terms(text), bucket_with(salt, dimension))


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of unequal length are an error, not a silent truncation."""
    product = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    return F.when(F.size(a) == F.size(b), product).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("vector size mismatch"), F.size(a), F.size(b)))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector has similarity zero with everything."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def count_matrix(lists: pd.Series, dimension: int) -> np.ndarray:
    """Rows of bucket counts, scaled to unit length."""
    rows = len(lists)
    sizes = np.fromiter((0 if x is None else len(x) for x in lists), dtype=np.int64, count=rows)
    if sizes.sum() == 0:
        return np.zeros((rows, dimension))
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists if x is not None and len(x)])
    owner = np.repeat(np.arange(rows, dtype=np.int64), sizes)
    counts = np.bincount(owner * dimension + flat, minlength=rows * dimension)
    return _unit_rows(counts.reshape(rows, dimension).astype(float))


def _unit_rows(counts: np.ndarray) -> np.ndarray:
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)


def term_buckets(start, terms: list[bytes], dimension: int = DIMENSION) -> np.ndarray:
    """First four digest bytes of each term after the salt, modulo the dimension."""

    def digest(term: bytes) -> bytes:
        hashed = start.copy()
        hashed.update(term)
        return hashed.digest()[:4]

    return np.frombuffer(b"".join(map(digest, terms)), ">u4").astype(np.int64) % dimension


def _text_rows(texts, salt: str, dimension: int) -> np.ndarray:
    """Rows of bucket counts (``buckets``) of some texts, scaled to unit length; each different term of them is hashed once."""
    cut = [words_of(text if isinstance(text, str) else None) for text in texts]
    row = np.repeat(np.arange(len(cut)), [len(words) for words in cut])
    coded = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [w.encode() for w in coded.dictionary.to_pylist()]
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs, pair = np.unique(code[inside] * max(1, len(words)) + code[inside + 1], return_inverse=True)
    first, second = np.divmod(pairs, max(1, len(words)))
    terms = [*words, *(words[x] + b" " + words[y] for x, y in zip(first.tolist(), second.tolist()))]
    found = term_buckets(hashlib.sha256(f"{salt}:".encode()), terms, dimension)
    place = np.concatenate((row, row[inside])) * dimension + found[np.concatenate((code, len(words) + pair))]
    return _unit_rows(np.bincount(place, minlength=len(cut) * dimension).reshape(len(cut), dimension).astype(float))


def words_of(text: str | None) -> list[str]:
    """``tokens`` of one text."""
    if text is None:
        return []
    return re.findall(TOKEN, text.lower()) if text.isascii() else [w.lower() for w in re.findall(TOKEN, text)]


def content_words_of(text: str | None) -> list[str]:
    """``content_words`` of one text."""
    if text is None:
        return []
    found = re.findall(WORD, text.lower()) if text.isascii() else [w.lower() for w in re.findall(WORD, text)]
    return [w for w in found if w not in _PASSED_OVER]


def text_cosine(salt: str, dimension: int = DIMENSION):
    """Arrow function over two text columns of the same row: the cosine of their ``buckets``.

    A few rows are compared at a time, so memory doesn't follow the batch; a text that several
    of them share is read once.
    """

    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for at in range(0, len(left), ROWS_AT_ONCE):
            sides = [pd.factorize(side.iloc[at : at + ROWS_AT_ONCE], use_na_sentinel=False) for side in (left, right)]
            a, b = (_text_rows(texts, salt, dimension)[place] for place, texts in sides)
            out.append((a * b).sum(axis=1))
        return pd.Series(np.concatenate(out))

    return similarity
