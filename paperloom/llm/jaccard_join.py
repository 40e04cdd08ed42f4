"""N-gram Jaccard join: documents whose sets of word shingles overlap, found through position-ordered lists.

Sets are ordered by one global order of shingles (rare first). Two sets can only be similar
enough if they share a shingle of their prefixes, and the places of the first shared one
bound their overlap. Lists of a shingle are therefore kept by (size, position) and skipped
block by block. Within a list the set with the lowest position is compared with all others;
what its answers already join needs no comparison of its own, so a group of near copies
costs one comparison a member instead of one a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, BooleanType

from paperloom.llm.common import small_batches
from paperloom.llm.graphs import components
from paperloom.llm.words import SOLID, window_hashes, word_blocks
from paperloom.session import materialize

SHINGLE = 5
# Fixed value: the contract's similarity 75 / 100 as a ratio of whole numbers.
SIMILAR = (3, 4)
FREQUENT_KEPT = 200_000
POSTINGS_PER_BUCKET = 400_000
_CHUNK = 300_000
SETS_BROADCAST = 200_000
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(texts: pa.Array):
    """(row, sorted distinct shingle hashes) of each text; under five words the whole sequence is the only shingle."""
    for _, w in word_blocks(texts, SOLID):
        code = window_hashes(w.hash, SHINGLE)
        for i in range(w.last - w.first):
            a, b = int(w.bounds[i]), int(w.bounds[i + 1])
            if b - a >= SHINGLE:
                yield w.first + i, np.unique(code[a : b - SHINGLE + 1])
            else:
                yield w.first + i, window_hashes(w.hash[a:b], b - a) if b > a else code[:0]


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _vertex(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _repeated(sets: list[np.ndarray], least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``least`` sets hold, with their counts."""
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    often = counts >= least
    return tokens[often].view(np.int64), counts[often]


def parities(tokens: np.ndarray) -> bytes:
    """A bitmap that every shingle flips one bit of; two or more bits a shingle, a power of two."""
    bits = 64 << max(0, (len(tokens) - 1) // 32).bit_length()
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def most_common(a: bytes, size_a: int, b: bytes, size_b: int) -> int:
    """An upper bound of the intersection: sets differ in at least as many shingles as their bitmaps do in bits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    differing = np.bitwise_xor.reduce(x.reshape(-1, width)) ^ np.bitwise_xor.reduce(y.reshape(-1, width))
    return (size_a + size_b - int(np.bitwise_count(differing).sum())) // 2


@arrow_udf(BooleanType())
def may_be_similar(left: pa.Array, size_left: pa.Array, right: pa.Array, size_right: pa.Array) -> pa.Array:
    out = []
    for a, n, b, m in zip(left.to_pylist(), size_left.to_pylist(), right.to_pylist(), size_right.to_pylist()):
        common = most_common(a, n, b, m)
        out.append(SIMILAR[1] * common >= SIMILAR[0] * (n + m - common))
    return pa.array(out, pa.bool_())


PROFILE = "row_key binary, doc_id long, n int, digest binary, vertex long, bitmap binary, token long, sets long"


def _profiles(docs: DataFrame) -> DataFrame:
    """One row a document with its set's size and digest, and rows with the shingles that many sets of a task hold."""

    def scan(batches):
        names = [c.split()[0] for c in PROFILE.split(", ")]
        types = [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

        def rows(columns, size):
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[n], t) if n in columns else pa.nulls(size, t) for n, t in zip(names, types)], names=names
            )

        kept, held = [], 0
        for batch in batches:
            sizes, digests, bitmaps = np.zeros(len(batch), np.int32), [b""] * len(batch), [b""] * len(batch)
            for i, tokens in shingle_sets(batch.column(2)):
                sizes[i], digests[i], bitmaps[i] = len(tokens), _digest(tokens), parities(tokens)
                kept.append(tokens)
                held += len(tokens)
                if held > 5 * _CHUNK:
                    often, counts = _repeated(kept)
                    yield rows({"token": often, "sets": counts}, len(often))
                    kept, held = [], 0
            yield rows(
                {
                    "row_key": batch.column(0), "doc_id": batch.column(1), "n": sizes, "digest": digests,
                    "vertex": [_vertex(d) for d in digests], "bitmap": bitmaps,
                },
                len(batch),
            )
        if kept:
            often, counts = _repeated(kept)
            yield rows({"token": often, "sets": counts}, len(often))

    return docs.select("row_key", "doc_id", "text").mapInArrow(scan, PROFILE)


def prefix_length(size):
    """How many leading shingles of a set must hold one of any similar set."""
    return size - -(-size * SIMILAR[0] // SIMILAR[1]) + 1


def ordered(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shingles in the global order: by the frequent ones' count, then by hash."""
    known, counts = frequent
    if not len(known):
        return tokens
    found = np.searchsorted(known, tokens)
    found[found == len(known)] = 0
    often = known[found] == tokens
    if not often.any():
        return tokens
    return tokens[np.lexsort((tokens, np.where(often, counts[found], 0)))]


def _packed(token, vertex, size, pos, known) -> bytes:
    return b"".join((
        np.uint32(len(token)).tobytes(), vertex.astype("<i8").tobytes(), size.astype("<u4").tobytes(), pos.astype("<u4").tobytes(),
        token.astype("<u4").tobytes(), (token >> np.uint64(32)).astype("<u2").tobytes(), known.astype("u1").tobytes(),
    ))


def _unpacked(payload: bytes):
    n, at, parts = int(np.frombuffer(payload, "<u4", 1)[0]), 4, []
    for kind in ("<i8", "<u4", "<u4", "<u4", "<u2", "u1"):
        parts.append(np.frombuffer(payload, kind, n, at))
        at += n * parts[-1].itemsize
    vertex, size, pos, low, high, known = parts
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), vertex, size.astype(np.int64), pos.astype(np.int64), known


def _runs(token: np.ndarray) -> np.ndarray:
    """Starts of equal runs, with the end of the last."""
    return np.concatenate(([0], np.flatnonzero(np.diff(token)) + 1, [len(token)])) if len(token) else np.zeros(1, np.int64)


def _prefixes(docs: DataFrame, frequent, buckets: int) -> DataFrame:
    """Prefix postings packed by bucket.

    A shingle that several sets of one task hold is surely shared: its postings go to groups
    of their own, spread over the cluster, and only one marker a task meets in its bucket.
    """

    def pack(columns):
        token, vertex, size, pos = (np.concatenate(c) for c in zip(*columns))
        order = np.lexsort((vertex, token))
        t, v = token[order], vertex[order]
        bounds = _runs(t)
        several = np.zeros(len(t), bool)
        change = np.flatnonzero((t[1:] == t[:-1]) & (v[1:] != v[:-1])) + 1
        several[change] = True
        shared = np.add.reduceat(several, bounds[:-1]) > 0
        direct = np.zeros(len(t), bool)
        direct[order] = np.repeat(shared, np.diff(bounds))
        marker = np.zeros(len(t), bool)
        marker[order[bounds[:-1][shared]]] = True
        place = (token % np.uint64(buckets)).astype(np.int64)
        spread = buckets + int(np.bitwise_xor.reduce(token) % np.uint64(buckets))
        chosen = [(spread, np.flatnonzero(direct))]
        inside = np.flatnonzero(~direct | marker)
        inside = inside[np.argsort(place[inside], kind="stable")]
        edges = np.searchsorted(place[inside], np.arange(buckets + 1))
        chosen += [(b, inside[edges[b] : edges[b + 1]]) for b in range(buckets)]
        chosen = [(g, k) for g, k in chosen if len(k)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g for g, _ in chosen], pa.int32()),
                pa.array([_packed(token[k], vertex[k], size[k], pos[k], marker[k] & (g < buckets)) for g, k in chosen], pa.binary()),
            ],
            names=["bucket", "payload"],
        )

    def scan(batches):
        known, columns, held = frequent.value, [], 0
        for batch in batches:
            for _, tokens in shingle_sets(batch.column(0)):
                if not len(tokens):
                    continue
                n, p = len(tokens), prefix_length(len(tokens))
                columns.append((
                    ordered(tokens, known)[:p] & _LOW48, np.full(p, _vertex(_digest(tokens))), np.full(p, n), np.arange(p),
                ))
                held += p
                if held > _CHUNK:
                    yield pack(columns)
                    columns, held = [], 0
        if columns:
            yield pack(columns)

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(scan, "bucket int, payload binary")


def may_match(size_a, pos_a, size_b, pos_b):
    """Whether sizes and the places of the first shared shingle leave room for enough overlap."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    rest = np.minimum(size_a - pos_a, size_b - pos_b)
    return (low * SIMILAR[1] >= high * SIMILAR[0]) & (rest * sum(SIMILAR) >= SIMILAR[0] * (size_a + size_b))


def _useful(size: np.ndarray, pos: np.ndarray, bounds: np.ndarray, blocks_at_once: int = 256) -> np.ndarray:
    """Entries of each list that any other entry may match, tested by (size, position) block."""
    keep = np.ones(len(size), bool)
    length = np.diff(bounds)
    pairs = bounds[:-1][length == 2]
    fits = may_match(size[pairs], pos[pairs], size[pairs + 1], pos[pairs + 1])
    keep[pairs], keep[pairs + 1] = fits, fits
    for a, n in zip(bounds[:-1][length > 2], length[length > 2]):
        kinds, member, count = np.unique(size[a : a + n] << 32 | pos[a : a + n], return_inverse=True, return_counts=True)
        if len(kinds) <= blocks_at_once:  # longer lists go on whole
            s, p = kinds >> 32, kinds & 0xFFFFFFFF
            fits = may_match(s[:, None], p[:, None], s[None, :], p[None, :])
            np.fill_diagonal(fits, fits.diagonal() & (count > 1))
            keep[a : a + n] = fits.any(axis=1)[member]
    return keep


POSTINGS = "token long, vertex long, size long, pos long"


def _shared_postings(packed: DataFrame, buckets: int) -> DataFrame:
    """Postings of shingles that lie in the prefixes of at least two different sets."""

    def shared(table: pa.Table) -> pa.Table:
        token, vertex, size, pos, known = (np.concatenate(c) for c in zip(*map(_unpacked, table.column("payload").to_pylist())))
        if table.column("bucket")[0].as_py() < buckets:
            order = np.lexsort((known, vertex, token))
            token, vertex, size, pos, known = (x[order] for x in (token, vertex, size, pos, known))
            fresh = np.concatenate(([True], (np.diff(token) != 0) | (np.diff(vertex) != 0) | (np.diff(known) != 0)))
            token, vertex, size, pos, known = (x[fresh] for x in (token, vertex, size, pos, known))
            bounds = _runs(token)
            several, marked = np.diff(bounds) > 1, np.add.reduceat(known, bounds[:-1]) > 0
            keep = np.repeat(several | marked, np.diff(bounds))
            keep &= np.where(np.repeat(marked, np.diff(bounds)), True, _useful(size, pos, bounds)) & (known == 0)
            token, vertex, size, pos = token[keep], vertex[keep], size[keep], pos[keep]
        return pa.table({"token": token.astype(np.int64), "vertex": vertex, "size": size, "pos": pos})

    return packed.groupBy("bucket").applyInArrow(shared, POSTINGS)


@arrow_udf(BinaryType())
def packed_set(texts: pa.Array, digests: pa.Array) -> pa.Array:
    """A text's sorted shingle hashes; null if its set is not the wanted one."""
    wanted, out = digests.to_pylist(), [None] * len(texts)
    for i, tokens in shingle_sets(texts):
        if _digest(tokens) == wanted[i]:
            out[i] = tokens.tobytes()
    return pa.array(out, pa.binary())


@arrow_udf(BooleanType())
def similar_sets(left: pa.Array, right: pa.Array) -> pa.Array:
    """The exact test: 100 * intersection >= 75 * union."""
    out = []
    for a, b in zip(left, right):
        x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(SIMILAR[1] * common >= SIMILAR[0] * (len(x) + len(y) - common))
    return pa.array(out, pa.bool_())


def _fits(a: str, b: str) -> Column:
    """``may_match`` on columns ``size_<x>`` and ``pos_<x>``."""
    size_a, size_b, part, whole = F.col(f"size_{a}"), F.col(f"size_{b}"), *SIMILAR
    rest = F.least(size_a - F.col(f"pos_{a}"), size_b - F.col(f"pos_{b}"))
    return (F.least(size_a, size_b) * whole >= F.greatest(size_a, size_b) * part) & (rest * (part + whole) >= (size_a + size_b) * part)


def _side(lists: DataFrame, name: str) -> DataFrame:
    return lists.select("token", *[F.col(c).alias(f"{c}_{name}") for c in lists.columns if c != "token"])


def _links(pairs: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs of representatives whose sets pass the exact test.

    Bitmaps rule out almost all pairs that are not similar; sets are read again only for the
    documents of the others.
    """
    pairs = pairs.select(F.least("vertex_a", "vertex_b").alias("va"), F.greatest("vertex_a", "vertex_b").alias("vb")).distinct()
    left, right = (classes.select(F.col("vertex").alias(f"v{x}"), F.col("bitmap").alias(f"bits_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    bounded = materialize(pairs, "pairs").join(left, "va").join(right, "vb")
    pairs = materialize(bounded.where(may_be_similar("bits_a", "n_a", "bits_b", "n_b")).select("va", "vb"), "pairs")
    ends = pairs.select(F.explode(F.array("va", "vb")).alias("vertex")).distinct()
    involved = materialize(classes.join(ends, "vertex", "left_semi").select(F.col("rep").alias("doc_id"), "digest", "vertex"), "involved")
    # Up to a fixed number of rows the ids are broadcast, beyond it texts and ids meet in a shuffle.
    few = involved.count() <= SETS_BROADCAST
    texts = named.join(F.broadcast(involved) if few else involved.hint("shuffle_hash"), "doc_id")
    sets = materialize(texts.select("doc_id", "vertex", packed_set("text", "digest").alias("tokens")).where("tokens IS NOT NULL"), "sets")
    left = sets.select(F.col("vertex").alias("va"), F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("vertex").alias("vb"), F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    tested = pairs.join(left, "va").join(right, "vb").select("a", "b", similar_sets("ta", "tb").alias("similar"))
    return materialize(tested.where("similar").select("a", "b"), "links")


def _resolve(lists: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """Components of all similar sets, list by list.

    A round compares each list's leader (lowest position, so fewest shingles of its own) with
    the list's other sets. Lists whose sets are then all joined are answered. The others go
    on without their leader; once the pairs across groups that remain are no more than fifty
    for each posting, their sizes and positions are compared outright, and those that may
    match are tested.
    """
    links, allowed = None, 50 * lists.count() + 5_000_000
    while True:
        spot = F.shiftleft("pos", 32) + F.col("size")
        leads = materialize(
            lists.groupBy("token").agg(F.min(spot).alias("spot"), F.min_by("vertex", spot).alias("vertex_a"))
            .select("token", "vertex_a", (F.shiftright("spot", 32)).alias("pos_a"), F.col("spot").bitwiseAND(0xFFFFFFFF).alias("size_a")),
            "leads",
        )
        led = _side(lists.select("token", "vertex", "size", "pos"), "b").join(leads, "token").where("vertex_a <> vertex_b")
        found = _links(led.where(_fits("a", "b")).select("vertex_a", "vertex_b"), classes, named)
        links = found if links is None else links.union(found)
        labels = components(links)
        root = F.coalesce("label", "rep").alias("root")
        roots = materialize(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("vertex", root), "roots")
        rest = led.select("token", *[F.col(f"{c}_b").alias(c) for c in ("vertex", "size", "pos")]).join(roots, "vertex")
        unanswered = rest.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
        lists = materialize(rest.join(unanswered, "token", "left_semi"), "lists")
        grouped = lists.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")
        )
        crossing = grouped.agg(F.sum("pairs")).first()[0]
        if crossing is None:
            return labels
        if crossing <= allowed:
            across = _side(lists, "a").join(_side(lists, "b"), "token").where("root_a <> root_b AND vertex_a < vertex_b")
            return components(links.union(_links(across.where(_fits("a", "b")).select("vertex_a", "vertex_b"), classes, named)))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row_key, doc_id, n_shingles, component_id)`` for every row.

    Words lie between ASCII blanks, A-Z lower-cased. A set holds the distinct runs of five
    words; a shorter text is one run. Sets link when 100 * intersection >= 75 * union, and
    ``component_id`` is the smallest doc_id reachable by links, the row's own included.

    A text without words has an empty set and links with nothing, nor does a row whose doc_id
    is null; its component is then its own doc_id. Rows with equal sets are one class, so
    copies add nothing to the work on pairs; repeated rows get equal results. ``row_key`` is a
    digest of id and text.

    The frequent shingles that come last in the global order are counted over all sets, by
    task: every shingle of more than two sets per two million shingles is seen, and the
    ``FREQUENT_KEPT`` most frequent are kept, which only decides how soon lists can be
    skipped, never what links. Postings are sent packed, and only shingles of two sets or
    more become rows. Bitmaps of two bits a shingle bound the overlap of a pair of lists; sets
    are read again only for documents of pairs that the bound lets through.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("row_key", row_key("doc_id", "text"))
    with small_batches(spark):
        profiles = materialize(_profiles(named), "profiles")
        rows = profiles.where("digest IS NOT NULL")
        classes = materialize(
            rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest", "vertex", "bitmap", "n").agg(F.min("doc_id").alias("rep")), "classes"
        )
        often = profiles.where("token IS NOT NULL").groupBy("token").agg(F.sum("sets").alias("sets")).orderBy(F.desc("sets"), "token").limit(FREQUENT_KEPT).toPandas()
        order = np.argsort(often["token"].to_numpy(np.int64).view(np.uint64))
        frequent = spark.sparkContext.broadcast(
            (often["token"].to_numpy(np.int64).view(np.uint64)[order], often["sets"].to_numpy(np.int64)[order])
        )
        n = F.col("n").cast("long")
        postings = rows.agg(F.sum(n - F.ceil(n * SIMILAR[0] / SIMILAR[1]) + 1)).first()[0] or 0
        buckets = max(1, -(-int(postings) // POSTINGS_PER_BUCKET))
        lists = materialize(_shared_postings(_prefixes(named, frequent, buckets), buckets), "postings")
        labels = _resolve(lists, classes, named)
    named_classes = materialize(
        classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("root")), "classes"
    )
    joined = rows.join(named_classes, "digest", "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "row_key", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    )


def row_key(doc_id: str, text: str) -> Column:
    """A digest of a row's id and text."""
    parts = F.concat_ws("\u0001", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.coalesce(f"`{text}`", F.lit("")))
    return F.unhex(F.md5(parts.cast("binary")))


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component; of repeated rows one stays.

    Rows with a null doc_id stay, too, repeated ones once.
    """
    named = similar_documents(docs, doc_id, text)
    stays = named.where("component_id IS NULL OR component_id = doc_id").select(F.col("row_key").alias("_stays")).distinct()
    box = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(doc_id, text).alias("_key"))
    kept = box.join(stays, F.col("_key") == F.col("_stays"), "left_semi").dropDuplicates(["_key"])
    return kept.select("row.*")
