"""Line dedup: lines that many documents share are dropped, the rest is put together again by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, boxed, unboxed
from paperloom.session import materialize

# Fixed value: the blanks that are stripped from both ends of a line.
BLANKS = " \t\n\u000b\u000c\r"


def line_keys(text: Column) -> Column:
    """The digest of each line's key; null for an empty key, which is never dropped."""
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)))
    return F.transform(keys, lambda key: F.when(key != "", F.unhex(F.md5(key.cast("binary")))))


def _in_documents(docs: DataFrame, shared: DataFrame, keys: Column, min_documents: int) -> DataFrame:
    """The keys ``(key, n)`` that enough different documents hold, where some ids have several rows."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    rows = docs.join(materialize(repeated, "repeated-ids"), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(keys)).alias("key"))
    again = rows.join(shared.select("key"), "key", "left_semi").groupBy("key", "doc_id").agg((F.count("*") - 1).alias("more")).where("more > 0")
    often = again.groupBy("key").agg(F.sum("more").alias("more"))
    return shared.join(often, "key", "left").select("key", (F.col("n") - F.coalesce("more", F.lit(0))).alias("n")).where(F.col("n") >= min_documents)


def drop_shared_lines(docs: DataFrame, text: str = "text", min_documents: int = 10) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys found in at
    least ``min_documents`` documents lose all their lines in every document.

    Rows with one ``doc_id`` are one document, however many they are; without that column, or
    with a null in it, every row is a document of its own. A null or empty text has one empty
    line and becomes an empty text. Blank lines stay. Columns called ``n_lines`` or
    ``n_dropped`` are replaced, all others stay.

    Each row adds a key once, so counting needs no distinct pass and a line of every
    document is summed before the shuffle; what rows of a repeated id count too much, for keys
    that pass at all, is taken off again. The table of shared keys is stored, which leaves
    the join's both sides plain shuffles that adaptive execution can split where a key is
    hot. Texts are shuffled once, by a digest of the whole row's text and id.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ids = [F.col(f"`{c}`").cast("string") for c in docs.columns if c == "doc_id"]
    row_key = F.unhex(F.md5(F.concat_ws("\u0001", *ids, whole).cast("binary")))
    keyed = docs.select(row_key.alias("row_key"), line_keys(whole).alias("keys"))
    shared = (
        keyed.select(F.explode(F.array_distinct("keys")).alias("key"))
        .where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_documents)
    )
    shared = materialize(shared, "shared-lines")
    if "doc_id" in docs.columns:
        shared = materialize(_in_documents(docs, shared, line_keys(whole), min_documents), "shared-lines")
    shared = shared.select("key")
    found = (
        keyed.select("row_key", F.posexplode("keys").alias("position", "key")).where("key IS NOT NULL")
        .join(shared, "key", "left_semi")
        .groupBy("row_key").agg(F.collect_set("position").alias("dropped"))
    )
    rows = boxed(docs, row_key=row_key).join(found, "row_key", "left")
    rows = rows.select("row", "dropped", F.split(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), "\n", -1).alias("lines"))
    n_lines, n_dropped = F.size("lines"), F.coalesce(F.size("dropped"), F.lit(0))
    stays = F.when(n_dropped == 0, F.col("lines")).when(n_dropped == n_lines, F.array().cast("array<string>")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("dropped")), lambda i: F.get("lines", i))
    )
    return unboxed(
        rows, docs.columns, **{text: F.array_join(stays, "\n")}, n_lines=n_lines.cast("long"), n_dropped=n_dropped.cast("long")
    )
