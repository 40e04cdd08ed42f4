"""Mixing sources to target weights by Pareto order sampling.

Sizes are counted in words. A source's target is shared out among its documents as expected
copies; the whole part of a document's copies is certain, the fraction is the probability of
one copy more. Documents are ranked by the odds of a random number over the odds of that
probability, and the first ones that fill what the certain copies leave of the target are
taken: a sample of fixed size, in words, with unequal probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.ranking import numbered
from paperloom.llm.common import boxed, unboxed
from paperloom.session import materialize

# What a word is, and the decimals of expected copies.
WORD, DECIMALS = r"[^\x20\x09-\x0D]+", 9
ROWS_PER_SLICE = 20_000


def words_in(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draws(doc_id: Column, text: Column, seed: int) -> Column:
    """A random number between 0 and 1 and a tie-break, both of 52 bits, from id and text alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))

    def bits(at):
        return F.conv(F.substring(digest, at, 13), 16, 10).cast("long")

    return F.struct(((bits(1) + F.lit(0.5)) / F.lit(float(1 << 52))).alias("draw"), bits(14).alias("tie"))


def expected_copies(size: Column, rate: Column, most: int, length_power: float) -> Column:
    """Copies of a document that its source's rate asks for; a null rate asks for ``most`` of all."""
    raised = F.pow(size.cast("double"), F.lit(float(length_power)))
    return F.round(F.when(rate.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), rate * raised)), DECIMALS)


def pareto_rank(draw: Column, chance: Column) -> Column:
    """The odds of the draw over the odds of the chance, as a share q / (1 + q), which keeps their order."""
    for_, against = draw * (1 - chance), chance * (1 - draw)
    return for_ / (for_ + against)


def source_targets(sizes: DataFrame, weights: tuple, most: int, share: float) -> DataFrame:
    """``(key, source, source_size)`` with ``target``.

    Sources take weights in code point order, null last, over and over. They divide ``share``
    of all sizes by weight; what a target has over ``most`` times its source's size is
    divided again among the others, until none is above. A round is one sum over sources.
    """
    ordered = sizes.withColumn("_order", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_number") - 1) % len(weights) + 1).cast("int"))
    weighed = materialize(numbered(ordered, "_order", "_number").select("key", "source", "source_size", weight.alias("weight")), "weighed")
    bound, level, before = F.col("source_size") * most, None, 0.0
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    while level is None or level > before:
        full = F.lit(False) if level is None else bound < F.col("weight") * F.lit(level)
        sums = weighed.agg(F.sum(F.when(full, bound)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        before = level or 0.0
        level = (total - (sums.full or 0)) / sums.open if sums.open else float("inf")
    asked = F.col("weight") * F.lit(level)
    return weighed.select("key", "source", "source_size", F.when(bound < asked, bound.cast("double")).otherwise(asked).alias("target"))


def _rates(histogram: DataFrame, targets: DataFrame, most: int, length_power: float) -> DataFrame:
    """``targets`` with ``rate`` and ``room``.

    Expected copies are rate * size ** length_power, ``most`` at the most, and sum to the
    target. The longest documents reach ``most`` first, so a source's rate comes from running
    sums over its distinct sizes, however many documents have them. ``room`` is what the
    certain copies leave of the target. Without a rate every document has ``most`` copies.
    """
    falling = Window.partitionBy("key").orderBy(F.desc("size"))
    words = F.col("size") * F.col("n")
    raised = F.pow(F.col("size").cast("double"), F.lit(float(length_power)))
    steps = histogram.where("size > 0").join(targets, "key").select(
        "key", "size", "n", "target",
        (F.sum(words).over(falling) - words).alias("longer"),
        F.sum(words * raised).over(Window.partitionBy("key").orderBy("size")).alias("weighed"),
    )
    rate = (F.col("target") - most * F.col("longer")) / F.col("weighed")
    fits = steps.withColumn("rate", rate).where(F.col("rate") * raised <= most)
    found = materialize(targets.join(fits.groupBy("key").agg(F.max_by("rate", "size").alias("rate")), "key", "left"), "rates")
    whole = F.floor(expected_copies(F.col("size"), F.col("rate"), most, length_power))
    certain = histogram.join(found, "key").groupBy("key").agg(F.sum(whole * words).alias("certain"))
    return materialize(found.join(certain, "key", "left").select("*", (F.col("target") - F.coalesce("certain", F.lit(0))).alias("room")).drop("certain"), "rates")


def _next_cut(drawn: DataFrame, state: DataFrame, slices: int) -> DataFrame:
    """``state`` moved on: behind its cut, documents no larger than the room are taken in rank order while they fit.

    Ranks are cut into slices; sums a slice tell where the room ends, and only documents of
    that slice are put in order, so no window holds more than a slice of a source. Rows of one id and
    text have one rank and are taken together.
    """
    after = F.struct("rank", "tie") > F.struct("cut_rank", "cut_tie")
    open_ = drawn.join(state.select("key", "room", "cut_rank", "cut_tie"), "key").where(after & (F.col("size") <= F.col("room")))
    open_ = open_.select("key", "room", "size", "rank", "tie", F.floor(F.col("rank") * slices).alias("slice"))
    running = F.sum("words").over(Window.partitionBy("key").orderBy("slice"))
    over = F.col("running") > F.col("room")
    ends = materialize(
        open_.groupBy("key", "room", "slice").agg(F.sum("size").alias("words")).withColumn("running", running).groupBy("key").agg(
            F.sum("words").alias("all_words"), F.min(F.when(over, F.col("slice"))).alias("slice"),
            F.min(F.when(over, F.col("running") - F.col("words"))).alias("sure"),
        ),
        "slice-ends",
    )
    within = open_.join(ends.select("key", "slice", "sure"), ["key", "slice"]).groupBy("key", "room", "sure", "rank", "tie").agg(F.sum("size").alias("words"))
    reached = F.col("sure") + F.sum("words").over(Window.partitionBy("key").orderBy("rank", "tie"))
    last = within.withColumn("reached", reached).where("reached <= room").groupBy("key").agg(
        F.max(F.struct("rank", "tie")).alias("last"), F.max("reached").alias("reached")
    )
    border = F.struct((F.col("slice") / slices).alias("rank"), F.lit(-1).cast("long").alias("tie"))
    beyond = F.struct(F.lit(2.0).alias("rank"), F.lit(0).cast("long").alias("tie"))
    cut = F.when(F.col("all_words").isNull(), F.struct(F.col("cut_rank").alias("rank"), F.col("cut_tie").alias("tie"))).otherwise(
        F.when(F.col("slice").isNull(), beyond).otherwise(F.coalesce("last", border))
    )
    taken = F.when(F.col("slice").isNull(), F.coalesce("all_words", F.lit(0))).otherwise(F.coalesce("reached", "sure"))
    moved = state.join(ends, "key", "left").join(last, "key", "left").withColumns({"cut": cut, "taken": taken})
    step = F.struct(F.col("room").alias("largest"), F.col("cut.rank").alias("rank"), F.col("cut.tie").alias("tie"))
    return materialize(
        moved.select(
            "key", "source_size", "target", "rate", (F.col("room") - F.col("taken")).alias("room"), F.col("cut.rank").alias("cut_rank"),
            F.col("cut.tie").alias("cut_tie"), F.concat("cuts", F.array(step)).alias("cuts"),
        ),
        "cuts",
    )


def mix_sources(
    docs: DataFrame, weights: tuple = (1, 2, 3), share: float = 1.0, most: int = 3, length_power: float = 0.5, passes: int = 3, seed: int = 1,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    A document's ``size`` is its number of words (null or empty: 0), ``source_size`` that of
    its source (null sources are one source), ``target`` the words its source should give
    (``source_targets``), ``copies`` how often the mix takes the document, ``taken`` the
    words that makes. No document is taken more than ``most`` times.

    Expected copies grow with size ** ``length_power`` (0: alike within a source, 1: in
    proportion to size). After whole copies, documents are taken in Pareto order while they
    fit the room left; the next ``passes - 1`` passes go on behind the first that did not
    fit with those no larger than what is left, which brings the words near the target.

    The random number of a document comes from its id and text, so reruns agree. Rows of
    equal source, id and text are taken alike. A null id counts as an empty one. Documents
    without words are never taken. Other columns stay, columns of these names are replaced.
    An empty table gives no rows.

    Documents are not shuffled, unless there are too many sources to broadcast; what is shuffled are
    sums by (source, size) and (source, slice of ranks) and the documents of one slice a source.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))
    whole, drawn_of = F.col(f"`{text}`"), _draws(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed)
    facts = docs.select(key.alias("key"), F.col(f"`{source}`").cast("string").alias("source"), words_in(whole).alias("size"), drawn_of.alias("d"))
    facts = materialize(facts.select("key", "source", "size", "d.draw", "d.tie"), "sizes")
    histogram = materialize(facts.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "size-counts")
    sizes = histogram.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, most, share).drop("source")
    state = _rates(histogram.drop("source"), targets, most, length_power)
    asked = expected_copies(F.col("size"), F.col("rate"), most, length_power)
    chance = F.round(asked - F.floor(asked), DECIMALS)
    drawn = facts.join(state.select("key", "rate"), "key").withColumn("chance", chance).where("chance > 0 AND size > 0")
    drawn = materialize(drawn.select("key", "size", pareto_rank(F.col("draw"), F.col("chance")).alias("rank"), "tie"), "ranks")
    slices = max(64, drawn.count() // ROWS_PER_SLICE)
    empty = F.array().cast("array<struct<largest:double,rank:double,tie:bigint>>")
    state = state.select("*", F.lit(-1.0).alias("cut_rank"), F.lit(0).cast("long").alias("cut_tie"), empty.alias("cuts"))
    for _ in range(passes):
        state = _next_cut(drawn, state, slices)
    rows = boxed(docs, key=key, size=words_in(whole), d=drawn_of).join(state.select("key", "source_size", "target", "rate", "cuts"), "key")
    rows = rows.withColumns({"asked": asked}).withColumns({"chance": chance}).withColumn("rank", pareto_rank(F.col("d.draw"), F.col("chance")))
    chosen = F.exists(
        "cuts", lambda c: (F.col("size") <= c["largest"]) & (F.struct("rank", F.col("d.tie")) <= F.struct(c["rank"], c["tie"]))
    )
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor("asked") + ((F.col("chance") > 0) & chosen).cast("int")).cast("int")
    rows = rows.withColumn("copies", copies)
    return unboxed(
        rows, docs.columns, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), copies=F.col("copies"),
        taken=F.col("copies") * F.col("size"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of a mix as often as it takes them, numbered by ``copy`` from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
