"""Text column functions. All stay on the JVM and touch one row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token, word and layout patterns whose results must stay the same.
TOKEN = r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*"
WORD = r"[A-Za-z][A-Za-z0-9\-]{2,}"
KEYWORD = r"[a-zA-Z][a-zA-Z\-]{2,}"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
WHITE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WIDE = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Printable ASCII is ruled in or out first, which settles most characters with one test.
SPACE = f"[[^!-~]&&[\t-\r\u001c-\u0020{_WIDE}]]"
NO_SPACE = f"[!-~[^\t-\r\u001c-\u0020{_WIDE}]]"
# A run of white space that is not already one single blank.
UNEVEN = f" {SPACE}+|[[^ -~]&&[\t-\r\u001c-\u001f{_WIDE}]]{SPACE}*"

# Words that rankings and questions pass over.
RANKING_STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "had", "but",
    "not", "into", "than", "between", "which", "what", "how", "why", "when", "where", "who", "does", "did",
    "can", "could", "would", "should", "may", "might", "will", "shall", "their", "there", "these", "those",
    "such", "also", "been", "being", "about", "more", "most",
)
QUESTION_STOP_WORDS = (
    "what", "how", "why", "when", "which", "where", "who", "the", "and", "are", "does", "for", "from", "with",
    "into", "this", "that", "these", "those", "have", "has", "had", "you", "your", "our", "their", "can",
    "could", "would", "should", "shall", "will", "may", "might", "about", "between",
)


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.trim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """Trim, and turn each inner run of white space into one blank."""
    return F.regexp_replace(strip(text), UNEVEN, " ")


def lines(text: Column) -> Column:
    """Split at every line break character."""
    return F.split(text, LINE_BREAK)


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def tokens(text: Column) -> Column:
    """Lower-cased tokens in text order; hyphens and underscores inside a token are kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def distinct_tokens(text: Column) -> Column:
    """First-seen distinct tokens."""
    return F.array_distinct(tokens(text))


def content_words(text: Column) -> Column:
    """Lower-cased words of three or more characters without stop words (repeats kept)."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    return F.filter(words, lambda w: ~w.isin(*RANKING_STOP_WORDS))


def question_keywords(text: Column) -> Column:
    """Words of a question that say what it is about."""
    words = F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*QUESTION_STOP_WORDS))


def sentences(text: Column) -> Column:
    """Sentences end in . ! or ? followed by white space; blanks are dropped."""
    parts = F.transform(F.split(text, f"(?<=[.!?]){SPACE}+"), strip)
    return F.filter(parts, lambda s: s != "")


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a blank and closed with an ellipsis."""
    flat = F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    cut = F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?s) [^ ]*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def beginning(text: Column, limit: int) -> Column:
    """As much of a text as ``shorten`` looks at for any limit up to this one."""
    whole = strip(text)
    return F.when(F.length(whole) <= limit + 1, whole).otherwise(F.concat(F.substring(whole, 1, limit + 1), F.lit(".")))


def first_sentence(text: Column) -> Column:
    """Text up to the first sentence end that an upper-case letter or digit follows."""
    head = F.element_at(F.split(strip(text), f"(?<=[.!?]){SPACE}+(?=[A-Z0-9])", 2), 1)
    return F.regexp_replace(head, r"\.+$", "")


def hex_id(digest: Column, length: int) -> Column:
    return F.substring(digest, 1, length)


def running_starts(lengths: Column, gaps: Column) -> Column:
    """Start offsets of the gaps between pieces.

    ``lengths`` are the piece lengths, ``gaps`` the lengths of what lies between
    piece i and piece i+1 (one fewer); the result has one offset per gap.
    """
    pairs = F.arrays_zip(F.slice(lengths, 1, F.size(gaps)).alias("p"), gaps.alias("g"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        pairs,
        begin,
        lambda acc, pair: F.struct(
            (acc["at"] + pair["p"] + pair["g"]).alias("at"),
            F.array_append(acc["starts"], acc["at"] + pair["p"]).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def match_spans(text: Column, pattern: str, groups: dict[str, int]) -> Column:
    """Every match of a pattern with its span: array<struct<start,end,...groups>>."""
    fields = ",".join(["start:int", "end:int", *[f"{name}:string" for name in groups]])
    none = F.array().cast(f"array<struct<{fields}>>")

    def spans(whole: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        starts = running_starts(F.transform(pieces, F.length), F.transform(whole, F.length))
        # Groups are cut from the short matches, so a text with matches is scanned twice however many there are, another once.
        return F.transform(
            F.arrays_zip(whole.alias("whole"), starts.alias("start")),
            lambda m: F.struct(
                m["start"].alias("start"),
                (m["start"] + F.length(m["whole"])).alias("end"),
                *[F.regexp_extract(m["whole"], pattern, index).alias(name) for name, index in groups.items()],
            ),
        )

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: F.when(F.size(whole) == 0, none).otherwise(spans(whole)))


def exploded(df: DataFrame, keep: list, array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element, empty arrays dropped.

    The outer form plus a filter on the element keeps Spark from adding a
    ``size(array) > 0`` filter that would compute a costly array twice.
    """
    if position:
        out = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    else:
        out = df.select(*keep, F.explode_outer(array).alias(name))
    return out.where(F.col(name).isNotNull())


def inlined(df: DataFrame, keep: list, structs: Column, present: str) -> DataFrame:
    """One row per struct with its fields as columns; ``present`` is a field that is never null."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(present).isNotNull())
