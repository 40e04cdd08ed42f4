"""URL filters as a sort-merge range join of url keys with the intervals of host rules.

A host's key is its labels in reverse order (``com.example.www.``), so a host and all its
subdomains are one interval of keys. Urls and rules are dealt to ranges of keys, sorted, and
swept once: a stack holds the rule hosts whose interval is open, each nested in the one
below. A url looks up the longest fitting path of every host on the stack.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from paperloom.llm.common import ascii_lower, boxed, unboxed

# Keys sampled to find the borders of ranges, and urls a range holds about.
SAMPLED, URLS_PER_RANGE = 20_000, 5_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot; an empty host has the key of no rule."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def range_borders(urls: DataFrame, per_range: int, sampled: int) -> list[tuple[str, str, int]]:
    """Borders (key, path, salt) that cut the urls into ranges of about ``per_range``, or more where ranges would be over ``sampled / 8``.

    They come from at most about ``sampled`` urls, those with the smallest hash of their id,
    and only decide where a url is judged. The salt divides urls that are all alike.
    """
    total = urls.count()
    ranges = max(1, min(-(-total // per_range), sampled // 8))
    if ranges == 1:
        return []
    share = min(1.0, sampled / total)
    chosen = urls.where(F.pmod(F.col("salt"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    keys = sorted((r.key, r.path, r.salt) for r in chosen.select("key", "path", "salt").limit(4 * sampled).toLocalIterator())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def _range_of(borders: list[tuple[str, str, int]]):
    @arrow_udf("int")
    def number(keys: pa.Array, paths: pa.Array, salts: pa.Array) -> pa.Array:
        rows = zip(keys.to_pylist(), paths.to_pylist(), salts.to_pylist())
        return pa.array([bisect_right(borders, row) for row in rows], pa.int32())

    return number


def _ranges_met(borders: list[tuple[str, str, int]]):
    """All ranges that the interval of a rule's host reaches into."""
    hosts = [b[0] for b in borders]

    @arrow_udf("array<int>")
    def numbers(keys: pa.Array) -> pa.Array:
        # "/" follows "." directly, so it closes the interval of keys that begin with "<key>".
        ends = ((bisect_left(hosts, k), bisect_right(hosts, k[:-1] + "/")) for k in keys.to_pylist())
        return pa.array([list(range(a, b + 1)) for a, b in ends], pa.list_(pa.int32()))

    return numbers


def longest_fit(paths: list[str], above: list[int], path: str) -> int:
    """The longest of sorted ``paths`` that begins ``path``, or -1; ``above[i]`` is the longest other path that begins path i."""
    at = bisect_right(paths, path) - 1
    while at >= 0 and not path.startswith(paths[at]):
        at = above[at]
    return at


class _Open:
    """A rule host whose interval is open, with its paths in order."""

    def __init__(self, key: str):
        self.key, self.paths, self.above, self.rules = key, [], [], []

    def add(self, path: str, rule: tuple[str, str]):
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.above[at]
        self.paths.append(path)
        self.above.append(at)
        self.rules.append(rule)


def _sweep(batches):
    """Rules and urls of one range after the other, sorted by (range, key, rules first, path)."""
    here, stack = None, []
    for batch in batches:
        at, keys, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        rules, verdicts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        kept, found = [], []
        for i, number in enumerate(at):
            if number != here:
                here, stack = number, []
            while stack and not keys[i].startswith(stack[-1].key):
                stack.pop()
            if rules[i] is not None:
                if not stack or stack[-1].key != keys[i]:
                    stack.append(_Open(keys[i]))
                stack[-1].add(paths[i], (rules[i], verdicts[i]))
                continue
            best = None
            for host in stack:  # from the shortest host on, so of equal lengths the longer host stays
                fit = longest_fit(host.paths, host.above, paths[i])
                if fit >= 0 and (best is None or len(host.rules[fit][0]) >= len(best[0])):
                    best = host.rules[fit]
            kept.append(i)
            found.append(best or (None, None))
        if kept:
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [rows.column(6), rows.column(7), rows.column(3), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
                names=["row", "host", "path", "rule", "verdict"],
            )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", row_id: tuple[str, ...] = ("page_id",),
    default: str = "allow", per_range: int = URLS_PER_RANGE, sampled: int = SAMPLED,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest (host and path together)
    wins, of equally long ones that of the longer host. A url that no rule fits has a null
    rule and the ``default`` verdict.

    ``row_id`` names columns that tell equal urls apart; they only spread the work.

    A null url, or one without ``://``, has an empty host and path and fits no rule. Hosts
    are taken literally, ports and user names included. Of rules that repeat host and path
    the alphabetically first verdict (allow) counts; rules with a null host, path or verdict
    are left out. Repeated rows are judged one by one; of the given columns those with an
    output's name are replaced. Empty tables give no rows, or the default for every url.

    Each url is shuffled once, to its range of keys; a rule goes to the ranges that its
    host's interval reaches into. Ranges follow the distribution of keys, paths and a salt,
    so one host, or one url, of a third of all rows fills many ranges.
    """
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in row_id], F.col(f"`{url}`"))
    box = boxed(pages, host=url_host(F.col(f"`{url}`")), path=url_path(F.col(f"`{url}`")), salt=salt)
    box = box.select("row", "host", "path", "salt", host_key(F.col("host")).alias("key"))
    ruled = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    ruled = ruled.where("host <> ''").select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    borders = range_borders(box.select("key", "path", "salt"), per_range, sampled)
    empty_row, no_host = F.lit(None).cast(box.schema["row"].dataType), F.lit(None).cast("string")
    starts = ruled.select(
        F.explode(_ranges_met(borders)("key")).alias("range"), "key", F.lit(0).alias("kind"), "path", "rule", "verdict",
        empty_row.alias("row"), no_host.alias("host"),
    )
    points = box.select(
        _range_of(borders)("key", "path", "salt").alias("range"), "key", F.lit(1).alias("kind"), "path", no_host.alias("rule"),
        no_host.alias("verdict"), "row", "host",
    )
    dealt = points.unionByName(starts).repartition(len(borders) + 1, "range").sortWithinPartitions("range", "key", "kind", "path")
    schema = f"row {box.schema['row'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    swept = dealt.mapInArrow(_sweep, schema)
    return unboxed(
        swept, pages.columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), verdict=F.coalesce("verdict", F.lit(default))
    )
