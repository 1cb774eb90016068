"""URL rules by host and path prefix: a sort-merge range join, in DataFrame functions only.

A host is written with its labels reversed, each with a dot after it (``org.example.``).
A rule for a host and all its subdomains is then an interval of keys: from its own key up
to that key with the last dot made the next character. Intervals of rules are nested or
disjoint. A sweep over the sorted rules keeps the stack of those active and leaves a mark
at each place where it changes; the sorted urls are merged with the marks, so that each
meets the stack that is active at its key. Of that stack, the longest rule whose path the
url's path starts with decides.

Sweeps go by ranges of keys. What is active at a range's start comes from one row for
each range. Ranges are cut by key and then row, so a hot host, or one url many times,
lies in many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize_table

_RULE = "struct<host: string, path: string, verdict: string>"
_HOST = f"struct<key: string, rules: array<{_RULE}>>"
_MARK = f"struct<key: string, rules: array<{_RULE}>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and path up to ``?``, ``#`` or the end.

    Both are empty for a null url or one without ``://``.
    """
    at = F.instr(url, "://")
    # Cut at the first ? or #, whatever stands behind; instr counts from 1.
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(F.substring_index(rest, "#", 1), "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, _UPPER, _LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def reversed_key(host: Column) -> Column:
    """``blog.example.org`` -> ``org.example.blog.``; labels hold no dot, so different hosts have different keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def after(key: Column) -> Column:
    """The end of the interval of keys that start with ``key``: its last dot made the next character, a slash."""
    return F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, *by: str) -> DataFrame:
    """Rows with ``part``, the number of their range of ``by``. Written, so that all uses see the same ranges."""
    return materialize_table(df.repartitionByRange(_parts(df), *by).withColumn("part", F.spark_partition_id()))


def marks(rules: DataFrame) -> DataFrame:
    """(key, rules) at each key where the stack of active rules changes: the stack from there on, without empty hosts.

    rules: host, path, verdict. Repeated rules count once; of two verdicts for one
    host and path ``block`` stays. Rows with a null or empty host or a null verdict
    are void; a null path is empty.
    """
    tidy = rules.select(F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    tidy = tidy.where((F.col("host") != "") & ~F.col("host").rlike("[/?#]") & F.col("verdict").isNotNull()).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = tidy.groupBy(reversed_key(F.col("host")).alias("key")).agg(F.collect_list(F.struct("host", "path", "verdict")).alias("rules"))
    hosts = _ranged(hosts, "key")
    # Active at a range's start: the hosts of which the range's first host is a subdomain, that is one for each of its labels at most.
    firsts = hosts.groupBy("part").agg(F.min("key").alias("first"))
    steps = firsts.withColumn("_l", F.split(F.col("first"), r"\.")).select("part", F.explode(F.transform(F.sequence(F.lit(1), F.size("_l") - 1), lambda i: F.concat(F.array_join(F.slice("_l", F.lit(1), i), "."), F.lit(".")))).alias("key"), "first")
    open_ = steps.where(F.col("key") < F.col("first")).join(hosts.select("key", "rules"), "key").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("key", "rules"))).alias("open"))
    ranges = hosts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("key", "rules"))).alias("hosts")).join(open_, "part", "left")
    empty_stack, empty_marks = F.array().cast(f"array<{_HOST}>"), F.array().cast(f"array<{_MARK}>")
    stacked = lambda stack: F.flatten(F.transform(stack, lambda h: h["rules"]))

    def popped(state: Column, key: Column) -> Column:
        """Take off the hosts whose interval ends at or before ``key`` (null: all), innermost first, with a mark at each end."""
        return F.aggregate(
            F.reverse(state["stack"]), state,
            lambda s, h: F.when(
                key.isNull() | (after(h["key"]) <= key),
                F.struct(
                    F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1).alias("stack"),
                    F.concat(s["marks"], F.array(F.struct(after(h["key"]).alias("key"), stacked(F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).alias("rules")))).alias("marks"),
                ),
            ).otherwise(s),
        )

    def step(state: Column, host: Column) -> Column:
        left = popped(state, host["key"])
        # An array holds the state, so that it is worked out once.
        return F.transform(
            F.array(left),
            lambda s: F.struct(F.concat(s["stack"], F.array(host)).alias("stack"), F.concat(s["marks"], F.array(F.struct(host["key"].alias("key"), stacked(F.concat(s["stack"], F.array(host))).alias("rules")))).alias("marks")),
        )[0]

    start = F.struct(F.coalesce("open", empty_stack).alias("stack"), empty_marks.alias("marks"))
    swept = ranges.select(F.explode(F.aggregate("hosts", start, step, lambda s: popped(s, F.lit(None).cast("string"))["marks"])).alias("m"))
    # A host that is open at the ends of several ranges ends in each of them, and in each its mark says the same: its own
    # hosts above it, as intervals are nested. Starts end with a dot and ends with a slash, so they never meet.
    return swept.select("m.key", "m.rules").dropDuplicates(["key"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page's url.

    rules: host, path, verdict (allow or block). A rule fits its host and all
    subdomains where the url's path starts with the rule's; the longest (host and
    path together; ties: the longer host) wins. ``rule`` is its host and path, null
    where none fits; then ``verdict`` is ``default``. Null, empty and broken urls
    have an empty host and path, so no rule. Repeated rows give repeated rows, null
    ids stay, an empty table gives no row, no rule leaves all to the default.
    Further columns are left out. Very long urls are handled whole.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", reversed_key(F.col("host")))
    none = F.lit(None).cast(f"array<{_RULE}>")
    urls = rows.select("key", F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", none.alias("rules"))
    kept = [F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")]
    changes = marks(rules).select("key", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("row"), *kept, "rules")
    merged = _ranged(urls.unionByName(changes), "key", "kind", "row")
    # One row for each range: its last stack, handed on to the ranges after it.
    last = merged.where(F.col("kind") == 0).groupBy("part").agg(F.max_by("rules", "key").alias("rules"))
    all_parts = merged.sparkSession.range(_parts(merged)).select(F.col("id").cast("int").alias("part"))
    carry = all_parts.join(last, "part", "left").select("part", F.last("rules", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    swept = merged.repartitionByRange(_parts(merged), "part").withColumn("active", F.last("rules", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "kind", "row").rowsBetween(Window.unboundedPreceding, 0)))
    swept = swept.where(F.col("kind") == 1).join(F.broadcast(carry), "part", "left")  # as many rows as there are ranges
    fits = F.filter(F.coalesce("active", "carried"), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("_b", best).select("page_id", "host", "path", F.col("_b.rule").alias("rule"), F.coalesce(F.col("_b.verdict"), F.lit(default)).alias("verdict"))
