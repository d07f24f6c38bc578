"""URL filters as a temporal list join, in DataFrame operations only.

Dated list entries become validity intervals: an entry for (list, pattern) holds from its date until
the next entry for the same (list, pattern). A capture is looked up under every pattern that could
name it (its host, the domains above it, and its path prefixes below the host), and the as-of join
keeps the intervals that contain its fetch time. The most specific active pattern decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def patterns(url: Column) -> Column:
    """The patterns that can name a URL: host and domains, and ``host/segment...`` prefixes.

    Domains have two labels at least, unless the host itself has one.
    """
    name = host(url)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.lit(1 << 20)), ".")
    )
    segments = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda s: s != "")
    prefixes = F.when(F.size(segments) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))),
        lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")),
    )).otherwise(F.array().cast("array<string>"))
    return F.when(name != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, decision, valid_from, valid_to) from dated entries (list, pattern, action, decision, day).

    ``action`` is 'add' or 'remove'. Of several entries of one list and pattern on a day, an 'add' wins
    over a 'remove', and among adds 'allow' over 'block'. Entries with a NULL pattern or day hold never.
    """
    days = (
        entries.where("pattern is not null and day is not null")
        .groupBy("list", "pattern", "day").agg(F.min("action").alias("action"), F.min(F.when(F.col("action") == "add", F.col("decision"))).alias("decision"))
    )
    following = Window.partitionBy("list", "pattern").orderBy("day")
    return days.withColumn("valid_to", F.lead("day").over(following)).where("action = 'add'").select(
        "list", "pattern", "decision", F.col("day").alias("valid_from"), "valid_to"
    )


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, host, n_active, pattern and decision of every capture (page_id, url, fetched).

    ``n_active`` counts the list entries in force at the fetch time that name the URL; ``pattern`` is the
    longest of them (ties: the smaller), and ``decision`` that of its entry, 'allow' before 'block' where
    lists disagree; without an entry it is 'allow' and ``pattern`` is NULL. A NULL or relative URL has an
    empty host and no entry; a NULL fetch time meets no interval. Repeated captures are evaluated once
    and returned as often as they occur. Other columns are not read.

    Only short keys move: a frequent host is first cut to its distinct (pattern, fetch time), so its
    rows meet the list once for each day.
    """
    captures = captures.select("page_id", "url", "fetched")
    keyed = captures.select("page_id", "url", "fetched", F.explode(patterns(F.col("url"))).alias("pattern"))
    asked = keyed.where("fetched is not null").select("pattern", "fetched").distinct()
    spans = intervals(entries).withColumnRenamed("pattern", "named")
    in_force = (
        asked.join(spans, (F.col("pattern") == F.col("named")) & (F.col("fetched") >= F.col("valid_from"))
                   & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
        .groupBy("pattern", "fetched").agg(F.count("*").alias("entries"), F.min("decision").alias("decision"))
    )
    longest = F.struct(-F.length("pattern"), F.col("pattern"), F.col("decision"))
    found = (
        keyed.select("page_id", "url", "fetched", "pattern").distinct()
        .join(in_force, ["pattern", "fetched"])
        .groupBy("page_id", "url", "fetched").agg(F.sum("entries").alias("n_active"), F.min(longest).alias("first"))
    )
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("page_id", "url", "fetched")]
    url = F.col("c.url")
    return captures.alias("c").join(found.alias("f"), same, "left").select(
        "c.page_id", "c.url", "c.fetched", host(url).alias("host"), F.coalesce("f.n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("f.first.pattern").alias("pattern"), F.coalesce("f.first.decision", F.lit("allow")).alias("decision"),
    )
