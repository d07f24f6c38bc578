"""Joins and set operations the reports share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import LISTING_KEYS


def with_geo(listings: DataFrame, geo: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listings with geography columns, one per (listing key, source)."""
    return listings.join(geo.select(*LISTING_KEYS, *columns), list(LISTING_KEYS))


def having_geo(listings: DataFrame, geo: DataFrame) -> DataFrame:
    """Listings that have a geography row; none of its columns are needed."""
    return listings.join(geo.select(*LISTING_KEYS), list(LISTING_KEYS), "left_semi")


def inline_relation(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Constant rows as a DataFrame of text columns."""
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns))


def split_items(text: str, item: str = "item", separator: str = ","):
    """The parts of a delimited parameter, one per row, as a generator column."""
    return F.explode(F.split(F.lit(text), separator)).alias(item)


def keep_listed(df: DataFrame, column: str, parameter: str) -> DataFrame:
    """Rows whose column is in a delimited parameter, once per row."""
    return df.where(F.array_contains(F.split(F.lit(parameter), ","), F.col(column)))


#: Parts that the members of a grid are dealt into.
GRID_PARTS = 32


def dense_grid(members: DataFrame, observed: DataFrame, member: str, periods: Sequence[str]) -> DataFrame:
    """Every member with every observed period, each pair once.

    The distinct periods are copied to each of a fixed number of parts, and members meet them
    in the part they are dealt to, so no task holds all members and no cross join takes place.
    """
    parts = F.sequence(F.lit(0), F.lit(GRID_PARTS - 1)).cast("array<bigint>")
    slots = observed.select(*periods).distinct().withColumn("_part", F.explode(parts))
    part = F.pmod(F.xxhash64(member), F.lit(GRID_PARTS)).alias("_part")
    return members.select(member).distinct().select(member, part).join(slots, "_part").drop("_part")


def fill_grid(members: DataFrame, facts: DataFrame, member: str, periods: Sequence[str]) -> DataFrame:
    """Facts for every member and every period that some fact has; a cell without facts gets zeros.

    ``facts`` has a row for a cell at the most. It is shuffled by cell once; the distinct periods
    and the join to the grid both read that shuffle, so what is behind it runs once.
    """
    cell = [member, *periods]
    values = [c for c in facts.columns if c not in cell]
    facts = facts.repartition(*cell)
    # Both readers need the same columns, or Spark would plan two shuffles.
    whole = F.max(F.struct(*facts.columns))
    seen = facts.groupBy(*periods).agg(whole.alias("_whole")).where("_whole is not null")
    named = {c: f"_{c}" for c in cell}
    grid = dense_grid(members, seen, member, periods).withColumnsRenamed(named)
    same = all_equal(F.col(new).eqNullSafe(F.col(old)) for old, new in named.items())
    found = grid.join(facts.withColumn("_seen", F.lit(True)), same, "left")
    return found.select(
        *[F.col(new).alias(old) for old, new in named.items()],
        *[
            F.when(F.col("_seen"), F.col(c)).otherwise(F.lit(0).cast(facts.schema[c].dataType)).alias(c)
            for c in values
        ],
    )


def all_equal(tests: Iterable[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def cells_without(members: DataFrame, facts: DataFrame, member: str, periods: Sequence[str], count: str) -> DataFrame:
    """Cells of the grid without a row that ``count`` counts: the anti join of the grid to those facts."""
    return fill_grid(members, facts, member, periods).where(F.col(count) == 0).select(member, *periods)


def region_weights(county_by_region: DataFrame, excluded_region: str | None) -> DataFrame:
    """Distinct regions per county: how often a join by region repeats a listing."""
    rows = county_by_region.select("region", "county").distinct()
    if excluded_region is not None:
        rows = rows.where(F.col("region") != excluded_region)
    return rows.groupBy("county").agg(F.count("*").alias("regions"))
