"""Office and firm ranking by units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.frames import OpenFrame

UNIT_SUMS = ("units", "price_sum", "price_n", "dom_sum", "dom_n")


def ranking_periods(frame: OpenFrame) -> dict[str, tuple[Column, str]]:
    """Ranking period -> (is the listing in it, price column averaged)."""

    def inside(date: str, start: Column, end: Column) -> Column:
        return C.in_open_interval(date, start, end)

    return {
        K.PERIOD_CLOSED: (inside("close_date", frame.cy_start, frame.cy_end), "close_price"),
        K.PERIOD_CONTRACT: (inside("contract_date", frame.cy_start, frame.cy_end), "list_price"),
        K.PERIOD_CLOSED_PRIOR: (inside("close_date", frame.py_start, frame.py_end), "close_price"),
        K.PERIOD_CONTRACT_PRIOR: (
            inside("contract_date", frame.py_start, frame.py_end),
            "list_price",
        ),
    }


def explode_sides(listings: DataFrame, roles=("list_office_key", "buyer_office_key")) -> DataFrame:
    """One row per listing and office on either side of the sale."""
    return C.explode_present(listings, "office_key", F.array(*map(F.col, roles)))


def side_units(listings: DataFrame, frame: OpenFrame, places: Sequence[str]) -> DataFrame:
    """Units, price and days on market sums by place, office and period.

    Sides and periods fan out inside the scan stage and are aggregated before any join,
    so the joins to offices and tabs see one row per place, office and period, however
    many sales one office or town has.
    """
    periods = ranking_periods(frame)
    wanted = None
    for test, _ in periods.values():
        wanted = test if wanted is None else wanted | test
    memberships = F.array(
        *[
            F.when(test, F.struct(F.lit(name).alias("period"), F.col(price).alias("price")))
            for name, (test, price) in periods.items()
        ]
    )
    inside = C.explode_present(listings.where(wanted), "_in", memberships)
    sides = explode_sides(inside).withColumns(
        {
            "GroupType": F.col("_in.period"),
            "price": F.col("_in.price"),
            "dom": C.days_on_market("list_date", "contract_date"),
        }
    )
    return sides.groupBy(*places, "office_key", "GroupType").agg(
        F.count("*").alias("units"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_n"),
        F.sum("dom").alias("dom_sum"),
        F.count("dom").alias("dom_n"),
    )


def add_up(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    return units.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in UNIT_SUMS])


def unit_columns() -> list[Column]:
    average = F.col("price_sum").cast("double") / F.nullif(F.col("price_n"), F.lit(0))
    return [
        F.col("units").alias("NoUnits"),
        average.alias("AvgPrice"),
        C.whole_average(F.col("dom_sum"), F.col("dom_n")).alias("avg_DOM"),
    ]


def dense_rank_units(keys: Sequence[str], units="units") -> Column:
    return F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(units))).cast("bigint")


def unit_block(units: Column) -> Column:
    """Number of the range that whole ``units`` lie in, 64 ranges from each power of two to the next."""
    bits = F.length(F.bin(units.cast("bigint")))
    over = units.cast("double") / F.pow(F.lit(2.0), bits - 1) - 1
    return F.when(units > 0, bits * 64 + F.floor(over * 64).cast("int")).when(units.isNotNull(), 0).otherwise(-1)


def dense_rank_by_blocks(df: DataFrame, keys: Sequence[str], units: str, name: str) -> DataFrame:
    """``df`` with the dense rank of ``units``, largest first, for groups too large for one task.

    Equal units share a rank, so only the distinct ones are ranked: those of a group are dealt to
    ranges of units, ranked within their range, and moved up by the number of distinct units in higher
    ranges. Ranges follow from the values, so a lost task computes the same ones again. Units are whole
    numbers from 0; NULL ranks last.
    """
    keys = list(keys)
    levels = df.select(*keys, units).distinct().withColumn("_block", unit_block(F.col(units)))
    sizes = levels.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    listed = sizes.groupBy(*keys).agg(F.collect_list(F.struct("_block", "_n")).alias("_sizes"))
    offsets = listed.select(*keys, "_sizes", F.explode("_sizes").alias("_own")).select(
        *keys, F.col("_own._block").alias("_block"),
        F.aggregate(
            F.filter("_sizes", lambda s: s["_block"] > F.col("_own._block")), F.lit(0).cast("bigint"), lambda a, s: a + s["_n"]
        ).alias("_above"),
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(F.desc(units)))
    ranks = null_safe_join(levels, offsets, [*keys, "_block"]).select(*keys, units, (F.col("_above") + within).alias(name))
    return null_safe_join(df, ranks, [*keys, units])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on columns in which NULL equals NULL; the left side's key columns stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first distinct row per key; a NULL sorts first."""
    window = Window.partitionBy(key).orderBy(order)
    return df.distinct().withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def firm_key() -> Column:
    """The prefix of an office id in capitals, so that ids that differ in case are of one firm."""
    return F.upper(C.firm_prefix())


def firm_directory(offices: DataFrame) -> DataFrame:
    """One firm name per office id prefix; ids without a prefix have none."""
    firms = offices.select(firm_key().alias("FirmPrefix"), C.firm_name().alias("Firm"))
    return keep_first(firms.where("FirmPrefix != ''"), "FirmPrefix", "Firm")


def rank_limit(own_rank: Column, keys: Sequence[str]) -> Column:
    """Last rank to show: the own one, or the top ranks if that is more.

    ``own_rank`` is the rank on rows of the own office or firm and NULL elsewhere. The
    limit is NULL in groups the own office or firm is absent from, which drops them.
    """
    own = F.max(own_rank).over(Window.partitionBy(*keys))
    return F.when(own.isNotNull(), F.greatest(own, F.lit(K.TOP_RANK).cast("bigint")))


def tab_texts(tabs: DataFrame) -> DataFrame:
    """Header and list of service areas of each tab.

    A missing service area leaves an empty entry in the list.
    """
    area = F.coalesce("service_area", F.lit(""))
    lists = tabs.groupBy("tab_name").agg(
        F.array_join(F.array_sort(F.collect_list(area)), ", ").alias("message_text")
    )
    headers = tabs.select("tab_name", "tab_header").distinct()
    return headers.join(lists, "tab_name").select(
        F.col("tab_name").alias("TabName"), F.col("tab_header").alias("TabHeader"), "message_text"
    )
