"""Views over the reports: year-over-year changes and the ranked display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K

PRICE_POINT_MEASURES = ("total_listings", "total_sold", "total_volume_sold", "months_inventory")


def report_quarter(df: DataFrame, year: int, quarter: int) -> DataFrame:
    """The report quarter, from the year before on."""
    return df.where((F.col("Yr") >= year - 1) & (F.col("Qtr") == quarter))


def yoy_change(value: str, keys=("Area", "Qtr"), year="Yr") -> Column:
    """Change from the year before, on values rounded half to even to whole numbers.

    A missing value counts as 0; the change is NULL from a missing year or from 0. Each
    year compares to the one before it; in the two-year views that is the first one shown.
    """
    whole = F.coalesce(F.bround(F.col(value).cast("double"), 0), F.lit(0.0))
    years = Window.partitionBy(*keys).orderBy(year)
    follows = F.lag(year).over(years) == F.col(year) - 1
    return C.relative_change(whole, F.when(follows, F.lag(whole).over(years)))


def area_yoy(report: DataFrame, year: int, quarter: int) -> DataFrame:
    """Market areas, one row per year of the report quarter, with four changes."""
    shown = report_quarter(report, year, quarter)
    return shown.select(
        "Area", "Qtr", "Yr", "sales_count", "avg_DOM", "MedianPrice", "ActiveListings",
        yoy_change("sales_count").alias("sales_count_change"),
        yoy_change("avg_DOM").alias("avg_DOM_change"),
        yoy_change("MedianPrice").alias("MedianPrice_change"),
        yoy_change("ActiveListings").alias("ActiveListings_change"),
    ).orderBy("Area", "Yr")


def price_point_yoy(report: DataFrame, year: int, band_order: Column) -> DataFrame:
    """Areas by price band: prior and current year and the change of four measures.

    A missing value shows as 0. The change is NULL if the prior value is missing or 0.
    """
    sums = {
        f"{tag}_{m}": F.sum(F.when(F.col("Yr") == y, F.col(m)))
        for m in PRICE_POINT_MEASURES
        for tag, y in (("py", year - 1), ("cy", year))
    }
    wide = report.groupBy("area", "listpricebucket").agg(*[c.alias(n) for n, c in sums.items()])
    columns = []
    for m in PRICE_POINT_MEASURES:
        previous = F.coalesce(F.col(f"py_{m}"), F.lit(0))
        current = F.coalesce(F.col(f"cy_{m}"), F.lit(0))
        columns += [
            previous.alias(f"py_{m}"),
            current.alias(f"cy_{m}"),
            C.relative_change(current, previous).alias(f"{m}_change"),
        ]
    return wide.orderBy("area", band_order).select("area", "listpricebucket", *columns)


def text_order(column: str, texts) -> Column:
    """Sort key: the position of a text in a list, unknown texts last."""
    position = F.array_position(F.array(*map(F.lit, texts)), F.col(column))
    return F.coalesce(F.nullif(position, F.lit(0)), F.lit(len(texts) + 1))


def firm_display(ranking: DataFrame) -> DataFrame:
    """The firm ranking as displayed: firms by rank, each followed by its offices."""
    firm_rank = F.max("FirmRank").over(
        Window.partitionBy("TabName", "GroupType", "FirmPrefix")
    )
    return (
        ranking.withColumns(
            {"_firm": firm_rank, "DisplayName": F.coalesce("OfficeCity", "Firm")}
        )
        .orderBy("TabName", "GroupType", "_firm", "FirmPrefix", F.asc_nulls_first("OfficeRank"))
        .select(
            "TabName", "GroupType", "FirmRank", "OfficeRank", "DisplayName", "MLSID", "NoUnits",
            "PercUnits", "AvgPrice", "avg_DOM",
        )
    )


PERIODS = (K.PERIOD_CLOSED, K.PERIOD_CONTRACT, K.PERIOD_CLOSED_PRIOR, K.PERIOD_CONTRACT_PRIOR)
FIGURES = ("NoUnits", "PercUnits", "AvgPrice", "avg_DOM")


def firm_blocks(ranking: DataFrame) -> DataFrame:
    """One row a tab: for each period an array of its firms by rank, each with an array of its offices.

    Firms of one rank follow by prefix, offices of one rank by city and id. A period without firms is
    an empty array. The arrays are as long as the ranking that is shown.
    """
    firm_row = F.col("FirmRank").isNotNull()
    figures = [F.col(c) for c in FIGURES]
    offices = F.collect_list(F.when(~firm_row, F.struct("OfficeRank", "OfficeCity", "MLSID", *figures)))
    firms = ranking.groupBy("TabName", "GroupType", "FirmPrefix").agg(
        F.max(F.when(firm_row, F.struct("FirmRank", "Firm", *figures))).alias("_firm"),
        F.sort_array(offices).alias("offices"),
    )
    entry = F.struct("_firm.FirmRank", "FirmPrefix", "_firm.Firm", *[f"_firm.{c}" for c in FIGURES], "offices")
    return firms.groupBy("TabName").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("GroupType") == p, entry))).alias(p) for p in PERIODS]
    )


def firm_lines(blocks: DataFrame) -> DataFrame:
    """The blocks as displayed: line by line, the four periods beside each other.

    A firm's line comes before those of its offices. A period with fewer lines ends earlier.
    """
    def lines(period: str) -> Column:
        def line(rank: Column, name: Column, row: Column) -> Column:
            return F.struct(rank.alias("Rank"), name.alias("Name"), *[row[c].alias(c) for c in FIGURES])

        def of_firm(firm: Column) -> Column:
            own = F.transform(firm["offices"], lambda o: line(o["OfficeRank"], F.coalesce(o["OfficeCity"], firm["Firm"]), o))
            return F.concat(F.array(line(firm["FirmRank"], firm["Firm"], firm)), own)

        return F.flatten(F.transform(period, of_firm)).alias(period)

    side_by_side = blocks.select("TabName", *[lines(p) for p in PERIODS])
    rows = side_by_side.select("TabName", F.posexplode(F.arrays_zip(*PERIODS)).alias("_at", "_l"))
    return rows.select(
        "TabName", (F.col("_at") + 1).alias("Line"),
        *[F.col(f"_l.{p}.{c}").alias(f"{p}_{c}") for p in PERIODS for c in ("Rank", "Name", *FIGURES)],
    ).orderBy("TabName", "Line")
