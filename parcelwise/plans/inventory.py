"""Active listings as a time series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import intervals
from .counties import CountyScope, county_rows
from .market_areas import AreaRules, area_rows

Tables = Mapping[str, DataFrame]


def area_inventory(
    t: Tables, first_day, last_day, rules: AreaRules | None = None, every: str = "day"
) -> DataFrame:
    """Residential listings on the market by market area, on each day of a range.

    The figures of a day are the inventory that ``market_area`` shows for that evaluation date.
    """
    first, last = C.date_literal(first_day), C.date_literal(last_day)
    relevant = C.open_or_closed_since(first) & (F.col("list_date") < last)
    rows = area_rows(t["listings"].where(relevant), t, rules or AreaRules(), "Area")
    return intervals.inventory_curve(rows, ["Area"], first, last, every)


def county_inventory(
    t: Tables, first_day, last_day, scope: CountyScope | None = None, every: str = "month"
) -> DataFrame:
    """Listings on the market by county and property class, on each first day of a month."""
    scope = scope or CountyScope()
    first, last = C.date_literal(first_day), C.date_literal(last_day)
    relevant = C.open_or_closed_since(first) & (F.col("list_date") < last)
    homes = t["listings"].where(F.col("property_type").isin("Residential", "Land") & relevant)
    rows = county_rows(homes, t, scope).where(scope.covered())
    rows = rows.withColumn("PropertyType", C.property_class())
    return intervals.inventory_curve(rows, ["County", "PropertyType"], first, last, every, F.col("weight"))
