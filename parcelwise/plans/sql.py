"""Reports that SQL users call with arguments: table functions over views of the listings.

A call is part of the query's plan: nothing runs before the query does, arguments may be literals or
session variables, and what they say about dates reaches the scan of the listings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators.intervals import market_interval
from .market_areas import AreaRules, area_rows

Tables = Mapping[str, DataFrame]
VIEW = "market_area_listings"


def quoted(texts: Sequence[str]) -> str:
    return ", ".join("'" + t.replace("'", "\\'") + "'" for t in texts)


def since(day: str) -> str:
    """``open_or_closed_since`` in SQL."""
    return f"(standard_status in ({quoted(K.STATUS_ON_MARKET)}) or close_date >= {day} or status_date >= {day})"


def area_view(t: Tables, rules: AreaRules, breaks: Sequence[int]) -> DataFrame:
    """Residential listings once per market area, with their bands and their days on the market."""
    come, gone = market_interval()
    rows = area_rows(t["listings"], t, rules, "Area")
    top = len(breaks) + 1
    return rows.select(
        "Area", "standard_status", "list_date", "close_date", "status_date", "list_price", "close_price",
        C.price_band("list_price", breaks, top).alias("list_band"),
        C.price_band("close_price", breaks, top).alias("close_band"),
        come.alias("on_from"), gone.alias("off_at"),
    )


def supply_demand_sql(breaks: Sequence[int]) -> str:
    return f"""
create or replace temporary function supply_demand(end_date date, report_year int)
returns table (Area string, Sort int, ListPriceBucket string, ActiveListings bigint, Sold_Prior6Months bigint, AvgDOM int)
return
select Area, entry.Sort, element_at(array({quoted(C.band_texts(breaks))}), entry.Sort),
  nullif(count_if(entry.supply), 0), nullif(count_if(not entry.supply), 0),
  cast(sum(dom) div nullif(count(dom), 0) as int)
from (
  select Area, entry, case when not entry.supply and year(close_date) = report_year then datediff(close_date, list_date) end as dom
  from (
    select Area, list_date, close_date, explode(array(
      case when on_from <= date_sub(end_date, 1) and off_at > date_sub(end_date, 1)
        then named_struct('Sort', list_band, 'supply', true) end,
      case when close_date < end_date and close_date >= add_months(end_date, -6) and close_price > 0
        then named_struct('Sort', close_band, 'supply', false) end)) as entry
    from {VIEW} where {since('add_months(end_date, -6)')} and list_date < end_date
  ) entries where entry is not null
) counted
group by Area, entry.Sort"""


AREA_INVENTORY = f"""
create or replace temporary function area_inventory(day date)
returns table (Area string, ActiveListings bigint)
return
select Area, count(*) from {VIEW}
where {since('day')} and list_date < day and on_from <= day and off_at > day
group by Area"""


def register_reports(t: Tables, rules: AreaRules | None = None, breaks: Sequence[int] = K.BREAKS_16) -> None:
    """Define ``supply_demand(end_date, report_year)`` and ``area_inventory(day)`` for the session.

    ``select * from supply_demand(date'2020-07-01', 2020)`` gives what the function of that name does.
    A listing sold in the six months was listed before their end, so the test on list dates loses none.
    """
    spark = t["listings"].sparkSession
    area_view(t, rules or AreaRules.supply(), breaks).createOrReplaceTempView(VIEW)
    spark.sql(supply_demand_sql(breaks))
    spark.sql(AREA_INVENTORY)
