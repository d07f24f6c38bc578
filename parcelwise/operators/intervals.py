"""Inventory on every day of a range, from the days at which each listing comes and goes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K

#: End of a listing that is on the market for good.
NEVER = "9999-12-31"


def market_interval(
    status="standard_status", list_date="list_date", close_date="close_date", status_date="status_date"
) -> tuple[Column, Column]:
    """First day on the market, and the day from which on it no longer is.

    ``on_market_at(day)`` holds if and only if the first is not after ``day`` and the second is
    after it. Either is NULL, or they enclose no day, for listings that never are.
    """
    status, listed, closed, changed = map(C.col, (status, list_date, close_date, status_date))
    gone = (
        F.when(status.isin(*K.STATUS_ON_MARKET), F.lit(NEVER).cast("date"))
        .when(status.isin(*K.STATUS_OFF_MARKET) & changed.isNotNull(), F.least(closed, changed))
        .when(status == K.STATUS_CLOSED, F.coalesce(closed, changed))
    )
    return F.date_add(listed, 1), gone


def inventory_events(
    rows: DataFrame, keys: Sequence[str], first: Column, last: Column, weight: Column | None = None
) -> DataFrame:
    """(keys, day, change): by how many the inventory of a group changes on a day of the range.

    A row stands for ``weight`` listings, one by default.

    Listings that never are on the market within the range are left out before anything is
    shuffled. What is there when the range begins counts as coming on its first day, so a group
    has one row a day at the most, whatever its history and its number of listings.
    """
    come, gone = market_interval()
    relevant = (first <= last) & C.open_or_closed_since(first) & (F.col("list_date") < last)
    during = rows.where(relevant).withColumns(
        {"_come": F.greatest(come, first), "_gone": gone}
    )

    count = F.lit(1) if weight is None else weight

    def event(day: Column, change: Column) -> Column:
        return F.struct(day.alias("day"), change.cast("bigint").alias("change"))

    events = F.array(
        event(first, F.lit(0)), event(F.col("_come"), count), F.when(F.col("_gone") <= last, event(F.col("_gone"), -count))
    )
    found = during.where("_gone > _come").select(*keys, events.alias("_events"))
    return (
        C.explode_present(found, "_e", F.col("_events"))
        .groupBy(*keys, F.col("_e.day").alias("day"))
        .agg(F.sum("_e.change").alias("change"))
    )


def inventory_curve(
    rows: DataFrame,
    keys: Sequence[str],
    first_day,
    last_day,
    every: str = "day",
    weight: Column | None = None,
    day: str = "Day",
    count: str = "ActiveListings",
) -> DataFrame:
    """Listings on the market by ``keys``, on every day from ``first_day`` to ``last_day``.

    ``every`` may be ``day``, or ``week``, ``month``, ``quarter`` or ``year`` for their first days.
    Groups with a listing on the market on some day of the range have a row for each day shown; a
    range that ends before it begins has none.
    Changes are summed by group and day; running sums over these serve all days at once.
    """
    first, last = C.date_literal(first_day), C.date_literal(last_day)
    by_day = Window.partitionBy(*keys).orderBy("day")
    steps = inventory_events(rows, keys, first, last, weight).select(
        *keys, "day", F.sum("change").over(by_day).alias(count),
        F.coalesce(F.lead("day").over(by_day), F.date_add(last, 1)).alias("_next"),
    )
    days = F.explode(F.sequence(F.col("day"), F.date_sub("_next", 1)))
    out = steps.select(*keys, days.alias(day), count)
    return out if every == "day" else out.where(F.trunc(day, every) == F.col(day))
