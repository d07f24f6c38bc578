"""Broker and firm ranking by town, county and zone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.frames import OpenFrame, open_frame
from ..operators import ranking as R

Tables = Mapping[str, DataFrame]
MARKET = ["TabName", "GroupType"]


def unit_share(units: str, total: Column) -> Column:
    return F.try_divide(F.col(units).cast("double"), total.cast("double"))


def broker_rank_towns(t: Tables, frame: OpenFrame | None = None) -> DataFrame:
    """Offices of each tab by units: the top ranks, extended to the own office's rank.

    The own office ids stand at the end of the tab header. Tabs and periods in which no
    own office has units are left out.
    """
    units = R.side_units(t["broker_listings"], frame or open_frame(), ["town"])
    tabs = t["custom_tabs"].select(
        F.col("tab_name").alias("TabName"), F.col("service_area").alias("town")
    )
    offices = t["broker_offices"].select(
        "office_key", C.firm_name().alias("Broker"), F.col("office_mls_id").alias("MLSID")
    )
    by_tab = R.add_up(units.join(tabs, "town"), [*MARKET, "office_key"])
    ranked = R.add_up(by_tab.join(offices, "office_key"), [*MARKET, "Broker", "MLSID"])
    ranked = ranked.withColumns(
        {
            "PercUnits": unit_share("units", F.sum("units").over(Window.partitionBy(*MARKET))),
            "OfficeRank": R.dense_rank_units(MARKET),
        }
    ).join(R.tab_texts(t["custom_tabs"]), "TabName")
    own_ids = C.own_office_ids(F.upper("TabHeader"))
    own = F.when(F.array_contains(own_ids, F.upper("MLSID")), F.col("OfficeRank"))
    return (
        ranked.withColumn("_limit", R.rank_limit(own, MARKET))
        .where(F.col("OfficeRank") <= F.col("_limit"))
        .select(
            "GroupType", "TabName", "Broker", "MLSID", *R.unit_columns(), "PercUnits", "OfficeRank",
            "TabHeader", "message_text",
        )
    )


def firm_ranking(
    t: Tables, units: DataFrame, own_prefix: str, period_total: Column | None = None
) -> DataFrame:
    """Firms and their offices by units, from units by tab, period, office and ``kind``.

    ``kind`` marks the rows that are ranked; other rows only enter ``period_total``, the
    divisor of the unit share. Firms up to the own firm's rank, or the top ranks, stay,
    with all of their offices.
    """
    offices = t["broker_offices"].select(
        "office_key",
        R.firm_key().alias("_prefix"),
        F.col("office_city").alias("OfficeCity"),
        F.col("office_mls_id").alias("MLSID"),
    )
    firms = R.firm_directory(t["broker_offices"])
    rows = units.join(offices, "office_key").join(
        firms, F.col("_prefix") == F.col("FirmPrefix"), "left"
    )
    firm = [*MARKET, "kind", "FirmPrefix", "Firm"]
    office = [*firm, "OfficeCity", "MLSID"]
    levels = rows.groupingSets(
        [[F.col(c) for c in firm], [F.col(c) for c in office]], *[F.col(c) for c in office]
    ).agg(
        F.grouping("MLSID").alias("_firm_row"),
        *[F.sum(c).alias(c) for c in R.UNIT_SUMS],
    )
    firm_row = F.col("_firm_row") == 1
    market = Window.partitionBy(*MARKET)
    ranked_units = F.sum(F.when(firm_row & F.col("kind"), F.col("units"))).over(market)
    all_units = F.sum(F.when(firm_row & ~F.col("kind"), F.col("units"))).over(market)
    total = ranked_units if period_total is None else F.when(period_total, ranked_units).otherwise(all_units)
    rank = R.dense_rank_units([*MARKET, "_firm_row"])
    ranked = (
        levels.withColumn("_total", total)
        .where(F.col("kind") & F.col("_total").isNotNull())
        .withColumn("_rank", rank)
        .withColumns(
            {
                "FirmRank": F.when(firm_row, F.col("_rank")),
                "OfficeRank": F.when(~firm_row, F.col("_rank")),
                "PercUnits": unit_share("units", F.col("_total")),
            }
        )
        .join(R.tab_texts(t["custom_tabs"]), "TabName")
    )
    own = F.when(F.lower("FirmPrefix") == own_prefix.lower(), F.col("FirmRank"))
    this_firm = Window.partitionBy(*MARKET, "FirmPrefix")
    return (
        ranked.withColumns(
            {"_limit": R.rank_limit(own, MARKET), "_firm_rank": F.max("FirmRank").over(this_firm)}
        )
        .where(F.col("FirmPrefix").isNotNull() & (F.col("_firm_rank") <= F.col("_limit")))
        .select(
            "GroupType", "TabName", "FirmPrefix", "Firm", "OfficeCity", "MLSID", *R.unit_columns(),
            "PercUnits", "FirmRank", "OfficeRank", "TabHeader", "message_text",
        )
    )


def firm_rank_counties(
    t: Tables, frame: OpenFrame | None = None, own_prefix: str = K.OWN_FIRM_PREFIX
) -> DataFrame:
    """Firms and their offices of each county tab by units."""
    units = R.side_units(t["broker_listings"], frame or open_frame(), ["county_or_parish"])
    tabs = t["custom_tabs"].where("tab_type = 'County'").select("tab_name").distinct()
    by_tab = units.join(tabs, F.col("county_or_parish") == F.col("tab_name")).withColumnsRenamed(
        {"tab_name": "TabName"}
    )
    return firm_ranking(t, by_tab.withColumn("kind", F.lit(True)), own_prefix)


def firm_rank_zones(
    t: Tables,
    frame: OpenFrame | None = None,
    own_prefix: str = K.OWN_FIRM_PREFIX,
    strict_parity: bool = True,
) -> DataFrame:
    """Firms and their offices of each zone tab by units.

    With ``strict_parity`` only the current closed share divides by the zone's units; the
    others divide by the units of the towns in the tab's service area.
    """
    units = R.side_units(t["broker_listings"], frame or open_frame(), ["zone", "town"])
    tabs = t["custom_tabs"]
    zones = (
        tabs.where("tab_type = 'Zone'")
        .select(F.lit(True).alias("kind"), C.zone_of_tab().alias("place"), "tab_name")
        .distinct()
    )
    towns = tabs.select(F.lit(False).alias("kind"), F.col("service_area").alias("place"), "tab_name")
    places = F.array(
        F.struct(F.lit(True).alias("kind"), F.col("zone").alias("place")),
        F.struct(F.lit(False).alias("kind"), F.col("town").alias("place")),
    )
    spread = units.withColumn("_p", F.explode(places)).select(
        "office_key", "GroupType", *R.UNIT_SUMS, "_p.*"
    )
    by_tab = spread.join(zones.unionByName(towns), ["kind", "place"])
    by_tab = R.add_up(
        by_tab.withColumnsRenamed({"tab_name": "TabName"}), [*MARKET, "kind", "office_key"]
    )
    own_total = F.col("GroupType") == K.PERIOD_CLOSED if strict_parity else None
    return firm_ranking(t, by_tab, own_prefix, own_total)
