"""Broker market share by county and quarter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from .counties import CountyScope, any_source

Tables = Mapping[str, DataFrame]

SHARE_SCOPE = CountyScope(sources=K.TRI_COUNTY_SHARE_SOURCES)
QUARTER_COLUMNS = ("date_qtr", "date_year")


def office_totals(
    t: Tables,
    keys: Mapping[str, object],
    scope: CountyScope,
    first_year: int,
    strict_parity: bool,
) -> DataFrame:
    """Sides and volume by county, quarter, office and further ``keys``.

    Aggregated by office key before the office table is joined, so a large office is one
    row there. With ``strict_parity`` listings match by listing key alone, whatever their
    source.
    """
    sides = t["listing_sides"].where(
        (F.col("close_date") >= F.lit(date(first_year, 1, 1)))
        & (F.col("property_type") == "Residential")
    )
    on = ["listing_key"] if strict_parity else ["listing_key", "source_system_id"]
    names = t["county_names"].select(
        "county_fp", F.col("state_num").alias("state_fp"), C.county_clean().alias("County")
    )
    fourth = F.col("County") == scope.fourth
    fips = ["county_fp", "state_fp"]
    located = t["listings_geo"].select(*on, *fips).join(
        names.where(F.col("County").isin(scope.all_counties)), fips
    )
    rows = (
        sides.join(located, on)
        .join(t["listings"].select(*on), on)
        .where((fourth & any_source(scope.fourth_sources)) | (~fourth & any_source(scope.sources)))
    )
    return rows.groupBy(
        "County",
        "office_key",
        F.quarter("close_date").alias("date_qtr"),
        F.year("close_date").alias("date_year"),
        *[c.alias(name) for name, c in keys.items()],
    ).agg(F.sum("sides").alias("sides"), F.sum("volume_credit").alias("volume"))


def company_shares(totals: DataFrame, t: Tables, keys: Sequence[str], rules) -> DataFrame:
    named = totals.join(t["offices"].select("office_key", "office_name"), "office_key")
    named = named.withColumn("Company", C.company_name(rules=rules))
    group = ["County", *keys, *QUARTER_COLUMNS]
    companies = named.groupBy(*group, "Company").agg(
        F.sum("sides").alias("SidesCount"), F.sum("volume").alias("VolumeTotal")
    )
    market = Window.partitionBy(*group)
    return companies.withColumns(
        {
            f"{what}MarketShare": C.percent_share(F.col(total), F.sum(total).over(market))
            for what, total in (("Sides", "SidesCount"), ("Volume", "VolumeTotal"))
        }
    )


def share_by_company(
    t: Tables,
    scope: CountyScope = SHARE_SCOPE,
    rules=K.COMPANY_RULES,
    first_year: int = K.SHARE_FIRST_YEAR,
    strict_parity: bool = True,
) -> DataFrame:
    """Sides, volume and their share of the county's quarter, by company."""
    totals = office_totals(t, {}, scope, first_year, strict_parity)
    shares = company_shares(totals, t, [], rules)
    return shares.select(
        "County", "Company", *QUARTER_COLUMNS, "SidesCount", "VolumeTotal",
        "SidesMarketShare", "VolumeMarketShare",
    )


def share_by_price_range(
    t: Tables,
    breaks: Sequence[int] = K.BREAKS_5,
    scope: CountyScope = SHARE_SCOPE,
    rules=K.COMPANY_RULES,
    first_year: int = K.SHARE_FIRST_YEAR,
    strict_parity: bool = True,
) -> DataFrame:
    """Sides, volume and their share of the county's quarter and list band, by company."""
    band = C.price_band("list_price", breaks, null_band=len(breaks) + 1)
    totals = office_totals(t, {"listpricebucket": band}, scope, first_year, strict_parity)
    shares = company_shares(totals, t, ["listpricebucket"], rules)
    return shares.select(
        "County", "listpricebucket", "Company", *QUARTER_COLUMNS, "SidesCount", "VolumeTotal",
        C.band_label("listpricebucket", breaks).alias("listpricebuckettext"),
        "SidesMarketShare", "VolumeMarketShare",
    )
