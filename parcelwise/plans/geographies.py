"""Sales by custom geography, municipality and census place."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import statistics as S
from ..operators.joins import fill_grid, having_geo, keep_listed, with_geo
from ..sources.tables import LISTING_KEYS

Tables = Mapping[str, DataFrame]
ALL_SUBTYPES = ",".join(K.PROPERTY_SUBTYPES)


def custom_geo(
    t: Tables,
    subtypes: str = ALL_SUBTYPES,
    pattern: str = K.LAKEFRONT_PATTERN,
    quarters: S.Quarters = None,
) -> DataFrame:
    """Lakefront sales by custom geography and quarter; quarters without sales are zero.

    The subtypes limit every figure but the median. ``quarters`` limits the report to
    (year, quarter) pairs.
    """
    geos = t["listings_custom_geo"].where(F.col("custom_geo").ilike(pattern))
    homes = having_geo(S.closed_residential(t["listings"], quarters), t["listings_geo"])
    shore = geos.where("lakefront_flag = 1").select(*LISTING_KEYS, "custom_geo")
    rows = S.by_close_quarter(homes.join(shore, list(LISTING_KEYS)))
    counted = F.array_contains(F.split(F.lit(subtypes), ","), F.col("property_sub_type"))
    keys = ["custom_geo", "Qtr", "Yr"]
    sales = S.sales_stats(rows, keys, F.coalesce(counted, F.lit(False)), never_null=keys)
    return fill_grid(geos, sales, "custom_geo", S.QUARTER)


def listed_pair(name: Column, kind: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    by_kind = defaultdict(list)
    for member, member_kind in pairs:
        by_kind[member_kind].append(member)
    out = F.lit(False)
    for member_kind, members in by_kind.items():
        out = out | ((kind == member_kind) & name.isin(members))
    return out


def towns_communities(
    t: Tables,
    municipalities: Sequence[tuple[str, str]] = K.MUNICIPALITIES,
    communities: Sequence[str] = K.COMMUNITY_GEOS,
    places: Sequence[str] = K.CENSUS_PLACES,
    place_source: int = K.CENSUS_PLACE_SOURCE,
    quarters: S.Quarters = None,
) -> DataFrame:
    """Sales by listed municipality, community and census place, and quarter.

    The places of a listing are gathered first, so that the listings are read once.
    """
    homes = S.closed_residential(t["listings"], quarters).where(
        F.col("property_sub_type").isin(*K.PROPERTY_SUBTYPES)
    )

    def level(number: int, name: Column, kind: Column) -> Column:
        return F.struct(
            F.lit(number).alias("level"),
            name.alias("Municipality"),
            kind.cast("string").alias("MunicipalityType"),
        )

    town, kind, place = F.col("municipality"), F.col("municipality_type"), F.col("census_place")
    listed = (F.col("source_system_id") == place_source) & place.isin(*places)
    levels = F.array(
        F.when(listed_pair(town, kind, municipalities), level(1, town, kind)),
        F.when(listed, level(3, place, F.lit(None))),
    )
    found = C.explode_present(t["listings_geo"], "_l", levels).select(*LISTING_KEYS, "_l.*")
    named = t["listings_custom_geo"].where(F.col("custom_geo").isin(*communities))
    shared = (
        having_geo(named, t["listings_geo"])
        .select(*LISTING_KEYS, level(2, F.col("custom_geo"), F.lit(None)).alias("_l"))
        .select(*LISTING_KEYS, "_l.*")
    )
    rows = S.by_close_quarter(homes.join(found.unionByName(shared), list(LISTING_KEYS)))
    keys = ["level", "Municipality", "MunicipalityType", "Qtr", "Yr"]
    return S.sales_stats(rows, keys, never_null=S.QUARTER).drop("level")


def municipality_level(
    t: Tables, subtypes: str = ALL_SUBTYPES, quarters: S.Quarters = None
) -> DataFrame:
    """Sales by municipality and quarter, for the given subtypes."""
    homes = keep_listed(S.closed_residential(t["listings"], quarters), "property_sub_type", subtypes)
    rows = with_geo(homes, t["listings_geo"], ["municipality", "municipality_type"])
    rows = rows.withColumnsRenamed(
        {"municipality": "Municipality", "municipality_type": "MunicipalityType"}
    )
    return S.sales_stats(
        S.by_close_quarter(rows), ["Municipality", "MunicipalityType", *S.QUARTER], never_null=S.QUARTER
    )
