"""Quarterly reports from stored histograms, and the histograms to store for them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import statistics as S
from ..operators.joins import with_geo
from ..sources import facts as store
from .counties import CountyScope, county_sales

Tables = Mapping[str, DataFrame]
#: A histogram of some quarters, or of all.
Facts = Callable[[S.Quarters], DataFrame]


def county_facts(t: Tables, scope: CountyScope | None = None) -> Facts:
    """Sales by county, property class, quarter and price."""

    def facts(quarters: S.Quarters = None) -> DataFrame:
        rows = county_sales(t, scope or CountyScope(), quarters)
        return S.sales_histogram(S.sale_measures(rows), ["County", "PropertyType", *S.QUARTER])

    return facts


def municipality_facts(t: Tables) -> Facts:
    """Residential sales by municipality, property subtype, quarter and price."""

    def facts(quarters: S.Quarters = None) -> DataFrame:
        homes = S.closed_residential(t["listings"], quarters)
        rows = S.by_close_quarter(with_geo(homes, t["listings_geo"], ["municipality", "municipality_type"]))
        rows = rows.withColumnsRenamed({"municipality": "Municipality", "municipality_type": "MunicipalityType"})
        keys = ["Municipality", "MunicipalityType", "property_sub_type", *S.QUARTER]
        return S.sales_histogram(S.sale_measures(rows), keys)

    return facts


def save(facts: Facts, path: str, files: int = 1) -> None:
    """Store the histogram of all quarters."""
    store.save_facts(facts(None), path, files)


def refresh(facts: Facts, path: str, quarters: Sequence[tuple[int, int]], files: int = 1) -> None:
    """Compute and replace the given (year, quarter) pairs; listings of no other quarter are read."""
    store.refresh_facts(facts(quarters), path, quarters, files)


def from_facts(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sales statistics by ``keys`` from a histogram at the same grain or a finer one."""
    return S.stats_of(hist, keys, never_null=[k for k in keys if k in S.QUARTER])


def county_level_from(hist: DataFrame) -> DataFrame:
    """``county_level`` from ``county_facts``."""
    return from_facts(hist, ["PropertyType", "County", *S.QUARTER])


def county_years_from(hist: DataFrame) -> DataFrame:
    """Counties by year, all classes together, from the same facts."""
    return from_facts(hist, ["County", "Yr"])


def municipality_level_from(hist: DataFrame, subtypes: Sequence[str] = K.PROPERTY_SUBTYPES) -> DataFrame:
    """``municipality_level`` from ``municipality_facts``."""
    kept = hist.where(F.col("property_sub_type").isin(*subtypes))
    return from_facts(kept, ["Municipality", "MunicipalityType", *S.QUARTER])
