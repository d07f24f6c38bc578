"""Reports by county: property classes, all classes, price bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.frames import eval_frame, quarter_frame
from ..operators import statistics as S
from ..operators.joins import region_weights
from ..sources.tables import LISTING_KEYS
from .market_areas import BAND_MEASURES, band_columns, band_sums, year_rows

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class CountyScope:
    """The three counties and the fourth, with the state and sources that cover them.

    ``None`` as state or sources means any. With ``by_region`` a listing of the three
    counts once per region of its county; without it, once if the county has a region.
    """

    counties: Sequence[str] = K.TRI_COUNTIES
    state: int | None = K.TRI_COUNTY_STATE
    sources: Sequence[int] | None = K.TRI_COUNTY_SOURCES
    fourth: str = K.FOURTH_COUNTY
    fourth_state: int | None = None
    fourth_sources: Sequence[int] | None = K.FOURTH_COUNTY_SOURCES
    excluded_region: str | None = K.EXCLUDED_REGION
    by_region: bool = True

    @property
    def all_counties(self) -> list[str]:
        return [*self.counties, self.fourth]

    def dimension(self, t: Tables) -> DataFrame:
        """Counties by code, with ``weight``: rows a listing stands for, NULL if none."""
        regions = region_weights(t["county_by_region"], self.excluded_region)
        names = t["county_names"].withColumn("county", C.county_clean())
        names = names.where(F.col("county").isin(self.all_counties)).join(regions, "county", "left")
        repeat = F.col("regions") if self.by_region else F.when(F.col("regions") > 0, 1)
        fourth = F.col("county") == self.fourth
        right_state = any_state(fourth, self.fourth_state) | any_state(~fourth, self.state)
        return names.select(
            F.col("county_fp"),
            F.col("state_num").alias("state_fp"),
            F.col("county").alias("County"),
            (~fourth).alias("tri"),
            F.when(right_state, F.when(fourth, 1).otherwise(repeat)).alias("weight"),
        )

    def any_source(self) -> Column:
        """Is the row from a source that covers any of the counties? Needs no county yet."""
        return any_source(self.sources) | any_source(self.fourth_sources)

    def covered(self) -> Column:
        """Is the row from a source that covers its county, with a weight?"""
        three = F.col("tri") & any_source(self.sources)
        fourth = ~F.col("tri") & any_source(self.fourth_sources)
        return F.col("weight").isNotNull() & (three | fourth)


def any_state(which: Column, state: int | None) -> Column:
    return which if state is None else which & (F.col("state_num") == state)


def any_source(sources: Sequence[int] | None) -> Column:
    return F.lit(True) if sources is None else F.col("source_system_id").isin(*sources)


def county_rows(listings: DataFrame, t: Tables, scope: CountyScope) -> DataFrame:
    """Listings of the counties; geography is cut to the counties before the large join."""
    fips = ["county_fp", "state_fp"]
    located = t["listings_geo"].select(*LISTING_KEYS, *fips).join(scope.dimension(t), fips)
    return listings.join(located, list(LISTING_KEYS))


# --- two years side by side ---------------------------------------------------

YEARS = ("cy", "py")
FLOWS = ("inv_cy", "inv_py", "sold_cy", "sold_py")
STATS = ("price_per_foot", "sales_volume", "sales_count", "avg_sale", "avg_dom", "MedianPrice")


def county_histogram(
    t: Tables, eval_date, scope: CountyScope, strict_parity: bool, with_class: bool
) -> DataFrame:
    """Sales histogram by county (and class) and year, with inventory and sold counts.

    Sales take any source; inventory and sold counts only the sources that cover the
    county. Both come from the same scan and shuffle.
    """
    frame = eval_frame(eval_date)
    days = {"cy": frame.eval_date, "py": frame.py_eval_date}
    quarters = {
        "cy": C.in_quarter("close_date", frame.eval_date),
        "py": C.in_quarter("close_date", frame.eval_date, years_back=1),
    }
    on_market = {y: C.on_market_at(day) for y, day in days.items()}
    sold = {
        y: C.in_half_open("close_date", day, 12) & (F.col("close_price") > 0)
        for y, day in days.items()
    }
    recent = C.open_or_closed_since(F.add_months(frame.py_eval_date, -12))
    listings = t["listings"].where(F.col("property_type").isin("Residential", "Land") & recent)
    # a listing in no measure of either year stays out of the joins
    listings = listings.where(C.any_of([*quarters.values(), *on_market.values(), *sold.values()]))
    if not strict_parity:
        listings = listings.where(scope.any_source())
    rows = county_rows(listings, t, scope).withColumn("PropertyType", C.property_class())
    if not strict_parity:
        rows = rows.where(scope.covered())

    in_sales = F.lit(True)
    year = C.first_match((in_sales & test, y) for y, test in quarters.items())
    rows = S.sale_measures(rows).withColumn("year", year)
    rows = rows.withColumn("price", F.when(F.col("year").isNotNull(), F.col("price")))

    listed_class = F.col("PropertyType").isin(K.CLASS_HOUSE, K.CLASS_CONDO)
    sold_class = F.lit(True) if with_class else F.col("PropertyType") != K.CLASS_OTHER
    flows = {}
    for y in YEARS:
        flows[f"inv_{y}"] = scope.covered() & listed_class & on_market[y]
        flows[f"sold_{y}"] = scope.covered() & sold_class & sold[y]
    keys = ["County", "tri", "year"] + (["PropertyType"] if with_class else [])
    return S.sales_histogram(
        rows, keys, F.col("year").isNotNull(),
        extra={name: F.when(test, F.col("weight")) for name, test in flows.items()},
    )


def side_by_side(hist: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Statistics at several grains, both years in one row.

    ``sets`` names each grain and its columns. The grains are grouping sets over the
    histogram, a fraction of the listings. Grains without the county keep only the three
    counties. Groups without a sale, a listing on the market or a sold listing are left out.
    """
    dims = [c for c in ("County", "PropertyType") if c in hist.columns]
    common = ["tri", "year", "value"]
    sums = [*S.SALES_SUMS, *FLOWS]
    cube = hist.groupingSets(
        [[*[F.col(c) for c in cols], *[F.col(c) for c in common]] for cols in sets.values()],
        *[F.col(c) for c in (*dims, *common)],
    ).agg(
        F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.grouping(c).alias(f"_no_{c}") for c in dims],
    )
    grain = C.first_match(
        (all_of((F.col(f"_no_{c}") == (0 if c in cols else 1)) for c in dims), name)
        for name, cols in sets.items()
    )
    cube = cube.withColumn("grain", grain).where((F.col("_no_County") == 0) | F.col("tri"))
    keys = ["grain", *dims]
    stats = S.exact_median(cube, [*keys, "year"], sums).select(
        *keys, "year", *FLOWS, *S.sales_columns()
    )
    return stats.groupBy(*keys).agg(
        *[F.expr(f"max({c}) filter (where year = '{y}') as {y}_{c}") for y in YEARS for c in STATS],
        *[F.expr(f"nullif(sum({c}), 0) as {c}") for c in FLOWS],
    ).where(" or ".join([*[f"{y}_sales_count > 0" for y in YEARS], *[f"{c} > 0" for c in FLOWS]]))


def all_of(tests) -> Column:
    out = None
    for test in tests:
        out = test if out is None else out & test
    return out


FETCHED = (*[f"{y}_{c}" for y in YEARS for c in ("price_per_foot", "MedianPrice")], *FLOWS)


def with_coarser(wide: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add figures of the coarser row that agrees on the grain's columns.

    The rows are the report's own by now, a few per county.
    """
    return wide.selectExpr(
        "*",
        *[
            f"max(if(grain = '{grain}', {c}, null)) "
            f"over (partition by {', '.join(cols) or '1'}) as {grain}_{c}"
            for grain, cols in sets.items()
            for c in FETCHED
        ],
    )


def supply(inventory: Column, sold: Column) -> Column:
    return C.months_of_supply_rounded(inventory, sold, 12)


def county_class(
    t: Tables, eval_date, scope: CountyScope | None = None, strict_parity: bool = True
) -> DataFrame:
    """Counties by property class, against three coarser roll-ups, two years side by side.

    With ``strict_parity`` the current months of supply of the three counties by class
    divide by the prior year's sold count, and sales are not limited by source.
    """
    hist = county_histogram(t, eval_date, scope or CountyScope(), strict_parity, with_class=True)
    return class_report(hist, strict_parity)


def class_report(hist: DataFrame, strict_parity: bool) -> DataFrame:
    """``county_class`` from its histogram."""
    wide = side_by_side(
        hist,
        {
            "cell": ["County", "PropertyType"],
            "county": ["County"],
            "class": ["PropertyType"],
            "all": [],
        },
    )
    wide = with_coarser(wide, {"county": ["County"], "class": ["PropertyType"], "all": []})
    out = wide.where("grain = 'cell' and (cy_sales_count > 0 or py_sales_count > 0)").where(
        F.col("PropertyType") != K.CLASS_OTHER
    )
    tri_sold = "class_sold_py" if strict_parity else "class_sold_cy"
    return out.select(
        "PropertyType",
        "County",
        *[
            column
            for y, word in (("cy", "Current"), ("py", "Previous"))
            for column in (
                F.col(f"{y}_sales_count").alias(f"{word}YearSalesCount"),
                F.col(f"{y}_price_per_foot").alias(f"{word}PricePerFoot"),
                F.col(f"class_{y}_price_per_foot").alias(f"{word}TriCountyPricePerFoot"),
                F.col(f"county_{y}_price_per_foot").alias(f"{word}AllUnitTypesPricePerFoot"),
                F.col(f"all_{y}_price_per_foot").alias(f"{word}TriCountyPricePerFootAllUnitTypes"),
                F.col(f"{y}_sales_volume").alias(f"{word}SalesVolume"),
                F.col(f"{y}_avg_sale").alias(f"{word}AvgSale"),
                F.col(f"{y}_avg_dom").alias(f"{word}AvgDOM"),
                F.col(f"{y}_MedianPrice").alias(f"{word}MedianPrice"),
                F.col(f"class_{y}_MedianPrice").alias(f"{word}TriCountyMedian"),
                F.col(f"county_{y}_MedianPrice").alias(f"{word}AllUnitTypesMedian"),
                F.col(f"all_{y}_MedianPrice").alias(f"{word}MedianTriCountyAllUnitTypes"),
            )
        ],
        supply(F.col("inv_cy"), F.col("sold_cy")).alias("cy_months_inventory"),
        supply(F.col("inv_py"), F.col("sold_py")).alias("py_months_inventory"),
        supply(F.col("class_inv_cy"), F.col(tri_sold)).alias("cy_TriCounty_months_inventory"),
        supply(F.col("class_inv_py"), F.col("class_sold_py")).alias("py_TriCounty_months_inventory"),
        *[
            supply(F.col(f"{g}_inv_{y}"), F.col(f"{g}_sold_{y}")).alias(f"{y}_{name}_months_inventory")
            for g, name in (("county", "AllUnitTypes"), ("all", "TriCountyAllUnitTypes"))
            for y in YEARS
        ],
    )


def county_all(
    t: Tables, eval_date, scope: CountyScope | None = None, strict_parity: bool = True
) -> DataFrame:
    """Counties with all classes together, and the three counties, two years side by side.

    With ``strict_parity`` the three-county price per foot is the county's own, and the
    current three-county months of supply divide by the prior year's sold count.
    """
    scope = scope or CountyScope()
    hist = county_histogram(t, eval_date, scope, strict_parity, with_class=False)
    return all_report(hist, scope.fourth, strict_parity)


def all_report(hist: DataFrame, fourth: str, strict_parity: bool) -> DataFrame:
    """``county_all`` from its histogram."""
    wide = side_by_side(hist, {"county": ["County"], "all": []})
    out = with_coarser(wide, {"all": []}).where(
        "grain = 'county' and (cy_sales_count > 0 or py_sales_count > 0)"
    )

    def tri_price(y: str) -> Column:
        if strict_parity:
            return F.when(F.col("County") != fourth, F.col(f"{y}_price_per_foot"))
        return F.col(f"all_{y}_price_per_foot")

    tri_sold = "all_sold_py" if strict_parity else "all_sold_cy"
    return out.select(
        "County",
        *[
            column
            for y, word in (("cy", "Current"), ("py", "Previous"))
            for column in (
                F.col(f"{y}_sales_count").alias(f"{word}YearSalesCount"),
                F.col(f"{y}_price_per_foot").alias(f"{word}PricePerFoot"),
                tri_price(y).alias(f"{word}TriCountyPricePerFoot"),
                F.col(f"{y}_sales_volume").alias(f"{word}SalesVolume"),
                F.col(f"{y}_avg_sale").alias(f"{word}AvgSale"),
                F.col(f"{y}_avg_dom").alias(f"{word}AvgDOM"),
                F.col(f"{y}_MedianPrice").alias(f"{word}MedianPrice"),
                F.col(f"all_{y}_MedianPrice").alias(f"{word}TriCountyMedian"),
            )
        ],
        supply(F.col("inv_cy"), F.col("sold_cy")).alias("cy_months_inventory"),
        supply(F.col("inv_py"), F.col("sold_py")).alias("py_months_inventory"),
        supply(F.col("all_inv_cy"), F.col(tri_sold)).alias("cy_TriCounty_months_inventory"),
        supply(F.col("all_inv_py"), F.col("all_sold_py")).alias("py_TriCounty_months_inventory"),
    )


def county_level(
    t: Tables, scope: CountyScope | None = None, quarters: S.Quarters = None
) -> DataFrame:
    """Sales by county, property class, quarter and year."""
    rows = county_sales(t, scope or CountyScope(), quarters)
    return S.sales_stats(rows, ["PropertyType", "County", *S.QUARTER], never_null=S.QUARTER)


def county_sales(t: Tables, scope: CountyScope, quarters: S.Quarters = None) -> DataFrame:
    """Closed listings of the counties with county, property class and quarter."""
    listings = t["listings"].where(
        F.col("close_date").isNotNull()
        & C.in_quarters("close_date", quarters)
        & F.col("property_type").isin("Residential", "Land")
    )
    rows = county_rows(listings, t, scope)
    return S.by_close_quarter(rows.withColumn("PropertyType", C.property_class()))


def price_range_county(
    t: Tables,
    as_of=None,
    breaks: Sequence[int] = K.BREAKS_5,
    scope: CountyScope | None = None,
) -> DataFrame:
    """Inventory, sales of the trailing year and months of supply by county and list band.

    Only bands with inventory, sales and a sale in the report quarter appear.
    """
    scope = scope or CountyScope(fourth_state=K.FOURTH_COUNTY_STATE)
    frame = quarter_frame(as_of)
    ends = {"cy": frame.end, "py": frame.py_end}
    tests = {
        tag: (
            C.on_market_at(end),
            C.in_trailing("close_date", end, 12) & (F.col("close_price") > 0),
            C.in_quarter("close_date", end),
        )
        for tag, end in ends.items()
    }
    recent = C.open_or_closed_since(F.add_months(frame.py_end, -12))
    counts = C.any_of(test for group in tests.values() for test in group)
    listings = t["listings"].where((F.col("property_type") == "Residential") & recent & counts)
    rows = county_rows(listings, t, scope).where(scope.covered())
    rows = rows.withColumn("band", C.price_band("list_price", breaks, null_band=len(breaks) + 1))
    wide = band_sums(rows.withColumnRenamed("County", "county"), ["county", "band"], tests)
    return band_report(wide, {tag: F.year(end) for tag, end in ends.items()}, breaks)


def band_report(wide: DataFrame, years: Mapping[str, Column], breaks: Sequence[int]) -> DataFrame:
    """``price_range_county`` from the sums by county and band."""
    found = year_rows(wide, years, list(BAND_MEASURES)).where(
        "inventory > 0 and sold > 0 and quarter_n > 0"
    )
    return found.select("Yr", "county", *band_columns(breaks, months=12))
