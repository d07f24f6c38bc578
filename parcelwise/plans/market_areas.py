"""Reports by market area: sales by quarter, price bands, supply and demand.

Each report scans the listings once. An area list per listing replaces a scan per area,
and conditional sums replace a scan per date, so that one aggregate serves the report.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.frames import quarter_frame
from ..operators import statistics as S
from ..operators.joins import having_geo
from ..sources.tables import LISTING_KEYS

Tables = Mapping[str, DataFrame]
Overlays = Callable[[Column], list[tuple[str, Column]]]


def quarterly_overlays(counties: Sequence[str] = K.TRI_COUNTY_AREA_COUNTIES) -> Overlays:
    """South of Broad by subdivision and the three counties by name."""

    def overlays(code: Column) -> list[tuple[str, Column]]:
        return [
            (K.SOUTH_OF_BROAD, F.col("subdivision") == K.SOUTH_OF_BROAD),
            (K.TRI_COUNTY_AREA, F.col("county_or_parish").isin(*counties)),
        ]

    return overlays


def supply_overlays(
    groups: Mapping[str, Sequence[str]] = K.SUPPLY_OVERLAYS,
    codes: tuple[int, int] = K.TRI_COUNTY_AREA_CODES,
) -> Overlays:
    """Groups of codes, South of Broad, and the three counties as a range of codes."""

    def overlays(code: Column) -> list[tuple[str, Column]]:
        return [
            *[(label, code.isin(*members)) for label, members in groups.items()],
            (K.SOUTH_OF_BROAD, F.col("subdivision") == K.SOUTH_OF_BROAD),
            (K.TRI_COUNTY_AREA, code.try_cast("int").between(*codes)),
        ]

    return overlays


@dataclass(frozen=True)
class AreaRules:
    """Labels of the area codes, and the areas that overlap them."""

    labels: Mapping[str, str] = field(default_factory=lambda: K.AREA_LABELS)
    overlays: Overlays = field(default_factory=quarterly_overlays)

    @classmethod
    def supply(cls) -> AreaRules:
        return cls(K.AREA_LABELS_SUPPLY, supply_overlays())

    def areas(self, listings: DataFrame) -> DataFrame:
        """Area listings with the array column ``areas``; listings in none are dropped."""
        code = F.col("area_code")
        overlays = self.overlays(code)
        somewhere = C.area_label(code, self.labels).isNotNull()
        for _, test in overlays:
            somewhere = somewhere | test
        return (
            listings.withColumn("area_code", C.area_code())
            .where(somewhere)
            .withColumn("areas", C.overlapping_areas(code, self.labels, overlays))
        )


def area_rows(listings: DataFrame, t: Tables, rules: AreaRules, label: str) -> DataFrame:
    """Residential listings, once per market area; the area table's dates as ``m_*``."""
    places = rules.areas(t["area_listings"]).select(
        *LISTING_KEYS,
        F.col("list_date").alias("m_list_date"),
        F.col("close_date").alias("m_close_date"),
        "areas",
    )
    homes = having_geo(listings.where(F.col("property_type") == "Residential"), t["listings_geo"])
    joined = homes.join(places, list(LISTING_KEYS))
    return C.explode_present(joined, label, F.col("areas")).drop("areas")


def market_area(
    t: Tables,
    eval_date,
    py_eval_date,
    as_of=None,
    rules: AreaRules | None = None,
    quarters: S.Quarters = None,
) -> DataFrame:
    """Sales, medians and active listings by market area and quarter.

    Every quarter of a year shows the inventory of that year's evaluation date. The
    column ``avg_DOM`` is a median. ``quarters`` limits the sales to (year, quarter) pairs;
    inventories need no sale.
    """
    frame = quarter_frame(as_of)
    on_market = {
        "inv_cy": C.on_market_at(C.date_literal(eval_date)),
        "inv_py": C.on_market_at(C.date_literal(py_eval_date)),
    }
    sold = C.in_quarters("close_date", quarters)
    listings = t["listings"].where(C.any_of([sold, *on_market.values()]))
    rows = area_rows(listings, t, rules or AreaRules(), "Area")
    rows = S.by_close_quarter(S.sale_measures(rows, "m_list_date", "m_close_date"))
    rows = rows.withColumns({c: F.when(sold, F.col(c)) for c in ("price", "dom")})

    keys = ["Area", "Qtr", "Yr"]
    hist = S.sales_histogram(
        rows, keys, sold, dom_median=True,
        extra={name: F.when(test, 1) for name, test in on_market.items()},
    )
    stats = S.exact_median(hist, [*keys, "metric"], [*S.SALES_SUMS, *on_market])
    stats = stats.groupBy(*keys).agg(
        F.max(F.when(F.col("metric") == S.PRICE, F.col("median"))).alias("median"),
        F.max(F.when(F.col("metric") == S.DOM, F.col("median"))).alias("median_dom"),
        *[F.sum(c).alias(c) for c in (*S.SALES_SUMS, *on_market)],
    )
    area = Window.partitionBy("Area")
    active = F.when(
        F.col("Yr") == F.year(frame.end), F.sum("inv_cy").over(area)
    ).when(F.col("Yr") == F.year(frame.py_end), F.sum("inv_py").over(area))
    return (
        stats.withColumn("ActiveListings", F.nullif(active, F.lit(0)))
        .where("sales_count > 0")
        .select(
            *keys, *S.sales_columns(avg_dom="_"), "ActiveListings",
            F.col("median_dom").alias("avg_DOM"),
        )
        .drop("_")
    )


BAND_MEASURES = {
    "inventory": "coalesce(sum(if({0}_on_market, weight, null)), 0)",
    "sold": "coalesce(sum(if({0}_sold, weight, null)), 0)",
    "volume": "sum(if({0}_sold, close_price * weight, null))",
    "dom_sum": "sum(if({0}_in_quarter, dom * weight, null))",
    "dom_n": "coalesce(sum(if({0}_in_quarter and dom is not null, weight, null)), 0)",
    "quarter_n": "coalesce(sum(if({0}_in_quarter, weight, null)), 0)",
}


def band_sums(
    rows: DataFrame, keys: Sequence[str], tests: Mapping[str, tuple[Column, Column, Column]]
) -> DataFrame:
    """Sums of the reports by price band, as columns ``<year>_<measure>``, in one pass.

    ``tests`` gives, for each year, whether a row is on the market, sold in the report
    window, and closed in the report quarter. A row stands for ``weight`` listings.
    """
    flags = {
        f"{tag}_{name}": test
        for tag, group in tests.items()
        for name, test in zip(("on_market", "sold", "in_quarter"), group)
    }
    rows = rows.withColumns({**flags, "dom": C.days_on_market()})
    return rows.groupBy(*keys).agg(
        *[
            F.expr(f"{sql.format(tag)} as {tag}_{name}")
            for tag in tests
            for name, sql in BAND_MEASURES.items()
        ]
    )


def year_rows(df: DataFrame, years: Mapping[str, Column], measures: Sequence[str]) -> DataFrame:
    """One row per year from columns ``<year>_<measure>``."""
    rows = F.array(
        *[
            F.struct(year.alias("Yr"), *[F.col(f"{tag}_{m}").alias(m) for m in measures])
            for tag, year in years.items()
        ]
    )
    kept = [c for c in df.columns if not any(c.startswith(f"{tag}_") for tag in years)]
    return df.select(*kept, F.explode(rows).alias("_y")).select(*kept, "_y.*")


def price_range_area(
    t: Tables,
    eval_date,
    py_eval_date,
    as_of=None,
    breaks: Sequence[int] = K.BREAKS_4,
    rules: AreaRules | None = None,
) -> DataFrame:
    """Inventory, sales of the quarter and months of supply by area and list price band."""
    frame = quarter_frame(as_of)
    years = {"cy": (C.date_literal(eval_date), frame.end), "py": (C.date_literal(py_eval_date), frame.py_end)}
    tests = {
        tag: (
            C.on_market_at(day),
            C.in_trailing("close_date", end, 3) & (F.col("close_price") > 0),
            C.in_quarter("close_date", end),
        )
        for tag, (day, end) in years.items()
    }
    first = F.least(C.date_literal(py_eval_date), F.add_months(frame.py_end, -3))
    counts = C.any_of(test for group in tests.values() for test in group)
    listings = t["listings"].where(C.open_or_closed_since(first) & counts)
    rows = area_rows(listings, t, rules or AreaRules(), "area").withColumns(
        {
            "band": C.price_band("list_price", breaks, null_band=len(breaks) + 1),
            "weight": F.lit(1),
        }
    )
    wide = band_sums(rows, ["area", "band"], tests)
    ends = {tag: F.year(end) for tag, (_, end) in years.items()}
    return year_rows(wide, ends, list(BAND_MEASURES)).where("inventory > 0").select(
        "Yr", "area", *band_columns(breaks, months=3)
    )


def band_columns(breaks: Sequence[int], months: int) -> list[Column]:
    sold = F.nullif(F.col("sold"), F.lit(0))
    return [
        C.band_label("band", breaks).alias("listpricebucket"),
        F.col("inventory").cast("bigint").alias("total_listings"),
        C.whole_average(F.col("dom_sum"), F.col("dom_n")).alias("avg_DOM"),
        sold.cast("bigint").alias("total_sold"),
        F.col("volume").alias("total_volume_sold"),
        C.months_of_supply(F.col("inventory"), sold, months).alias("months_inventory"),
    ]


def supply_demand(
    t: Tables,
    end_date,
    report_year: int,
    breaks: Sequence[int] = K.BREAKS_16,
    rules: AreaRules | None = None,
) -> DataFrame:
    """Active listings by list price against six months of sales by close price.

    A listing enters its area and band as supply, as demand, or both. Grouping the two
    together is a full outer join of the two counts. Days on market are those of sales in
    ``report_year``, so the part of the six months in another year is left out.
    """
    end = C.date_literal(end_date)
    supply = C.on_market_at(F.date_sub(end, 1))
    demand = C.in_half_open("close_date", end, 6) & (F.col("close_price") > 0)
    listings = t["listings"].where(C.open_or_closed_since(F.add_months(end, -6)) & (supply | demand))
    rows = area_rows(listings, t, rules or AreaRules.supply(), "Area")

    top = len(breaks) + 1

    def entry(price: str, is_supply: bool) -> Column:
        band = C.price_band(price, breaks, top)
        return F.struct(band.alias("Sort"), F.lit(is_supply).alias("supply"))

    entries = F.array(
        F.when(supply, entry("list_price", True)), F.when(demand, entry("close_price", False))
    )
    rows = C.explode_present(rows, "_e", entries).withColumns(
        {"Sort": F.col("_e.Sort"), "supply": F.col("_e.supply")}
    )
    dom = F.when(~F.col("supply") & (F.year("close_date") == report_year), C.days_on_market())
    counts = rows.groupBy("Area", "Sort").agg(
        F.count_if("supply").alias("listed"),
        F.count_if(~F.col("supply")).alias("sold"),
        F.sum(dom).alias("dom_sum"),
        F.count(dom).alias("dom_n"),
    )
    none = F.lit(0)
    return counts.select(
        "Area",
        "Sort",
        C.band_label("Sort", breaks).alias("ListPriceBucket"),
        F.nullif(F.col("listed"), none).alias("ActiveListings"),
        F.nullif(F.col("sold"), none).alias("Sold_Prior6Months"),
        C.whole_average(F.col("dom_sum"), F.col("dom_n")).alias("AvgDOM"),
    )
