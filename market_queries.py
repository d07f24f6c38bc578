"""Queries over the sample market: one per operator, report and view."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise import plans as P
from parcelwise.functions import columns as C
from parcelwise.functions import constants as K
from parcelwise.functions import frames as FR
from parcelwise.operators import joins as J
from parcelwise.operators import ranking as R
from parcelwise.operators import statistics as S
from parcelwise.plans import counties as PC
from parcelwise.plans import facts as PF
from parcelwise.plans import market_areas as PA
from parcelwise.plans import sql as PQ
from parcelwise.plans import suite as PS
from parcelwise.plans import views as PV
from parcelwise.sources import clustering as CL
from parcelwise.sources import facts as store
from parcelwise.sources.schemas import TABLES
from parcelwise.sources.sql import register_functions
from parcelwise.sources.tables import LISTING_KEYS, from_catalog

Tables = Mapping[str, DataFrame]

EVAL, PY_EVAL, AS_OF = date(2000, 7, 1), date(1999, 7, 1), date(2000, 8, 10)
SUBTYPES = "Condominium,Single Family Residential,Townhouse"
TRI, FOURTH = ("NATION_1", "NATION_2", "NATION_3"), "NATION_4"
TOWNS = (("NATION_1", "C"), ("NATION_1", "T"), ("NATION_7", "V"), ("NATION_12", "C"), ("NATION_20", "T"))
COMMUNITIES = ("Lake 1 Lakefront", "Lake 8 Resort")
PLACES = ("Place 1", "Place 5", "Place 12")
RULES = (
    ("supplier#00000000%", "First Ten"),
    ("%5", "Fives"),
    ("%#0000000_2%", "Twenties"),
)
OWN_PREFIX = "are"
SHARE_FIRST_YEAR = 1997
SCOPE = P.CountyScope(counties=TRI, state=None, fourth=FOURTH)
SCOPE_BANDS = P.CountyScope(counties=("NATION_1", "NATION_5", "NATION_10"), state=None, fourth=FOURTH)
SUITE = PS.Suite(EVAL, AS_OF, SCOPE, K.BREAKS_5)
SHARE_SCOPE = P.CountyScope(counties=TRI, sources=(1,), fourth=FOURTH)
QUARTERS = ((1999, 2), (2000, 2))
CURVE_DAYS = (date(1999, 12, 15), date(2000, 7, 1))
CURVE_MONTHS = (date(1995, 1, 1), date(2000, 12, 31))
AREA_RULES = P.AreaRules(K.AREA_LABELS, PA.quarterly_overlays(TRI))
SUPPLY_RULES = P.AreaRules.supply()


def eval_day():
    return C.date_literal(EVAL)


def ranking_frame() -> FR.OpenFrame:
    return FR.open_frame(AS_OF)


def closed_by_town(t: Tables) -> DataFrame:
    rows = J.with_geo(S.closed_residential(t["listings"]), t["listings_geo"], ["municipality"])
    return S.by_close_quarter(rows)


def by_kind(df: DataFrame) -> DataFrame:
    """Count and volume by property type, to show a date window."""
    return df.groupBy("property_type").agg(
        F.count("*").alias("n"), F.sum("close_price").alias("volume")
    )


def office_units(t: Tables) -> DataFrame:
    return R.explode_sides(t["broker_listings"]).groupBy("zone", "office_key").agg(
        F.count("*").alias("units")
    )


def banded(t: Tables, breaks, list_null: int, close_null: int | None) -> DataFrame:
    return t["listings"].select(
        "listing_key",
        C.price_band("list_price", breaks, list_null).alias("list_band"),
        C.price_band("close_price", breaks, close_null).alias("close_band"),
    )


def labelled(t: Tables, labels: Mapping[str, str]) -> DataFrame:
    label = F.coalesce(C.area_label(C.area_code(), labels), F.lit(""))
    return t["area_listings"].select("listing_key", label.alias("Area"))


# --- operators ---------------------------------------------------------------


def inline_relation_join(t: Tables) -> DataFrame:
    geo = t["listings_geo"]
    towns = J.inline_relation(geo.sparkSession, TOWNS, ["municipality", "municipality_type"])
    return (
        geo.join(towns, ["municipality", "municipality_type"])
        .groupBy("municipality", "municipality_type")
        .agg(F.count("*").alias("n"))
    )


def split_param_join(t: Tables) -> DataFrame:
    items = t["listings"].sparkSession.range(1).select(J.split_items(SUBTYPES, "property_sub_type"))
    return t["listings"].join(items, "property_sub_type").groupBy("property_sub_type").agg(
        F.count("*").alias("n")
    )


def append_union(t: Tables) -> DataFrame:
    located = J.with_geo(t["listings"], t["listings_geo"], ["municipality"])
    regions = t["county_by_region"].select("region", F.col("county").alias("municipality")).distinct()
    three = located.where(F.col("municipality").isin(*TRI)).join(regions, "municipality")
    fourth = located.where(F.col("municipality") == FOURTH).withColumn(
        "region", F.lit(None).cast("string")
    )
    columns = ["municipality", "region", "property_type"]
    return (
        three.select(*columns)
        .unionByName(fourth.select(*columns))
        .groupBy(*columns)
        .agg(F.count("*").alias("n"))
    )


def inventory_asof(t: Tables) -> DataFrame:
    return t["listings"].groupBy("standard_status", "property_type").agg(
        F.count_if(C.on_market_at(eval_day())).alias("on_market")
    )


def source_scope(t: Tables) -> DataFrame:
    rows = PC.county_rows(t["listings"], t, SCOPE).where(SCOPE.covered())
    return rows.groupBy("County", "source_system_id").agg(F.count("*").alias("n"))


def join_two_keys(t: Tables) -> DataFrame:
    placed = J.with_geo(t["listings"], t["listings_geo"], ["municipality"])
    areas = t["area_listings"].select(*LISTING_KEYS, "area")
    return placed.join(areas, list(LISTING_KEYS)).groupBy("municipality", "area").agg(
        F.count("*").alias("n")
    )


def join_dimension(t: Tables) -> DataFrame:
    geo, names = t["listings_geo"], t["county_names"]
    match = (geo["county_fp"] == names["county_fp"]) & (geo["state_fp"] == names["state_num"])
    return geo.join(names, match).groupBy("county_name").agg(F.count("*").alias("n"))


def join_computed_key(t: Tables) -> DataFrame:
    names = t["county_names"].select("state_num", C.county_clean().alias("municipality"))
    return t["listings_geo"].join(names, "municipality").groupBy("municipality", "state_num").agg(
        F.count("*").alias("n")
    )


def join_distinct_dim(t: Tables) -> DataFrame:
    weights = J.region_weights(t["county_by_region"], None).withColumnRenamed("county", "municipality")
    counts = t["listings_geo"].groupBy("municipality").agg(F.count("*").alias("listings"))
    return counts.join(weights, "municipality").select(
        "municipality", (F.col("listings") * F.col("regions")).alias("n")
    )


def left_join_metrics(t: Tables) -> DataFrame:
    """Inventory and sold of every county with sales, from one aggregate."""
    rows = PC.county_rows(t["listings"], t, SCOPE)
    sold = C.in_half_open("close_date", eval_day(), 12) & (F.col("close_price") > 0)
    counts = rows.groupBy("County", "property_type").agg(
        F.count_if(F.col("close_date").isNotNull()).alias("closed"),
        F.nullif(F.count_if(C.on_market_at(eval_day())), F.lit(0)).alias("inventory"),
        F.nullif(F.count_if(sold), F.lit(0)).alias("sold"),
    )
    return counts.where("closed > 0")


def left_join_const(t: Tables) -> DataFrame:
    listings = t["listings"].withColumn("band", C.price_band("list_price", K.BREAKS_16, 16))
    inventory = listings.where(C.on_market_at(eval_day())).groupBy("band").agg(
        F.count("*").alias("total_listings")
    )
    dom = (
        listings.where(F.col("close_date").isNotNull())
        .groupBy("band", F.year("close_date").alias("year"))
        .agg(C.whole_average(F.sum(C.days_on_market()), F.count("*")).alias("avg_dom"))
    )
    return inventory.join(dom.where("year = 2001").drop("year"), "band", "left")


def densify_cross(t: Tables) -> DataFrame:
    geos = t["listings_custom_geo"]
    closed = S.by_close_quarter(t["listings"].where(F.col("close_date").isNotNull()))
    return J.dense_grid(geos, closed, "custom_geo", ["Qtr", "Yr"])


def anti_join(t: Tables) -> DataFrame:
    condos = F.count_if(F.col("property_sub_type") == "Condominium").alias("condos")
    sold = closed_by_town(t).groupBy("municipality", "Qtr", "Yr").agg(condos)
    return J.cells_without(t["listings_geo"], sold, "municipality", ["Qtr", "Yr"], "condos")


def share_of_total(t: Tables) -> DataFrame:
    sides = t["listing_sides"].groupBy("property_type", "office_key").agg(
        F.sum("sides").alias("sides"), F.sum("volume_credit").alias("volume")
    )
    market = Window.partitionBy("property_type")
    return sides.select(
        "property_type",
        "office_key",
        C.percent_share(F.col("sides"), F.sum("sides").over(market)).alias("sides_share"),
        C.percent_share(F.col("volume"), F.sum("volume").over(market)).alias("volume_share"),
    )


def dense_rank_blocks(t: Tables) -> DataFrame:
    return R.dense_rank_by_blocks(office_units(t), ["zone"], "units", "office_rank")


def split_lateral(t: Tables) -> DataFrame:
    """Items of a delimited column by a table function; some texts are NULL or end in an empty item."""
    spark = t["custom_tabs"].sparkSession
    register_functions(spark)
    return spark.sql(
        """select tab_name, service_area, item_number, item
        from (select *, case when tab_type <> 'Zone' then concat(tab_header, '/', service_area, '//') end as text from {tabs}) x,
        lateral split_text(x.text, '/')""",
        tabs=t["custom_tabs"],
    )


def catalog_names(t: Tables) -> DataFrame:
    """Tables over files with the source's columns, read by three-part names."""
    spark = t["county_names"].sparkSession
    names = {}
    for table in ("county_names", "county_by_region"):
        raw = t[table].select(*[F.col(c).cast(kind).alias(source) for c, (source, kind) in TABLES[table].items()])
        path = f"{store.shared_folder(spark)}/source-{table}-{sample_id(t)}"
        names[table] = f"spark_catalog.default.source_{table}_{sample_id(t)}"
        raw.write.mode("overwrite").parquet(path)
        spark.sql(f"drop table if exists {names[table]}")
        spark.sql(f"create table {names[table]} using parquet location '{path}'")
    read = from_catalog(spark, names, case_blind=False)
    return read["county_names"].join(read["county_by_region"], "county").select("county_fp", "county", "region")


def sample_id(t: Tables) -> str:
    return hashlib.md5(t.sf_dir.encode()).hexdigest()


def clustered_quarters(t: Tables) -> DataFrame:
    """A report of two quarters over listings saved in clustered files."""
    spark = t["listings"].sparkSession
    path = f"{store.shared_folder(spark)}/clustered-{sample_id(t)}"
    CL.write_clustered_listings(t["listings"], path, files=8)
    tables = {name: t[name] for name in ("listings_geo", "county_names", "county_by_region")}
    return P.county_level({**tables, "listings": spark.read.parquet(path)}, SCOPE, QUARTERS)


def sql_supply_demand(t: Tables) -> DataFrame:
    """The report called from SQL."""
    PQ.register_reports(t, SUPPLY_RULES, K.BREAKS_16)
    return t["listings"].sparkSession.sql(f"select * from supply_demand(date'{EVAL}', 2000)")


def rank_up_to_own(t: Tables) -> DataFrame:
    ranked = office_units(t).withColumn("office_rank", R.dense_rank_units(["zone"]))
    own = F.when(F.col("office_key") == 5, F.col("office_rank"))
    return (
        ranked.withColumn("_limit", R.rank_limit(own, ["zone"]))
        .where("office_rank <= _limit")
        .drop("_limit")
    )


def explode_sides(t: Tables) -> DataFrame:
    return R.explode_sides(t["broker_listings"]).groupBy("office_key").agg(
        F.count("*").alias("units"), F.sum("list_price").alias("list_volume")
    )


def group_by_expr(t: Tables) -> DataFrame:
    closed = S.by_close_quarter(t["listings"].where(F.col("close_date").isNotNull()))
    return closed.groupBy(C.property_class().alias("property_class"), "Qtr", "Yr").agg(
        F.count("*").alias("n")
    )


def avg_dom_trunc(t: Tables) -> DataFrame:
    dom = C.days_on_market()
    return closed_by_town(t).groupBy("municipality").agg(
        C.whole_average(F.sum(dom), F.count(dom)).alias("avg_dom")
    )


def median_price(t: Tables) -> DataFrame:
    hist = S.sales_histogram(S.sale_measures(closed_by_town(t)), ["municipality", "Yr"])
    return S.exact_median(hist, ["municipality", "Yr"], []).withColumnRenamed("median", "median_price")


def median_dom(t: Tables) -> DataFrame:
    hist = S.sales_histogram(S.sale_measures(closed_by_town(t)), ["municipality"], dom_median=True)
    medians = S.exact_median(hist, ["municipality", "metric"], [])
    return medians.where(F.col("metric") == S.DOM).select(
        "municipality", F.col("median").alias("median_dom")
    )


def grouping_sets_stats(t: Tables) -> DataFrame:
    hist = PC.county_histogram(t, EVAL, SCOPE, strict_parity=True, with_class=True)
    grains = {
        "cell": ["County", "PropertyType"], "county": ["County"], "class": ["PropertyType"], "all": [],
    }
    return PC.side_by_side(hist, grains).select(
        "grain", "County", "PropertyType", "cy_sales_count", "cy_price_per_foot", "cy_MedianPrice",
        "py_sales_count", "py_MedianPrice", "inv_cy", "sold_cy",
    )


def yoy_pivot(t: Tables) -> DataFrame:
    return closed_by_town(t).groupBy("municipality").agg(
        F.sum(F.when(F.col("Yr") == 1999, F.col("close_price"))).alias("volume_py"),
        F.sum(F.when(F.col("Yr") == 2000, F.col("close_price"))).alias("volume_cy"),
    )


def inventory_and_sold(t: Tables, sold) -> DataFrame:
    rows = J.with_geo(t["listings"], t["listings_geo"], ["municipality"])
    return rows.groupBy("municipality").agg(
        F.nullif(F.count_if(C.on_market_at(eval_day())), F.lit(0)).alias("inventory"),
        F.nullif(F.count_if(sold & (F.col("close_price") > 0)), F.lit(0)).alias("sold"),
    )


def months_inventory_year(t: Tables) -> DataFrame:
    counts = inventory_and_sold(t, C.in_half_open("close_date", eval_day(), 12))
    supply = C.months_of_supply_rounded(F.col("inventory"), F.col("sold"))
    return counts.select("municipality", supply.alias("months_inventory"))


def months_inventory_qtr(t: Tables) -> DataFrame:
    frame = FR.quarter_frame(AS_OF)
    counts = inventory_and_sold(t, C.in_trailing("close_date", frame.end, 3))
    supply = C.months_of_supply(F.col("inventory"), F.col("sold"), 3)
    return counts.select("municipality", supply.alias("months_inventory"))


def unit_share(t: Tables) -> DataFrame:
    total = F.sum("units").over(Window.partitionBy("zone")).cast("double")
    return office_units(t).select(
        "zone", "office_key", (F.col("units").cast("double") / total).alias("share")
    )


def yoy_change(t: Tables) -> DataFrame:
    counts = closed_by_town(t).groupBy("municipality", "Qtr", "Yr").agg(F.count("*").alias("n"))
    return counts.withColumn("change", PV.yoy_change("n", ["municipality", "Qtr"]))


def order_custom(t: Tables) -> DataFrame:
    label = C.band_label(C.price_band("list_price", K.BREAKS_5, 5), K.BREAKS_5)
    counts = t["listings"].groupBy(label.alias("band")).agg(F.count("*").alias("n"))
    return counts.orderBy(PV.text_order("band", C.band_texts(K.BREAKS_5)))


def order_zone_number(t: Tables) -> DataFrame:
    tabs = t["custom_tabs"].where("tab_type = 'Zone'")
    areas = tabs.groupBy("tab_name").agg(F.count("*").alias("areas"))
    return areas.orderBy(C.zone_of_tab().try_cast("int"))


def union_all_levels(t: Tables) -> DataFrame:
    geo = t["listings_geo"]
    towns = geo.select(F.col("municipality").alias("place"), F.col("municipality_type").alias("kind"))
    places = geo.select(
        F.col("census_place").alias("place"), F.lit(None).cast("string").alias("kind")
    )
    return towns.unionByName(places).groupBy("place", "kind").agg(F.count("*").alias("n"))


def two_year_inventory(t: Tables) -> DataFrame:
    rows = J.with_geo(t["listings"], t["listings_geo"], ["municipality"])
    wide = rows.groupBy("municipality").agg(
        F.count_if(C.on_market_at(eval_day())).alias("cy_listings"),
        F.count_if(C.on_market_at(C.date_literal(PY_EVAL))).alias("py_listings"),
    )
    years = {"cy": F.lit(EVAL.year), "py": F.lit(PY_EVAL.year)}
    return PA.year_rows(wide, years, ["listings"]).where("listings > 0")


def date_frame_quarter(t: Tables) -> DataFrame:
    days = t["listings"].groupBy("list_date").agg(F.count("*").alias("n"))
    frame, numbers = FR.quarter_frame(F.col("list_date")), FR.calendar_numbers(F.col("list_date"))
    return days.select(
        "list_date", "n", *[c.alias(n) for n, c in {**frame._asdict(), **numbers._asdict()}.items()]
    )


def date_frame_eval(t: Tables) -> DataFrame:
    days = t["listings"].groupBy("list_date").agg(F.count("*").alias("n"))
    frame = FR.eval_frame(F.col("list_date"))
    return days.select("n", *[c.alias(n) for n, c in frame._asdict().items()])


def date_frame_open(t: Tables) -> DataFrame:
    days = t["listings"].groupBy("list_date").agg(F.count("*").alias("n"))
    frame = FR.open_frame(F.col("list_date"))
    return days.select("list_date", "n", *[c.alias(n) for n, c in frame._asdict().items()])


def date_frame_labels(t: Tables) -> DataFrame:
    days = t["listings"].groupBy("list_date").agg(F.count("*").alias("n"))
    labels = FR.frame_labels(FR.open_frame(F.col("list_date")))
    return days.select("list_date", "n", *[c.alias(n) for n, c in labels._asdict().items()])


OPERATORS: dict[str, Callable[[Tables], DataFrame]] = {
    "scan_listings": lambda t: t["listings"].select(
        "listing_key", "source_system_id", "standard_status", "list_date", "list_price"
    ),
    "inline_relation_join": inline_relation_join,
    "split_param_join": split_param_join,
    "split_lateral": split_lateral,
    "catalog_names": catalog_names,
    "distinct_lookup": lambda t: t["property_subtypes"]
    .where(F.col("property_sub_type").isin(*K.PROPERTY_SUBTYPES))
    .distinct(),
    "append_union": append_union,
    "dedupe_keep_first": lambda t: R.firm_directory(t["broker_offices"]),
    "firm_ids_ignore_case": lambda t: R.firm_directory(
        t["broker_offices"].withColumn(
            "office_mls_id", F.when(F.col("office_key") % 2 == 0, F.lower("office_mls_id")).otherwise(F.col("office_mls_id"))
        )
    ),
    "project_star": lambda t: t["listings"].select("*", C.days_on_market().alias("dom")),
    "property_class": lambda t: t["listings"].select(
        "listing_key", C.property_class().alias("property_class")
    ),
    "area_code": lambda t: t["area_listings"].select("listing_key", C.area_code().alias("area_code")),
    "area_label": lambda t: labelled(t, K.AREA_LABELS),
    "area_label_ytd": lambda t: labelled(t, K.AREA_LABELS_SUPPLY),
    "overlapping_areas": lambda t: C.explode_present(
        AREA_RULES.areas(t["area_listings"]), "Area", F.col("areas")
    ).select("listing_key", "Area"),
    "price_band_5": lambda t: banded(t, K.BREAKS_5, 5, None),
    "price_band_4": lambda t: banded(t, K.BREAKS_4, 4, None),
    "price_band_16": lambda t: banded(t, K.BREAKS_16, 16, 16),
    "band_label": lambda t: t["listings"].select(
        "listing_key",
        C.band_label(C.price_band("list_price", K.BREAKS_5, 5), K.BREAKS_5).alias("band"),
    ),
    "brand_normalise": lambda t: t["offices"].select(
        "office_key", "office_name", C.company_name(rules=RULES).alias("company")
    ),
    "firm_prefix": lambda t: t["broker_offices"].select(
        "office_key", "office_mls_id", C.firm_prefix().alias("firm_prefix")
    ),
    "coalesce_name": lambda t: t["broker_offices"].select("office_key", C.firm_name().alias("firm")),
    "county_clean": lambda t: t["county_names"].select(
        "county_fp", "county_name", C.county_clean().alias("county")
    ),
    "days_on_market": lambda t: t["listings"].select(
        "listing_key",
        C.days_on_market().alias("to_close"),
        C.days_on_market("list_date", "contract_date").alias("to_contract"),
    ),
    "zone_key": lambda t: t["custom_tabs"].select("tab_name", C.zone_of_tab().alias("zone")).distinct(),
    "filter_basic": lambda t: t["listings"]
    .where(
        F.col("property_type").isin("Residential", "Land")
        & ~F.col("source_system_id").isin(4, 8)
        & (F.col("standard_status") != "Coming Soon")
        & F.col("building_area").isNotNull()
        & (F.col("close_price").isNull() | (F.col("property_sub_type") == "Duplex"))
    )
    .select("listing_key", "property_type", "standard_status"),
    "filter_like": lambda t: t["listings_custom_geo"]
    .where(F.col("custom_geo").ilike(K.LAKEFRONT_PATTERN))
    .groupBy("custom_geo")
    .agg(F.count("*").alias("n")),
    "filter_between_cast": lambda t: t["area_listings"]
    .where(C.area_code().try_cast("int").between(15, 28))
    .select("listing_key", "area"),
    "inventory_asof": inventory_asof,
    "window_trailing_year": lambda t: by_kind(
        t["listings"].where(C.in_trailing("close_date", FR.quarter_frame(AS_OF).end, 12))
    ),
    "window_trailing_quarter": lambda t: by_kind(
        t["listings"].where(C.in_trailing("close_date", FR.quarter_frame(AS_OF).end, 3))
    ),
    "window_half_open_year": lambda t: by_kind(
        t["listings"].where(C.in_half_open("close_date", eval_day(), 12))
    ),
    "window_six_months": lambda t: by_kind(
        t["listings"].where(C.in_half_open("close_date", eval_day(), 6))
    ),
    "window_open_interval": lambda t: by_kind(
        t["listings"].where(
            C.in_open_interval("contract_date", ranking_frame().cy_start, ranking_frame().cy_end)
        )
    ),
    "filter_quarter": lambda t: by_kind(t["listings"].where(C.in_quarter("close_date", eval_day(), 1))),
    "source_scope": source_scope,
    "yoy_view": lambda t: PV.report_quarter(closed_by_town(t), 2000, 2).select(
        "listing_key", "municipality", "Qtr", "Yr"
    ),
    "join_two_keys": join_two_keys,
    "join_dimension": join_dimension,
    "join_computed_key": join_computed_key,
    "join_distinct_dim": join_distinct_dim,
    "semi_filter": lambda t: J.keep_listed(t["listings"], "property_sub_type", SUBTYPES).select(
        "listing_key", "property_sub_type"
    ),
    "semi_exists": lambda t: by_kind(
        J.having_geo(t["listings"], t["listings_geo"].where("county_fp = 3"))
    ),
    "left_join_metrics": left_join_metrics,
    "left_join_const": left_join_const,
    "anti_join": anti_join,
    "densify_cross": densify_cross,
    "supply_demand": lambda t: P.supply_demand(t, date(1999, 3, 1), 1999, K.BREAKS_5, SUPPLY_RULES),
    "sales_stats": lambda t: S.sales_stats(closed_by_town(t), ["municipality", "Qtr", "Yr"]),
    "share_of_total": share_of_total,
    "rank_up_to_own": rank_up_to_own,
    "explode_sides": explode_sides,
    "group_by_expr": group_by_expr,
    "avg_dom_trunc": avg_dom_trunc,
    "median_price": median_price,
    "median_dom": median_dom,
    "distinct_rows": lambda t: t["listings_geo"].select("municipality", "municipality_type").distinct(),
    "service_area_list": lambda t: R.tab_texts(t["custom_tabs"]),
    "grouping_sets_stats": grouping_sets_stats,
    "yoy_pivot": yoy_pivot,
    "months_inventory_year": months_inventory_year,
    "months_inventory_qtr": months_inventory_qtr,
    "unit_share": unit_share,
    "dense_rank_blocks": dense_rank_blocks,
    "dense_rank_units": lambda t: office_units(t).withColumn(
        "office_rank", R.dense_rank_units(["zone"])
    ),
    "yoy_change": yoy_change,
    "order_multi": lambda t: office_units(t).orderBy("zone", F.desc("units"), "office_key"),
    "order_custom": order_custom,
    "order_zone_number": order_zone_number,
    "firm_office_rank": lambda t: P.firm_rank_counties(t, ranking_frame(), "BRE"),
    "union_all_levels": union_all_levels,
    "two_year_inventory": two_year_inventory,
    "date_frame_quarter": date_frame_quarter,
    "date_frame_eval": date_frame_eval,
    "date_frame_open": date_frame_open,
    "date_frame_labels": date_frame_labels,
}

def facts_refreshed(t: Tables) -> DataFrame:
    """The quarterly county report from a store in which two quarters came late and were refreshed."""
    spark, listings = t["listings"].sparkSession, t["listings"]
    late = C.in_quarters("close_date", QUARTERS) & (F.col("listing_key") % 3 == 0)
    before = {**{name: t[name] for name in ("listings_geo", "county_names", "county_by_region")}}
    before["listings"] = listings.where(~F.coalesce(late, F.lit(False)))
    path = f"{store.shared_folder(spark)}/facts-{sample_id(t)}"
    PF.save(PF.county_facts(before, SCOPE), path)
    PF.refresh(PF.county_facts(t, SCOPE), path, QUARTERS)
    return PF.county_level_from(store.stored_facts(spark, path))


REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "rpt_market_area": lambda t: P.market_area(t, EVAL, PY_EVAL, AS_OF, AREA_RULES),
    "rpt_price_range_area": lambda t: P.price_range_area(
        t, EVAL, PY_EVAL, AS_OF, K.BREAKS_4, AREA_RULES
    ),
    "rpt_supply_demand": lambda t: P.supply_demand(t, EVAL, 2000, K.BREAKS_16, SUPPLY_RULES),
    "rpt_price_range_county": lambda t: P.price_range_county(t, AS_OF, K.BREAKS_5, SCOPE_BANDS),
    "rpt_county_class": lambda t: P.county_class(t, EVAL, SCOPE),
    "rpt_county_all": lambda t: P.county_all(t, EVAL, SCOPE),
    "rpt_custom_geo": lambda t: P.custom_geo(t, SUBTYPES),
    "rpt_towns": lambda t: P.towns_communities(t, TOWNS, COMMUNITIES, PLACES),
    "rpt_share_company": lambda t: P.share_by_company(t, SHARE_SCOPE, RULES, SHARE_FIRST_YEAR),
    "rpt_share_price_range": lambda t: P.share_by_price_range(
        t, K.BREAKS_5, SHARE_SCOPE, RULES, SHARE_FIRST_YEAR
    ),
    "rpt_broker_towns": lambda t: P.broker_rank_towns(t, ranking_frame()),
    "rpt_firm_counties": lambda t: P.firm_rank_counties(t, ranking_frame(), OWN_PREFIX),
    "rpt_firm_zones": lambda t: P.firm_rank_zones(t, ranking_frame(), OWN_PREFIX),
    "rpt_municipality": lambda t: P.municipality_level(t, SUBTYPES),
    "rpt_county_level": lambda t: P.county_level(t, SCOPE),
    "rpt_county_class_corrected": lambda t: P.county_class(t, EVAL, SCOPE, strict_parity=False),
    "rpt_county_all_corrected": lambda t: P.county_all(t, EVAL, SCOPE, strict_parity=False),
    "rpt_share_company_corrected": lambda t: P.share_by_company(
        t, SHARE_SCOPE, RULES, SHARE_FIRST_YEAR, strict_parity=False
    ),
    "rpt_firm_zones_corrected": lambda t: P.firm_rank_zones(
        t, ranking_frame(), OWN_PREFIX, strict_parity=False
    ),
    "rpt_county_level_quarters": lambda t: P.county_level(t, SCOPE, QUARTERS),
    "rpt_supply_demand_sql": sql_supply_demand,
    "rpt_county_level_clustered": clustered_quarters,
    "rpt_county_level_stored": facts_refreshed,
    "suite_county_class": lambda t: SUITE.county_class(SUITE.stage(t)),
    "suite_county_all": lambda t: SUITE.county_all(SUITE.stage(t)),
    "suite_county_level": lambda t: SUITE.county_level(SUITE.stage(t)),
    "suite_price_range_county": lambda t: SUITE.price_range_county(SUITE.stage(t)),
    "inventory_curve": lambda t: P.area_inventory(t, *CURVE_DAYS, AREA_RULES),
    "inventory_months": lambda t: P.county_inventory(t, *CURVE_MONTHS, SCOPE),
    "view_area_yoy": lambda t: P.area_yoy(
        P.market_area(t, EVAL, PY_EVAL, AS_OF, AREA_RULES, QUARTERS), 2000, 2
    ),
    "view_price_point_yoy": lambda t: P.price_point_yoy(
        P.price_range_area(t, EVAL, PY_EVAL, AS_OF, K.BREAKS_4, AREA_RULES),
        2000,
        PV.text_order("listpricebucket", C.band_texts(K.BREAKS_4)),
    ),
    "view_firm_lines": lambda t: P.firm_lines(
        P.firm_blocks(P.firm_rank_counties(t, ranking_frame(), OWN_PREFIX))
    ),
    "view_firm_display": lambda t: P.firm_display(
        P.firm_rank_counties(t, ranking_frame(), OWN_PREFIX)
    ),
}


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and other numbers as double, for comparison across engines.

    32-bit ratios and figures summed in floating point are rounded to four places; medians are not.
    """
    inexact = re.compile("price_?per_?foot(?!.*_change$)", re.IGNORECASE)
    columns = []
    for field in df.schema.fields:
        value, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            value = value.cast("bigint")
        elif isinstance(kind, T.DecimalType):
            value = value.cast("double")
        elif isinstance(kind, T.FloatType):
            value = F.round(value.cast("double"), 4)
        elif isinstance(kind, T.DoubleType) and inexact.search(field.name):
            value = F.round(value, 4)
        columns.append(value.alias(field.name))
    return df.select(*columns)
