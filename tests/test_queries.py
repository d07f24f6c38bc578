"""Every query against its SQL, and the shape of the plans behind the reports."""

import io
import os
import re
from contextlib import redirect_stdout

import pytest
from conftest import SAMPLE_DIR
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check_oracles
import market_queries as Q
from parcelwise import plans as P
from parcelwise.functions import columns as C
from parcelwise.functions import constants as K
from parcelwise.operators import statistics as S
from parcelwise.plans import views as PV
from parcelwise.sources import tables as T

# Seven suppliers are too few for these to find an own office in every period.
MAY_BE_EMPTY = {"rank_up_to_own", "rpt_broker_towns", "rpt_firm_counties", "rpt_firm_zones",
                "firm_office_rank", "view_firm_display", "view_firm_lines", "left_join_const"}


@pytest.fixture(scope="session")
def db():
    return check_oracles.connect(SAMPLE_DIR)


MARKET = [*Q.OPERATORS, *Q.REPORTS]


def test_every_query_has_sql():
    assert set(MARKET) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", MARKET)
def test_query_agrees_with_sql(spark, db, name):
    problem = check_oracles.compare(spark, db, SAMPLE_DIR, name)
    assert problem == "" or (problem == "no rows" and name in MAY_BE_EMPTY)


LARGER_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(LARGER_DIR), reason="no larger sample")
@pytest.mark.parametrize("name", sorted(MAY_BE_EMPTY))
def test_rankings_have_rows_and_agree(spark, name):
    assert check_oracles.compare(spark, check_oracles.connect(LARGER_DIR), LARGER_DIR, name) == ""


def test_orders(sample):
    units = [(r.zone, -r.units, r.office_key) for r in Q.OPERATORS["order_multi"](sample).collect()]
    assert units == sorted(units) and len(set(units)) > 2
    texts = C.band_texts(K.BREAKS_5)
    bands = [texts.index(r.band) for r in Q.OPERATORS["order_custom"](sample).collect()]
    assert bands == sorted(bands) and len(bands) > 2
    zones = [int(r.tab_name.split()[1]) for r in Q.OPERATORS["order_zone_number"](sample).collect()]
    assert zones == sorted(zones) and len(zones) > 2
    areas = [(r.Area, r.Yr) for r in Q.REPORTS["view_area_yoy"](sample).collect()]
    assert areas == sorted(areas) and areas
    points = [(r.area, K_ORDER.index(r.listpricebucket)) for r in Q.REPORTS["view_price_point_yoy"](sample).collect()]
    assert points == sorted(points) and points


K_ORDER = C.band_texts(K.BREAKS_4)


def test_firm_display_order(spark):
    rows = [
        ("T", "g", p, f, c, m, 1, 1.0, 1, 0.5, fr, o)
        for p, f, c, m, fr, o in [
            ("B", "Bee", None, None, 1, None), ("A", "Ay", None, None, 2, None), ("A", "Ay", "X", "A2", None, 3),
            ("A", "Ay", "Y", "A1", None, 1), ("B", "Bee", "Z", "B1", None, 2),
        ]
    ]
    ranking = spark.createDataFrame(
        rows,
        "TabName string, GroupType string, FirmPrefix string, Firm string, OfficeCity string, MLSID string, NoUnits int, "
        "AvgPrice double, avg_DOM int, PercUnits double, FirmRank int, OfficeRank int",
    )
    assert [r.DisplayName for r in P.firm_display(ranking).collect()] == ["Bee", "Z", "Ay", "Y", "X"]


def test_firm_blocks_nest_and_line_up(spark):
    schema = (
        "TabName string, GroupType string, FirmPrefix string, Firm string, OfficeCity string, MLSID string, NoUnits int, "
        "AvgPrice double, avg_DOM int, PercUnits double, FirmRank int, OfficeRank int"
    )
    rows = [
        ("T", "ytdClosed", p, f, c, m, 1, 1.0, 1, 0.5, fr, o)
        for p, f, c, m, fr, o in [
            ("B", "Bee", None, None, 1, None), ("A", "Ay", None, None, 2, None), ("A", "Ay", None, "A2", None, 3),
            ("A", "Ay", "Y", "A1", None, 1), ("B", "Bee", "Z", "B1", None, 2),
        ]
    ] + [("T", "pytdUC", "A", "Ay", None, None, 7, 2.0, None, 1.0, 1, None)]
    blocks = P.firm_blocks(spark.createDataFrame(rows, schema))
    tab = blocks.first()
    assert [(f.Firm, [o.MLSID for o in f.offices]) for f in tab.ytdClosed] == [("Bee", ["B1"]), ("Ay", ["A1", "A2"])]
    assert tab.ytdUC == [] and [f.NoUnits for f in tab.pytdUC] == [7]
    lines = P.firm_lines(blocks).collect()
    assert [(r.Line, r.ytdClosed_Name, r.pytdUC_Name) for r in lines] == [
        (1, "Bee", "Ay"), (2, "Z", None), (3, "Ay", None), (4, "Y", None), (5, "Ay", None)
    ]
    assert P.firm_lines(blocks.where("false")).count() == 0


def test_change_is_from_the_year_before(spark):
    rows = [("a", 2, 2019, 100), ("a", 2, 2021, 150), ("a", 2, 2022, 75), ("b", 2, 2020, 0), ("b", 2, 2021, 5), ("b", 2, 2022, None)]
    frame = spark.createDataFrame(rows, "Area string, Qtr int, Yr int, n int")
    got = {(r.Area, r.Yr): r.c for r in frame.select("Area", "Yr", PV.yoy_change("n").alias("c")).collect()}
    assert got == {("a", 2019): None, ("a", 2021): None, ("a", 2022): -0.5, ("b", 2020): None, ("b", 2021): None, ("b", 2022): -1.0}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def executed(df):
    df.collect()
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue().split("== Initial Plan ==")[0]


# Listings, geography and area table come from one scan of the orders each, the
# geography and area table also from one of the customers.
REPORT_SCANS = {
    "rpt_market_area": {"orders": 3, "customer": 2},
    "rpt_price_range_area": {"orders": 3, "customer": 2},
    "rpt_supply_demand": {"orders": 3, "customer": 2},
    "rpt_county_class": {"orders": 2, "customer": 1},
    "rpt_county_all": {"orders": 2, "customer": 1},
    "rpt_county_level": {"orders": 2, "customer": 1},
    "rpt_price_range_county": {"orders": 2, "customer": 1},
    "rpt_municipality": {"orders": 2, "customer": 1},
    "rpt_custom_geo": {"orders": 4, "customer": 1},
    "rpt_towns": {"orders": 4, "customer": 2},
    "rpt_share_company": {"orders": 4, "customer": 1},
    "rpt_share_price_range": {"orders": 4, "customer": 1},
    "view_area_yoy": {"orders": 3, "customer": 2},
    "view_price_point_yoy": {"orders": 3, "customer": 2},
    "view_firm_display": {"orders": 1, "customer": 1},
    "rpt_broker_towns": {"orders": 1, "customer": 1},
    "rpt_firm_counties": {"orders": 1, "customer": 1},
    "rpt_firm_zones": {"orders": 1, "customer": 1},
}
KEY_COLUMNS = {"orders": "o_orderkey", "customer": "c_custkey"}


@pytest.mark.parametrize("name", list(REPORT_SCANS))
def test_each_table_is_scanned_once(sample, name):
    plan = executed(Q.REPORTS[name](sample))
    assert not re.search("CartesianProduct|NestedLoopJoin|Python", plan)
    for table, scans in REPORT_SCANS[name].items():
        found = len(re.findall(rf"FileScan parquet \[[^\]]*\b{table[0]}_\w+", plan))
        assert 0 < found <= scans, plan


@pytest.mark.parametrize("name", ["rpt_municipality", "rpt_custom_geo"])
def test_the_median_reuses_the_histogram_shuffle(sample, name):
    assert "ReusedExchange" in executed(Q.REPORTS[name](sample))


@pytest.mark.parametrize(
    "report", [lambda t, **k: P.county_level(t, Q.SCOPE, **k), P.municipality_level]
)
def test_one_quarter_of_a_report(sample, report):
    """The parameter keeps one read of the listings, and gives the rows that a filter gives."""
    wanted = "Yr = 2000 and Qtr = 2"
    filtered, asked = report(sample).where(wanted), report(sample, quarters=[(2000, 2)])
    reads = [
        len(re.findall(r"FileScan parquet \[[^\]]*\bo_\w+", executed(df))) for df in (asked, report(sample))
    ]
    assert reads[0] == reads[1]
    rows = sorted(map(repr, filtered.collect()))
    assert rows == sorted(map(repr, asked.collect())) and rows


def test_quarters_parameter(sample):
    pairs = ((1999, 2), (2000, 3))
    for report in (P.municipality_level, lambda t, **k: P.county_level(t, Q.SCOPE, **k), lambda t, **k: P.towns_communities(t, Q.TOWNS, Q.COMMUNITIES, Q.PLACES, **k)):
        some = sorted(map(repr, report(sample, quarters=pairs).collect()))
        assert some == sorted(repr(r) for r in report(sample).collect() if (r.Yr, r.Qtr) in pairs) and some
    areas = P.market_area(sample, Q.EVAL, Q.PY_EVAL, Q.AS_OF, Q.AREA_RULES, Q.QUARTERS)
    every = P.market_area(sample, Q.EVAL, Q.PY_EVAL, Q.AS_OF, Q.AREA_RULES)
    assert sorted(map(repr, areas.collect())) == sorted(repr(r) for r in every.collect() if (r.Yr, r.Qtr) in Q.QUARTERS)


@pytest.fixture(scope="module")
def stored(spark, sample):
    """All tables cleaned and saved by the library, and read back by it."""
    names = ("listings", "listings_geo", "area_listings", "county_names", "county_by_region")
    T.store_tables({n: sample[n] for n in names}, "st_", 4)
    yield T.stored_tables(spark, "st_", names)
    for n in names:
        spark.sql(f"drop table st_{n}")


STORED_REPORTS = {
    "price_range_area": lambda t: P.price_range_area(t, Q.EVAL, Q.PY_EVAL, Q.AS_OF, K.BREAKS_4, Q.AREA_RULES),
    "supply_demand": lambda t: P.supply_demand(t, Q.EVAL, 2000, K.BREAKS_16, Q.SUPPLY_RULES),
    "price_range_county": lambda t: P.price_range_county(t, Q.AS_OF, K.BREAKS_5, Q.SCOPE_BANDS),
    "county_class": lambda t: P.county_class(t, Q.EVAL, Q.SCOPE),
    "county_all": lambda t: P.county_all(t, Q.EVAL, Q.SCOPE),
}


@pytest.mark.parametrize("name", list(STORED_REPORTS))
def test_filters_reach_the_stored_listings(stored, sample, name):
    out = io.StringIO()
    with redirect_stdout(out):
        STORED_REPORTS[name](stored).explain("formatted")
    scans = [s for s in out.getvalue().split("\n\n") if "st_listings\n" in s and "PushedFilters" in s]
    assert scans
    for scan in scans:
        pushed = re.search("PushedFilters: (.*)", scan).group(1)
        assert "close_date" in pushed and "property_type" in pushed and "standard_status" in pushed and "status_date" in pushed
    assert sorted(map(repr, STORED_REPORTS[name](stored).collect())) == sorted(map(repr, STORED_REPORTS[name](sample).collect()))


def test_stored_listings_meet_their_geography_without_a_shuffle(spark, stored):
    from parcelwise.operators.joins import with_geo

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = with_geo(stored["listings"].where("property_type = 'Land'"), stored["listings_geo"], ["county_fp"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("query", [Q.REPORTS["rpt_custom_geo"], Q.OPERATORS["anti_join"]])
def test_zero_filled_grid_reads_its_facts_once(sample, query):
    plan = executed(query(sample))
    assert not re.search("CartesianProduct|NestedLoopJoin|Exchange SinglePartition", plan)
    # no window gathers all rows in one task: each has something to partition by
    assert not re.search(r"windowspecdefinition\((specifiedwindowframe|\w+#\d+L? (ASC|DESC))", plan)
    assert "ReusedExchange" in plan
    assert len(re.findall(r"FileScan parquet \[[^\]]*\bo_totalprice|FileScan parquet \[[^\]]*\bo_orderpriority", plan)) == 1


def test_grid_keeps_null_members_and_periods(spark):
    members = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "m string")
    facts = spark.createDataFrame([("a", 1, 5, 2.5), (None, 1, 7, None), ("z", None, 9, 1.0)], "m string, p int, n int, x double")
    from parcelwise.operators.joins import cells_without, fill_grid

    got = {tuple(r) for r in fill_grid(members, facts, "m", ["p"]).collect()}
    assert got == {("a", 1, 5, 2.5), ("a", None, 0, 0.0), ("b", 1, 0, 0.0), ("b", None, 0, 0.0), (None, 1, 7, None), (None, None, 0, 0.0)}
    assert {tuple(r) for r in cells_without(members, facts, "m", ["p"], "n").collect()} == {("a", None), ("b", 1), ("b", None), (None, None)}
    assert fill_grid(members, facts.where("1 = 0"), "m", ["p"]).count() == 0


def test_filters_reach_the_listing_scan(spark, sample, tmp_path):
    path = str(tmp_path / "listings")
    sample["listings"].write.parquet(path)
    tables = {name: sample[name] for name in ("listings_geo", "county_names", "county_by_region")}
    tables["listings"] = spark.read.parquet(path)
    out = io.StringIO()
    with redirect_stdout(out):
        P.county_class(tables, Q.EVAL, Q.SCOPE).explain("formatted")
    scan = next(s for s in out.getvalue().split("\n\n") if str(tmp_path) in s)
    pushed = re.search("PushedFilters: (.*)", scan).group(1)
    assert "close_date" in pushed and "property_type" in pushed and "standard_status" in pushed
    assert "office_key" not in re.search("ReadSchema: (.*)", scan).group(1)


def test_corrected_county_reports(sample):
    parity = {(r.County, r.PropertyType): r for r in P.county_class(sample, Q.EVAL, Q.SCOPE).collect()}
    fixed = {
        (r.County, r.PropertyType): r
        for r in P.county_class(sample, Q.EVAL, Q.SCOPE, strict_parity=False).collect()
    }
    assert set(fixed) <= set(parity)
    assert fixed
    for k, row in fixed.items():
        assert (row.CurrentYearSalesCount or 0) <= (parity[k].CurrentYearSalesCount or 0)
    counties = P.county_all(sample, Q.EVAL, Q.SCOPE, strict_parity=False).collect()
    assert len({r.CurrentTriCountyPricePerFoot for r in counties}) == 1


def test_county_without_regions_counted_once(sample):
    once = P.CountyScope(counties=("NATION_1", "NATION_5"), state=None, fourth=Q.FOURTH, by_region=False)
    twice = P.CountyScope(counties=("NATION_1", "NATION_5"), state=None, fourth=Q.FOURTH)
    weights = {
        name: {r.County: r.weight for r in scope.dimension(sample).collect()}
        for name, scope in {"once": once, "twice": twice}.items()
    }
    assert weights["once"] == {"NATION_1": 1, "NATION_5": 1, "NATION_4": 1}
    assert weights["twice"] == {"NATION_1": 1, "NATION_5": 2, "NATION_4": 1}


def test_shares_add_up(sample):
    report = P.share_by_price_range(sample, scope=Q.SHARE_SCOPE, rules=Q.RULES, first_year=1995)
    totals = report.groupBy("County", "listpricebucket", "date_qtr", "date_year").agg(
        F.sum("SidesMarketShare").alias("sides"), F.sum("VolumeMarketShare").alias("volume")
    )
    rows = totals.collect()
    assert rows
    for r in rows:
        assert r.sides == pytest.approx(100, abs=1e-3) and r.volume == pytest.approx(100, abs=1e-3)


def test_inventory_ignores_coming_soon(sample):
    tables = {name: sample[name] for name in ("listings_geo", "area_listings")}
    reports = []
    for listings in (sample["listings"], sample["listings"].where("standard_status <> 'Coming Soon'")):
        tables["listings"] = listings.where("close_date is null")
        reports.append({tuple(r) for r in P.supply_demand(tables, Q.EVAL, 2000).collect()})
    assert reports[0] == reports[1] and reports[0]


def test_area_years_keep_their_own_inventory(sample):
    rows = P.market_area(sample, Q.EVAL, Q.PY_EVAL, Q.AS_OF, Q.AREA_RULES).collect()
    for year, shown in ((2000, True), (1999, True), (1998, False)):
        assert any(r.ActiveListings is not None for r in rows if r.Yr == year) == shown


def test_stats_of_an_empty_table(sample):
    rows = S.by_close_quarter(sample["listings"].where("1 = 0"))
    assert S.sales_stats(rows, ["Qtr", "Yr"]).count() == 0
