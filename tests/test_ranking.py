from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from parcelwise import plans as P
from parcelwise.functions import frames as FR
from parcelwise.operators import joins as J
from parcelwise.operators import ranking as R


def frame():
    return FR.open_frame(date(2020, 8, 10))
LISTING = (
    "list_office_key long, buyer_office_key long, list_date date, contract_date date, close_date date, "
    "list_price decimal(18,2), close_price decimal(18,2), town string, county_or_parish string, zone string"
)


def listing(office, buyer=None, town="Avon"):
    return (office, buyer, date(2020, 4, 1), date(2020, 4, 11), date(2020, 5, 1), Decimal(100), Decimal(90),
            town, "County A", "1")


def market(spark, units, offices, tabs):
    """Listings so that each office has the given number of units."""
    rows = [listing(k) for k, n in units.items() for _ in range(n)]
    return {
        "broker_listings": spark.createDataFrame(rows, LISTING),
        "broker_offices": spark.createDataFrame(
            offices, "office_key long, office_name string, company string, office_mls_id string, office_city string"
        ),
        "custom_tabs": spark.createDataFrame(
            tabs, "tab_name string, tab_type string, tab_header string, service_area string"
        ),
    }


def office(key, prefix=None, company=None):
    name = prefix or f"F{chr(65 + key)}RE"
    return (key, f"Office {key}", company, f"{name}{key:02d}"[-6:], f"City {key}")


TOWN_TABS = [("Avon", "Town", "Avon DERE00", "Avon")]


def closed_ranks(report):
    rows = [r for r in report.collect() if r.GroupType == "ytdClosed"]
    return sorted((r.OfficeRank, r.MLSID) for r in rows)


def test_top_five_when_own_office_is_above(spark):
    offices = [office(0, "DERE")] + [office(k) for k in range(1, 9)]
    units = {0: 10, **{k: 12 - 2 * (k - 3) if k > 3 else 20 - k for k in range(1, 9)}}
    ranks = closed_ranks(P.broker_rank_towns(market(spark, units, offices, TOWN_TABS), frame()))
    assert {r for r, _ in ranks} == {1, 2, 3, 4, 5}
    assert any(i == "DERE00" for _, i in ranks)


def test_extended_to_own_rank(spark):
    offices = [office(0, "DERE")] + [office(k) for k in range(1, 12)]
    units = {0: 4, **{k: 16 - k for k in range(1, 12)}}
    ranks = closed_ranks(P.broker_rank_towns(market(spark, units, offices, TOWN_TABS), frame()))
    assert ranks[-1] == (12, "DERE00") and len(ranks) == 12


def test_nothing_without_own_office(spark):
    offices = [office(k) for k in range(1, 4)]
    report = P.broker_rank_towns(market(spark, {1: 3, 2: 2, 3: 1}, offices, TOWN_TABS), frame())
    assert report.count() == 0


def test_ties_share_a_rank_and_all_stay(spark):
    offices = [office(0, "DERE")] + [office(k) for k in range(1, 9)]
    units = {0: 9, 1: 8, 2: 7, 3: 6, 4: 5, 5: 5, 6: 5, 7: 1, 8: 1}
    ranks = closed_ranks(P.broker_rank_towns(market(spark, units, offices, TOWN_TABS), frame()))
    assert [r for r, _ in ranks] == [1, 2, 3, 4, 5, 5, 5]


def test_two_own_offices_use_the_lower_one(spark):
    tabs = [("Avon", "Town", "DERE00/DERE11", "Avon")]
    offices = [office(0, "DERE"), office(11, "DERE")] + [office(k) for k in range(1, 10)]
    units = {0: 30, 11: 1, **{k: 20 - k for k in range(1, 10)}}
    header_ids = closed_ranks(P.broker_rank_towns(market(spark, units, offices, tabs), frame()))
    assert header_ids[-1] == (11, "DERE11") and len(header_ids) == 11


def test_both_sides_count(spark):
    df = spark.createDataFrame([listing(1, 2), listing(1, 1), listing(3)], LISTING)
    counts = {r.office_key: r["count"] for r in R.explode_sides(df).groupBy("office_key").count().collect()}
    assert counts == {1: 3, 2: 1, 3: 1}


def test_firms_with_all_their_offices(spark):
    """The firm without a prefix takes a rank but is not shown."""
    offices = [
        office(0, "DERE", "Own"), office(1, "DERE", "Own"), office(2, "BIGG", "Big"), office(3, "SMAL", "Small"),
        (4, "No digits", None, "LETTERS", "City"),
    ]
    tabs = [("County A", "County", "County A DERE00", "Avon")]
    units = {0: 3, 1: 2, 2: 9, 3: 1, 4: 7}
    rows = P.firm_rank_counties(market(spark, units, offices, tabs), frame()).collect()
    closed = [r for r in rows if r.GroupType == "ytdClosed"]
    firms = {r.FirmPrefix: r for r in closed if r.FirmRank is not None}
    assert {p: r.FirmRank for p, r in firms.items()} == {"BIGG": 1, "DERE": 3, "SMAL": 4}
    assert firms["DERE"].NoUnits == 5 and firms["DERE"].PercUnits == 5 / 22
    assert sorted(r.MLSID for r in closed if r.FirmPrefix == "DERE" and r.OfficeRank) == ["DERE00", "DERE01"]
    assert firms["DERE"].AvgPrice == 90 and firms["DERE"].avg_DOM == 10


def test_zone_shares_by_town_or_zone(spark):
    offices = [office(0, "DERE", "Own"), office(1, "BIGG", "Big")]
    tabs = [("Zone 1", "Zone", "Zone DERE00", "Elsewhere"), ("Zone 1", "Zone", "Zone DERE00", "Avon")]
    tables = market(spark, {0: 2, 1: 2}, offices, tabs)
    extra = spark.createDataFrame([listing(1, None, "Far")] * 4, LISTING)
    tables["broker_listings"] = tables["broker_listings"].union(extra)

    def shares(**flags):
        rows = P.firm_rank_zones(tables, frame(), **flags).collect()
        return {r.GroupType: r.PercUnits for r in rows if r.FirmPrefix == "DERE" and r.FirmRank}

    assert shares() == {"ytdClosed": 2 / 8, "ytdUC": 2 / 4}
    assert shares(strict_parity=False) == {"ytdClosed": 2 / 8, "ytdUC": 2 / 8}


def test_tab_text_keeps_empty_entries_and_signs(spark):
    tabs = spark.createDataFrame(
        [("T", "Town", "H", "B & C"), ("T", "Town", "H", None), ("T", "Town", "H", "A"), ("U", "Town", "I", "x")],
        "tab_name string, tab_type string, tab_header string, service_area string",
    )
    texts = {r.TabName: r.message_text for r in R.tab_texts(tabs).collect()}
    assert texts == {"T": ", A, B & C", "U": "x"}


def test_first_firm_of_a_prefix(spark):
    offices = spark.createDataFrame(
        [(1, "Z", None, "AB1", "c"), (2, "Y", "M", "AB2", "c"), (3, None, None, "CD1", "c"),
         (4, "K", None, "CD2", "c"), (5, "L", None, "123", "c")],
        "office_key long, office_name string, company string, office_mls_id string, office_city string",
    )
    firms = {r.FirmPrefix: r.Firm for r in R.firm_directory(offices).collect()}
    assert firms == {"AB": "M", "CD": None}


def test_firms_ignore_case(spark):
    offices = spark.createDataFrame(
        [(1, "Z", None, "AAA01", "c"), (2, "Y", "M", "aaa02", "c")],
        "office_key long, office_name string, company string, office_mls_id string, office_city string",
    )
    assert [tuple(r) for r in R.firm_directory(offices).collect()] == [("AAA", "M")]


def test_grid_and_zero_fill(spark):
    geos = spark.createDataFrame([("a",), ("b",), ("a",)], "geo string")
    facts = spark.createDataFrame([("a", 1, 2020, 5, None)], "geo string, Qtr int, Yr int, n long, price double")
    more = spark.createDataFrame([("b", 2, 2020, 1, 1.0)], facts.schema)
    facts = facts.union(more)
    grid = {tuple(r) for r in J.dense_grid(geos, facts, "geo", ["Qtr", "Yr"]).collect()}
    assert grid == {(g, q, 2020) for g in "ab" for q in (1, 2)}
    filled = J.fill_grid(geos.union(spark.createDataFrame([("c",)], "geo string")), facts, "geo", ["Qtr", "Yr"])
    assert filled.columns == ["geo", "Qtr", "Yr", "n", "price"]
    found = [tuple(r) for r in filled.collect()]
    assert len(found) == len(set(found)) == 6 and {("c", 1, 2020, 0, 0.0), ("c", 2, 2020, 0, 0.0)} <= set(found)
    rows = {r for r in found if r[0] != "c"}
    assert rows == {("a", 1, 2020, 5, None), ("a", 2, 2020, 0, 0.0), ("b", 1, 2020, 0, 0.0), ("b", 2, 2020, 1, 1.0)}


def test_share_by_listing_key_alone_or_with_source(spark):
    """A key that two sources share matches twice under parity, once without it."""
    tables = {
        "listing_sides": spark.createDataFrame(
            [("k", 1, 7, date(2018, 2, 1), Decimal(10), Decimal(10), "Residential", Decimal(1), Decimal(10))],
            "listing_key string, source_system_id int, office_key long, close_date date, list_price decimal(18,2), "
            "close_price decimal(18,2), property_type string, sides decimal(9,2), volume_credit decimal(18,2)",
        ),
        "listings": spark.createDataFrame([("k", 1), ("k", 10)], "listing_key string, source_system_id int"),
        "listings_geo": spark.createDataFrame(
            [("k", 1, 59, 55), ("k", 10, 59, 55)],
            "listing_key string, source_system_id int, county_fp int, state_fp int",
        ),
        "county_names": spark.createDataFrame(
            [(59, 55, "Kenosha County", "Kenosha")],
            "county_fp int, state_num int, county_name string, county string",
        ),
        "offices": spark.createDataFrame([(7, "Keefe X")], "office_key long, office_name string"),
    }
    [parity] = P.share_by_company(tables).collect()
    [exact] = P.share_by_company(tables, strict_parity=False).collect()
    assert (parity.SidesCount, exact.SidesCount) == (4, 1)
    assert parity.Company == exact.Company == "Keefe Real Estate" and parity.SidesMarketShare == 100


def test_dense_rank_by_blocks(spark):
    import random

    from pyspark.sql import Window

    draw = random.Random(4)
    values = [0, 1, 2, 3, 7, 8, 9, 63, 64, 65, 127, 128, 1000, 1001, 2**40, 2**40 + 1, 2**62, None]
    rows = [(k, draw.choice(values)) for k in ["a", "b", None] for _ in range(60)] + [("c", v) for v in range(3000)]
    frame = spark.createDataFrame(rows, "tab string, units bigint").withColumn("row", F.monotonically_increasing_id()).cache()
    ranked = R.dense_rank_by_blocks(frame, ["tab"], "units", "r")
    plain = frame.withColumn("r", F.dense_rank().over(Window.partitionBy("tab").orderBy(F.desc("units"))).cast("bigint"))
    assert sorted(map(repr, ranked.collect())) == sorted(map(repr, plain.select(ranked.columns).collect()))
    # ranges keep their order, so ties and neighbours across ranges are counted right
    blocks = [r.b for r in spark.range(1, 5000).select("id", R.unit_block(F.col("id")).alias("b")).orderBy("id").collect()]
    assert blocks == sorted(blocks) and len(set(blocks)) > 300
    text = ranked._jdf.queryExecution().executedPlan().toString()
    specs = [line for line in text.split("\n") if "Window [" in line]
    assert specs and all("_block" in line for line in specs) and "Cartesian" not in text


def test_split_text_is_a_generator(spark):
    from parcelwise.sources.sql import register_functions

    register_functions(spark)
    spark.createDataFrame([(1, "a|b||"), (2, None), (3, ""), (4, "a.b")], "k int, x string").createOrReplaceTempView("texts_to_split")
    found = spark.sql("select k, item_number, item from texts_to_split, lateral split_text(x, '|')")
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, ""), (3, 1, ""), (4, 1, "a.b")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and "Join" not in plan and "Exchange" not in plan
