from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import market_queries
from parcelwise.sources import schemas, tables


def source_rows(spark):
    rows = [
        ("k1 ", 1, "Closed", "Residential", "Duplex  ", date(2020, 1, 1), date(2020, 2, 1),
         datetime(2020, 2, 2, 3, 4), Decimal("5.00"), Decimal("4.00"), Decimal("2.00")),
        ("k2", 4, "active", "Residential", None, date(2020, 1, 1), None, datetime(2020, 2, 2),
         Decimal("5.00"), None, None),
    ]
    return spark.createDataFrame(rows, schemas.source_schema("listings"))


def test_read_parquet_under_library_names(spark, tmp_path):
    path = str(tmp_path / "listings")
    source_rows(spark).withColumn("Unused", F.lit(1)).write.parquet(path)
    listings = tables.from_parquet(spark, {"listings": path})["listings"]
    assert listings.columns == list(schemas.TABLES["listings"])
    first = listings.where("listing_key = 'k1'").collect()[0]
    assert first.property_sub_type == "Duplex" and first.close_price == Decimal("4.00")


def test_case_blind_text(spark):
    listings = tables.standardise(source_rows(spark), "listings")
    assert listings.where("standard_status = 'Active'").count() == 1
    exact = tables.standardise(source_rows(spark), "listings", case_blind=False)
    assert exact.where("standard_status = 'Active'").count() == 0
    places = spark.createDataFrame([(None,) * 7], schemas.source_schema("listings_geo"))
    assert "LCASE" in str(tables.standardise(places, "listings_geo").schema["municipality"].dataType)


def test_codes_get_their_usual_spelling(spark):
    values = [("CLOSED",), ("active under contract",), ("Odd Value",), (None,)]
    got = spark.createDataFrame(values, "v string").select(tables.spelled(F.col("v"), tables.CODES["standard_status"])).collect()
    assert [r[0] for r in got] == ["Closed", "Active Under Contract", "Odd Value", None]


def test_keyed_tables_join_without_a_shuffle(spark, sample):
    for name in ("listings", "listings_geo"):
        tables.write_keyed(sample[name], f"keyed_{name}", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("keyed_listings").join(spark.table("keyed_listings_geo"), list(tables.LISTING_KEYS))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == sample["listings"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table keyed_listings")
        spark.sql("drop table keyed_listings_geo")


def test_catalog_names(spark):
    source_rows(spark).write.mode("overwrite").saveAsTable("raw_listings")
    try:
        got = tables.from_catalog(spark, {"listings": "spark_catalog.default.raw_listings"})["listings"]
        assert got.count() == 2
    finally:
        spark.sql("drop table raw_listings")


def test_folders_by_source_and_year_prune(spark, sample, tmp_path):
    path = str(tmp_path / "by_year")
    tables.write_by_close_year(sample["listings"], path)
    part = spark.read.parquet(path).where("close_year = 2000 and source_system_id = 1")
    assert "PartitionFilters: [isnotnull(close_year" in part._jdf.queryExecution().executedPlan().toString()
    assert part.count() == sample["listings"].where("year(close_date) = 2000 and source_system_id = 1").count()


def test_saved_report(spark, sample, tmp_path):
    report = sample["listings"].groupBy("property_type").agg(F.count("*").alias("n"))
    tables.save_report(report, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).count() == report.count()


REPORTS_READ = (
    "rpt_market_area", "rpt_price_range_area", "rpt_supply_demand", "rpt_price_range_county",
    "rpt_county_class", "rpt_county_all", "rpt_custom_geo", "rpt_towns", "rpt_share_price_range",
    "rpt_broker_towns", "rpt_firm_counties", "rpt_firm_zones",
)


@pytest.fixture(scope="module")
def ingested(spark, sample):
    """The sample under source names, with shouting text and trailing blanks, read case-blind."""
    out = {}
    for table, columns in schemas.TABLES.items():
        raw = sample[table].select(
            *[
                (F.concat(F.upper(c), F.lit("  ")) if c in ("standard_status", "property_type") else F.col(c))
                .cast(kind)
                .alias(source)
                for c, (source, kind) in columns.items()
            ]
        )
        out[table] = tables.standardise(raw, table)
    return out


@pytest.mark.parametrize("name", REPORTS_READ)
def test_case_blind_tables_give_the_same_report(sample, ingested, name):
    def rows(source):
        return sorted(map(repr, market_queries.comparable(market_queries.REPORTS[name](source)).collect()))

    assert rows(ingested) == rows(sample)
