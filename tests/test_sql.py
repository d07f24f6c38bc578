"""Reports called from SQL against the functions, and what reaches the scan."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import market_queries as Q
from parcelwise import plans as P
from parcelwise.functions import columns as C
from parcelwise.functions import constants as K
from parcelwise.plans import market_areas as PA
from parcelwise.plans import sql as PQ


@pytest.fixture(scope="module")
def tables(spark, sample, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sql") / "listings")
    sample["listings"].write.parquet(path)
    return {**{n: sample[n] for n in ("listings_geo", "area_listings")}, "listings": spark.read.parquet(path)}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("day,year", [("2000-07-01", 2000), ("2000-03-01", 2000), ("1999-02-15", 1998)])
def test_supply_demand_from_sql(spark, tables, day, year):
    PQ.register_reports(tables, Q.SUPPLY_RULES)
    want = rows(P.supply_demand(tables, day, year, K.BREAKS_16, Q.SUPPLY_RULES))
    assert rows(spark.sql(f"select * from supply_demand(date'{day}', {year})")) == want and want
    spark.sql(f"declare or replace variable report_day date default date'{day}'")
    assert rows(spark.sql(f"select * from supply_demand(report_day, {year})")) == want
    some = spark.sql(f"select * from supply_demand(date'{day}', {year}) where ActiveListings > 1")
    assert rows(some) == rows(P.supply_demand(tables, day, year, K.BREAKS_16, Q.SUPPLY_RULES).where("ActiveListings > 1"))


def test_inventory_from_sql(spark, tables):
    PQ.register_reports(tables, Q.SUPPLY_RULES)
    day = F.lit("2000-05-05").cast("date")
    homes = PA.area_rows(tables["listings"].where(C.on_market_at(day)), tables, Q.SUPPLY_RULES, "Area")
    want = rows(homes.groupBy("Area").agg(F.count("*").alias("ActiveListings")))
    assert rows(spark.sql("select * from area_inventory(date'2000-05-05')")) == want and want


def test_arguments_reach_the_scan(spark, tables):
    PQ.register_reports(tables, Q.SUPPLY_RULES)
    out = io.StringIO()
    with redirect_stdout(out):
        spark.sql("select * from supply_demand(date'2000-07-01', 2000)").explain("formatted")
    pushed = next(p for p in re.findall("PushedFilters: (.*)", out.getvalue()) if "close_date" in p)
    assert "GreaterThanOrEqual(close_date,2000-01-01)" in pushed and "LessThan(list_date,2000-07-01)" in pushed
    assert "GreaterThanOrEqual(status_date,2000-01-01)" in pushed and "standard_status" in pushed
    assert not re.search("NestedLoop|Cartesian|Subquery", out.getvalue())
