"""Clustered files and year folders: same rows, and a fraction of them read."""

import glob
import os
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import market_queries as Q
import market_sample
from parcelwise import plans as P
from parcelwise.functions import columns as C
from parcelwise.sources import clustering as CL
from parcelwise.sources import tables as T

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    if not os.path.isdir(LARGER):
        pytest.skip("no larger sample")
    return market_sample.load(spark, LARGER)


@pytest.fixture(scope="module")
def clustered(larger, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "listings")
    CL.write_clustered_listings(larger["listings"], path, files=16, rows_per_file=120)
    return path


def rows_read(spark, df):
    """Rows that the scan hands on, after row groups are skipped."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("listing_key")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_same_rows(spark, larger, clustered):
    stored = spark.read.parquet(clustered)
    assert stored.columns == larger["listings"].columns
    assert stored.exceptAll(larger["listings"]).count() == 0 == larger["listings"].exceptAll(stored).count()


def test_one_quarter_reads_a_fifth_of_the_row_groups(spark, larger, clustered):
    stored = spark.read.parquet(clustered)
    total = stored.count()
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{clustered}/*.parquet"))
    assert groups > 100
    quarter = stored.where(C.in_quarters("close_date", [(1996, 2)]))
    assert quarter.count() > 0 and rows_read(spark, quarter) < total / 5
    changed = stored.where((F.col("status_date") >= date(1996, 4, 1)) & (F.col("status_date") < date(1996, 7, 1)))
    assert changed.count() > 0 and rows_read(spark, changed) < total / 5
    plain = larger["listings"].where(C.in_quarters("close_date", [(1996, 2)]))
    assert plain.count() == quarter.count()


def test_the_prefilter_of_inventory_skips_row_groups(spark, clustered):
    """Listings on the market are kept whatever their dates; of the others only the recent ones are read."""
    stored = spark.read.parquet(clustered)
    recent = stored.where(C.open_or_closed_since(F.lit("2001-04-01").cast("date")))
    others = stored.count() - stored.where(F.col("standard_status").isin(*CL.K.STATUS_ON_MARKET)).count()
    needed = recent.count()
    read = rows_read(spark, recent)
    assert needed <= read < needed + others / 5


def test_reports_on_clustered_listings(spark, larger, clustered):
    t = {n: larger[n] for n in ("listings_geo", "county_names", "county_by_region")}
    ours = P.county_level({**t, "listings": spark.read.parquet(clustered)}, Q.SCOPE, Q.QUARTERS)
    plain = P.county_level({**t, "listings": larger["listings"]}, Q.SCOPE, Q.QUARTERS)
    short = lambda df: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert short(ours) == short(plain) and short(ours)


def test_report_reads_year_folders(spark, larger, tmp_path):
    path = str(tmp_path / "years")
    T.write_by_close_year(larger["listings"], path)
    since = CL.listings_since(spark, path, date(1998, 7, 1))
    read = {r.f for r in since.selectExpr("input_file_name() as f").distinct().collect()}
    years = {f.split("close_year=")[1].split("/")[0] for f in read}
    assert "__HIVE_DEFAULT_PARTITION__" in years and min(years) == "1998"
    t = {n: larger[n] for n in ("listings_geo", "county_names", "county_by_region")}
    ours = P.county_all({**t, "listings": since}, Q.EVAL, Q.SCOPE)
    plain = P.county_all({**t, "listings": larger["listings"]}, Q.EVAL, Q.SCOPE)
    short = lambda df: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert short(ours) == short(plain) and short(ours)


def test_missing_and_single_values(spark, tmp_path):
    frame = spark.createDataFrame([(i, None, 5) for i in range(20)], "k int, a date, b int")
    CL.write_clustered(frame, str(tmp_path / "x"), ["a", "b"], 3)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 20
    CL.write_clustered(frame.limit(0), str(tmp_path / "y"), ["a", "b"], 3)
    assert spark.read.parquet(str(tmp_path / "y")).count() == 0
