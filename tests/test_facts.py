"""Stored histograms: reports from the store, late quarters, and what a refresh reads and writes."""

import glob
import io
import os
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import market_queries as Q
from parcelwise import plans as P
from parcelwise.functions import columns as C
from parcelwise.functions import constants as K
from parcelwise.plans import facts as PF
from parcelwise.sources import facts as store

LATE = [(2000, 2), (1999, 4)]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def tables(spark, sample, tmp_path):
    """The sample with listings in Parquet, so that pushed filters can be seen."""
    t = {n: sample[n] for n in ("listings_geo", "county_names", "county_by_region")}
    sample["listings"].write.parquet(str(tmp_path / "listings"))
    t["listings"] = spark.read.parquet(str(tmp_path / "listings"))
    return t


def files(path, but=()):
    found = {}
    for f in glob.glob(f"{path}/Yr=*/Qtr=*/*.parquet"):
        year, quarter = map(int, re.search(r"Yr=(\d+)/Qtr=(\d+)", f).groups())
        if (year, quarter) not in but:
            found[f] = os.stat(f).st_mtime_ns
    return found


def test_late_quarters_replace_their_folders_only(spark, tables, tmp_path):
    path = str(tmp_path / "facts")
    late = C.in_quarters("close_date", LATE) & (F.col("listing_key") % 3 == 0)
    early = {**tables, "listings": tables["listings"].where(~F.coalesce(late, F.lit(False)))}
    PF.save(PF.county_facts(early, Q.SCOPE), path)
    assert rows(PF.county_level_from(store.stored_facts(spark, path))) == rows(P.county_level(early, Q.SCOPE))
    full = rows(P.county_level(tables, Q.SCOPE))
    assert full != rows(P.county_level(early, Q.SCOPE))
    kept = files(path, LATE)
    PF.refresh(PF.county_facts(tables, Q.SCOPE), path, LATE)
    assert rows(PF.county_level_from(store.stored_facts(spark, path))) == full
    assert files(path, LATE) == kept and kept


def test_a_refresh_reads_its_quarters_and_a_report_its_folders(spark, tables, tmp_path):
    path = str(tmp_path / "facts")
    facts = PF.county_facts(tables, Q.SCOPE)
    PF.save(facts, path, files=3)
    pushed = next(p for p in formatted(facts([(2000, 2)]), "PushedFilters") if "close_date" in p)
    assert "GreaterThanOrEqual(close_date,2000-04-01)" in pushed and "LessThan(close_date,2000-07-01)" in pushed
    some = store.stored_facts(spark, path, [(2000, 2), (1999, 2)])
    folders = formatted(PF.county_level_from(some), "PartitionFilters")
    assert folders and all("Yr" in f and "Qtr" in f for f in folders)
    assert rows(PF.county_level_from(some)) == rows(P.county_level(tables, Q.SCOPE, [(2000, 2), (1999, 2)]))
    read = {r.f for r in some.selectExpr("input_file_name() as f").distinct().collect()}
    assert read and all("Yr=2000/Qtr=2" in f or "Yr=1999/Qtr=2" in f for f in read)


def formatted(df, entry):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return re.findall(rf"^{entry}: (.*)$", out.getvalue(), re.MULTILINE)


def test_a_quarter_can_lose_all_its_sales(spark, tables, tmp_path):
    path = str(tmp_path / "facts")
    PF.save(PF.county_facts(tables, Q.SCOPE), path)
    without = {**tables, "listings": tables["listings"].where("close_date is null or year(close_date) <> 2000 or quarter(close_date) <> 2")}
    PF.refresh(PF.county_facts(without, Q.SCOPE), path, [(2000, 2)])
    got = rows(PF.county_level_from(store.stored_facts(spark, path)))
    assert got == rows(P.county_level(without, Q.SCOPE)) and got
    PF.refresh(PF.county_facts(without, Q.SCOPE), path, [])
    assert rows(PF.county_level_from(store.stored_facts(spark, path))) == got
    # a quarter that was not there before
    PF.refresh(PF.county_facts(tables, Q.SCOPE), path, [(2000, 2), (2031, 1)])
    assert rows(PF.county_level_from(store.stored_facts(spark, path))) == rows(P.county_level(tables, Q.SCOPE))


def test_coarser_reports_and_municipalities(spark, tables, tmp_path):
    path = str(tmp_path / "towns")
    PF.save(PF.municipality_facts(tables), path)
    hist = store.stored_facts(spark, path)
    assert rows(PF.municipality_level_from(hist)) == rows(P.municipality_level(tables))
    some = K.PROPERTY_SUBTYPES[:2]
    assert rows(PF.municipality_level_from(hist, some)) == rows(P.municipality_level(tables, ",".join(some)))
    years = PF.county_years_from(PF.county_facts(tables, Q.SCOPE)(None)).collect()
    quarters = P.county_level(tables, Q.SCOPE).collect()
    for r in years:
        assert r.sales_count == sum(q.sales_count for q in quarters if (q.County, q.Yr) == (r.County, r.Yr))
    prices = sale_prices(tables)
    for r in years:
        mine = sorted(prices[r.County, r.Yr])
        assert r.MedianPrice == pytest.approx((mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2, rel=1e-12)


def sale_prices(tables):
    found = {}
    for r in P.counties.county_sales(tables, Q.SCOPE).where("close_price is not null").collect():
        found.setdefault((r.County, r.Yr), []).append(float(r.close_price))
    return found
