"""Inventory as a time series against the test of each single day."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_queries import executed

import market_queries as Q
from parcelwise import plans as P
from parcelwise.functions import columns as C
from parcelwise.functions import constants as K
from parcelwise.operators import intervals

FIRST, LAST = date(2000, 1, 1), date(2000, 12, 31)
STATUSES = [*K.STATUS_ON_MARKET, *K.STATUS_OFF_MARKET, K.STATUS_CLOSED, K.STATUS_UPCOMING, "Draft", None]


def some_listings(spark, n=600, seed=7):
    draw = random.Random(seed)
    start = date(1999, 6, 1)

    def day():
        return None if draw.random() < 0.15 else start + timedelta(draw.randrange(700))

    rows = [(draw.choice("abc"), draw.choice(STATUSES), day(), day(), day()) for _ in range(n)]
    schema = "place string, standard_status string, list_date date, close_date date, status_date date"
    return spark.createDataFrame(rows, schema)


def test_interval_is_the_day_test(spark):
    rows = some_listings(spark)
    come, gone = intervals.market_interval()
    draw = random.Random(3)
    for _ in range(20):
        day = F.lit(date(1999, 1, 1) + timedelta(draw.randrange(1200)))
        inside = F.coalesce((come <= day) & (gone > day), F.lit(False))
        assert rows.where(inside != F.coalesce(C.on_market_at(day), F.lit(False))).count() == 0


def test_curve_equals_fifty_days(spark):
    rows = some_listings(spark)
    curve = {(r.place, r.Day): r.ActiveListings for r in intervals.inventory_curve(rows, ["place"], FIRST, LAST).collect()}
    assert len(curve) == 3 * 366
    days = [FIRST, LAST] + random.Random(1).sample([FIRST + timedelta(i) for i in range(1, 365)], 48)
    tests = [F.count_if(C.on_market_at(F.lit(d))).alias(str(d)) for d in days]
    for r in rows.groupBy("place").agg(*tests).collect():
        assert {d: r[str(d)] for d in days} == {d: curve[r.place, d] for d in days}


def test_weights_steps_and_empty_groups(spark):
    rows = some_listings(spark).withColumn("w", F.lit(3))
    plain = intervals.inventory_curve(rows, ["place"], FIRST, LAST, "month")
    tripled = intervals.inventory_curve(rows, ["place"], FIRST, LAST, "month", F.col("w"))
    assert plain.count() == 36
    assert [3 * r.ActiveListings for r in plain.orderBy("place", "Day").collect()] == [
        r.ActiveListings for r in tripled.orderBy("place", "Day").collect()
    ]
    assert intervals.inventory_curve(rows.where("standard_status = 'Coming Soon'"), ["place"], FIRST, LAST).count() == 0
    assert intervals.inventory_curve(rows, ["place"], LAST, FIRST).count() == 0


def test_curve_gives_the_reports_inventory(sample):
    report = P.market_area(sample, Q.EVAL, Q.PY_EVAL, Q.AS_OF, Q.AREA_RULES).where("Yr = 2000")
    shown = {r.Area: r.ActiveListings or 0 for r in report.collect()}
    curve = P.area_inventory(sample, Q.EVAL, Q.EVAL, Q.AREA_RULES)
    got = {r.Area: r.ActiveListings for r in curve.collect()}
    assert shown and all(got.get(area, 0) == n for area, n in shown.items())


@pytest.mark.parametrize("name", ["inventory_curve", "inventory_months"])
def test_one_pass_whatever_the_number_of_days(sample, name):
    plan = executed(Q.REPORTS[name](sample))
    # listings, geography and areas come from one scan of the orders each
    assert plan.count("FileScan parquet [o_") <= 3
    assert "windowspecdefinition(day" not in plan and "NestedLoopJoin" not in plan and "Cartesian" not in plan
