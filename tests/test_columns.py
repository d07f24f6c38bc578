import itertools
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import columns as C
from parcelwise.functions import constants as K
from parcelwise.functions import frames as FR

DAY = date(2020, 7, 1)
BEFORE, AFTER = DAY - timedelta(days=1), DAY + timedelta(days=1)
STATUSES = [*K.STATUS_ON_MARKET, *K.STATUS_OFF_MARKET, K.STATUS_CLOSED, K.STATUS_UPCOMING, None]


def was_listed(status, listed, closed, changed):
    """The inventory rule, case by case; an unknown comparison is false."""
    if status is None or status == "Coming Soon" or not listed < DAY:
        return False
    if status in ("Active", "Active Under Contract", "Pending"):
        return True
    if status == "Closed":
        end = closed or changed
        return end is not None and end > DAY
    return (closed is None or closed > DAY) and changed is not None and changed > DAY


def test_on_market_every_status_and_date(spark):
    cases = list(itertools.product(STATUSES, [BEFORE, DAY], [None, DAY, AFTER], [None, DAY, AFTER]))
    schema = "standard_status string, list_date date, close_date date, status_date date"
    rows = spark.createDataFrame(cases, schema)
    held = rows.withColumn("held", F.coalesce(C.on_market_at(F.lit(DAY)), F.lit(False))).collect()
    assert len(held) == len(cases)
    for row in held:
        assert row.held == was_listed(*row[:4]), row


def test_on_market_at_unknown_day_is_empty(spark):
    rows = spark.createDataFrame(
        [("Active", BEFORE, None, None)],
        "standard_status string, list_date date, close_date date, status_date date",
    )
    assert rows.where(C.on_market_at(F.lit(None).cast("date"))).count() == 0


def test_old_sales_filter_keeps_all_that_counts(spark):
    days = [BEFORE - timedelta(days=400), BEFORE, DAY, AFTER, None]
    cases = list(itertools.product(STATUSES, [BEFORE], days, [None, DAY, AFTER]))
    rows = spark.createDataFrame(
        cases, "standard_status string, list_date date, close_date date, status_date date"
    )
    counts = C.on_market_at(F.lit(DAY)) | (F.col("close_date") >= DAY)
    kept = C.open_or_closed_since(F.lit(DAY))
    assert rows.where(counts).count() == rows.where(counts & kept).count() > 0
    assert rows.where(kept).count() < rows.count()
    old = rows.where("standard_status = 'Expired' and close_date is null and status_date is null")
    assert old.count() > 0 and old.where(kept).count() == 0


def test_quarters_as_date_ranges(spark):
    days = [date(1999, 12, 31), date(2000, 1, 1), date(2000, 3, 31), date(2000, 4, 1), date(2001, 12, 31), None]
    rows = spark.createDataFrame([(d,) for d in days], "close_date date")
    kept = [r.close_date for r in rows.where(C.in_quarters("close_date", [(2000, 1), (2001, 4)])).collect()]
    assert kept == [days[1], days[2], days[4]]
    assert rows.where(C.in_quarters("close_date", None)).count() == 5 and rows.where(C.in_quarters("close_date", [])).count() == 0


@pytest.mark.parametrize(
    ("breaks", "null_band"), [(K.BREAKS_4, 4), (K.BREAKS_5, None), (K.BREAKS_5, 5), (K.BREAKS_16, 16)]
)
def test_price_band_edges(spark, breaks, null_band):
    prices = [None, Decimal(0)]
    for b in breaks:
        prices += [Decimal(b) - Decimal("0.01"), Decimal(b)]
    df = spark.createDataFrame([(p,) for p in prices], "price decimal(18,2)")
    bands = [r[0] for r in df.select(C.price_band("price", breaks, null_band)).collect()]
    expected = [null_band, 1] + [n for i in range(len(breaks)) for n in (i + 1, i + 2)]
    assert bands == expected


def test_band_labels(spark):
    assert C.band_texts(K.BREAKS_5) == [
        "$0 - $124,999", "$125,000 - $199,999", "$200,000 - $349,999", "$350,000 - $499,999", "$500,000+",
    ]
    df = spark.createDataFrame([(1,), (5,), (None,)], "band int")
    labels = [r[0] for r in df.select(C.band_label("band", K.BREAKS_5)).collect()]
    assert labels == ["$0 - $124,999", "$500,000+", None]


def values(spark, inputs, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in inputs], "x string").select(column).collect()]


def test_area_code(spark):
    inputs = ["21 - X", "21-X", "21", " 21 ", "Unknown", "", None, "-x"]
    assert values(spark, inputs, C.area_code("x")) == ["21", "21", "21", "21", "Unknown", "", None, ""]


def test_area_label(spark):
    label = C.area_label(C.area_code("x"), K.AREA_LABELS)
    assert values(spark, ["61 - A", "62", "24 - none", None], label) == [
        "Summerville (61-63)", "Summerville (61-63)", None, None,
    ]


def test_firm_prefix(spark):
    inputs = ["DERE01", "ABC", "123", "AB12C3", "A-1", "dere01", "", None]
    expected = ["DERE", "", "", "AB12C", "A", "dere", "", ""]
    assert values(spark, inputs, C.firm_prefix("x")) == expected


def test_company_rules_in_order_and_any_case(spark):
    inputs = ["Keefe Real", "KEEFE X", "@Properties LLC", "a the real estate group b", "shorewest #1",
              "NON-MLS", "non mls office", "Xkeefe ", None]
    expected = ["Keefe Real Estate", "Keefe Real Estate", "@properties", "CB The Real Estate Group",
                "Shorewest", "NON MLS", "NON MLS", "Other", "Other"]
    assert values(spark, inputs, C.company_name("x")) == expected


def test_names(spark):
    assert values(spark, ["Kenosha County", " Racine county "], C.county_clean("x")) == ["Kenosha", "Racine"]
    assert values(spark, ["Zone 3", "Zone", "A b c"], C.zone_of_tab("x")) == ["3", "Zone", "b c"]
    ids = values(spark, ["Town DERE01/DERE22", "Town DERE01"], C.own_office_ids("x"))
    assert ids == [["DERE22", "DERE01"], ["DERE01", "DERE01"]]


def test_property_class(spark):
    df = spark.createDataFrame(
        [("Land", None), ("Residential", "Condominium"), ("Residential", "Duplex"), ("Residential", None),
         ("Commercial", "Duplex")],
        "property_type string, property_sub_type string",
    )
    assert [r[0] for r in df.select(C.property_class()).collect()] == [
        "Land", "Condominium", "Single Family Residential", "Other", "Other",
    ]


@pytest.mark.parametrize(("days", "expected"), [([1, 2], 1), ([-1, -2], -1), ([None], None), ([3, None], 3)])
def test_whole_average_cuts_toward_zero(spark, days, expected):
    df = spark.createDataFrame([(d,) for d in days], "d int")
    out = df.agg(C.whole_average(F.sum("d"), F.count("d")).alias("a"))
    assert out.collect()[0].a == expected
    assert dict(out.dtypes)["a"] == "int"


def test_supply_and_change_guard_zero(spark):
    df = spark.createDataFrame([(10, 4), (10, None), (None, 4), (10, 0)], "i long, s long")
    supply = [r[0] for r in df.select(C.months_of_supply_rounded(F.col("i"), F.col("s"))).collect()]
    assert supply == [Decimal("30.0"), None, None, None]
    change = [r[0] for r in df.select(C.relative_change(F.col("i"), F.col("s"))).collect()]
    assert change == [1.5, None, None, None]


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0])


@pytest.mark.parametrize(
    ("as_of", "start", "end"),
    [
        (date(2020, 2, 29), date(2019, 10, 1), date(2019, 12, 31)),
        (date(2020, 1, 1), date(2019, 10, 1), date(2019, 12, 31)),
        (date(2020, 3, 31), date(2019, 10, 1), date(2019, 12, 31)),
        (date(2020, 4, 1), date(2020, 1, 1), date(2020, 3, 31)),
        (date(2020, 9, 30), date(2020, 4, 1), date(2020, 6, 30)),
    ],
)
def test_quarter_frame(spark, as_of, start, end):
    frame = one(spark, *FR.quarter_frame(as_of))
    assert frame == (start, end, start.replace(year=start.year - 1), end.replace(year=end.year - 1))


def test_other_frames(spark):
    assert one(spark, *FR.open_frame(date(2020, 8, 10))) == (
        date(2020, 3, 31), date(2020, 7, 1), date(2019, 3, 31), date(2019, 7, 1),
    )
    assert one(spark, *FR.frame_labels(FR.open_frame(date(2020, 8, 10)))) == (
        "Apr 2020", "Jun 2020", "Apr 2019", "Jun 2019",
    )
    assert one(spark, *FR.eval_frame(date(2020, 2, 29))) == (
        date(2020, 2, 29), date(2019, 2, 28), 1, 2020, 2019,
    )
    assert one(spark, *FR.calendar_numbers(date(2020, 1, 5))) == (1, 4, 2020, 2019)


def test_trailing_quarter_before_30_june_starts_on_31_march(spark):
    df = spark.createDataFrame([(date(2020, 3, 30),), (date(2020, 3, 31),), (date(2020, 6, 30),)], "d date")
    inside = [r[0] for r in df.select(C.in_trailing("d", F.lit(date(2020, 6, 30)), 3)).collect()]
    assert inside == [False, True, True]
