import random
import statistics
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest

from parcelwise.operators import statistics as S

SCHEMA = "place string, kind string, list_date date, close_date date, close_price decimal(18,2), building_area int"


def sales(seed, n=600):
    """Random sales; one place holds a third of them, one has no price at all."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        place = "hot" if i % 3 == 0 else r.choice(["a", "b", "c", "single", None])
        if place == "single" and any(row[0] == "single" for row in rows):
            place = "a"
        price = None if r.random() < 0.1 else Decimal(r.choice([r.randrange(1, 10**8), 25000000])) / 100
        start = date(2020, 1, 1) + timedelta(days=r.randrange(300))
        rows.append((place, r.choice("xyz"), start, start + timedelta(days=r.randrange(-3, 90)), price,
                     r.choice([None, 0, 100, 333])))
    rows += [("unpriced", "x", date(2020, 1, 1), date(2020, 1, 5), None, 100)] * 3
    return rows


def by_hand(rows, key):
    groups = defaultdict(list)
    for row in rows:
        groups[key(row)].append(row)
    out = {}
    for k, members in groups.items():
        prices = [float(m[4]) for m in members if m[4] is not None]
        feet = [float(m[4]) / m[5] for m in members if m[4] is not None and m[5]]
        days = [(m[3] - m[2]).days for m in members]
        out[k] = (
            len(members),
            sum(m[4] for m in members if m[4] is not None) if prices else None,
            statistics.median(prices) if prices else None,
            sum(feet) / len(feet) if feet else None,
            int(sum(days) / len(days)),
            statistics.median(days),
        )
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sales_stats_against_plain_python(spark, seed):
    rows = sales(seed)
    stats = S.sales_stats(spark.createDataFrame(rows, SCHEMA), ["place"]).collect()
    expected = by_hand(rows, lambda r: r[0])
    assert {r.place for r in stats} == set(expected) and len(stats) == len(expected)
    for r in stats:
        count, volume, median, feet, dom, _ = expected[r.place]
        assert (r.sales_count, r.sales_volume, r.avg_dom) == (count, volume, dom)
        assert r.MedianPrice == (pytest.approx(median, abs=1e-9) if median is not None else None)
        assert r.price_per_foot == (pytest.approx(feet) if feet is not None else None)


def test_both_medians_from_one_histogram(spark):
    rows = sales(4)
    hist = S.sales_histogram(S.sale_measures(spark.createDataFrame(rows, SCHEMA)), ["place"], dom_median=True)
    got = {
        (r.place, r.metric): r for r in S.exact_median(hist, ["place", "metric"], S.SALES_SUMS).collect()
    }
    for place, (count, _, median, _, _, dom) in by_hand(rows, lambda r: r[0]).items():
        assert got[place, S.DOM].median == dom
        assert got[place, S.PRICE].median == (pytest.approx(median) if median is not None else None)
        assert got[place, S.PRICE].sales_count == count
        assert got[place, S.DOM].sales_count == 0


@pytest.mark.parametrize("width", [0.5, 1000.0, 1e12])
def test_bin_width_does_not_change_the_median(spark, width):
    rows = sales(5)
    hist = S.sales_histogram(S.sale_measures(spark.createDataFrame(rows, SCHEMA)), ["place"])
    got = {r.place: r.median for r in S.exact_median(hist, ["place"], [], bin_width=width).collect()}
    assert got == {k: v[2] and pytest.approx(v[2]) for k, v in by_hand(rows, lambda r: r[0]).items()}


def test_coarser_groups_from_a_finer_histogram(spark):
    rows = sales(6)
    fine = S.sales_histogram(S.sale_measures(spark.createDataFrame(rows, SCHEMA)), ["place", "kind"])
    got = {r.place: r for r in S.exact_median(fine, ["place"], S.SALES_SUMS).collect()}
    for place, (count, volume, median, *_) in by_hand(rows, lambda r: r[0]).items():
        assert got[place].sales_count == count
        assert got[place].volume == (volume or 0)
        assert got[place].median == (median and pytest.approx(median))


def test_counted_rows_do_not_limit_the_median(spark):
    rows = sales(7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.place: r for r in S.sales_stats(df, ["place"], df["kind"] == "x").collect()}
    everyone = by_hand(rows, lambda r: r[0])
    counted = by_hand([r for r in rows if r[1] == "x"], lambda r: r[0])
    assert set(got) == set(counted)
    for place, r in got.items():
        assert r.sales_count == counted[place][0]
        assert r.sales_volume == counted[place][1]
        median = everyone[place][2]
        assert r.MedianPrice == (median and pytest.approx(median))
