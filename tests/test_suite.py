"""The county reports from one staged table against the single reports."""

import io
import re
from contextlib import redirect_stdout

import pytest

import market_queries as Q
from parcelwise import plans as P
from parcelwise.functions import constants as K
from parcelwise.plans import suite as PS

SINGLE = {
    "county_class": lambda t, s: P.county_class(t, s.eval_date, s.scope, s.strict_parity),
    "county_all": lambda t, s: P.county_all(t, s.eval_date, s.scope, s.strict_parity),
    "county_level": lambda t, s: P.county_level(t, s.scope),
    "price_range_county": lambda t, s: P.price_range_county(t, s.as_of, s.breaks, s.scope),
}


def rows(df):
    """Sorted rows; sums of doubles differ in their last digits with the order of summing."""
    def plain(x):
        return round(x, 6) if isinstance(x, float) else x

    return sorted(repr([plain(x) for x in r]) for r in df.collect())


@pytest.fixture(scope="module")
def written(spark, sample, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stage") / "county")
    PS.write_stage(Q.SUITE.stage(sample), path)
    return path


@pytest.mark.parametrize("name", list(SINGLE))
def test_reports_from_the_written_stage(spark, sample, written, name):
    got = getattr(Q.SUITE, name)(PS.read_stage(spark, written))
    assert rows(got) == rows(SINGLE[name](sample, Q.SUITE)) and rows(got)


def test_a_report_reads_its_families_only(spark, written):
    out = io.StringIO()
    with redirect_stdout(out):
        Q.SUITE.county_level(PS.read_stage(spark, written)).explain("formatted")
    filters = re.findall(r"PartitionFilters: (.*)", out.getvalue())
    assert filters and all("family" in f and "sale" in f for f in filters)


def test_the_stage_is_one_scan_and_one_shuffle_of_the_listings(sample):
    plan = Q.SUITE.stage(sample)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*\bo_totalprice", plan)) == 1
    # one partial and one final aggregate of the tagged rows
    assert len(re.findall(r"HashAggregate\(keys=\[family", plan)) + len(re.findall(r"SortAggregate\(key=\[family", plan)) == 2
    assert plan.count("Generate explode") == 1 and "Union" not in plan.split("Generate")[0]


@pytest.mark.parametrize("name", list(SINGLE))
def test_corrected_suite(sample, name):
    suite = PS.Suite(Q.EVAL, Q.AS_OF, Q.SCOPE_BANDS, K.BREAKS_4, strict_parity=False)
    if name == "county_level":
        pytest.skip("the single report has no corrected form")
    assert rows(getattr(suite, name)(suite.stage(sample))) == rows(SINGLE[name](sample, suite))


def test_an_empty_market(sample):
    t = {n: sample[n] for n in ("listings_geo", "county_names", "county_by_region")}
    staged = Q.SUITE.stage({**t, "listings": sample["listings"].where("1 = 0")})
    assert all(getattr(Q.SUITE, name)(staged).count() == 0 for name in SINGLE)
