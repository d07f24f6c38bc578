"""Derived columns and predicates. Every function returns a ``Column``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- classes and names -------------------------------------------------------


def property_class(property_type="property_type", sub_type="property_sub_type") -> Column:
    """Land, Condominium, Single Family Residential or Other.

    A residential listing without a subtype is Other.
    """
    kind, sub = col(property_type), col(sub_type)
    return (
        F.when(kind == "Land", K.CLASS_LAND)
        .when((kind == "Residential") & (sub != K.CLASS_CONDO), K.CLASS_HOUSE)
        .when((kind == "Residential") & (sub == K.CLASS_CONDO), K.CLASS_CONDO)
        .otherwise(K.CLASS_OTHER)
    )


def area_code(area="area") -> Column:
    """Text before the first hyphen, or all of it, trimmed."""
    return F.trim(F.substring_index(col(area), "-", 1)).cast("string")


def area_label(code: Column, labels: Mapping[str, str]) -> Column:
    """Market area of a code; NULL if the code has none. The mapping is one constant."""
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), code)


def first_match(rules: Iterable[tuple[Column, str]], default: str | None = None) -> Column:
    chain = None
    for test, label in rules:
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    if chain is None:
        return F.lit(default)
    return chain if default is None else chain.otherwise(default)


def overlapping_areas(code: Column, labels: Mapping[str, str], overlays) -> Column:
    """The areas a row belongs to: an array with a place for each, NULL where it does not.

    ``overlays`` holds (label, condition) pairs. Exploding the array and dropping NULLs
    gives the rows of a UNION ALL over the areas, from a single scan.
    """
    members = [area_label(code, labels)]
    members += [F.when(test, label) for label, test in overlays]
    return F.array(*members)


def company_name(office_name="office_name", rules=K.COMPANY_RULES) -> Column:
    """Company of a brokerage name by the first pattern that fits, else Other."""
    name = col(office_name)
    return first_match(((name.ilike(p), company) for p, company in rules), default="Other")


def firm_prefix(office_id="office_mls_id") -> Column:
    """Office id without its trailing non-letters; '' without letters or trailing part."""
    return F.coalesce(F.regexp_extract(col(office_id), r"(?is)^(.*[a-z])[^a-z]+$", 1), F.lit(""))


def firm_name(company="company", office_name="office_name") -> Column:
    return F.coalesce(col(company), col(office_name))


def county_clean(county_name="county_name") -> Column:
    """County name without the word County."""
    return F.trim(F.regexp_replace(col(county_name), "(?i)county", ""))


def zone_of_tab(tab_name="tab_name") -> Column:
    """Text after the first blank, or all of it."""
    name = col(tab_name)
    return F.substr(name, F.instr(name, " ") + F.lit(1))


def own_office_ids(tab_header="tab_header") -> Column:
    """Ids at the end of the header and at the end of its part before a slash."""
    header = col(tab_header)
    width = F.lit(K.OFFICE_ID_LENGTH)
    return F.array(
        F.right(header, width), F.right(F.substring_index(header, "/", 1), width)
    )


# --- bands -------------------------------------------------------------------


def price_band(price: str | Column, breaks: Sequence[int], null_band: int | None = None) -> Column:
    """Band number from 1; a price on a break belongs to the band above it."""
    value = col(price)
    chain = F.when(value.isNull(), F.lit(null_band).cast("int"))
    for band, upper in enumerate(breaks, start=1):
        chain = chain.when(value < upper, band)
    return chain.otherwise(len(breaks) + 1)


def band_texts(breaks: Sequence[int]) -> list[str]:
    lows = [0, *breaks]
    texts = [f"${low:,} - ${high - 1:,}" for low, high in zip(lows, breaks)]
    return [*texts, f"${breaks[-1]:,}+"]


def band_label(band: str | Column, breaks: Sequence[int]) -> Column:
    texts = enumerate(band_texts(breaks), start=1)
    return first_match((col(band) == number, text) for number, text in texts)


def explode_present(df: DataFrame, name: str, items: Column) -> DataFrame:
    """One row per item of an array that is not NULL.

    Filtering after the explode keeps the stage compiled; a lambda over the array, as in
    ``array_compact``, would not.
    """
    return df.withColumn(name, F.explode(items)).where(F.col(name).isNotNull())


# --- measures ----------------------------------------------------------------


def price_per_area(price="close_price", area="building_area") -> Column:
    """Price per unit of area; NULL unless the area is positive."""
    return F.when(col(area) > 0, col(price).cast("double") / col(area).cast("double"))


def days_on_market(start="list_date", end="close_date") -> Column:
    return F.datediff(col(end), col(start))


def whole_average(total: Column, n: Column) -> Column:
    """Average of integers cut toward zero, as an integer; NULL for no values."""
    n = F.nullif(n, F.lit(0))
    return F.call_function("div", total, n).cast("int")


def real_ratio(part: Column, total: Column) -> Column:
    """Quotient in 32-bit arithmetic, NULL for a zero or missing divisor.

    Dividing two 32-bit values in 64 bits and rounding once gives the 32-bit quotient.
    """
    part, total = (c.cast("double").cast("float") for c in (part, total))
    return F.try_divide(part, total).cast("float")


def percent_share(part: Column, total: Column) -> Column:
    return real_ratio(part, total) * F.lit(100).cast("float")


def months_of_supply(inventory: Column, sold: Column, months: int) -> Column:
    """Months the inventory lasts at the pace of ``sold`` per ``months``."""
    return real_ratio(inventory, sold) * F.lit(months).cast("float")


def months_of_supply_rounded(inventory: Column, sold: Column, months: int = 12) -> Column:
    supply = months_of_supply(inventory, sold, months).cast("double")
    return F.round(supply, 1).cast("decimal(11,1)")


def relative_change(current: Column, previous: Column) -> Column:
    """(current - previous) / previous, NULL if the previous value is missing or 0."""
    current, previous = current.cast("double"), previous.cast("double")
    return F.try_divide(current - previous, previous)


# --- date predicates ---------------------------------------------------------


def on_market_at(
    day: Column,
    status="standard_status",
    list_date="list_date",
    close_date="close_date",
    status_date="status_date",
) -> Column:
    """Was the listing on the market on ``day``, judged from its present status?"""
    status, listed, closed, changed = map(col, (status, list_date, close_date, status_date))
    not_closed_yet = closed.isNull() | (closed > day)
    return (
        (status != K.STATUS_UPCOMING)
        & (listed < day)
        & (
            status.isin(*K.STATUS_ON_MARKET)
            | (status.isin(*K.STATUS_OFF_MARKET) & not_closed_yet & (changed > day))
            | ((status == K.STATUS_CLOSED) & (F.coalesce(closed, changed) > day))
        )
    )


def open_or_closed_since(
    first: Column, status="standard_status", close_date="close_date", status_date="status_date"
) -> Column:
    """Rows that can be on the market, or be sold, on or after a date.

    A superset of every inventory and sales test from ``first`` on, made of comparisons a
    Parquet scan can push down, so that older sales and listings taken off the market
    before never reach a shuffle. A listing off the market, or closed without a date,
    counts only up to its last change of status.
    """
    return (
        col(status).isin(*K.STATUS_ON_MARKET) | (col(close_date) >= first) | (col(status_date) >= first)
    )


def any_of(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def in_quarters(date: str | Column, quarters: Iterable[tuple[int, int]] | None) -> Column:
    """In one of the (year, quarter) pairs, as date ranges that reach the scan; ``None``: any date."""
    if quarters is None:
        return col(date).isNotNull()

    def first_day(year: int, quarter: int) -> Column:
        return F.lit(f"{year}-{3 * quarter - 2:02d}-01").cast("date")

    return any_of(
        (col(date) >= first_day(y, q)) & (col(date) < F.add_months(first_day(y, q), 3)) for y, q in quarters
    )


def in_trailing(date: str | Column, end: Column, months: int) -> Column:
    """Within the months up to and including ``end``."""
    return (col(date) <= end) & (col(date) > F.add_months(end, -months))


def in_half_open(date: str | Column, end: Column, months: int) -> Column:
    """Within the months before ``end``, first day included, ``end`` excluded."""
    return (col(date) < end) & (col(date) >= F.add_months(end, -months))


def in_open_interval(date: str | Column, start: Column, end: Column) -> Column:
    return (col(date) > start) & (col(date) < end)


def in_quarter(date: str | Column, day: Column, years_back: int = 0) -> Column:
    """In the calendar quarter of ``day``, ``years_back`` years before it.

    Written as a date range, which reaches the scan; ``quarter(d) = q`` would not.
    """
    first = F.add_months(F.trunc(day, "quarter"), -12 * years_back)
    return (col(date) >= first) & (col(date) < F.add_months(first, 3))


def date_literal(value) -> Column:
    """A date parameter as a Column; columns pass through."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")
