"""Sales statistics by group, with an exact median that no single task has to hold.

Rows are first reduced to one row per (group, value), a histogram whose counts and sums
add up. Coarser groups are rolled up from the histogram, not from the rows. The median
is then found in two steps: counts per bin of values locate the bin with the middle
rank, and only the values in that bin are ordered. A group that holds most of the rows
is spread over many tasks until at most one bin of distinct values is left of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Prices and days enter the histogram with two decimals, as the source schema declares money.
VALUE_TYPE = "decimal(18,2)"
BIN_WIDTH = 1000.0
PRICE, DOM = "price", "dom"
SALES_SUMS = ("sales_count", "volume", "priced", "ppf_sum", "ppf_n", "dom_sum", "dom_n")


def sale_measures(df: DataFrame, start="list_date", end="close_date") -> DataFrame:
    """Add ``price``, ``ppf`` (price per unit of area) and ``dom`` (days on market)."""
    return df.withColumns(
        {
            "price": F.col("close_price").cast(VALUE_TYPE),
            "ppf": C.price_per_area(),
            "dom": C.days_on_market(start, end),
        }
    )


def sales_histogram(
    sales: DataFrame,
    keys: Sequence[str],
    counted: Column | None = None,
    dom_median: bool = False,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per (keys, price) with sums that add up over rows.

    ``counted`` marks the rows that enter counts, sums and averages; all rows enter the
    median. With ``dom_median`` days on market get rows of their own (``metric``), so that
    both medians come from one scan. ``extra`` holds further row values to add up.
    """
    sales = sales.withColumn("_counted", F.lit(True) if counted is None else counted)
    if extra:
        sales = sales.withColumns(dict(extra))
    base = "true"
    if dom_median:
        both = f"array(named_struct('metric', '{PRICE}', 'value', price), "
        both += f"named_struct('metric', '{DOM}', 'value', cast(dom as {VALUE_TYPE})))"
        sales = sales.selectExpr("*", f"inline({both})")
        base = f"metric = '{PRICE}'"
        keys = [*keys, "metric"]
    else:
        sales = sales.withColumn("value", F.col("price"))

    counts = f"_counted and {base}"
    sums = {
        "n": "count(*)",
        "sales_count": f"count_if({counts})",
        "priced": f"count_if({counts} and value is not null)",
        "ppf_sum": f"coalesce(sum(if({counts}, ppf, null)), 0D)",
        "ppf_n": f"count(if({counts}, ppf, null))",
        "dom_sum": f"coalesce(sum(if({counts}, dom, null)), 0)",
        "dom_n": f"count(if({counts}, dom, null))",
        **{name: f"coalesce(sum(if({base}, {name}, null)), 0)" for name in extra or ()},
    }
    out = sales.groupBy(*keys, "value").agg(*[F.expr(f"{sql} as {name}") for name, sql in sums.items()])
    return out.selectExpr("*", "coalesce(value * priced, 0) as volume")


def exact_median(
    hist: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str],
    bin_width: float = BIN_WIDTH,
    never_null: Sequence[str] = (),
) -> DataFrame:
    """One row per ``keys``: the median of ``value`` weighted by ``n``, and ``sums``.

    ``hist`` may be finer than ``keys``. Values outside the middle bin are added up by
    bin, values inside it one by one, so both sides read the same histogram columns and
    its shuffle is reused. Sums must not be NULL. A later filter on keys in ``never_null``
    reaches both sides and the scan below; groups in which such a key is NULL are lost.
    """
    keys, sums = list(keys), list(sums)
    group = f"partition by {', '.join(keys)}"
    upto = f"({group} order by _bin rows between unbounded preceding and current row)"
    whole = f"({group} order by _bin rows between unbounded preceding and unbounded following)"
    # Ranks of the middle values: equal for an odd total, neighbours for an even one.
    low, high = "(_total + 1) div 2", "(_total + 2) div 2"
    rest = [f"_rest_{c}" for c in sums]

    binned = hist.selectExpr(
        *keys, "value", "n", *sums, f"floor(cast(value as double) / {bin_width}) as _bin"
    )
    bins = binned.groupBy(*keys, "_bin").agg(
        F.expr("sum(if(value is null, 0, n)) as _w"), *[F.expr(f"sum({c}) as {c}") for c in sums]
    )
    located = (
        bins.selectExpr("*", f"sum(_w) over {upto} as _upto", f"sum(_w) over {whole} as _total")
        .selectExpr(
            "*",
            f"_total = 0 or (_w > 0 and _upto >= {low} and _upto - _w < {high}) as _middle",
        )
        .selectExpr(
            *keys, "_bin", "_upto - _w as _below", "_total", "_middle",
            *[f"sum(if(_middle, null, {c})) over {whole} as _rest_{c}" for c in sums],
        )
        .where("_middle")
    )
    same = " and ".join(f"h.{k} {'=' if k in never_null else '<=>'} t.{k}" for k in (*keys, "_bin"))
    near = binned.alias("h").join(located.alias("t"), F.expr(same)).selectExpr(
        "h.*", "t._below", "t._total", *[f"t.{c}" for c in rest]
    )
    near = near.selectExpr(
        "*",
        f"""min(_below) over ({group} order by value
              rows between unbounded preceding and unbounded following)
            + sum(n) over ({group} order by value
              rows between unbounded preceding and current row) as _run""",
    )

    def middle_value(rank: str) -> str:
        return f"sum(if(_run >= {rank} and _run - n < {rank}, value, null))"

    return near.groupBy(*keys).agg(
        F.expr(f"cast({middle_value(low)} + {middle_value(high)} as double) / 2 as median"),
        *[F.expr(f"coalesce(first(_rest_{c}), 0) + sum({c}) as {c}") for c in sums],
    )


def sales_columns(avg_dom: str = "avg_dom") -> list[Column]:
    """Report columns from the sums of a sales histogram."""
    columns = {
        "price_per_foot": "ppf_sum / nullif(ppf_n, 0)",
        "sales_volume": "if(priced > 0, volume, null)",
        "sales_count": "sales_count",
        "avg_sale": "cast(volume as double) / nullif(priced, 0)",
        avg_dom: "cast(dom_sum div nullif(dom_n, 0) as int)",
        "MedianPrice": "median",
    }
    return [F.expr(f"{sql} as {name}") for name, sql in columns.items()]


def sales_stats(
    sales: DataFrame,
    keys: Sequence[str],
    counted: Column | None = None,
    never_null: Sequence[str] = (),
) -> DataFrame:
    """Count, volume, averages and exact median price by ``keys``.

    Groups without a counted row are left out. ``never_null`` as in ``exact_median``.
    """
    return stats_of(sales_histogram(sale_measures(sales), keys, counted), keys, never_null)


def stats_of(hist: DataFrame, keys: Sequence[str], never_null: Sequence[str] = ()) -> DataFrame:
    """The same from a histogram by ``keys`` or finer ones."""
    stats = exact_median(hist, keys, SALES_SUMS, never_null=never_null)
    return stats.where("sales_count > 0").select(*keys, *sales_columns())


def by_close_quarter(df: DataFrame, close_date="close_date") -> DataFrame:
    """Add the quarter (``Qtr``) and year (``Yr``) of the close date."""
    return df.withColumns({"Qtr": F.quarter(close_date), "Yr": F.year(close_date)})


QUARTER = ("Qtr", "Yr")
Quarters = Sequence[tuple[int, int]] | None


def closed_residential(listings: DataFrame, quarters: Quarters = None) -> DataFrame:
    """Residential sales, of the (year, quarter) pairs only if they are given."""
    return listings.where(
        F.col("close_date").isNotNull()
        & C.in_quarters("close_date", quarters)
        & (F.col("property_type") == "Residential")
    )
