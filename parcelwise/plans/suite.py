"""County reports from one staged table: one scan of the listings, one shuffle, one partitioned write.

A listing enters the stage at most twice, tagged by family: as a sale of its quarter and price, and as
stock of its price band, with the inventory and sales measures of all reports. Both families are summed
in one aggregate. ``county_class``, ``county_all``, ``county_level`` and ``price_range_county`` are then
read from the staged rows alone, which are counts and sums, so the listings are not needed again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.frames import eval_frame, quarter_frame
from ..operators import statistics as S
from . import counties as PC
from .market_areas import BAND_MEASURES

Tables = Mapping[str, DataFrame]
SALE, STOCK = "sale", "stock"
BANDS = [f"{y}_{m}" for y in PC.YEARS for m in BAND_MEASURES]


@dataclass(frozen=True)
class Suite:
    """What the reports are asked for: one scope, one evaluation date, one set of bands."""

    eval_date: date
    as_of: date | None = None
    scope: PC.CountyScope = field(default_factory=PC.CountyScope)
    breaks: Sequence[int] = K.BREAKS_5
    strict_parity: bool = True

    def stage(self, t: Tables) -> DataFrame:
        """Tagged sums by family, county, class, quarter, band and price."""
        scope, frame, ends = self.scope, eval_frame(self.eval_date), quarter_frame(self.as_of)
        days = {"cy": frame.eval_date, "py": frame.py_eval_date}
        closings = {"cy": ends.end, "py": ends.py_end}
        home, paid = F.col("property_type") == "Residential", F.col("close_price") > 0
        flows, bands = {}, {}
        for y in PC.YEARS:
            flows[f"inv_{y}"] = C.on_market_at(days[y])
            flows[f"sold_{y}"] = C.in_half_open("close_date", days[y], 12) & paid
            tests = (
                C.on_market_at(closings[y]),
                C.in_trailing("close_date", closings[y], 12) & paid,
                C.in_quarter("close_date", closings[y]),
            )
            bands |= {f"{y}_{n}": home & test for n, test in zip(("on_market", "sold", "in_quarter"), tests)}
        # a short test that keeps all that any measure may count, and more
        first = F.add_months(F.least(days["py"], closings["py"]), -12)
        closed, stock = F.col("close_date").isNotNull(), C.open_or_closed_since(first)
        listings = t["listings"].where(F.col("property_type").isin("Residential", "Land") & (closed | stock))
        rows = PC.county_rows(listings, t, scope).withColumn("PropertyType", C.property_class())
        rows = S.by_close_quarter(S.sale_measures(rows)).withColumns({
            **flows, **bands, "covered": scope.covered(),
            "band": C.price_band("list_price", self.breaks, null_band=len(self.breaks) + 1),
        })
        listed = F.col("PropertyType").isin(K.CLASS_HOUSE, K.CLASS_CONDO)
        sale = closed & (F.lit(True) if self.strict_parity else F.col("covered"))
        none = F.lit(None).cast("int")

        def tag(family: str, **values: Column) -> Column:
            places = {"Yr": none, "Qtr": none, "band": none, "value": none.cast(S.VALUE_TYPE)} | values
            return F.struct(F.lit(family).alias("family"), *[c.alias(name) for name, c in places.items()])

        tags = F.array(
            F.when(sale, tag(SALE, Yr=F.col("Yr"), Qtr=F.col("Qtr"), value=F.col("price"))),
            F.when(F.col("covered") & stock, tag(STOCK, band=F.col("band"))),
        )
        rows = rows.withColumns({f"inv_{y}": F.col(f"inv_{y}") & listed for y in PC.YEARS})
        kept = ["County", "tri", "PropertyType", "weight", "close_price", "ppf", "dom", *flows, *bands]
        tagged = C.explode_present(rows.select(*kept, tags.alias("_tags")), "_t", F.col("_tags")).select(*kept, "_t.*")
        on_sale, in_stock = f"family = '{SALE}'", f"family = '{STOCK}'"
        sums = {
            "n": "count(*)",
            "sales_count": f"count_if({on_sale})",
            "priced": f"count_if({on_sale} and value is not null)",
            "ppf_sum": f"coalesce(sum(if({on_sale}, ppf, null)), 0D)",
            "ppf_n": f"count(if({on_sale}, ppf, null))",
            "dom_sum": f"coalesce(sum(if({on_sale}, dom, null)), 0)",
            "dom_n": f"count(if({on_sale}, dom, null))",
            **{c: f"coalesce(sum(if({in_stock} and {c}, weight, null)), 0)" for c in flows},
        }
        sums |= {
            f"{y}_{name}": sql.format(f"{in_stock} and {y}") for y in PC.YEARS for name, sql in BAND_MEASURES.items()
        }
        keys = ["family", "County", "tri", "PropertyType", "Yr", "Qtr", "band", "value"]
        staged = tagged.groupBy(*keys).agg(*[F.expr(f"{sql} as {name}") for name, sql in sums.items()])
        return staged.selectExpr("*", "coalesce(value * priced, 0) as volume")

    def county_histogram(self, staged: DataFrame, with_class: bool) -> DataFrame:
        """The histogram behind ``county_class`` and ``county_all``, from the stage."""
        day = C.date_literal(self.eval_date)
        quarters = {"cy": day, "py": F.add_months(day, -12)}
        year = C.first_match(
            ((F.col("Yr") == F.year(d)) & (F.col("Qtr") == F.quarter(d)), y) for y, d in quarters.items()
        )
        rows = staged.withColumn("year", F.when(F.col("family") == SALE, year))
        rows = rows.where(F.col("year").isNotNull() | (F.col("family") == STOCK))
        if not with_class:
            other = F.col("PropertyType") == K.CLASS_OTHER
            rows = rows.withColumns({f"sold_{y}": F.when(other, 0).otherwise(F.col(f"sold_{y}")) for y in PC.YEARS})
        keys = ["County", "tri", "year", *(["PropertyType"] if with_class else []), "value"]
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", *S.SALES_SUMS, *PC.FLOWS)])

    def county_class(self, staged: DataFrame) -> DataFrame:
        return PC.class_report(self.county_histogram(staged, True), self.strict_parity)

    def county_all(self, staged: DataFrame) -> DataFrame:
        return PC.all_report(self.county_histogram(staged, False), self.scope.fourth, self.strict_parity)

    def county_level(self, staged: DataFrame) -> DataFrame:
        sales = staged.where(F.col("family") == SALE)
        return S.stats_of(sales, ["PropertyType", "County", *S.QUARTER], never_null=S.QUARTER)

    def price_range_county(self, staged: DataFrame) -> DataFrame:
        stock = staged.where(F.col("family") == STOCK)
        wide = stock.groupBy(F.col("County").alias("county"), "band").agg(*[F.sum(c).alias(c) for c in BANDS])
        ends = quarter_frame(self.as_of)
        return PC.band_report(wide, {"cy": F.year(ends.end), "py": F.year(ends.py_end)}, self.breaks)


def write_stage(staged: DataFrame, path: str) -> None:
    """One folder a family, so that a report reads only the families it needs."""
    staged.write.mode("overwrite").partitionBy("family").parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
