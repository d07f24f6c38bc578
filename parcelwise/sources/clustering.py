"""Files whose rows lie close together in several columns, so that a filter on any of them skips most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K

BITS = 6
#: Columns of listings that reports filter by, besides the status. List dates lie close to both.
LISTING_ORDER = ("close_date", "status_date")


def bounds(df: DataFrame, columns: Sequence[str], bits: int) -> dict[str, list]:
    """Up to 2^bits - 1 values of each column that cut it into parts of about equal size."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(c, shares, 2 ** (bits + 4)).alias(c) for c in columns]).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def bucket(column: str, cuts: Sequence, kind: str) -> Column:
    """How many cuts a value has reached; 0 for NULL, so missing values lie together."""
    if not cuts:
        return F.when(F.col(column).isNull(), 0).otherwise(1)
    reached = F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(column))
    return F.when(F.col(column).isNull(), 0).otherwise(F.size(reached) + 1)


def interleaved(buckets: Sequence[Column], bits: int) -> Column:
    """The buckets' bits in turn: a space-filling (Morton) order that treats all columns alike."""
    out = F.lit(0).cast("bigint")
    for place in range(bits + 1):
        for i, number in enumerate(buckets):
            bit = F.shiftright(number.cast("bigint"), place).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, place * len(buckets) + i))
    return out


def write_clustered(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    files: int,
    first: Sequence[Column] = (),
    rows_per_file: int = 0,
    bits: int = BITS,
) -> None:
    """Save ``df`` in about ``files`` files in the order of ``first`` and then of all ``columns`` at once.

    The order comes from samples of the columns' ranges, so dense times get as many files as rows.
    Each row group then spans a small box of values, and its statistics let a scan skip it.
    """
    kinds, cuts = dict(df.dtypes), bounds(df, columns, bits)
    curve = interleaved([bucket(c, cuts[c], kinds[c]) for c in columns], bits)
    order = {f"_order{i}": c for i, c in enumerate([*first, curve])}
    rows = df.withColumns(order).repartitionByRange(files, *order).sortWithinPartitions(*order).drop(*order)
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_clustered_listings(df: DataFrame, path: str, files: int, rows_per_file: int = 0) -> None:
    """Save listings so that date filters, and the prefilter of inventory reports, skip most row groups.

    Listings on the market pass that prefilter whatever their dates, so they lie apart from the others.
    These lie by status: a row group's least and greatest status then tell that none is on the market,
    which statistics over a mix, say of canceled and withdrawn with pending between, could not.
    """
    apart = F.col("standard_status").isin(*K.STATUS_ON_MARKET)
    write_clustered(df, path, LISTING_ORDER, files, [apart, F.col("standard_status")], rows_per_file)


def listings_since(spark: SparkSession, path: str, first_day) -> DataFrame:
    """Listings that ``write_by_close_year`` saved, without the folders of years closed before ``first_day``.

    A listing closed before the first day that a report looks at is neither a sale nor inventory of it.
    """
    year = F.year(C.date_literal(first_day))
    return spark.read.parquet(path).where(F.col("close_year").isNull() | (F.col("close_year") >= year))
