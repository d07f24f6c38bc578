"""Readers and writers for the listing tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from .schemas import TABLES, source_schema

CASE_BLIND = "UTF8_LCASE"
LISTING_KEYS = ("listing_key", "source_system_id")
KEYED_TABLES = ("listings", "listings_geo", "area_listings", "listings_custom_geo")


#: Coded columns, which get the spelling that the reports compare with.
CODES = {
    "standard_status": (*K.STATUS_ON_MARKET, *K.STATUS_OFF_MARKET, K.STATUS_CLOSED, K.STATUS_UPCOMING),
    "property_type": ("Residential", "Land"),
    "property_sub_type": K.PROPERTY_SUBTYPES,
}


def spelled(value: Column, codes: Sequence[str]) -> Column:
    """A code in its usual spelling; other values as they are."""
    known = F.create_map(*[F.lit(x) for code in codes for x in (code.lower(), code)])
    return F.coalesce(F.try_element_at(known, F.lower(value)), value)


def standardise(df: DataFrame, table: str, case_blind: bool = True) -> DataFrame:
    """Select a table's columns under library names.

    Trailing blanks are cut, so that equality ignores them. ``case_blind`` gives coded
    columns their usual spelling and other text columns, keys excepted, a case-insensitive
    collation, so that filters, joins and groups ignore case. A scan cannot push filters
    through these steps: ``store_tables`` does them once, at ingest.
    """
    columns = []
    for name, (source, kind) in TABLES[table].items():
        value = F.col(source).cast(kind)
        if isinstance(kind, T.StringType):
            value = F.rtrim(value)
            if case_blind and name in CODES:
                value = spelled(value, CODES[name])
            elif case_blind and not name.endswith("_key"):
                value = F.collate(value, CASE_BLIND)
        columns.append(value.alias(name))
    return df.select(*columns)


def from_parquet(spark: SparkSession, paths: Mapping[str, str], **options) -> dict[str, DataFrame]:
    """Read tables from Parquet folders with the declared source schemas."""
    return {
        table: standardise(spark.read.schema(source_schema(table)).parquet(path), table, **options)
        for table, path in paths.items()
    }


def from_catalog(spark: SparkSession, names: Mapping[str, str], **options) -> dict[str, DataFrame]:
    """Read tables by (one- to three-part) catalog names."""
    return {table: standardise(spark.table(name), table, **options) for table, name in names.items()}


def write_keyed(df: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Save a listing-keyed table bucketed and sorted by listing key.

    Tables saved with one bucket count join on the key without a shuffle.
    """
    writer = (
        df.repartition(buckets, *LISTING_KEYS)
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, *LISTING_KEYS)
        .sortBy(*LISTING_KEYS)
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def store_tables(tables: Mapping[str, DataFrame], prefix: str, buckets: int) -> None:
    """Save cleaned tables in the catalog as ``<prefix><table>``, listing-keyed ones bucketed."""
    for table, df in tables.items():
        if table in KEYED_TABLES:
            write_keyed(df, prefix + table, buckets)
        else:
            df.write.mode("overwrite").format("parquet").saveAsTable(prefix + table)


def stored_tables(spark: SparkSession, prefix: str, names: Iterable[str] = TABLES) -> dict[str, DataFrame]:
    """Tables that ``store_tables`` saved, column by column as stored.

    Filters reach the Parquet scan, and listing-keyed tables join without a shuffle.
    """
    return {name: spark.table(prefix + name) for name in names}


def write_by_close_year(df: DataFrame, path: str) -> None:
    """Save listings partitioned by source and close year, so that filters prune folders."""
    year = F.year("close_date")
    (
        df.withColumn("close_year", year)
        .write.mode("overwrite")
        .partitionBy("source_system_id", "close_year")
        .parquet(path)
    )


def save_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
