"""Stored sales histograms by quarter, refreshed one quarter at a time.

A histogram's counts and sums add up, so reports roll up from the stored rows as they would from the
listings. Rows lie in a folder for each quarter; a refresh replaces the folders of its quarters only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

FOLDERS = ("Yr", "Qtr")
Quarters = Sequence[tuple[int, int]]


def of_quarters(quarters: Quarters | None) -> Column:
    """Rows of the (year, quarter) pairs, as a test on the folders; ``None``: all."""
    if quarters is None:
        return F.lit(True)
    return C.any_of((F.col("Yr") == y) & (F.col("Qtr") == q) for y, q in quarters)


def laid_out(hist: DataFrame, files: int) -> DataFrame:
    """Each quarter in ``files`` tasks at the most, sorted by its keys; prices spread a large quarter."""
    spread = F.pmod(F.hash("value"), F.lit(files))
    keys = hist.columns[: hist.columns.index("value") + 1]
    return hist.repartition(*FOLDERS, spread).sortWithinPartitions(*[k for k in keys if k not in FOLDERS])


def save_facts(hist: DataFrame, path: str, files: int = 1) -> None:
    """Replace the whole store by a histogram with the columns ``Yr``, ``Qtr``, ``value`` and ``n``."""
    laid_out(hist, files).write.mode("overwrite").partitionBy(*FOLDERS).parquet(path)


def refresh_facts(hist: DataFrame, path: str, quarters: Quarters, files: int = 1) -> None:
    """Replace the folders of ``quarters`` by the rows that ``hist`` has for them.

    Other folders are not touched. A quarter that has lost its last sale gets a folder with one
    row that counts nothing, since Spark replaces only folders it writes to. Every quarter that
    lost or gained a sale must be named, such as both of a sale whose close date moved.
    """
    if not quarters:
        return
    wanted = hist.where(of_quarters(quarters))
    pairs = hist.sparkSession.createDataFrame([tuple(p) for p in quarters], "Yr int, Qtr int")
    kinds = dict(hist.dtypes)
    empty = {c: F.lit(None).cast(kinds[c]) for c in hist.columns if c not in FOLDERS}
    marks = pairs.withColumns(empty).withColumn("n", F.lit(0).cast(kinds["n"]))
    rows = laid_out(wanted.unionByName(marks), files).write.mode("overwrite")
    rows.option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)


def stored_facts(spark: SparkSession, path: str, quarters: Quarters | None = None) -> DataFrame:
    """The stored histogram; only the folders of ``quarters`` are read."""
    return spark.read.parquet(path).where(of_quarters(quarters)).where("n > 0")


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can write: the cluster's checkpoint folder, or else its warehouse."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
