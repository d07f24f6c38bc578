"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Items of a delimited text with their numbers from 1: empty items stay, a NULL text has none. The
#: separator is taken as it is, not as a pattern.
SPLIT_TEXT = r"""
create or replace temporary function split_text(text string, separator string)
returns table (item_number int, item string)
return select pos + 1, col from posexplode(split(text, concat('\\Q', separator, '\\E')))"""


def register_functions(spark: SparkSession) -> None:
    """Define ``split_text`` for the session; ``from t, lateral split_text(t.c, ',')`` calls it by row.

    Spark plans the call as a generator within the scan's stage: no join, no shuffle.
    """
    spark.sql(SPLIT_TEXT)
