"""Orders that screens and readers ask for. Each gives the place of a row, so that the order outlives the next shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def reading_order(lines: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """Lines of a page from the top (y counts from the bottom), then from the left."""
    return _placed(lines, keys, F.desc("y"), "x", *ties)


def span_order(spans: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """Spans of a scanned page from the top (y counts from the top), then from the left."""
    return _placed(spans, keys, "y", "x", *ties)


def file_number(name: Column) -> Column:
    """The number in a chapter file's name; null if there is none."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("long")


def natural_order(files: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Chapter files by number, not by spelling: 2 before 10; files without a number last."""
    return _placed(files, keys, F.asc_nulls_last(file_number(F.col(name))), name)


def preview(df: DataFrame, keys: list[str], order: str, n: int = 8) -> DataFrame:
    """The first n rows of each key."""
    return _placed(df, keys, order).where(F.col("place") < n)


def neutral_first(voices: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Voices that call themselves neutral before all others, then by name."""
    return _placed(voices, keys, ~F.contains(F.lower(name), F.lit("neutral")), name)


def shipped_last(voices: DataFrame, keys: list[str], shipped: list[str], name: str = "name") -> DataFrame:
    """Own voices before those that an engine brings along, each by name, case aside."""
    return _placed(voices, keys, F.col(name).isin(*shipped), F.lower(name), name)


def newest(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The `most` newest rows of a group, and their place from 1; the limit is applied before rows move."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("place") <= most)
