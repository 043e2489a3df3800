"""Duplicate rows: found, counted and removed by a window over what makes rows equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_columns(df: DataFrame, columns: str | Sequence[str] = "all", primary_key: Sequence[str] = (), include_blob: bool = False) -> list[str]:
    """The columns that make rows equal: those named, or all but keys, binary ones and times of creation or change."""
    if columns != "all":
        return [columns] if isinstance(columns, str) else list(columns)
    return [f.name for f in df.schema if f.name not in primary_key and (include_blob or not isinstance(f.dataType, T.BinaryType)) and not f.name.endswith("_at")]


def numbered(df: DataFrame, columns: Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """df with copy_number: 1 for the first row of each group of equals, by order_by. Nulls are equal to each other."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.withColumn("copy_number", F.row_number().over(Window.partitionBy(*columns).orderBy(*order)))


def keep_first(df: DataFrame, columns: Sequence[str], order_by: str) -> DataFrame:
    """The first row of each group. Only keys and the order column are aggregated, map-side first, so that a group of
    any size meets in a few rows; whole rows are then taken by a join on the order column, which must be unique."""
    if order_by in columns:
        return df.dropDuplicates(list(columns))
    first = df.groupBy(*columns).agg(F.min(order_by).alias("_first")).select("_first")
    return df.join(first, df[order_by] == first["_first"], "left_semi")


def duplicates(df: DataFrame, columns: Sequence[str], order_by: str) -> DataFrame:
    """The rows that keep_first would remove."""
    first = df.groupBy(*columns).agg(F.min(order_by).alias("_first")).select("_first")
    return df.join(first, df[order_by] == first["_first"], "left_anti")


def duplicate_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(total, duplicates, rate): rate is duplicates by distinct rows; 0 for an empty table."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kept"))
    return sums.select("total", (F.col("total") - F.col("kept")).alias("duplicates"), F.when(F.col("kept") > 0, (F.col("total") - F.col("kept")) / F.col("kept")).otherwise(0.0).alias("rate"))


def equal_rows(df: DataFrame, row: dict) -> DataFrame:
    """The rows that equal `row` in its columns; a null equals nothing."""
    same = F.lit(True)
    for c, v in row.items():
        same = same & (F.col(c) == F.lit(v))
    return df.where(same)


def delete_one(df: DataFrame, row: dict, order_by: str) -> DataFrame:
    """df without the first row, by the unique order_by, that equals `row` in its columns; a null equals nothing."""
    first = equal_rows(df, row).agg(F.min(order_by).alias("_first"))
    return df.join(F.broadcast(first), df[order_by] == first["_first"], "left_anti")  # one row
