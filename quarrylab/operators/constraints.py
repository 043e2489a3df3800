"""Constraint checks: each gives the rows, or keys, that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys on several rows, with their number; a key with a null is never equal to another."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key isn't null and has no parent row."""
    keys = parent.select(F.col(parent_column).alias("_parent")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The number of nulls in each column that must have none."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.*")
