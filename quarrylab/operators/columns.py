"""Changes of columns: each is a projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import COMPANIONS, declared_type, parse, spark_type


def add_column(df: DataFrame, name: str, declaration: str, default=None) -> DataFrame:
    """df with a column of the declared type, filled with the default; an array column comes with its companions."""
    if name in df.columns:
        raise ValueError(f"column {name} is there already")
    own = parse(declaration).default
    value = F.lit(default) if default is not None else F.expr(own) if own else F.lit(None)
    df = df.withColumn(name, value.cast(spark_type(declaration)))
    if spark_type(declaration).typeName() == "binary":
        for suffix, companion in COMPANIONS.items():
            if f"{name}_{suffix}" not in df.columns:
                df = add_column(df, f"{name}_{suffix}", companion)
    return df


def drop_columns(df: DataFrame, names: str | Sequence[str], if_exists: bool = False) -> DataFrame:
    names = [names] if isinstance(names, str) else list(names)
    missing = [n for n in names if n not in df.columns]
    if missing and not if_exists:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    if set(df.columns) <= set(names):
        raise ValueError("the last column stays")
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns:
        raise ValueError(f"can't rename {old} to {new}")
    return df.withColumnRenamed(old, new)


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    if sorted(order) != sorted(df.columns):
        raise ValueError("the order must hold each column once")
    return df.select(*order)


def sort_columns(df: DataFrame, reverse: bool = False, key_columns_first: Sequence[str] | None = None, key: Callable | None = None) -> DataFrame:
    """df with its columns by name; key columns, as far as they are there, before them in the order given."""
    first = [c for c in key_columns_first or () if c in df.columns]
    return df.select(*first, *sorted((c for c in df.columns if c not in first), key=key, reverse=reverse))


def column_info(df: DataFrame, primary_key: Sequence[str] = (), not_null: Sequence[str] = (), defaults: dict | None = None) -> DataFrame:
    """(cid, name, type, notnull, dflt_value, pk) of each column."""
    rows = [(i, f.name, declared_type(f.dataType), int(f.name in not_null), (defaults or {}).get(f.name), int(f.name in primary_key)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")
