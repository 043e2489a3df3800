"""Reading rows: projection, filter, lookup by id, sort, paging and counts, all lazy."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_columns(order_by: str | Sequence[str] | None) -> list[Column]:
    """Sort columns of an ORDER BY list; nulls come first in ascending order unless it says otherwise."""
    if not order_by:
        return []
    parts = re.split(r",(?![^()]*\))", order_by) if isinstance(order_by, str) else order_by
    found = []
    for part in parts:
        m = re.fullmatch(r"\s*(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*", part, re.I | re.S)
        down, nulls = (m[2] or "asc").lower() == "desc", (m[3] or "").lower()
        column = F.expr(m[1])
        if down:
            found.append(column.desc_nulls_first() if nulls == "first" else column.desc_nulls_last())
        else:
            found.append(column.asc_nulls_last() if nulls == "last" else column.asc_nulls_first())
    return found


def predicate(where: str | Column) -> Column:
    return where if isinstance(where, Column) else F.expr(where)


def get_rows(
    df: DataFrame, columns: str | Sequence[str] | None = None, ids: int | Sequence[int] | str = "all", where: str | Column | None = None, order_by: str | None = None,
    limit: int | None = None, offset: int | None = None, include_blobs: bool = True, id_column: str = "id",
) -> DataFrame:
    """Rows of df that `where` holds for and whose id is among ids, sorted, from the offset on, as many as the limit.

    Filters and columns reach the scan; sort and limit together are one top-k of each task. Without columns all come,
    but for binary ones if include_blobs is false.
    """
    if isinstance(ids, int):
        df = df.where(F.col(id_column) == ids)
    elif ids != "all":
        df = df.where(F.col(id_column).isin(list(ids)))
    if where is not None and not (isinstance(where, str) and not where):
        df = df.where(predicate(where))
    if order_by:
        df = df.orderBy(*order_columns(order_by))
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    if columns is None:
        kept = [f.name for f in df.schema if include_blobs or not isinstance(f.dataType, T.BinaryType)]
    else:
        kept = [columns] if isinstance(columns, str) else list(columns)
    return df.select(*[c if c == "*" else F.col(f"`{c}`") for c in kept])


def select(df: DataFrame, columns: Sequence[str] | None = None, where: str | None = None, params: Sequence | dict | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """Expressions over df, with `?` or `:name` parameters in the predicate; a limit of 0 is no limit."""
    query = f"SELECT {', '.join(columns or ['*'])} FROM {{df}}" + (f" WHERE {where}" if where else "") + (f" ORDER BY {order_by}" if order_by else "") + (f" LIMIT {int(limit)}" if limit else "")
    return df.sparkSession.sql(query, args=params or None, df=df)


def count_rows(df: DataFrame, where: str | Column | None = None) -> DataFrame:
    """The number of rows that `where` holds for, as a table of one row."""
    return (df if where is None or isinstance(where, str) and not where else df.where(predicate(where))).agg(F.count(F.lit(1)).alias("n"))


def bounded_count(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The number of rows, counted no further than `most`: (n, is_approximate)."""
    counted = df.limit(most).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("is_approximate", F.col("n") >= most)


def head(df: DataFrame, order_by: str, limit: int = 5) -> DataFrame:
    return get_rows(df, order_by=order_by, limit=limit)


def blob_placeholders(df: DataFrame) -> DataFrame:
    """df with binary cells shown as their size."""
    shown = [F.concat(F.lit("<BLOB "), F.octet_length(f.name).cast("string"), F.lit(" bytes>")).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*shown)
