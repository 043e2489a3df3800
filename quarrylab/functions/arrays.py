"""Array cells: a binary form that keeps dtype, shape, compression and a hash, and the typed form for analysis."""

from __future__ import annotations

import ast
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shorter cells are never compressed.
COMPRESS_FROM = 1024
HASH_DIGITS = 16
CELL = "struct<data:binary,dtype:string,shape:string,is_compressed:boolean,hash:string>"


def encode(array: np.ndarray, compress: bool = False, level: int = 6) -> dict:
    """The cell of an array; compress is a wish that cells of COMPRESS_FROM bytes and less don't fulfil."""
    if not isinstance(array, np.ndarray):
        raise ValueError(f"an array is asked for, not {type(array).__name__}")
    if array.dtype.hasobject:
        raise ValueError("arrays of objects have no binary form")
    raw = np.ascontiguousarray(array).tobytes()
    packed = compress and len(raw) > COMPRESS_FROM
    return {"data": zlib.compress(raw, level) if packed else raw, "dtype": str(array.dtype), "shape": str(tuple(array.shape)), "is_compressed": packed, "hash": hashlib.sha256(raw).hexdigest()[:HASH_DIGITS]}


def decode(data: bytes | None, dtype: str, shape: str, is_compressed=False) -> np.ndarray | None:
    """The array of a cell; None of a null one. The flag may be a boolean, 0 or 1, or their text."""
    if data is None:
        return None
    packed = is_compressed in (True, 1, "1", "true", "TRUE", "True")
    return np.frombuffer(zlib.decompress(data) if packed else data, np.dtype(dtype)).reshape(ast.literal_eval(shape))


def stack(cells: list[np.ndarray | None]) -> np.ndarray | None:
    """Arrays of one shape with a row axis before it; nulls are filled with NaN; None without any array."""
    first = next((c for c in cells if c is not None), None)
    if first is None:
        return None
    if any(c is None for c in cells) and not np.issubdtype(first.dtype, np.inexact):
        raise ValueError(f"{first.dtype} has no NaN for null cells")
    return np.stack([np.full_like(first, np.nan) if c is None else c for c in cells])


def encode_column(values: Column, dtype: str, compress: bool = False, level: int = 6) -> Column:
    """The cells of an array column, by Arrow batches; null stays null."""

    @F.pandas_udf(CELL)
    def cells(arrays: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(("data", "dtype", "shape", "is_compressed", "hash"))
        return pd.DataFrame([empty if a is None else encode(np.asarray(a, dtype), compress, level) for a in arrays], columns=list(empty))

    return cells(values)


def decode_column(cell: Column, element: str = "double") -> Column:
    """The values of cells as a flat array in row-major order."""

    @F.pandas_udf(f"array<{element}>")
    def values(cells: pd.DataFrame) -> pd.Series:
        found = [decode(*c) for c in cells[["data", "dtype", "shape", "is_compressed"]].itertuples(index=False, name=None)]
        return pd.Series([None if a is None else a.ravel() for a in found])

    return values(cell)


def raw_bytes(data: Column, is_compressed: Column) -> Column:
    """The bytes of a cell before compression."""

    @F.pandas_udf("binary")
    def inflate(data: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series([zlib.decompress(d) if d is not None and p else d for d, p in zip(data, packed)], dtype=object)

    return inflate(data, is_compressed)


def hash_of(data: Column) -> Column:
    """The cell hash of raw bytes or text: the first digits of SHA-256."""
    return F.substring(F.sha2(data, 256), 1, HASH_DIGITS)


def verify(df: DataFrame, column: str) -> DataFrame:
    """df with `<column>_ok`: whether the cell's bytes have the hash that is kept with them; null of a null cell."""
    raw = raw_bytes(F.col(column), F.col(f"{column}_is_compressed").cast("string").isin("true", "1"))
    return df.withColumn(f"{column}_ok", F.when(F.col(column).isNotNull(), F.coalesce(hash_of(raw) == F.col(f"{column}_hash"), F.lit(False))))


def null_fill(values: Column, length: int) -> Column:
    """Null arrays as NaN ones of this length."""
    return F.coalesce(values, F.array_repeat(F.lit(float("nan")), length))


def statistics(values: Column) -> list[Column]:
    """Mean, norm, least and largest of an array's values."""
    total = lambda f: F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    return [(total(lambda x: x) / F.size(values)).alias("mean"), F.sqrt(total(lambda x: x * x)).alias("norm"), F.array_min(values).cast("double").alias("min"), F.array_max(values).cast("double").alias("max")]


def element_means(df: DataFrame, values: str, by: str) -> DataFrame:
    """(by, pos, mean): the mean of each element over a group's rows, summed in tasks before the shuffle."""
    return df.select(by, F.posexplode(values).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def stacked(rows: Iterator, column: str) -> np.ndarray | None:
    """The stacked array of rows that hold a cell and its companions."""
    return stack([decode(r[column], r[f"{column}_dtype"], r[f"{column}_shape"], r[f"{column}_is_compressed"]) for r in rows])


def decode_frame(df: pd.DataFrame, columns: list[str] | None = None, dtype=None, shape=None) -> pd.DataFrame:
    """A frame of rows with its array cells as arrays, of their own dtype and shape or, where no companions name them, of those given."""
    found = df.copy()
    for c in [c for c in df.columns if f"{c}_dtype" in df.columns] if columns is None else columns:
        if f"{c}_dtype" in df.columns and f"{c}_shape" in df.columns:
            kinds = zip(df[f"{c}_dtype"], df[f"{c}_shape"], df.get(f"{c}_is_compressed", [False] * len(df)))
        elif dtype is not None and shape is not None:
            kinds = [(np.dtype(dtype), str(tuple(shape)), False)] * len(df)
        else:
            raise ValueError(f"{c} has no dtype and shape beside it; name them")
        values = np.empty(len(df), object)
        for n, (cell, kind) in enumerate(zip(df[c], kinds)):
            values[n] = decode(cell, *kind) if isinstance(cell, (bytes, bytearray)) else None
        found[c] = pd.Series(values, df.index)
    return found


def array_dict(df: pd.DataFrame, columns: list[str] | None = None, dtype=None, shape=None) -> dict[str, np.ndarray | None]:
    """The stacked arrays of a frame's array columns."""
    columns = [c for c in df.columns if f"{c}_dtype" in df.columns] if columns is None else list(columns)
    decoded = decode_frame(df, columns, dtype, shape)
    return {c: stack(list(decoded[c])) for c in columns}
