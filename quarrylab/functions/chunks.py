"""Arrays above a cell's size: rows of (array, chunk) along the first axis, of which a slice reads those alone that it touches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Bytes of a chunk, unless one row of the first axis is longer.
CHUNK_BYTES = 4 << 20
LAYOUT = "chunk int, start long, stop long, dtype string, shape string, is_compressed boolean, hash string, data binary"


def pieces(array: np.ndarray, chunk_bytes: int = CHUNK_BYTES, compress: bool = False, level: int = 6) -> Iterator[dict]:
    """The chunks of an array; an array without rows has one that is empty, and one without axes is a single row."""
    rows = array.reshape(1) if array.ndim == 0 else array
    step = max(1, chunk_bytes // max(1, rows[:1].nbytes))
    for chunk, start in enumerate(range(0, max(1, len(rows)), step)):
        part = rows[start : start + step]
        cell = arrays.encode(part, compress, level)
        yield {"chunk": chunk, "start": start, "stop": start + len(part)} | cell | {"shape": str(tuple(array.shape))}


def chunked(df: DataFrame, key: str, cell: str = "cell", chunk_bytes: int = CHUNK_BYTES, compress: bool = False) -> DataFrame:
    """The chunks of the array cells in a column (data, dtype, shape, is_compressed): (key, LAYOUT). A null cell has none.

    Written to a table, their bounds (start, stop) are what a slice's reader is pruned by.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, data, dtype, shape, packed in batch.itertuples(index=False, name=None):
                found = pd.DataFrame(list(pieces(arrays.decode(data, dtype, shape, packed), chunk_bytes, compress)))
                found.insert(0, key, own)
                yield found

    parts = df.where(F.col(f"{cell}.data").isNotNull()).select(key, *[f"{cell}.{n}" for n in ("data", "dtype", "shape", "is_compressed")])
    return parts.mapInPandas(cut, f"`{key}` {df.schema[key].dataType.simpleString()}, {LAYOUT}")


def sliced(chunks: DataFrame, key: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows first .. last - 1 of the first axis of every array, as pieces in the chunks' layout, whose bounds are those within the slice's.

    Chunks outside are not read; those at its ends are cut. Arrays that don't reach so far give as much as they have, or nothing.
    """
    if first < 0 or last is not None and last < first:
        raise ValueError("a slice goes from a row on to a later one")
    touched = chunks.where(F.col("stop") > first)
    if last is not None:
        touched = touched.where(F.col("start") < last)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                rest = ast.literal_eval(r.shape)[1:]
                part = arrays.decode(r.data, r.dtype, str((r.stop - r.start, *rest)), r.is_compressed)
                a, b = max(first, r.start), r.stop if last is None else min(last, r.stop)
                rows.append((r[0], r.chunk, a - first, b - first, r.dtype, r.shape, part[a - r.start : b - r.start].tobytes()))
            yield pd.DataFrame(rows, columns=[key, "chunk", "start", "stop", "dtype", "shape", "data"])

    kind = chunks.schema[key].dataType.simpleString()
    return touched.select(key, *[f.split()[0] for f in LAYOUT.split(", ")]).mapInPandas(cut, f"`{key}` {kind}, chunk int, start long, stop long, dtype string, shape string, data binary")


def assembled(parts: DataFrame, key: str) -> DataFrame:
    """(key, cell): the pieces of each array put together as one cell, which must hold them; their hash is made anew."""

    @F.pandas_udf(arrays.CELL)
    def cell(found: pd.Series, dtype: pd.Series, shape: pd.Series) -> pd.DataFrame:
        made = []
        for several, kind, whole in zip(found, dtype, shape):
            ordered = sorted(several, key=lambda p: p["start"])
            axes = ast.literal_eval(whole)
            rows = sum(p["stop"] - p["start"] for p in ordered)
            array = np.frombuffer(b"".join(p["data"] for p in ordered), kind).reshape((rows, *axes[1:]) if axes else ())
            made.append(arrays.encode(array))
        return pd.DataFrame(made, columns=["data", "dtype", "shape", "is_compressed", "hash"])

    grouped = parts.groupBy(key).agg(F.collect_list(F.struct("start", "stop", "data")).alias("p"), F.any_value("dtype").alias("dtype"), F.any_value("shape").alias("shape"))
    return grouped.select(key, cell("p", "dtype", "shape").alias("cell"))
