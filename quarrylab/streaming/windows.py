"""Time windows; the same code runs on batches and, behind a watermark, on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, length: str, by: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    """Aggregates of each window of this length; late: how long after a window's end a stream waits for its rows."""
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(F.window(time, length).alias("_w"), *by).agg(*aggregates).withColumn("start", F.col("_w.start")).drop("_w")


def sessions(df: DataFrame, time: str, gap: str, by: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    """Aggregates of each session: rows of a key no further apart than the gap."""
    df = df.withWatermark(time, late) if late else df
    # Rows exactly one gap apart are one session, so windows are a microsecond longer.
    made = df.groupBy(F.session_window(time, F.lit(f"{gap} 1 microsecond")).alias("_w"), *by).agg(*aggregates)
    return made.withColumn("start", F.col("_w.start")).drop("_w")
