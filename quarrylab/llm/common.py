"""Small helpers shared by the operators: staging, gapless numbering, bounded broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import shared_dir
from .words import frames, trim

#: Settings under which tasks hold few long texts at once, and Spark's own values: what somebody has set otherwise stays.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(2 << 20)),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}

#: A side of a join is broadcast only if it was counted and has no more rows than this (about 50 MB).
BROADCAST_ROWS = 1_000_000


def small_batches(spark: SparkSession) -> None:
    for name, (usual, small) in SMALL_BATCHES.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, small)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """As df.mapInArrow(f, schema), with batches of few bytes, and with the worker's free memory given back at the end."""
    small_batches(df.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return df.mapInArrow(apply, schema)


def in_slices(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, by: str = "text") -> DataFrame:
    """As df.mapInPandas(f, schema), but with frames of few rows and few bytes of the column `by`, so that a task holds few texts as Python objects."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in f(frame.to_pandas() for frame in frames(batches, by)):
            yield pa.RecordBatch.from_pandas(found, fields, preserve_index=False)

    return mapped(df, apply, schema)


def over_cores(df: DataFrame) -> DataFrame:
    """df over as many tasks as work at once, if it is a scan of fewer splits, as of a file with one row group; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it was counted to be small; else as it is, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: What stands between two words of the kind [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, once the text is in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() is many times faster, and the same where all characters are ASCII.
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def plain_words(text: Column) -> Column:
    """Words of digits, a-z and non-ASCII characters of the lower-cased text, in order."""
    inner = F.btrim(lower_ascii(text), F.lit(_GAPS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATORS))


def gapless(df: DataFrame, group: str, order: list[str], spread: Column, buckets: int, out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, with no group in one task.

    A group is split into `buckets` parts by the hash of `spread`, parts are counted, and row numbers within a
    part are moved by the sizes of the parts before it.
    """
    df = df.withColumn("_part", F.pmod(F.xxhash64(spread, F.lit("slot")), F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select(group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = df.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    return (
        numbered.join(offsets, [group, "_part"])
        .withColumn(out, F.col("_before") + F.col("_rank"))
        .drop("_part", "_before", "_rank")
    )
