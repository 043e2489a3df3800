"""CSV files: written by all tasks into a folder, or as a single file; read with the types of a table."""

from __future__ import annotations

import csv
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for null, so that empty texts stay apart from nulls.
NULL = "\\N"
OPTIONS = {"header": True, "nullValue": NULL, "quote": '"', "escape": '"', "multiLine": True}


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.hex(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str, null: str = NULL) -> None:
    """A folder of CSV files, each with a header; binary columns are in hexadecimal."""
    _shown(df).write.mode("overwrite").options(**OPTIONS | {"nullValue": null}).csv(path)


def write_single_csv(df: DataFrame, path: str, parts: str, null: str = NULL) -> None:
    """One CSV file on a file system that the driver sees: tasks write `parts`, a new folder beside it, in order, and the files' bytes are joined by the
    system. No row passes through Python."""
    _shown(df).write.options(**OPTIONS | {"nullValue": null, "header": False}).csv(parts)
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator="\n").writerow(df.columns)
    with open(path, "ab") as out:
        for part in sorted(Path(parts).glob("part-*.csv")):
            with part.open("rb") as one:
                shutil.copyfileobj(one, out, 1 << 20)
    shutil.rmtree(parts)


def read_csv(spark: SparkSession, path: str, like: DataFrame | None = None, null: str = NULL) -> DataFrame:
    """The file or folder; `like` gives types, and columns that it lacks are dropped. Without it types are inferred."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    options = OPTIONS | {"nullValue": null}
    if like is None:
        return spark.read.options(**options, inferSchema=True).csv(path)
    found = spark.read.options(**options).csv(path)
    kinds = {f.name: f.dataType for f in like.schema}
    cast = lambda c: F.unhex(c) if isinstance(kinds[c], T.BinaryType) else F.col(f"`{c}`").cast(kinds[c])
    return found.select(*[cast(c).alias(c) for c in found.columns if c in kinds])
