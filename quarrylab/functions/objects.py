"""Objects under keys: arrays as their bytes, plain values as JSON, anything else pickled if that is asked for."""

from __future__ import annotations

import json
import os
import pickle
import platform
import time
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import COMPRESS_FROM, raw_bytes
from .arrays import decode as decode_array


def encode(data, compress: bool, level: int = 6, metadata: dict | None = None, pickled: bool = False) -> dict:
    """The columns of an object's row, but for its key."""
    if isinstance(data, np.ndarray):
        raw, kind = np.ascontiguousarray(data).tobytes(), f"ndarray:{data.dtype}:{tuple(data.shape)}"
    elif pickled:
        raw, kind = pickle.dumps(data), "pickle"
    else:
        try:
            raw, kind = json.dumps(data).encode(), "json"
        except TypeError as e:
            raise ValueError("this object is no JSON; pickled=True keeps it as a pickle, to be loaded from trusted stores alone") from e
    packed = bool(compress) and len(raw) > COMPRESS_FROM
    stored = zlib.compress(raw, level) if packed else raw
    notes = dict(metadata or {}) | ({"original_size": len(raw), "compressed_size": len(stored)} if packed else {})
    return {"timestamp": time.time(), "pid": os.getpid(), "hostname": platform.node(), "data": stored, "compressed": int(packed), "data_type": kind, "metadata": json.dumps(notes) if notes else None}


def decode(row: dict, pickled: bool = False):
    """The object of a row."""
    kind = row["data_type"]
    if kind.startswith("ndarray:"):
        _, dtype, shape = kind.split(":", 2)
        return decode_array(row["data"], dtype, shape, row["compressed"])
    raw = zlib.decompress(row["data"]) if row["compressed"] else bytes(row["data"])
    if kind == "json":
        return json.loads(raw)
    if not pickled:
        raise ValueError("this object is a pickle; pickled=True loads it, which runs code of whoever wrote it")
    return pickle.loads(raw)


def encoded(found: DataFrame, compress: bool = False, level: int = 6) -> DataFrame:
    """The rows of objects given as JSON texts (key, json, and perhaps metadata, as JSON too), encoded in tasks as `encode` does."""
    host, pid = platform.node(), os.getpid()

    @F.pandas_udf("data binary, compressed long, metadata string")
    def cells(texts: pd.Series, notes: pd.Series) -> pd.DataFrame:
        rows = []
        for text, note in zip(texts, notes):
            raw = text.encode()
            packed = compress and len(raw) > COMPRESS_FROM
            stored = zlib.compress(raw, level) if packed else raw
            kept = (json.loads(note) if note else {}) | ({"original_size": len(raw), "compressed_size": len(stored)} if packed else {})
            rows.append((stored, int(packed), json.dumps(kept) if kept else None))
        return pd.DataFrame(rows, columns=["data", "compressed", "metadata"])

    notes = F.col("metadata") if "metadata" in found.columns else F.lit(None).cast("string")
    made = found.where(F.col("json").isNotNull()).select("key", cells("json", notes).alias("c"))
    return made.select("key", F.unix_timestamp().cast("double").alias("timestamp"), F.lit(pid).cast("long").alias("pid"), F.lit(host).alias("hostname"), "c.data", "c.compressed", F.lit("json").alias("data_type"), "c.metadata")


def decoded(rows: DataFrame) -> DataFrame:
    """(key, data_type, value, metadata) of objects' rows; value and metadata as VARIANT. What is no JSON is null."""
    raw = raw_bytes(F.col("data"), F.col("compressed") == 1)
    value = F.when(F.col("data_type") == "json", F.try_parse_json(F.decode(raw, "UTF-8")))
    return rows.select("key", "data_type", value.alias("value"), F.try_parse_json("metadata").alias("metadata"))
