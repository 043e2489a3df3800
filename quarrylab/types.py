"""Declared column types, and what Spark, pandas and NumPy call them."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import types as T


class IntegrityError(ValueError):
    """A row that a constraint forbids."""


class ConflictError(Exception):
    """Another handle has changed the store since this one's transaction began."""


class Declared(NamedTuple):
    """A column as declared: its type's name, and the constraints written after it."""

    type: str
    primary_key: bool
    not_null: bool
    unique: bool
    default: str | None


#: Declared type names by the Spark type that holds them; any other name is a string.
SPARK_TYPES = {
    "long": ("INTEGER", "INT", "BIGINT", "SMALLINT", "SERIAL", "BIGSERIAL"),
    "double": ("REAL", "FLOAT", "DOUBLE", "NUMERIC", "DECIMAL"),
    "binary": ("BLOB", "BYTEA", "BINARY"),
    "boolean": ("BOOLEAN", "BOOL"),
    "timestamp_ntz": ("TIMESTAMP", "DATETIME"),
    "date": ("DATE",),
}
#: NumPy kinds whose arrays have a typed form, by the Spark element type.
ELEMENT_TYPES = {"float32": "float", "float64": "double", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "bool": "boolean", "uint8": "smallint"}
#: Companion columns of an array column.
COMPANIONS = {"dtype": "TEXT DEFAULT 'unknown'", "shape": "TEXT DEFAULT 'unknown'", "is_compressed": "BOOLEAN DEFAULT FALSE", "hash": "TEXT"}


def parse(declaration: str) -> Declared:
    upper = declaration.upper()
    default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\([^)]*\)|\S+)", declaration, re.I)
    name = re.match(r"\s*(\w*)", upper)[1]
    return Declared(name or "TEXT", "PRIMARY KEY" in upper, "NOT NULL" in upper, bool(re.search(r"\bUNIQUE\b", upper)), default[1] if default else None)


def spark_type(declaration: str) -> T.DataType:
    name = parse(declaration).type
    found = next((k for k, names in SPARK_TYPES.items() if name in names), "string")
    kinds = (T.LongType(), T.DoubleType(), T.BinaryType(), T.BooleanType(), T.TimestampNTZType(), T.DateType(), T.StringType())
    return next(k for k in kinds if k.typeName() == found)


def declared_type(kind: T.DataType) -> str:
    """The declaration that a Spark type is listed under."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "REAL"
    names = {T.BinaryType: "BLOB", T.BooleanType: "BOOLEAN", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE"}
    return names.get(type(kind), "TEXT")


def pandas_declaration(dtype) -> str:
    """The declared type of a pandas column's dtype."""
    text = str(dtype)
    if "bool" in text:
        return "BOOLEAN"
    if "datetime" in text:
        return "TIMESTAMP"
    if "int" in text.lower():
        return "INTEGER"
    return "REAL" if "float" in text.lower() else "TEXT"


def element_type(dtype: np.dtype) -> str | None:
    """The Spark element type of an array of this dtype; None if it has only the binary form."""
    return ELEMENT_TYPES.get(np.dtype(dtype).name)
