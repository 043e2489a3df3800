"""SQLite files as a source and a sink: a file or a folder of files, read by ranges of row numbers, with Spark's filters in SQLite's own query."""

from __future__ import annotations

import heapq
import sqlite3
import uuid
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from ..types import declared_type, spark_type

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: SQLite's storage classes that hold a Spark type's values as they are; values of other classes are read by Spark's filters alone.
_CLASSES = {"long": "'integer'", "double": "'integer', 'real'", "string": "'text'"}
_SIGNS = {"EqualTo": "=", "EqualNullSafe": "IS", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}


class _Range(D.InputPartition):
    """Rows of a file whose number is from first to last; all rows without a number."""

    def __init__(self, path: str, by: str | None = None, first: int = 0, last: int = -1):
        self.path, self.by, self.first, self.last = path, by, first, last


def _open(path: str) -> sqlite3.Connection:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _paths(path: str) -> list[str]:
    """The file, or the files of a folder."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return sorted(str(p) for p in Path(path).iterdir() if p.suffix in (".db", ".sqlite", ".sqlite3")) if Path(path).is_dir() else [path]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def row_number(db: sqlite3.Connection, table: str) -> str | None:
    """What numbers a table's rows: rowid, or the whole-number key of a table without one; None of a view and of other tables."""
    try:
        db.execute(f"SELECT rowid FROM {_quoted(table)} LIMIT 0")
        if db.execute("SELECT type FROM sqlite_master WHERE name = ?", (table,)).fetchone() == ("table",):
            return "rowid"
        return None
    except sqlite3.OperationalError:
        keys = [name for _, name, kind, _, _, pk in db.execute(f"PRAGMA table_info({_quoted(table)})") if pk == 1 and "INT" in kind.upper()]
        return _quoted(keys[0]) if keys else None


def ranges(db: sqlite3.Connection, table: str, by: str, parts: int) -> list[tuple[int, int]]:
    """Up to `parts` ranges that hold all row numbers, each from one that is there to one that is there.

    The widest range is halved again and again, and gaps at the halves' ends are left out, so that ranges follow where rows are. Each
    step looks up two numbers in the table's tree and reads no rows.
    """
    first, last = db.execute(f"SELECT min({by}), max({by}) FROM {_quoted(table)}").fetchone()
    if first is None:
        return []
    found, done = [(first - last, first, last)], []
    while found and len(found) + len(done) < parts:
        _, a, b = heapq.heappop(found)
        middle = a + (b - a) // 2
        up = db.execute(f"SELECT min({by}) FROM {_quoted(table)} WHERE {by} > ? AND {by} <= ?", (middle, b)).fetchone()[0]
        if up is None:
            done.append((a, b))
            continue
        down = db.execute(f"SELECT max({by}) FROM {_quoted(table)} WHERE {by} <= ?", (middle,)).fetchone()[0]
        for start, end in ((a, down), (up, b)):
            heapq.heappush(found, (start - end, start, end))
    return sorted(done + [(a, b) for _, a, b in found])


class _Reader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict, exact: Iterable[str]):
        self.names = [f.name for f in schema]
        self.kinds = {f.name: f.dataType.typeName() for f in schema}
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))
        self.exact, self.conditions, self.values = set(exact), [], []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Take what SQLite can test. Spark tests all filters again, since SQLite may keep values of other types in a column."""
        for f in filters:
            if found := self._condition(f):
                self.conditions.append(found[0])
                self.values += found[1]
            yield f

    def _condition(self, f: D.Filter) -> tuple[str, list] | None:
        kind = type(f).__name__
        if kind == "Not":
            inner = self._test(f.child)
        else:
            inner = self._test(f)
        if inner is None:
            return None
        name, test, values = inner
        test = f"NOT ({test})" if kind == "Not" else test
        if name in self.exact:
            return test, values
        return f"({test} OR typeof({_quoted(name)}) NOT IN ({_CLASSES[self.kinds[name]]}, 'null'))", values

    def _test(self, f: D.Filter) -> tuple[str, str, list] | None:
        """(column, SQL, values) of a filter on a single column of a type whose order SQLite shares."""
        kind, name = type(f).__name__, f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name not in self.kinds or self.kinds[name] not in _CLASSES:
            return None
        own, value = _quoted(name), getattr(f, "value", None)
        if kind in _SIGNS and (value is not None or kind == "EqualNullSafe"):
            return name, f"{own} {_SIGNS[kind]} ?", [value]
        if kind == "In" and 0 < len(value) <= 500 and None not in value:
            return name, f"{own} IN ({', '.join('?' * len(value))})", list(value)
        if kind == "IsNotNull":
            return name, f"{own} IS NOT NULL", []
        if kind == "IsNull":
            return name, f"{own} IS NULL", []
        if kind == "StringStartsWith":
            return name, f"substr({own}, 1, ?) = ?", [len(value), value]
        if kind == "StringContains":
            return name, f"instr({own}, ?) > 0", [value]
        return None

    def partitions(self) -> list[_Range]:
        found, paths = [], _paths(self.path)
        each = max(1, self.parts // max(1, len(paths)))
        for path in paths:
            with _open(path) as db:
                by = row_number(db, self.table)
                found += [_Range(path, by, a, b) for a, b in ranges(db, self.table, by, each)] if by else [_Range(path)]
        return found or [_Range("")]

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.path:
            return
        conditions, values = list(self.conditions), list(self.values)
        if part.by:
            conditions.append(f"{part.by} BETWEEN ? AND ?")
            values += [part.first, part.last]
        where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
        with _open(part.path) as db:
            for row in db.execute(f"SELECT {', '.join(map(_quoted, self.names))} FROM {_quoted(self.table)}{where}", values):
                yield tuple(self._fit(v, self.kinds[n]) for v, n in zip(row, self.names))

    @staticmethod
    def _fit(value, kind: str):
        """A value as its column's type; SQLite columns may hold any. What doesn't fit is null."""
        if value is None:
            return None
        try:
            if kind == "long":
                return int(value)
            if kind == "double":
                return float(value)
            if kind == "boolean":
                return value in (1, "1", "true", "TRUE")
            if kind == "binary":
                return value if isinstance(value, bytes) else str(value).encode()
        except (TypeError, ValueError):
            return None
        return value.decode(errors="replace") if isinstance(value, bytes) else str(value)


class SqliteSource(D.DataSource):
    """Options: path (a file or a folder of them), table (or a view), columns (all, if none are named), partitions. All executors must see the path."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _info(self) -> list[tuple]:
        paths = _paths(self.options["path"])
        if not paths:
            raise FileNotFoundError(self.options["path"])
        with _open(paths[0]) as db:
            info = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not info:
            raise ValueError(f"no such table: {self.options['table']}")
        return info

    def schema(self) -> T.StructType:
        # Times and dates are texts in SQLite.
        kind = lambda d: spark_type(d) if spark_type(d).typeName() not in ("timestamp_ntz", "date") else T.StringType()
        fields = {name: T.StructField(name, kind(declared)) for _, name, declared, *_ in self._info()}
        named = [c for c in self.options.get("columns", "").split("\n") if c]
        if unknown := [c for c in named if c not in fields]:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        return T.StructType([fields[c] for c in named or fields])

    def reader(self, schema: T.StructType) -> _Reader:
        info = self._info()
        keys = [name for _, name, kind, _, _, pk in info if pk]
        exact = [name for _, name, kind, *_ in info if keys == [name] and kind.upper() == "INTEGER"]  # the row's number: always a whole number
        return _Reader(schema, dict(self.options), exact)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8, columns: Sequence[str] | None = None) -> DataFrame:
    """A table or a view of a file, or of each file of a folder. Name the columns to read no others: Spark doesn't tell a source in Python.

    Filters reach SQLite if PUSHDOWN is on in the session; it is set here where nobody has set it.
    """
    if not Path(path).exists():
        raise FileNotFoundError(path)
    if spark.conf.get(PUSHDOWN, "false") == "false":
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").options(path=path, table=table, partitions=partitions, columns="\n".join(columns or ())).load()


def write_sqlite(df: DataFrame, folder: str, table: str) -> list[str]:
    """A file for each task in a folder that all executors see, each with its rows of the table; their paths.

    A file is written under another name first, so that a task that is tried again leaves no half of one.
    """
    Path(folder).mkdir(parents=True, exist_ok=True)
    columns = ", ".join(f"{_quoted(f.name)} {declared_type(f.dataType)}" for f in df.schema)
    marks = ", ".join("?" * len(df.columns))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unfinished = Path(folder) / f".{uuid.uuid4().hex}"
        with sqlite3.connect(unfinished) as db:
            db.execute(f"CREATE TABLE {_quoted(table)} ({columns})")
            for batch in batches:
                values = batch.astype(object).where(batch.notna(), None)
                db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({marks})", [tuple(str(v) if isinstance(v, pd.Timestamp) else v for v in row) for row in values.itertuples(index=False, name=None)])
        db.close()
        yield pd.DataFrame({"file": [unfinished.name]})

    found = []
    for row in df.mapInPandas(write, "file string").collect():  # a name a task
        done = Path(folder) / f"part-{row.file[1:]}.db"
        (Path(folder) / row.file).rename(done)
        found.append(str(done))
    return found


def tables(path: str) -> list[str]:
    with _open(path) as db:
        return sorted(r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'"))
