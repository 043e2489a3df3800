"""A store of tables: immutable Parquet snapshots under a folder, and a manifest that names the current ones.

A change writes the new rows or the new state of a table beside the old one and then puts a new manifest in the
place of the current. Readers keep the files that their manifest names; a rollback forgets what was staged. The
manifest lies on a file system of the driver, the snapshots wherever Spark can write.
"""

from __future__ import annotations

import copy
import fcntl
import json
import os
import re
import shutil
import threading
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, chunks, objects
from ..operators import columns as column_ops
from ..operators import constraints, dedup, dml, rows, statistics
from ..session import shared_dir
from ..sources.delimited import NULL, read_csv, write_csv, write_single_csv
from ..types import COMPANIONS, ConflictError, IntegrityError, declared_type, pandas_declaration, parse, spark_type
from .statements import Statements
from .versions import Versions

ROWID = "__rowid"
#: Statements of a script: semicolons within literals, quoted names and comments end none.
_STATEMENTS = re.compile(r"""(?:'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;])+""", re.S)
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
OBJECTS = {"key": "TEXT PRIMARY KEY", "timestamp": "REAL", "pid": "INTEGER", "hostname": "TEXT", "data": "BLOB", "compressed": "INTEGER", "data_type": "TEXT", "metadata": "TEXT"}


def scratch(spark: SparkSession) -> str:
    """A new folder's name in what driver and executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


class Store(Versions):
    """Tables under `root`. mode: "ro" reads, "rw" needs a store that is there, "rwc" makes one."""

    def __init__(self, spark: SparkSession, root: str | Path, mode: str = "rwc", compress_by_default: bool = False, timeout: float = 300.0):
        if mode not in ("ro", "rw", "rwc"):
            raise ValueError("mode must be ro, rw or rwc")
        self.spark, self.root, self.mode = spark, Path(root), mode
        self.compress_by_default, self.timeout = compress_by_default, timeout
        self._lock, self._saved, self._staged, self._using = threading.RLock(), [], [], None
        self.enforce_foreign_keys = True
        self._statements = Statements(self)
        if not self._manifest_path.exists():
            if mode != "rwc":
                raise FileNotFoundError(self._manifest_path)
            self.root.mkdir(parents=True, exist_ok=True)
            self._manifest = {"version": 0, "writable": True, "tables": {}, "git": None}
            self._save()
        self._load()

    # Life cycle and transactions

    @property
    def _manifest_path(self) -> Path:
        return self.root / "manifest.json"

    def _load(self) -> None:
        self._manifest = json.loads(self._manifest_path.read_text())

    def _save(self) -> None:
        """Put the manifest in the current one's place, if that is still the one that it came from."""
        with self._held(".commit"):
            if self._manifest_path.exists() and json.loads(self._manifest_path.read_text())["version"] != self._manifest["version"]:
                raise ConflictError("the store was changed meanwhile")
            self._manifest["version"] += 1
            new = self.root / f".manifest-{uuid.uuid4().hex}"
            new.write_text(json.dumps(self._manifest))
            os.replace(new, self._manifest_path)

    def _held(self, name: str, kind: int = fcntl.LOCK_EX):
        """An open file of the store with a lock on it, which other handles and processes see; closing it ends the lock."""
        file = (self.root / name).open("a")
        fcntl.flock(file, kind)
        return file

    @property
    def _depth(self) -> int:
        return len(self._saved)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Drop what isn't committed."""
        while self._depth:
            self.rollback()

    def reconnect(self) -> None:
        self.close()
        self._load()

    ensure_connection = reconnect

    @contextmanager
    def transaction(self):
        """All changes within take effect together at its end, or none do; within another one it is part of that."""
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    def begin(self) -> None:
        if not self._lock.acquire(timeout=self.timeout):
            raise TimeoutError("the store is locked")
        try:
            if self._depth == 0:
                self._using = self._held(".use", fcntl.LOCK_SH) if self.mode != "ro" else None
                self._load()
            self._saved.append((copy.deepcopy(self._manifest), len(self._staged)))
        except BaseException:
            self._lock.release()
            raise

    def commit(self) -> None:
        """End this level; the outermost one's changes take effect, or are dropped with a ConflictError if another handle's came first."""
        if not self._depth:
            return
        if self._depth == 1:
            try:
                if self._manifest != self._saved[0][0]:
                    self._save()
            except BaseException:
                self.rollback()
                raise
            self._staged = []
        self._end()

    def rollback(self) -> None:
        """Go back to where this level began; what the levels around it did before stays."""
        if not self._depth:
            return
        self._manifest, kept = self._saved[-1]
        for path in self._staged[kept:]:
            shutil.rmtree(path, ignore_errors=True)
        del self._staged[kept:]
        self._end()

    def _end(self) -> None:
        self._saved.pop()
        if not self._saved and self._using:
            self._using.close()
            self._using = None
        self._lock.release()

    @contextmanager
    def maintenance_lock(self):
        if not self._lock.acquire(timeout=self.timeout):
            raise TimeoutError("the store is locked")
        try:
            yield
        finally:
            self._lock.release()

    @property
    def writable(self) -> bool:
        return self.mode != "ro" and self._manifest["writable"]

    @writable.setter
    def writable(self, state: bool) -> None:
        if self.mode == "ro":
            raise ValueError("the store is open for reading")
        with self.transaction():
            self._manifest["writable"] = bool(state)

    @contextmanager
    def _change(self):
        if not self.writable:
            raise ValueError("the store is not writable")
        with self.transaction():
            yield

    def enable_foreign_keys(self) -> None:
        self.enforce_foreign_keys = True

    def disable_foreign_keys(self) -> None:
        self.enforce_foreign_keys = False

    # Tables

    def _meta(self, table: str) -> dict:
        if table is None or table not in self._manifest["tables"]:
            raise ValueError(f"no such table: {table}")
        return self._manifest["tables"][table]

    def _stored(self, table: str) -> DataFrame:
        """The table with its row numbers."""
        meta = self._meta(table)
        schema = T.StructType.fromJson(meta["schema"])
        if not meta["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*meta["files"])

    def read(self, table: str) -> DataFrame:
        return self._stored(table).drop(ROWID)

    def _write(self, table: str, df: DataFrame) -> str:
        path = str(self.root / "tables" / table / uuid.uuid4().hex)
        meta = self._manifest["tables"].get(table)
        keys = {c for cs in (meta["primary_key"], *meta["unique"].values(), *meta["indexes"].values()) for c in cs} if meta else set()
        writer = df.write
        for c in sorted(keys & {f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.StringType, T.DoubleType))}):
            # A Bloom filter of each row group tells a lookup by an indexed column what it need not read.
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)
        self._staged.append(path)
        return path

    def _put(self, table: str, df: DataFrame) -> DataFrame:
        """df written beside the table, to be read several times within a change; vacuum deletes it."""
        return self.spark.read.schema(df.schema).parquet(self._write(table, df))

    def _append(self, table: str, new: DataFrame) -> int:
        """Add rows that conform to the table, numbered without gaps in their order; old files stay as they are. Their number.

        A whole-number key that isn't given is one more than the largest key until then, of the table and of the rows before.
        """
        meta = self._meta(table)
        schema = T.StructType.fromJson(meta["schema"])
        first, key = meta["next_rowid"], meta["primary_key"]
        own = key[0] if len(key) == 1 and meta["types"][key[0]] in ("INTEGER", "INT", "BIGINT", "SMALLINT") else None
        path = self._write(table, new.withColumn(ROWID, F.monotonically_increasing_id() + first).select(*[f"`{c}`" for c in schema.names]))
        added = self.spark.read.schema(schema).parquet(path)
        last, n, missing = added.agg(F.max(ROWID), F.count(F.lit(1)), F.count(F.when(F.col(own).isNull(), 1)) if own else F.lit(0)).first()
        if n and (missing or last - first + 1 != n):  # written by several tasks, each with numbers of its own: close the gaps between them
            raw, path = path, self._write(table, self._numbered(added, first, own if missing else None, self._stored(table)).select(*[f"`{c}`" for c in schema.names]))
            shutil.rmtree(raw)
            self._staged.remove(raw)
            added = self.spark.read.schema(schema).parquet(path)
        self._check(table, added, self._stored(table))
        if n:
            meta["files"].append(path)
            meta["next_rowid"] = first + n
        return n

    def _numbered(self, added: DataFrame, first: int, own: str | None, old: DataFrame) -> DataFrame:
        """added with row numbers from `first` on without gaps, and the keys that miss in `own`, by each task's sums of the tasks before it."""
        within = Window.partitionBy("_task").orderBy(ROWID)
        rows = added.withColumn("_task", F.shiftright(F.col(ROWID) - first, 33))
        ahead = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # over a row a task
        sums = [F.count(F.lit(1)).alias("_rows")]
        if own:
            # A given key less the missing ones before it: the largest of these, and the missing ones until a row, are its key.
            rows = rows.withColumn("_missing", F.count(F.when(F.col(own).isNull(), 1)).over(within)).withColumn("_base", F.col(own) - F.col("_missing"))
            sums += [F.max("_missing").alias("_m"), F.max("_base").alias("_b")]
        before = rows.groupBy("_task").agg(*sums).withColumn("_before", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
        if own:
            before = before.withColumn("_m_before", F.coalesce(F.sum("_m").over(ahead), F.lit(0))).withColumn("_b", F.col("_b") - F.col("_m_before"))
            before = before.withColumn("_b_before", F.max("_b").over(ahead)).drop("_m", "_b")
        dense = rows.join(before.drop("_rows"), "_task").withColumn(ROWID, F.col("_before") + (F.col(ROWID) - first).bitwiseAND((1 << 33) - 1) + first)
        if own:
            top = old.agg(F.max(own)).first()[0] or 0
            reached = F.greatest(F.lit(top), F.col("_b_before"), F.max("_base").over(within) - F.col("_m_before"))
            dense = dense.withColumn(own, F.coalesce(F.col(own), reached + F.col("_m_before") + F.col("_missing")))
        return dense

    def _replace(self, table: str, df: DataFrame, check: bool = True, touched: Iterable[str] | None = None) -> None:
        """Put a new state in the table's place; df has row numbers. Only constraints on touched columns are checked, if these are named."""
        meta = self._meta(table)
        path = self._write(table, df)
        meta["files"], meta["schema"] = [path], df.schema.jsonValue()
        if check:
            self._check(table, self._stored(table), None, touched)

    def _check(self, table: str, new: DataFrame, old: DataFrame | None, touched: Iterable[str] | None = None) -> None:
        """Hold new rows against the constraints, and against the old rows' keys where those count."""
        meta = self._meta(table)
        touched = {*(new.columns if touched is None else touched)}
        needed = [c for c in {*meta["not_null"], *meta["primary_key"]} if c in new.columns and c in touched]
        if needed and (broken := [r["column_name"] for r in constraints.null_violations(new, needed).where("nulls > 0").collect()]):
            raise IntegrityError(f"{table}: null in {', '.join(broken)}")
        for keys in [meta["primary_key"], *meta["unique"].values()]:
            if not touched & {*keys}:
                continue
            if not constraints.unique_violations(new, keys).isEmpty() or (old is not None and meta["files"] and not new.join(self._those(old, new, keys[0]).select(*keys), list(keys), "left_semi").isEmpty()):
                raise IntegrityError(f"{table}: {', '.join(keys)} must be unique")
        for fk in meta["foreign_keys"] if self.enforce_foreign_keys else ():
            if fk["column"] in touched and not constraints.foreign_key_violations(new, fk["column"], self.read(fk["table"]), fk["to"]).isEmpty():
                raise IntegrityError(f"{table}: {fk['column']} without a row of {fk['table']}")

    @staticmethod
    def _those(old: DataFrame, new: DataFrame, key: str, most: int = 500) -> DataFrame:
        """old, without rows whose key is none of new's, if these are few: then they are listed, and files are skipped by their bounds and Bloom filters."""
        found = [r[0] for r in new.select(key).where(F.col(key).isNotNull()).limit(most + 1).collect()]
        return old if len(found) > most else old.where(F.col(key).isin(found))

    def create_table(self, table: str, columns: dict[str, str], foreign_keys: Sequence[dict] | None = None, if_not_exists: bool = True, companions: bool = True) -> None:
        """A table of declared columns; array (BLOB) columns come with their companions."""
        with self._change():
            if table in self._manifest["tables"]:
                if if_not_exists:
                    return
                raise ValueError(f"table {table} is there already")
            declared = {}
            for name, text in columns.items():
                declared[name] = text
                if companions and spark_type(text).typeName() == "binary" and columns is not OBJECTS:
                    declared |= {f"{name}_{s}": d for s, d in COMPANIONS.items() if f"{name}_{s}" not in columns}
            parsed = {c: parse(d) for c, d in declared.items()}
            schema = T.StructType([T.StructField(c, spark_type(d)) for c, d in declared.items()] + [T.StructField(ROWID, T.LongType())])
            links = [{"column": f.get("tgt_column") or f["column"], "table": f.get("src_table") or f["references"], "to": f.get("src_column") or f["referenced_column"]} for f in foreign_keys or ()]
            self._manifest["tables"][table] = {
                "schema": schema.jsonValue(), "files": [], "next_rowid": 1, "types": {c: p.type for c, p in parsed.items()},
                "primary_key": [c for c, p in parsed.items() if p.primary_key], "not_null": [c for c, p in parsed.items() if p.not_null],
                "defaults": {c: p.default for c, p in parsed.items() if p.default}, "unique": {f"unique_{table}_{c}": [c] for c, p in parsed.items() if p.unique},
                "indexes": {}, "foreign_keys": links,
            }

    def drop_table(self, table: str, if_exists: bool = True) -> None:
        with self._change():
            if table in self._manifest["tables"]:
                for child, fk in self._links_to(table):
                    if child != table and self.enforce_foreign_keys and not self.read(child).where(F.col(fk["column"]).isNotNull()).isEmpty():
                        raise IntegrityError(f"{child}: {fk['column']} refers to {table}")
                    self._meta(child)["foreign_keys"].remove(fk)
                del self._manifest["tables"][table]
            elif not if_exists:
                raise ValueError(f"no such table: {table}")

    def rename_table(self, old: str, new: str) -> None:
        with self._change():
            if new in self._manifest["tables"]:
                raise ValueError(f"table {new} is there already")
            self._meta(old)
            for _, fk in self._links_to(old):
                fk["table"] = new
            self._manifest["tables"][new] = self._manifest["tables"].pop(old)

    def _links_to(self, table: str) -> list[tuple[str, dict]]:
        """The foreign keys that refer to a table, each with the table that it is of."""
        return [(name, fk) for name, meta in self._manifest["tables"].items() for fk in meta["foreign_keys"] if fk["table"] == table]

    def get_table_names(self) -> list[str]:
        return sorted(self._manifest["tables"])

    def table_exists(self, table: str) -> bool:
        return table in self._manifest["tables"]

    def get_column_info(self, table: str) -> list[dict]:
        meta = self._meta(table)
        return [
            {"cid": i, "name": c, "type": meta["types"].get(c, "TEXT"), "notnull": c in meta["not_null"], "default": meta["defaults"].get(c), "pk": c in meta["primary_key"]}
            for i, c in enumerate(self.read(table).columns)
        ]

    def get_table_schema(self, table: str) -> pd.DataFrame:
        found = pd.DataFrame(self.get_column_info(table)).rename(columns={"default": "dflt_value"})
        return found.assign(notnull=found["notnull"].astype(int), pk=found["pk"].astype(int))

    def get_primary_key(self, table: str) -> str | None:
        return next(iter(self._meta(table)["primary_key"]), None)

    def get_primary_keys(self, table: str) -> list[str]:
        """All columns of the primary key."""
        return list(self._meta(table)["primary_key"])

    def get_foreign_keys(self, table: str) -> list[dict]:
        return list(self._meta(table)["foreign_keys"])

    def column_exists(self, table: str, column: str) -> bool:
        return column in self.read(table).columns

    def get_table_stats(self, table: str) -> dict:
        return self._sizes(table) | {"row_count": self.get_row_count(table)}

    def _sizes(self, table: str) -> dict:
        """Parquet files of the current state ("pages"), their mean size, and their size together."""
        files = [p for d in self._meta(table)["files"] for p in Path(d).glob("*.parquet")]
        total = sum(p.stat().st_size for p in files)
        return {"pages": len(files), "page_size": total // len(files) if files else 0, "total_size": total}

    def recommendations(self) -> list[str]:
        """What upkeep would help: small files put together, snapshots out of use deleted, a key or an index for tables without one."""
        found = []
        for name in self.get_table_names():
            sizes, meta = self._sizes(name), self._meta(name)
            if sizes["pages"] > 16 and sizes["page_size"] < 16 << 20:
                found.append(f"{name}: {sizes['pages']} small files; optimize puts them together")
            if not (meta["primary_key"] or meta["unique"] or meta["indexes"]):
                found.append(f"{name}: no key and no index; lookups read all of it")
        used = self._files_in_use()
        stale = sum(str(p) not in used for p in (self.root / "tables").glob("*/*"))
        return found + ([f"{stale} snapshots out of use; vacuum deletes them"] if stale else [])

    def copy_table(self, source: str, target: str, where: str | None = None) -> None:
        with self._change():
            if not self.table_exists(target):
                meta = copy.deepcopy(self._meta(source)) | {"files": [], "next_rowid": 1}
                self._manifest["tables"][target] = meta
            self._append(target, dml.conform(dml.copy_rows(self._filtered(source, where)), self.read(target)))

    # Columns: each returns whether it could be done

    def _columns(self, table: str, change, rename: dict[str, str] | None = None) -> bool:
        try:
            with self._change():
                stored = self._stored(table)
                changed = change(stored.drop(ROWID)).columns
                self._replace(table, change(stored).select(*changed, ROWID), check=False)
                meta = self._meta(table)
                name = lambda c: (rename or {}).get(c, c)
                meta["types"] = {c: next((t for o, t in meta["types"].items() if name(o) == c), declared_type(self.read(table).schema[c].dataType)) for c in changed}
                for part in ("primary_key", "not_null"):
                    meta[part] = [name(c) for c in meta[part] if name(c) in changed]
                meta["defaults"] = {name(c): d for c, d in meta["defaults"].items() if name(c) in changed}
                meta["unique"] = {k: [*map(name, cs)] for k, cs in meta["unique"].items() if {*map(name, cs)} <= {*changed}}
                meta["indexes"] = {k: [*map(name, cs)] for k, cs in meta["indexes"].items() if {*map(name, cs)} <= {*changed}}
                meta["foreign_keys"] = [f | {"column": name(f["column"])} for f in meta["foreign_keys"] if name(f["column"]) in changed]
            return True
        except IntegrityError:
            raise
        except ValueError:
            if not self.writable:
                raise
            return False

    def add_column(self, table: str, column: str, declaration: str, default=None, not_null: bool = False) -> bool:
        own = parse(declaration)
        if (not_null or own.not_null) and default is None and own.default is None:
            return False
        done = self._columns(table, lambda df: column_ops.add_column(df, column, declaration, default))
        if done:
            with self._change():
                meta = self._meta(table)
                meta["types"][column] = own.type
                if not_null or own.not_null:
                    meta["not_null"].append(column)
                if own.default or default is not None:
                    meta["defaults"][column] = own.default or repr(default)
        return done

    def add_columns(self, table: str, columns: dict[str, str], default_values: dict | None = None) -> bool:
        return all([self.add_column(table, c, d, (default_values or {}).get(c)) for c, d in columns.items()])

    def drop_columns(self, table: str, names: str | Sequence[str], if_exists: bool = False) -> bool:
        return self._columns(table, lambda df: column_ops.drop_columns(df, names, if_exists) if ROWID not in df.columns else df.drop(*([names] if isinstance(names, str) else names)))

    def drop_column(self, table: str, column: str) -> bool:
        return self.drop_columns(table, column)

    def rename_column(self, table: str, old: str, new: str) -> bool:
        return self._columns(table, lambda df: column_ops.rename_column(df, old, new), {old: new})

    def reorder_columns(self, table: str, order: Sequence[str]) -> bool:
        return self._columns(table, lambda df: column_ops.reorder_columns(df, [*order, ROWID] if ROWID in df.columns else order))

    def sort_columns(self, table: str, reverse: bool = False, key_columns_first: Sequence[str] | None = None, key=None) -> bool:
        return self._columns(table, lambda df: column_ops.sort_columns(df, reverse, key_columns_first, key))

    # Indexes

    def create_index(self, table: str, column_names: str | Sequence[str], index_name: str | None = None, unique: bool = False) -> None:
        """A unique index is a constraint from now on; another one is what `optimize` sorts by. Files written from now on, and by `optimize`
        all of them, have Bloom filters on indexed columns, so that lookups and the checks of appended keys skip row groups."""
        names = [column_names] if isinstance(column_names, str) else list(column_names)
        with self._change():
            meta = self._meta(table)
            if unique and not constraints.unique_violations(self.read(table), names).isEmpty():
                raise IntegrityError(f"{table}: {', '.join(names)} must be unique")
            meta["unique" if unique else "indexes"][index_name or f"idx_{table}_{'_'.join(names)}"] = names

    def drop_index(self, name: str) -> None:
        with self._change():
            for meta in self._manifest["tables"].values():
                meta["unique"].pop(name, None)
                meta["indexes"].pop(name, None)

    def get_indexes(self, table: str | None = None) -> list[dict]:
        return [
            {"table": t, "name": n, "columns": c, "unique": kind == "unique"}
            for t, meta in self._manifest["tables"].items() if table in (None, t) for kind in ("unique", "indexes") for n, c in meta[kind].items()
        ]

    def fix_indexes(self) -> None:
        for name in self.get_table_names():
            self._check(name, self._stored(name), None)

    # Queries

    def execute(self, query: str, parameters: Sequence | dict = ()) -> DataFrame | int | None:
        """Any statement, with `?` or `:name` parameters: a query's rows, lazy; the number of rows that a change has changed; else None.

        Spark's parser reads it, and it has SQLite's answers (`dialect`). Changes are INSERT (OR REPLACE, OR IGNORE), REPLACE, UPDATE, DELETE, MERGE,
        CREATE TABLE (AS), ALTER, DROP, TRUNCATE, CREATE INDEX, BEGIN, COMMIT, ROLLBACK; each is all or none.
        """
        return self._statements.run(query, parameters)

    def executemany(self, query: str, parameters: Iterable[Sequence]) -> int:
        """An INSERT, UPDATE or DELETE for each row of parameters, all or none; the number of rows changed."""
        return self._statements.run_many(query, list(parameters))

    def execute_query(self, query: str, parameters: Sequence | dict = ()) -> list[dict]:
        """A query's rows as dicts; none of a statement that has no rows."""
        found = self.execute(query, parameters)
        return [r.asDict() for r in found.collect()] if isinstance(found, DataFrame) else []

    def executescript(self, script: str) -> list[DataFrame]:
        """Statement after statement; the queries' rows."""
        done = [self.execute(part) for part in _STATEMENTS.findall(script) if _COMMENT.sub("", part).strip()]
        return [d for d in done if isinstance(d, DataFrame)]

    def _where(self, df: DataFrame, where: str | Column | None, params: Sequence | dict | None = None) -> Column | None:
        """A predicate in SQLite's dialect over df, which may have row numbers; None without one."""
        if where is None or isinstance(where, Column):
            return where
        return self._statements.dialect.predicate(df, where, params or ()) if where.strip() else None

    def _filtered(self, table: str, where: str | Column | None, params: Sequence | dict | None = None) -> DataFrame:
        """The table's rows, with their numbers dropped, that a predicate holds for."""
        stored = self._stored(table)
        condition = self._where(stored, where, params)
        return (stored if condition is None else stored.where(condition)).drop(ROWID)

    def _known(self, table: str, columns: Iterable[str]) -> None:
        if unknown := [c for c in columns if c not in self.read(table).columns]:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")

    def _typed(self, table: str, df: DataFrame) -> DataFrame:
        """df's columns as the table's types."""
        kinds = {f.name: f.dataType for f in self.read(table).schema}
        return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in df.columns])

    def get_rows(self, table: str, columns=None, ids="all", where=None, order_by=None, limit=None, offset=None, return_as: str = "spark", include_blobs: bool = True):
        """Rows as a lazy DataFrame, or as "dataframe" (pandas), "list" (tuples) or "dict" (a list of dicts)."""
        found = rows.get_rows(self._filtered(table, where), columns, ids, None, order_by, limit, offset, include_blobs, self.get_primary_key(table) or "id")
        if return_as == "spark":
            return found
        if return_as == "list":
            return [tuple(r) for r in found.collect()]
        if return_as == "dict":
            return [r.asDict() for r in found.collect()]
        return found.toPandas()

    def get_row_count(self, table: str, where: str | None = None, params: Sequence | dict | None = None) -> int:
        return rows.count_rows(self._filtered(table, where, params)).first()["n"]

    count = get_row_count

    def select(self, table: str, columns=None, where=None, params=None, order_by=None, limit=None) -> list[dict]:
        return [r.asDict() for r in rows.select(self.read(table), columns, where, params, order_by, limit).collect()]

    # Rows

    def _rows(self, table: str, new: Iterable[dict] | pd.DataFrame | DataFrame) -> DataFrame:
        """New rows as a DataFrame of the table's types; columns that no row names get their default."""
        kinds = {f.name: f.dataType for f in self.read(table).schema}
        if not isinstance(new, (DataFrame, pd.DataFrame)):
            new = list(new)
            names = list(dict.fromkeys(c for r in new for c in r))
            if unknown := [c for c in names if c not in kinds]:
                raise ValueError(f"unknown columns: {', '.join(unknown)}")
            plain = lambda v: v.item() if isinstance(v, np.generic) else bytes(v) if isinstance(v, (bytearray, memoryview)) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
            fit = lambda c, v: float(v) if isinstance(kinds[c], T.DoubleType) and isinstance(v, int) and not isinstance(v, bool) else v
            new = self.spark.createDataFrame([tuple(fit(c, plain(r.get(c))) for c in names) for r in new], T.StructType([T.StructField(c, kinds[c]) for c in names])).coalesce(1)  # so that they are numbered in a row
        elif isinstance(new, pd.DataFrame):
            new = self.spark.createDataFrame(new).coalesce(1)
        for c, d in self._meta(table)["defaults"].items():
            if c not in new.columns:
                new = new.withColumn(c, F.expr(d))
        return dml.conform(new, self.read(table))

    def insert_many(self, table: str, rows: Iterable[dict] | pd.DataFrame | DataFrame, inherit_foreign: bool = True, where: str | None = None) -> None:
        """Append rows, all or none; those alone that `where` holds for. Foreign values that are missing are inherited."""
        if isinstance(rows, list) and not rows:
            return
        with self._change():
            new = self._rows(table, rows)
            for fk in self._meta(table)["foreign_keys"] if inherit_foreign else ():
                if fk["to"] in new.columns and fk["to"] != fk["column"]:
                    parent = self.read(fk["table"])
                    if fk["column"] in parent.columns:
                        new = dml.conform(dml.inherit_foreign(new, parent, fk["column"], fk["column"], fk["to"]), self.read(table))
            self._append(table, new.where(dml.holds(self._where(new, where))) if where else new)

    def insert(self, table: str, data: dict) -> None:
        self.insert_many(table, [data])

    def _key_sets(self, table: str) -> list[list[str]]:
        meta = self._meta(table)
        return [keys for keys in (meta["primary_key"], *meta["unique"].values()) if keys]

    def replace_many(self, table: str, rows: Iterable[dict] | DataFrame) -> None:
        """Insert rows, in the place of those with the same primary key or unique values; of such new rows the last stays."""
        with self._change():
            self._replace_rows(table, self._rows(table, rows))

    def _replace_rows(self, table: str, rows: DataFrame) -> int:
        sets, new = self._key_sets(table), self._rows(table, rows).withColumn("_at", F.monotonically_increasing_id())
        if sets:
            written = self._put(table, dml.marked_last(new, sets, "_at", "_stays"))
            left = self._stored(table)
            for keys in sets:
                left = left.join(written.select(*keys), list(keys), "left_anti").select(*left.columns)
            self._replace(table, left, check=False)
            new = written.where("_stays").drop("_stays")
        return self._append(table, new.orderBy("_at").drop("_at"))

    def _without_conflicts(self, table: str, rows: DataFrame) -> DataFrame:
        """New rows without those whose key or unique values are there, or on a row before them."""
        sets, new = self._key_sets(table), self._rows(table, rows).withColumn("_at", F.monotonically_increasing_id())
        if sets:
            written = self._put(table, new)
            for keys in sets:
                written = written.join(self.read(table).select(*keys), list(keys), "left_anti").select(*new.columns)
            new = dml.marked_last(written.withColumn("_back", -F.col("_at")), sets, "_back", "_stays").where("_stays").drop("_stays", "_back")
        return new.orderBy("_at").drop("_at")

    def update_many(self, table: str, rows: Iterable[dict] | DataFrame, key: str | Sequence[str] | None = None, where: str | None = None, columns: Sequence[str] | None = None) -> int | None:
        """Set, in the rows of each dict's key (the primary key, if none is named), the other columns that it names.

        A column that a dict doesn't name stays as it is; of several dicts of one key the last that names a column counts.
        Dicts without that key change every row, so that the last of them stays.
        With `where`, each dict sets `columns` (all that it names, if none are named) in the rows for which that predicate holds with
        the dict's own values: those of `:name`, or for each `?` those of the words of the predicate that are names in the
        dicts. One join does it, without a nested loop for keys and ranges, and the last dict wins.
        """
        if where is not None:
            if isinstance(rows, DataFrame):
                raise ValueError("where takes dicts")
            rows = list(rows)
            if not rows:
                return 0
            names = list(columns or rows[0])
            if "?" not in where:
                return self.executemany(f"UPDATE `{table}` SET {', '.join(f'`{c}` = :{c}' for c in names)} WHERE {where}", rows)
            asked = [w for w in where.split() if w in rows[0]]
            text = f"UPDATE `{table}` SET {', '.join(f'`{c}` = ?' for c in names)} WHERE {where}"
            return self.executemany(text, [[r.get(c) for c in (*names, *asked)] for r in rows])
        if columns is not None and not isinstance(rows, DataFrame):
            kept = {*columns, *([key] if isinstance(key, str) else key or self._meta(table)["primary_key"])}
            rows = [{c: v for c, v in r.items() if c in kept} for r in rows]
        with self._change():
            stored, names = self._stored(table), None
            keys = [key] if isinstance(key, str) else list(key or self._meta(table)["primary_key"])
            if not isinstance(rows, DataFrame):
                rows = list(rows)
                names = list(dict.fromkeys(c for r in rows for c in r))
                if not rows:
                    return
            if not keys or not {*keys} <= {*(names or rows.columns)}:
                if isinstance(rows, DataFrame):
                    raise ValueError("update rows without a key")
                self._replace(table, dml.update_where(stored, rows[-1], "true"))
                return
            new = self._rows(table, rows).select(*(names or rows.columns)).withColumn("_at", F.monotonically_increasing_id())
            given = [c for c in names or () if c not in keys and any(c not in r for r in rows)]
            if given:  # numbered as their rows, which come in one part
                marks = self.spark.createDataFrame([(i, *[c in r for c in given]) for i, r in enumerate(rows)], ", ".join(["_at long", *[f"`_given_{c}` boolean" for c in given]]))
                new = new.join(marks, "_at")
            self._replace(table, dml.update_keyed(stored, new, keys, "_at", given))

    def update_where(self, table: str, updates: dict, where: str, limit: int | None = None, params: Sequence | dict | None = None) -> int:
        """Set columns in the rows that `where` holds for, or the first so many of them; their number."""
        with self._change():
            stored = self._stored(table)
            condition = self._where(stored, where, params) if isinstance(where, str) and where.strip() else where
            hit = stored.where(dml.holds(condition)).count()
            self._replace(table, dml.update_where(stored, updates, condition, limit, ROWID if limit is not None else None), touched=updates)
            return hit if limit is None else min(hit, limit)

    def update(self, table: str, data: dict, where: str, params: Sequence | dict | None = None) -> int:
        return self.update_where(table, data, where, params=params)

    def delete_where(self, table: str, where: str, limit: int | None = None, params: Sequence | dict | None = None) -> int:
        with self._change():
            stored = self._stored(table)
            condition = self._where(stored, where, params) if isinstance(where, str) and where.strip() else where
            hit = stored.where(dml.holds(condition)).count()
            self._replace(table, dml.delete_where(stored, condition, limit, ROWID if limit is not None else None).select(*[f"`{c}`" for c in stored.columns]), check=False)
            return hit if limit is None else min(hit, limit)

    def delete(self, table: str, where: str, params: Sequence | dict | None = None) -> int:
        return self.delete_where(table, where, params=params)

    def delete_duplicates(self, table: str, columns="all", include_blob: bool = False, dry_run: bool = True) -> tuple[int, int]:
        """(rows after it, duplicates); the first of equal rows stays. A dry run counts alone."""
        stored = self._stored(table)
        keys = dedup.key_columns(stored.drop(ROWID), columns, self._meta(table)["primary_key"], include_blob)
        found = dedup.duplicate_rate(stored, keys).first()
        if dry_run:
            return found["total"], found["duplicates"]
        with self._change():
            self._replace(table, dedup.keep_first(stored, keys, ROWID).select(*stored.columns), check=False)
        return found["total"] - found["duplicates"], found["duplicates"]

    def verify_duplicated_index(self, table: str, row: dict) -> bool:
        """Whether a row with these values is there; a null equals nothing."""
        self._known(table, row)
        return not dedup.equal_rows(self.read(table), row).limit(1).isEmpty()

    def delete_entry(self, table: str, row: dict, dry_run: bool = True) -> bool:
        """Delete the first row with these values, and no other; whether there is one. A dry run deletes nothing."""
        there = self.verify_duplicated_index(table, row)
        if there and not dry_run:
            with self._change():
                stored = self._stored(table)
                self._replace(table, dedup.delete_one(stored, row, ROWID).select(*[f"`{c}`" for c in stored.columns]), check=False)
        return there

    def sort_table(self, table: str, order_by: str) -> None:
        with self._change():
            self._replace(table, self._stored(table).orderBy(*rows.order_columns(order_by)), check=False)

    def truncate_table(self, table: str) -> None:
        with self._change():
            self._meta(table)["files"] = []

    def _loads(self, table: str | None, probe) -> bool:
        try:
            return all(probe(self.read(name)) for name in ([table] if table else self.get_table_names()))
        except Exception:  # whatever a damaged file or cell raises
            return False

    def is_rows_loadable(self, table: str | None = None) -> bool:
        """Whether rows of the table, or of all tables, can be read."""
        return self._loads(table, lambda df: df.limit(1).collect() is not None)

    def is_arrays_loadable(self, table: str | None = None) -> bool:
        """Whether all array cells have the hashes that are kept with them."""

        def hold(df: DataFrame) -> bool:
            named = [c for c in df.columns if f"{c}_is_compressed" in df.columns]
            return all(arrays.verify(df.where(F.col(f"{c}_hash").isNotNull()), c).where(~F.col(f"{c}_ok")).isEmpty() for c in named)

        return self._loads(table, hold)

    def is_blobs_loadable(self, table: str | None = None) -> bool:
        """Whether the bytes of all objects can be unpacked."""

        def unpacked(df: DataFrame) -> bool:
            if {*OBJECTS} <= {*df.columns}:
                df.agg(F.sum(F.length(arrays.raw_bytes(F.col("data"), F.col("compressed") == 1)))).collect()
            return True

        return self._loads(table, unpacked)

    def is_loadable(self, table: str | None = None) -> bool:
        """Whether rows, array cells and objects of the table, or of all tables, can be read."""
        return self.is_rows_loadable(table) and self.is_arrays_loadable(table) and self.is_blobs_loadable(table)

    list_tables, list_indexes, upsert = get_table_names, get_indexes, replace_many

    # Arrays and objects

    def _cell(self, column: str, array: np.ndarray, compress: bool | None, level: int) -> dict:
        cell = arrays.encode(array, self.compress_by_default if compress is None else compress, level)
        return {column: cell.pop("data")} | {f"{column}_{k}": v for k, v in cell.items()}

    def _companions(self, table: str, columns: Iterable[str]) -> None:
        present = self.read(table).columns
        for column in columns:
            for suffix, declaration in COMPANIONS.items():
                if f"{column}_{suffix}" not in present:
                    self.add_column(table, f"{column}_{suffix}", declaration)

    def save_arrays(self, table: str, data: dict[str, np.ndarray], ids: int | Sequence[int] | None = None, additional_columns: dict | None = None, compress: bool | None = None, compress_level: int = 6) -> None:
        """One row of array cells; with an id, the cells of that row."""
        values = dict(additional_columns or {})
        for column, array in data.items():
            values |= self._cell(column, array, compress, compress_level)
        with self._change():
            self._companions(table, data)
            key = self.get_primary_key(table) or "id"
            if ids is None:
                self.insert_many(table, [values])
                return
            own = ids if isinstance(ids, int) else list(ids)[0]
            if self.get_row_count(table, f"`{key}` = {int(own)}"):
                self.update_many(table, [{key: own} | values], key)
            else:
                self.insert_many(table, [{key: own} | values])

    def save_array(self, table: str, data: np.ndarray | Sequence[np.ndarray], column: str = "data", ids=None, additional_columns=None, compress=None, compress_level: int = 6, where: str | None = None) -> None:
        """One array; or a list of arrays for a list of ids, in one change; with `where`, one array for all rows that it holds for."""
        if where is not None:
            with self._change():
                self._companions(table, [column])
                self.update_where(table, dict(additional_columns or {}) | self._cell(column, data, compress, compress_level), where)
            return
        if isinstance(data, np.ndarray) or not isinstance(data, Sequence):
            self.save_arrays(table, {column: data}, ids, additional_columns, compress, compress_level)
            return
        ids = [] if ids is None else list(ids)
        if len(ids) != len(data) or len({*ids}) != len(ids):
            raise ValueError("an id of its own is asked for with each array")
        key = self.get_primary_key(table) or "id"
        new = [{key: i} | dict(additional_columns or {}) | self._cell(column, a, compress, compress_level) for i, a in zip(ids, data)]
        with self._change():
            self._companions(table, [column])
            there = {r[key] for r in rows.get_rows(self.read(table), [key], ids, id_column=key).collect()}
            self.update_many(table, [r for r in new if r[key] in there], key)
            self.insert_many(table, [r for r in new if r[key] not in there])

    def get_array_dict(self, df: pd.DataFrame, columns=None, dtype=None, shape=None) -> dict[str, np.ndarray | None]:
        return arrays.array_dict(df, columns, dtype, shape)

    def decode_array_columns(self, df: pd.DataFrame, columns=None, dtype=None, shape=None) -> pd.DataFrame:
        return arrays.decode_frame(df, columns, dtype, shape)

    def load_arrays(self, table: str, columns="all", ids="all", where=None, order_by=None, batch_size: int | None = None) -> dict[str, np.ndarray] | Iterator[dict[str, np.ndarray]] | None:
        """The stacked arrays of each column, rows first, in the order of the ids, an id as often as it is named; None without any.

        With batch_size, an iterator of such dicts of so many rows: the driver holds a batch, and a task's rows, at a time.
        """
        columns = self._array_columns(table) if columns == "all" else [columns] if isinstance(columns, str) else list(columns)
        found = self._array_rows(table, columns, ids, where, order_by)
        if batch_size is not None:
            if batch_size < 1:
                raise ValueError("batch_size must be positive")
            return self._batches(found, columns, batch_size)
        found = found.collect()
        made = {c: arrays.stacked(found, c) for c in columns}
        return made if any(a is not None for a in made.values()) else None

    def _array_columns(self, table: str) -> list[str]:
        names = self.read(table).columns
        return [c for c in names if {f"{c}_dtype", f"{c}_shape", f"{c}_is_compressed"} <= {*names}]

    def _array_rows(self, table: str, columns: Sequence[str], ids, where, order_by) -> DataFrame:
        """Cells and their companions; for a list of ids by a join with their places in it."""
        key, stored = self.get_primary_key(table) or "id", self._stored(table)
        needed = [key, *[x for c in columns for x in (c, f"{c}_dtype", f"{c}_shape", f"{c}_is_compressed")]]
        where = self._where(stored, where)
        if isinstance(ids, (int, str)):
            return rows.get_rows(stored, needed, ids, where, order_by or ROWID, id_column=key)
        asked = self.spark.createDataFrame([([int(i) for i in ids],)], "ids array<long>").select(F.posexplode("ids").alias("_place", "_id"))
        if len(ids) <= 1000:
            stored = stored.where(F.col(key).isin([int(i) for i in ids]))  # reaches the files
        kept = stored if where is None else stored.where(where)
        return kept.join(asked, F.col(key) == F.col("_id")).orderBy(*(rows.order_columns(order_by) or ["_place"])).select(*[f"`{c}`" for c in needed])

    @staticmethod
    def _batches(found: DataFrame, columns: Sequence[str], size: int) -> Iterator[dict[str, np.ndarray]]:
        held = []
        for row in found.toLocalIterator():
            held.append(row)
            if len(held) == size:
                yield {c: arrays.stacked(held, c) for c in columns}
                held = []
        if held:
            yield {c: arrays.stacked(held, c) for c in columns}

    def load_array(self, table: str, column: str = "data", ids="all", where=None, order_by=None, batch_size: int | None = None):
        if batch_size is not None:
            return (b[column] for b in self.load_arrays(table, [column], ids, where, order_by, batch_size))
        return (self.load_arrays(table, [column], ids, where, order_by) or {}).get(column)

    def save_chunks(self, table: str, found: dict[int, np.ndarray] | DataFrame, chunk_bytes: int = chunks.CHUNK_BYTES, compress: bool | None = None) -> None:
        """Arrays by their ids, in the place of those that are there, in a table of chunks along the first axis.

        From a DataFrame (id, cell) of array cells, tasks cut them; from a dict the driver does.
        """
        compress = self.compress_by_default if compress is None else compress
        with self._change():
            self.create_table(table, {"id": "INTEGER", "chunk": "INTEGER", "start": "INTEGER", "stop": "INTEGER", "dtype": "TEXT", "shape": "TEXT", "is_compressed": "BOOLEAN", "hash": "TEXT", "data": "BLOB"}, companions=False)
            if isinstance(found, DataFrame):
                new = chunks.chunked(found, "id", "cell", chunk_bytes, compress)
            else:
                kinds = {f.name: f.dataType for f in self.read(table).schema}
                made = [{"id": int(i)} | p for i, a in found.items() for p in chunks.pieces(np.asarray(a), chunk_bytes, compress)]
                new = self.spark.createDataFrame([tuple(r[c] for c in kinds) for r in made], self.read(table).schema)
            new = self._put(table, self._typed(table, new))
            self._replace(table, self._stored(table).join(new.select("id").distinct(), "id", "left_anti").select(*self._stored(table).columns), check=False)
            self._append(table, self._rows(table, new))

    def read_slice(self, table: str, first: int = 0, last: int | None = None, ids="all") -> DataFrame:
        """(id, cell): rows first .. last - 1 of the first axis of chunked arrays; chunks outside are not read."""
        stored = self.read(table)
        kept = stored if isinstance(ids, str) else stored.where(F.col("id").isin([ids] if isinstance(ids, int) else list(ids)))
        return chunks.assembled(chunks.sliced(kept, "id", first, last), "id")

    def load_slice(self, table: str, first: int = 0, last: int | None = None, ids="all") -> dict[int, np.ndarray]:
        return {r.id: arrays.decode(r.cell.data, r.cell.dtype, r.cell.shape) for r in self.read_slice(table, first, last, ids).toLocalIterator()}

    def verify_array_hash(self, table: str, column: str, row_id: int) -> bool:
        key = self.get_primary_key(table) or "id"
        row = arrays.verify(rows.get_rows(self.read(table), ids=row_id, id_column=key), column).first()
        return bool(row and row[f"{column}_ok"])

    def save_blob(self, table: str, data, key: str, compress: bool | None = None, compress_level: int = 6, metadata: dict | None = None, pickled: bool = False) -> None:
        """Keep an object under a key, in the place of what was there."""
        row = objects.encode(data, self.compress_by_default if compress is None else compress, compress_level, metadata, pickled)
        self.create_table(table, OBJECTS)
        self.replace_many(table, [{"key": key} | row])

    def save_objects(self, table: str, found: DataFrame, compress: bool | None = None, compress_level: int = 6) -> None:
        """Keep many objects, (key, json) or (key, json, metadata) as texts, in the place of those of the same keys; tasks encode them."""
        self.create_table(table, OBJECTS)
        with self._change():
            self._replace_rows(table, objects.encoded(found, self.compress_by_default if compress is None else compress, compress_level))

    def read_objects(self, table: str, keys: Sequence[str] | None = None, ids: Sequence[int] | None = None, where: str | None = None) -> DataFrame:
        """(key, data_type, value, metadata) of all objects, or those of some keys or row numbers, lazy: value and metadata are VARIANTs whose
        paths Spark queries; the value of an array or a pickle is null."""
        stored = self._stored(table)
        if keys is not None:
            stored = stored.where(F.col("key").isin(list(keys)))
        if ids is not None:
            stored = stored.where(F.col(ROWID).isin([int(i) for i in ids]))
        condition = self._where(stored, where)
        return objects.decoded(stored if condition is None else stored.where(condition))

    def load_blob(self, table: str, key: str | None = None, where: str | None = None, pickled: bool = False, ids: int | Sequence[int] | None = None):
        """The object of a key; without one, all objects that the caller asks for, by row numbers or a predicate, as a dict."""
        found = self._stored(table) if key is None else self._stored(table).where(F.col("key") == key)
        if key is None:
            condition = self._where(found, where)
            found = found if condition is None else found.where(condition)
            found = found if ids is None else found.where(F.col(ROWID).isin([ids] if isinstance(ids, int) else [int(i) for i in ids]))
        made = {r["key"]: objects.decode(r.asDict(), pickled) for r in found.toLocalIterator()}
        if key is None:
            return made
        if key not in made:
            raise KeyError(key)
        return made[key]

    # Files

    def load_from_csv(self, table: str, path: str, if_exists: str = "append", null: str = "") -> None:
        """Rows of a CSV file or folder; columns that the table lacks are dropped, and what reads `null` is null. "replace" makes the table anew."""
        with self._change():
            if if_exists == "replace":
                df = read_csv(self.spark, path, null=null)
                self._manifest["tables"].pop(table, None)
                self.create_table(table, {f.name: declared_type(f.dataType) for f in df.schema})
                self._append(table, dml.conform(df, self.read(table)))
            elif if_exists == "append":
                self._append(table, self._rows(table, read_csv(self.spark, path, self.read(table), null=null)))
            else:
                raise ValueError("if_exists must be append or replace")

    def save_to_csv(self, table: str, path: str, columns=None, where=None, single: bool = False, null: str = NULL) -> None:
        """A folder of CSV files, or a single one that tasks write in parts; nulls are written as `null`, which load_from_csv takes too.

        Columns may be expressions of Spark SQL.
        """
        kept = self._filtered(table, where)
        asked = None if columns in (None, "*", ["*"]) else [columns] if isinstance(columns, str) else list(columns)
        found = kept if asked is None else kept.select(*[F.col(f"`{c}`") if c in kept.columns else F.expr(c) for c in asked])
        write_single_csv(found, path, f"{self.root}/tables/.csv-{uuid.uuid4().hex}", null) if single else write_csv(found, path, null)

    def dataframe_to_sql(self, df: pd.DataFrame, table: str, if_exists: str = "fail") -> None:
        if if_exists not in ("fail", "replace", "append"):
            raise ValueError("if_exists must be fail, replace or append")
        if if_exists == "fail" and self.table_exists(table):
            raise ValueError(f"table {table} is there already")
        with self._change():
            if if_exists == "replace":
                self.drop_table(table)
            self.create_table(table, {c: pandas_declaration(t) for c, t in df.dtypes.items()})
            self.insert_many(table, df)

    # Upkeep

    def get_summaries(self, table_names: Sequence[str] | None = None, limit: int = 5) -> dict[str, pd.DataFrame]:
        return {t: self.read(t).limit(limit).toPandas() for t in table_names or self.get_table_names()}

    summary = __call__ = get_summaries

    def analyze(self, table: str | None = None) -> int:
        """Make the statistics of the table's, or all tables', files that have none yet; the number of files read. Old files are not read again."""
        done = 0
        with self._change():
            known = self._manifest.setdefault("stats", {})
            for name in [table] if table else self.get_table_names():
                meta = self._meta(name)
                schema = T.StructType.fromJson(meta["schema"])
                for file in [f for f in meta["files"] if f not in known]:
                    known[file] = self._write(name, statistics.sketches(self.spark.read.schema(schema).parquet(file).drop(ROWID)).coalesce(1))
                    done += 1
        return done

    def get_column_stats(self, table: str) -> DataFrame:
        """Exact counts and bounds, and estimates of distinct values, quartiles and frequent values of each column (`statistics.estimates`); of files
        that `analyze` has not seen, it is called first."""
        if {*self._meta(table)["files"]} - {*self._manifest.get("stats", {})}:
            self.analyze(table)
        files = [self._manifest["stats"][f] for f in self._meta(table)["files"]]
        if not files:
            raise ValueError(f"{table} has no rows")
        return statistics.estimates(statistics.merged(self.spark.read.parquet(*files)))

    def _files_in_use(self) -> set[str]:
        """All folders of the tables, the commits, and their statistics."""
        used = {f for m in self._manifest["tables"].values() for f in m["files"]} | self._files_of_commits()
        return used | {at for f, at in self._manifest.get("stats", {}).items() if f in used}

    def optimize(self, analyze: bool = False) -> None:
        """Write each table in few files, sorted by its first plain index within them, and drop files out of use; then make statistics, if asked."""
        with self._change():
            for name, meta in self._manifest["tables"].items():
                if meta["files"]:
                    order = next(iter(meta["indexes"].values()), [ROWID])
                    self._replace(name, self._stored(name).repartitionByRange(*order).sortWithinPartitions(*order), check=False)
        if analyze:
            self.analyze()
        if not self._depth:
            self.vacuum()

    def vacuum(self, into: str | Path | None = None) -> int:
        """Delete snapshots that neither the manifest nor a commit names; their number. It waits for open transactions to end.

        With `into` nothing is deleted: what is in use is copied into that folder.
        """
        if self._depth:
            raise ValueError("vacuum within a transaction")
        if into is not None:
            self.backup(into)
            return 0
        with self.maintenance_lock(), self._held(".use"):
            self._load()
            used = self._files_in_use()
            stale = [p for p in (self.root / "tables").glob("*/*") if str(p) not in used]
            for p in stale:
                shutil.rmtree(p)
            return len(stale)

    def backup(self, path: str | Path, progress=None) -> None:
        """Copy the store's snapshots and its manifest into another folder, where they make a store."""
        with self.maintenance_lock():
            files = sorted(self._files_in_use())
            for n, f in enumerate(files, 1):
                shutil.copytree(f, Path(path) / Path(f).relative_to(self.root), dirs_exist_ok=True)
                if progress:
                    progress(n, len(files))
            Path(path).mkdir(parents=True, exist_ok=True)
            text = json.dumps(self._manifest).replace(json.dumps(str(self.root))[1:-1] + "/", json.dumps(str(path))[1:-1] + "/")
            (Path(path) / "manifest.json").write_text(text)

    def working_copy(self, path: str | Path) -> Store:
        """A store of its own, of the same contents, in another folder."""
        self.backup(path)
        return Store(self.spark, path, "rw", self.compress_by_default)

    def check_health(self) -> dict:
        """Loadability of every table, empty ones, orphans, files' numbers and sizes, what upkeep would help, and the score."""
        from .health import status

        issues, tables, orphans = [], {}, None
        for name in self.get_table_names():
            try:
                tables[name] = self.get_row_count(name)
            except Exception as e:  # whatever a damaged file raises
                issues.append(f"{name} can't be read: {type(e).__name__}")
                continue
            if not tables[name]:
                issues.append(f"{name} is empty")
            for fk in self._meta(name)["foreign_keys"]:
                lost = constraints.foreign_key_violations(self.read(name), fk["column"], self.read(fk["table"]), fk["to"]).count()
                if lost:
                    issues.append(f"{name}.{fk['column']}: {lost} rows without a row of {fk['table']}")
        points = max(0, 100 - 20 * len(issues))
        loadable = {kind: probe() for kind, probe in (("rows", self.is_rows_loadable), ("arrays", self.is_arrays_loadable), ("blobs", self.is_blobs_loadable))}
        stats = {name: self._sizes(name) for name in tables}
        return {"tables": tables, "issues": issues, "stats": stats, "recommendations": self.recommendations(), "loadability": loadable, "health_score": points, "status": status(points), "checked_at": time.time()}

    def inspect(self, table_names: Sequence[str] | None = None, sample_size: int = 5, skip_count: bool = False) -> list[dict]:
        """Columns, bounded row count and a sample of each table."""
        found = []
        for name in sorted(table_names or self.get_table_names()):
            df = self.read(name)
            n, approximate = ("Not counted", None) if skip_count else rows.bounded_count(df).first()
            sample = [r.asDict() for r in rows.blob_placeholders(df).limit(sample_size).collect()]
            found.append({"table_name": name, "columns": self.get_column_info(name), "row_count": ">100,000" if approximate else n, "is_approximate": approximate, "sample_data": sample})
        return found


def delete_sqlite3_duplicates(spark: SparkSession, path: str | Path, table: str, columns="all", include_blob: bool = False, dry_run: bool = True) -> tuple[int | None, int | None]:
    """Store.delete_duplicates of the store at a path; (None, None) of what can't be opened or has no such table."""
    try:
        with Store(spark, path, "ro" if dry_run else "rw") as db:
            return db.delete_duplicates(table, columns, include_blob, dry_run)
    except (OSError, ValueError):
        return None, None
