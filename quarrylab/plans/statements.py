"""SQL statements that change a store: Spark's parser reads them, and each kind of node is a change of the store's own.

Nothing of Spark's tables is asked for: the parsed source of an INSERT, the assignments of an UPDATE and the predicates are used as
DataFrames and Columns over the store's snapshots. What a user's statement has that Spark's grammar lacks is little, and marked here:
the conflict clause of INSERT OR REPLACE, UNIQUE before INDEX, and type names.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from contextlib import contextmanager
from typing import TYPE_CHECKING

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dml
from ..types import IntegrityError, declared_type
from .catalyst import Catalyst, plain
from .dialect import ROWID, Dialect

if TYPE_CHECKING:
    from .store import Store

_CONFLICT = re.compile(r"\s*(?:INSERT\s+OR\s+(REPLACE|IGNORE|ABORT|FAIL|ROLLBACK)\s+INTO\b|(REPLACE)\s+INTO\b)", re.I)
_UNIQUE_INDEX = re.compile(r"\s*CREATE\s+UNIQUE\s+INDEX\b", re.I)
_TRANSACTION = re.compile(r"\s*(BEGIN|COMMIT|END|ROLLBACK)(?:\s+(?:DEFERRED|IMMEDIATE|EXCLUSIVE))?(?:\s+TRANSACTION)?\s*;?\s*", re.I)
_FOREIGN_KEYS = re.compile(r"\s*PRAGMA\s+foreign_keys\s*=\s*(ON|OFF|1|0|TRUE|FALSE)\s*;?\s*", re.I)
_TABLE_INFO = re.compile(r"\s*PRAGMA\s+table_info\s*\(\s*[\"'`]?(\w+)[\"'`]?\s*\)\s*;?\s*", re.I)
#: Type names that Spark's parser doesn't know, by one of the same kind that it does.
_TYPE_NAMES = {"TEXT": "STRING", "CLOB": "STRING", "NVARCHAR": "STRING", "BLOB": "BINARY", "BYTEA": "BINARY", "DATETIME": "TIMESTAMP", "SERIAL": "BIGINT", "BIGSERIAL": "BIGINT", "BOOL": "BOOLEAN"}
_SET_ASIDE = "_u_"
#: A task that writes a table sorted by row number gets about so many rows or bytes of its files, whichever are fewer.
TASK_ROWS, TASK_BYTES = 250_000, 16 << 20


@contextmanager
def _quiet():
    """Without the log entry of a statement that the parser refuses: the caller is told, or it is tried again."""
    logger = logging.getLogger("SQLQueryContextLogger")
    before, logger.disabled = logger.disabled, True
    try:
        yield
    finally:
        logger.disabled = before


class Statements:
    """Statements over one store."""

    def __init__(self, store: Store):
        self.store = store
        self.catalyst = Catalyst(store.spark)
        self.dialect = Dialect(self.catalyst)

    def run(self, text: str, parameters: Sequence | dict = ()) -> DataFrame | int | None:
        """A query's rows, lazy; the number of rows that a change has changed; None of what changes no rows."""
        if m := _TRANSACTION.fullmatch(text):
            getattr(self.store, {"BEGIN": "begin", "ROLLBACK": "rollback"}.get(m[1].upper(), "commit"))()
            return None
        if m := _FOREIGN_KEYS.fullmatch(text):
            self.store.enforce_foreign_keys = m[1].upper() in ("ON", "1", "TRUE")
            return None
        if m := _TABLE_INFO.fullmatch(text):
            return self.store.spark.createDataFrame(self.store.get_table_schema(m[1]))
        plan, conflict, unique = self._parsed(text)
        done = getattr(self, f"_{self.catalyst.name(plan)}", None)
        if done is None:
            return self.query(self._bound(plan, parameters))
        if not self.store.writable:
            raise ValueError("the store is not writable")
        with self.store.transaction():
            if conflict:
                return self._insert(self._bound(plan, parameters), conflict)
            return self._CreateIndex(plan, unique) if unique else done(self._bound(plan, parameters))

    def run_many(self, text: str, rows: Sequence[Sequence | dict]) -> int:
        """A change for each row of parameters (by place, or dicts by name), all or none. Rows of an INSERT are one append; an UPDATE or DELETE is one join
        of the table with the rows, the last row winning, or goes row by row where it reads what it sets."""
        if not (rows := list(rows)):
            return 0
        plan, conflict, _ = self._parsed(text)
        kind, c = self.catalyst.name(plan), self.catalyst
        own = rows
        if isinstance(rows[0], dict):
            asked = sorted({n.name() for n in c.walk(plan) if c.name(n) == "NamedParameter"})
            if missing := [k for k in asked for r in rows if k not in r]:
                raise ValueError(f"no value for :{missing[0]}")
            rows = [tuple(r[k] for k in asked) for r in rows]
        else:
            asked, rows = list(c.parameters(plan)), [tuple(r) for r in rows]
        if any(len(r) != len(asked) for r in rows):
            raise ValueError(f"{len(asked)} parameters are asked for")
        if kind not in ("InsertIntoStatement", "UpdateTable", "DeleteFromTable"):
            raise ValueError("executemany takes INSERT, UPDATE and DELETE")
        if not self.store.writable:
            raise ValueError("the store is not writable")
        names = [f"{_SET_ASIDE}{i}" for i in range(len(asked))]
        given = self.store.spark.createDataFrame([(*map(plain, r), i) for i, r in enumerate(rows)], self._schema(rows, names)).coalesce(1)
        columns = c.bind(plan, {k: F.col(n) for k, n in zip(asked, names)} if isinstance(own[0], dict) else [F.col(n) for n in names])
        with self.store.transaction():
            if kind == "InsertIntoStatement":
                source = columns.query()
                if c.name(source) != "UnresolvedInlineTable":
                    raise ValueError("executemany takes INSERT with VALUES")
                values = [self.dialect.column(given, e) for e in c.items(c.items(source.rows())[0])]
                return self._insert(columns, conflict, given.orderBy("_at").select(*[v.alias(f"_v{i}") for i, v in enumerate(values)]))
            table, assigned = self._target(columns), {}
            if kind == "UpdateTable":
                assigned = {c.items(a.key().nameParts())[-1]: a.value() for a in c.items(columns.assignments())}
                read = {parts[-1] for e in (*assigned.values(), *([columns.condition().get()] if columns.condition().isDefined() else [])) for parts in c.attributes(e)}
                if read & {*assigned}:
                    return sum(self.run(text, r) for r in own)
            where = columns.condition().get() if kind == "UpdateTable" and columns.condition().isDefined() else columns.condition() if kind == "DeleteFromTable" else None
            stored = self.store._stored(table)
            matched = self._matched(stored, given, where)
            if kind == "DeleteFromTable":
                return self._without(table, stored, matched.select(ROWID))
            both = stored.crossJoin(given.limit(0))  # names and types alone: an empty side
            values = {k: self.dialect.column(both, v) for k, v in assigned.items()}
            self.store._known(table, values)
            last = matched.groupBy(ROWID).agg(F.max("_at").alias("_at")).join(dml.sized(given), "_at")
            of_values = {parts[-1] for e in assigned.values() for parts in c.attributes(e)}
            if needed := [x for x in stored.columns if x != ROWID and x in of_values]:
                last = last.join(stored.select(ROWID, *needed).hint("merge"), ROWID)  # of which Spark knows the compressed size alone
            found = last.select(F.col(ROWID).alias("_row"), *[v.alias(f"_new_{k}") for k, v in values.items()])
            return self._set(table, stored, found, list(values))

    def _schema(self, rows: Sequence[tuple], names: list[str]):
        """The type of each parameter by its first value that isn't null; whole numbers beside others are doubles."""
        def kind(values: list) -> str:
            kinds = {"boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "binary" if isinstance(v, bytes) else "string" for v in map(plain, values) if v is not None}
            return "double" if kinds == {"long", "double"} else kinds.pop() if len(kinds) == 1 else "string"

        return ", ".join([*[f"{n} {kind([r[i] for r in rows])}" for i, n in enumerate(names)], "_at long"])

    def _matched(self, stored: DataFrame, given: DataFrame, where: JavaObject | None) -> DataFrame:
        """(row number, _at): the rows of the table that each row of parameters changes."""
        if where is None:
            return stored.select(ROWID).join(F.broadcast(given.orderBy(F.desc("_at")).limit(1).select("_at")))  # one row: the last
        return dml.matches(stored, given, self._conjuncts(stored, given, where), ROWID, "_at")

    def _conjuncts(self, stored: DataFrame, given: DataFrame, where: JavaObject) -> list[dml.Term]:
        """The predicate's parts: what is equal, above or below between a column of the table and a parameter's, and the rest."""
        c, terms = self.catalyst, []
        scope = stored.crossJoin(given.limit(0))
        of_given = lambda e: {parts[-1].startswith(_SET_ASIDE) for parts in c.attributes(e)}
        turned = {"EqualTo": "EqualTo", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual", "GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual"}
        for part in c.conjuncts(where):
            kind = c.name(part)
            if kind in turned:
                sides = of_given(part.left()), of_given(part.right())
                a, b = (self.dialect.column(scope, e) for e in (part.left(), part.right()))
                if sides == ({False}, {True}):
                    terms.append(dml.Term(kind, a, b))
                    continue
                if sides == ({True}, {False}):
                    terms.append(dml.Term(turned[kind], b, a))
                    continue
            terms.append(dml.Term("", self.dialect.column(scope, part), None))
        return terms

    # Reading

    def query(self, plan: JavaObject) -> DataFrame:
        """A query whose relations of the store's names are the store's tables. Nothing is registered in the session."""
        c = self.catalyst
        mine = {t.lower(): t for t in self.store.get_table_names()}
        named = [n for n in c.walk(plan) if c.name(n) == "UnresolvedRelation"]
        used = {mine[k] for n in named if (k := c.items(n.multipartIdentifier())[-1].lower()) in mine}
        columns = [x.lower() for t in used for x in self.store.read(t).columns]
        numbered = self.dialect.mentions_rowid(plan, columns)
        local = {p.productElement(0).lower() for n in c.walk(plan) if c.name(n) == "UnresolvedWith" for p in c.items(n.cteRelations())}

        def change(n: JavaObject) -> JavaObject:
            if c.name(n) != "UnresolvedRelation":
                return n
            key = c.items(n.multipartIdentifier())[-1].lower()
            if key not in mine or key in local:
                return n
            return c.relation(key, self.store._stored(mine[key]) if numbered else self.store.read(mine[key]))

        found = self.dialect.frame(c.rewrite(plan, change), columns)
        return found.drop(ROWID)

    def _bound(self, plan: JavaObject, parameters: Sequence | dict) -> JavaObject:
        return self.catalyst.bind(plan, parameters)

    def _parsed(self, text: str) -> tuple[JavaObject, str, bool]:
        """(plan, conflict clause, whether an index is unique) of a statement."""
        conflict, unique = "", False
        if m := _CONFLICT.match(text):
            conflict, text = (m[1] or m[2]).upper(), "INSERT INTO" + text[m.end() :]
        if m := _UNIQUE_INDEX.match(text):
            unique, text = True, "CREATE INDEX" + text[m.end() :]
        text = re.sub(r"\bAUTOINCREMENT\b", "", text, flags=re.I) if re.match(r"\s*CREATE\s+TABLE\b", text, re.I) else text
        while True:
            try:
                with _quiet():
                    return self.catalyst.parse(text), conflict, unique
            except ParseException as e:
                # The parser says where a type's name is that it doesn't know.
                at = (e.getQueryContext() or [None])[0] if e.getCondition() == "UNSUPPORTED_DATATYPE" else None
                known = at and _TYPE_NAMES.get(text[at.startIndex() : at.stopIndex() + 1].upper().split("(")[0])
                if not known:
                    raise ValueError(str(e).split("\n\n")[0]) from e
                text = text[: at.startIndex()] + known + text[at.stopIndex() + 1 :]

    def _name(self, plan: JavaObject) -> str:
        """The table that a plan names."""
        c = self.catalyst
        for n in c.walk(plan):
            if c.name(n) in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedTableOrView"):
                return c.items(n.multipartIdentifier())[-1]
            if c.name(n) == "UnresolvedIdentifier":
                return c.items(n.nameParts())[-1]
        raise ValueError("no table is named")

    def _target(self, plan: JavaObject) -> str:
        name = self._name(plan.table())
        self.store._meta(name)
        return name

    def _scope(self, target: JavaObject, table: str) -> DataFrame:
        """The table with its row numbers under the name that the statement gives it."""
        c = self.catalyst
        return self.store._stored(table).alias(target.alias() if c.name(target) == "SubqueryAlias" else table)

    def _inner(self, expression: JavaObject) -> JavaObject:
        """An expression whose subqueries read the store's tables."""
        c, names = self.catalyst, {t.lower(): t for t in self.store.get_table_names()}

        def change(n: JavaObject) -> JavaObject:
            if c.name(n) == "UnresolvedRelation" and (key := c.items(n.multipartIdentifier())[-1].lower()) in names:
                return c.relation(key, self.store.read(names[key]))
            return n

        return c.rewrite(expression, change)

    # Changing rows

    def _InsertIntoStatement(self, plan: JavaObject) -> int:
        return self._insert(plan)

    def _insert(self, plan: JavaObject, conflict: str = "", source: DataFrame | None = None) -> int:
        c, table = self.catalyst, self._target(plan)
        new = self.query(plan.query()) if source is None else source
        columns = c.items(plan.userSpecifiedCols()) or self.store.read(table).columns
        if len(columns) != len(new.columns):
            raise ValueError(f"{len(columns)} columns and {len(new.columns)} values")
        new = new.toDF(*columns)
        self.store._known(table, columns)
        if source is None and c.name(plan.query()) == "UnresolvedInlineTable":
            new = new.coalesce(1)  # numbered as they are listed
        new = self.store._typed(table, new)
        if conflict == "REPLACE":
            return self.store._replace_rows(table, new)
        if conflict == "IGNORE":
            new = self.store._without_conflicts(table, new)
        return self.store._append(table, self.store._rows(table, new))

    def _UpdateTable(self, plan: JavaObject) -> int:
        c, table = self.catalyst, self._target(plan)
        stored = self._scope(plan.table(), table)
        values = {c.items(a.key().nameParts())[-1]: self.dialect.column(stored, self._inner(a.value())) for a in c.items(plan.assignments())}
        self.store._known(table, values)
        hit = stored.where(self.dialect.column(stored, self._inner(plan.condition().get()))) if plan.condition().isDefined() else stored
        found = hit.select(F.col(ROWID).alias("_row"), *[v.alias(f"_new_{k}") for k, v in values.items()])
        return self._set(table, stored, found, list(values))

    def _set(self, table: str, stored: DataFrame, found: DataFrame, columns: list[str]) -> int:
        """Put the new values of found (_row, _new_<column> of each) in the place of the old ones."""
        kinds = {f.name: f.dataType for f in stored.schema}
        found = self.store._put(table, found.select("_row", *[F.col(f"_new_{k}").cast(kinds[k]).alias(f"_new_{k}") for k in columns]).withColumn("_hit", F.lit(True)))
        joined = self._by_number(table, stored, found)
        changed = joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{x}")).otherwise(F.col(f"`{x}`")).alias(x) if x in columns else F.col(f"`{x}`") for x in stored.columns])
        self.store._replace(table, changed, touched=columns)
        return found.count()

    def _by_number(self, table: str, stored: DataFrame, rows: DataFrame) -> DataFrame:
        """The table's rows beside those of rows that have their number (_row, each once), or nulls. Unless these are few, whole rows of the table are
        sorted, in parts that a task of little memory holds; a task writes several of them, one after the other."""
        on = F.col(ROWID) == F.col("_row")
        if dml.few(rows):
            return stored.join(F.broadcast(rows), on, "left")
        spark = self.store.spark
        tasks = max(spark.sparkContext.defaultParallelism, -(-self.store._meta(table)["next_rowid"] // TASK_ROWS), -(-self.store._sizes(table)["total_size"] // TASK_BYTES))
        # With fewer parts than its own number of them, Spark would deal both sides out again.
        parts = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return stored.repartition(parts, ROWID).join(rows.hint("merge"), on, "left").coalesce(tasks)

    def _DeleteFromTable(self, plan: JavaObject) -> int:
        table = self._target(plan)
        stored = self._scope(plan.table(), table)
        return self._without(table, stored, stored.where(self.dialect.column(stored, self._inner(plan.condition()))).select(ROWID))

    def _without(self, table: str, stored: DataFrame, rows: DataFrame) -> int:
        gone = self.store._put(table, rows.select(F.col(ROWID).alias("_row")).distinct())
        self.store._replace(table, self._by_number(table, stored, gone).where(F.col("_row").isNull()).select(*[f"`{x}`" for x in stored.columns]), touched=())
        return gone.count()

    def _MergeIntoTable(self, plan: JavaObject) -> int:
        """The first clause that holds decides about a row; a row of the table that several source rows match is an error."""
        c = self.catalyst
        table = self._name(plan.targetTable())
        self.store._meta(table)
        stored = self._scope(plan.targetTable(), table)
        name = plan.sourceTable().alias() if c.name(plan.sourceTable()) == "SubqueryAlias" else self._name(plan.sourceTable())
        source = self.store._put(table, self.query(plan.sourceTable()).withColumn("_source", F.monotonically_increasing_id())).alias(name)
        both = stored.join(source, self.dialect.column(stored.crossJoin(source.limit(0)), plan.mergeCondition()))
        if not both.groupBy(ROWID).count().where("count > 1").isEmpty():
            raise IntegrityError(f"{table}: several rows of the source match one row")
        column = lambda df, e: self.dialect.column(df, self._inner(e))
        columns = self.store.read(table).columns
        kinds = {f.name: f.dataType for f in stored.schema}
        old = {x: F.col(f"{self._alias(plan.targetTable(), table)}.`{x}`") for x in stored.columns}
        action, values = F.lit("keep"), {x: old[x] for x in columns}
        for clause in reversed(c.items(plan.matchedActions())):
            holds = F.coalesce(column(both, clause.condition().get()), F.lit(False)) if clause.condition().isDefined() else F.lit(True)
            kind = c.name(clause)
            sets = {c.items(a.key().nameParts())[-1]: column(both, a.value()) for a in c.items(clause.assignments())} if kind == "UpdateAction" else {}
            if kind == "UpdateStarAction":
                sets = {x: F.col(f"{name}.`{x}`") for x in columns}
            self.store._known(table, sets)
            action = F.when(holds, F.lit("delete" if kind == "DeleteAction" else "update")).otherwise(action)
            values = {x: F.when(holds, sets.get(x, old[x]).cast(kinds[x])).otherwise(values[x]) for x in columns}
        done = self.store._put(table, both.select(old[ROWID].alias("_row"), F.col("_source").alias("_matched"), action.alias("_action"), *[values[x].alias(f"_new_{x}") for x in columns]))
        joined = stored.join(done, old[ROWID] == F.col("_row"), "left").where("_action is null or _action <> 'delete'")
        changed = joined.select(*[F.when(F.col("_action") == "update", F.col(f"_new_{x}")).otherwise(old[x]).alias(x) for x in columns], old[ROWID].alias(ROWID))
        self.store._replace(table, changed)
        n, left = done.where("_action <> 'keep'").count(), source.join(done, F.col("_source") == F.col("_matched"), "left_anti")
        for clause in c.items(plan.notMatchedActions()):
            holds = F.coalesce(column(left, clause.condition().get()), F.lit(False)) if clause.condition().isDefined() else F.lit(True)
            sets = {x: F.col(f"{name}.`{x}`") for x in columns} if c.name(clause) == "InsertStarAction" else {c.items(a.key().nameParts())[-1]: column(left, a.value()) for a in c.items(clause.assignments())}
            new = left.where(holds).select(*[v.alias(x) for x, v in sets.items()])
            n += self.store._append(table, self.store._rows(table, self.store._typed(table, new)))
            left = left.where(~holds)
        return n

    def _alias(self, target: JavaObject, table: str) -> str:
        return target.alias() if self.catalyst.name(target) == "SubqueryAlias" else table

    def _TruncateTable(self, plan: JavaObject) -> None:
        self.store.truncate_table(self._name(plan))

    # Tables and columns

    def _declared(self, column: JavaObject) -> str:
        """A column of a CREATE or ALTER statement as the store's own declarations have it."""
        name = declared_type(T_of(column.dataType()))
        default = column.defaultValue() if hasattr(column, "defaultValue") else None
        text = f"{name}{'' if column.nullable() else ' NOT NULL'}"
        return text + (f" DEFAULT {default.get().originalSQL()}" if default is not None and default.isDefined() else "")

    def _CreateTable(self, plan: JavaObject) -> None:
        c = self.catalyst
        table, columns = self._name(plan), {x.name(): self._declared(x) for x in c.items(plan.columns())}
        keys, unique, links = [], [], []
        for rule in c.items(plan.tableSpec().constraints()):
            kind = c.name(rule)
            if kind == "PrimaryKeyConstraint":
                keys = c.items(rule.columns())
            elif kind == "UniqueConstraint":
                unique.append(c.items(rule.columns()))
            elif kind == "ForeignKeyConstraint":
                own, other = c.items(rule.childColumns()), c.items(rule.parentColumns())
                if len(own) != 1 or len(other) != 1:
                    raise ValueError("a foreign key has one column")
                links.append({"tgt_column": own[0], "src_table": c.items(rule.parentTableId())[-1], "src_column": other[0]})
            else:
                raise ValueError("CHECK is no constraint of the store")
        for key in keys:
            columns[key] = columns[key].replace(" NOT NULL", "") + " PRIMARY KEY"
        for names in unique:
            if len(names) == 1:
                columns[names[0]] += " UNIQUE"
        self.store.create_table(table, columns, links, if_not_exists=plan.ignoreIfExists())
        for names in unique:
            if len(names) > 1:
                self.store.create_index(table, names, unique=True)

    def _CreateTableAsSelect(self, plan: JavaObject) -> int:
        table, df = self._name(plan.name()), self.query(plan.query())
        if self.store.table_exists(table) and plan.ignoreIfExists():
            return 0
        self.store.create_table(table, {f.name: declared_type(f.dataType) for f in df.schema}, if_not_exists=False, companions=False)
        return self.store._append(table, self.store._rows(table, self.store._typed(table, df)))

    def _DropTable(self, plan: JavaObject) -> None:
        self.store.drop_table(self._name(plan), if_exists=plan.ifExists())

    def _RenameTable(self, plan: JavaObject) -> None:
        self.store.rename_table(self._name(plan), self.catalyst.items(plan.newName())[-1])

    def _AddColumns(self, plan: JavaObject) -> None:
        for column in self.catalyst.items(plan.columnsToAdd()):
            default = column.default() if hasattr(column, "default") else None
            text = declared_type(T_of(column.dataType())) + ("" if column.nullable() else " NOT NULL") + (f" DEFAULT {default.get().originalSQL()}" if default is not None and default.isDefined() else "")
            if not self.store.add_column(self._name(plan), column.colName(), text):
                raise ValueError(f"{column.colName()} can't be added")

    def _field(self, column: JavaObject) -> str:
        return self.catalyst.items(column.name())[-1]

    def _DropColumns(self, plan: JavaObject) -> None:
        names = [self._field(x) for x in self.catalyst.items(plan.columnsToDrop())]
        if not self.store.drop_columns(self._name(plan), names, plan.ifExists()):
            raise ValueError(f"no such columns: {', '.join(names)}")

    def _RenameColumn(self, plan: JavaObject) -> None:
        if not self.store.rename_column(self._name(plan), self._field(plan.column()), plan.newName()):
            raise ValueError(f"{self._field(plan.column())} can't be renamed")

    def _CreateIndex(self, plan: JavaObject, unique: bool = False) -> None:
        names = [self._field(x.productElement(0)) for x in self.catalyst.items(plan.columns())]
        table = self._name(plan)
        if not (plan.ignoreIfExists() and plan.indexName() in [i["name"] for i in self.store.get_indexes(table)]):
            self.store.create_index(table, names, plan.indexName(), unique)


def T_of(kind: JavaObject):
    """Spark's type in Python of one in Java."""
    import json

    from pyspark.sql.types import _parse_datatype_json_value

    return _parse_datatype_json_value(json.loads(kind.json()))
