"""Statements on a store against the same ones on SQLite, predicates in its dialect, and changes for many rows by joins."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarrylab.operators import dml
from quarrylab.plans.store import Store
from quarrylab.types import IntegrityError

CREATE = "CREATE TABLE items (id INTEGER PRIMARY KEY, name TEXT, n INTEGER, x REAL)"
ROWS = [(1, "apple", 7, 2.5), (2, "APPLE", 3, 0.0), (3, "éclair", 0, 1.0), (4, "Éclair", 9, None), (5, "a%b", -7, -1.5), (9, None, 2, 2.0), (12, "12abc", None, 3.5), (13, "5", 5, 1e300)]


@pytest.fixture
def both(spark, tmp_path):
    lite = sqlite3.connect(":memory:")
    store = Store(spark, tmp_path / "store")
    for db in (lite, store):
        db.execute(CREATE)
        db.executemany("INSERT INTO items (id, name, n, x) VALUES (?, ?, ?, ?)", ROWS)
    return store, lite


def same(store, lite, table="items"):
    assert sorted((tuple(r) for r in store.read(table).collect()), key=str) == sorted(lite.execute(f"SELECT * FROM {table}").fetchall(), key=str)


@pytest.mark.parametrize(
    "where",
    ["name LIKE 'APP%'", "name LIKE 'é%'", r"name LIKE 'a\%b'", "name LIKE 'a!%b' ESCAPE '!'", "name NOT LIKE '%A%'", "n / 2 = 3", "n / 2 / 2 = 1", "n / 2 = 4.5", "7 / n = 2", "n % 0 IS NULL", "id / 0 IS NULL", "x / 0 IS NULL",
     "CAST(name AS INTEGER) = 12", "CAST(name AS INTEGER) = 0", "CAST(name AS REAL) > 4", "CAST(x AS INTEGER) = 2", "name = 5", "n < 'abc'", "n > 'abc'", "n = '7'", "n >= '3'", "name > 3", "(n + 1) / 2 * 2 = 4", "-7 / 2 = -3", "n % 4 = -3",
     "x > 1.1", "1.0 / 3 = 0.3333333333333333", "n / 2.0 = 4.5", "n BETWEEN 3 AND 7", "n IN (7, 3)", "id IN (SELECT max(id) FROM items)", "EXISTS (SELECT 1 FROM items WHERE n / 2 = 3)", "name IS NULL OR n IS NULL", "rowid > 4"],
)
def test_dialect(both, where):
    store, lite = both
    want = sorted(lite.execute(f"SELECT id FROM items WHERE {where.replace('rowid > 4', 'id > 4')}").fetchall())
    if where.startswith("rowid"):
        want = [(5,), (9,), (12,), (13,)]  # the fifth row and those after it
    assert sorted((r.id,) for r in store.execute(f"SELECT id FROM items WHERE {where}").collect()) == want
    if "SELECT" not in where:
        assert sorted((r.id,) for r in store.get_rows("items", where=where).collect()) == want
        assert store.get_row_count("items", where) == len(want)


def test_changes_as_sqlite_makes_them(both):
    store, lite = both
    for text, parameters in [
        ("INSERT INTO items (name, x) VALUES (?, ?)", ("test_item", 42.0)),
        ("INSERT INTO items (id, name) VALUES (NULL, 'a'), (40, 'b'), (NULL, 'c')", ()),
        ("INSERT INTO items (name) VALUES ('d')", ()),
        ("UPDATE items SET x = ? WHERE name = ?", (99.0, "test_item")),
        ("UPDATE items SET n = id / 2, x = x + n WHERE id IN (SELECT max(id) FROM items) OR name LIKE 'A%'", ()),
        ("UPDATE items SET n = n + (SELECT count(*) FROM items) WHERE n > 5", ()),
        ("INSERT OR REPLACE INTO items (id, name) VALUES (1, 'new'), (50, 'x'), (50, 'y')", ()),
        ("INSERT OR IGNORE INTO items (id, name) VALUES (1, 'old'), (60, 'z'), (60, 'zz')", ()),
        ("REPLACE INTO items VALUES (2, 'r', 1, 1.5)", ()),
        ("INSERT INTO items (name, n) SELECT upper(name), n FROM items WHERE n / 2 > 1", ()),
        ("DELETE FROM items WHERE name = ?", ("c",)),
        ("DELETE FROM items WHERE id NOT IN (SELECT min(id) FROM items GROUP BY name)", ()),
    ]:
        got = store.execute(text, parameters)
        n = lite.execute(text, parameters).rowcount
        assert got == n or "OR REPLACE" in text and got == n - 1, text  # here the rows that stay are counted
        same(store, lite)
    assert store.execute_query("SELECT count(*) AS n FROM items") == [{"n": lite.execute("SELECT count(*) FROM items").fetchone()[0]}]
    assert store.execute_query("DELETE FROM items WHERE 1 = 0") == [] and store.spark.catalog.listTables() == []


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("INSERT INTO items (id, name, x) VALUES (?, upper(?), ? + 1)", [(100 + i, f"m{i}", i / 2) for i in range(30)]),
        ("INSERT OR REPLACE INTO items (id, name) VALUES (?, ?)", [(1, "a"), (200, "b"), (1, "c")]),
        ("UPDATE items SET x = ? WHERE id = ?", [(1.0, 1), (2.0, 2), (3.0, 1), (4.0, 999)]),
        ("UPDATE items SET name = ? WHERE id >= ? AND id < ?", [("a", 1, 4), ("b", 3, 10), ("c", 5, 6), ("d", 20, 30)]),
        ("UPDATE items SET name = ? WHERE id > ?", [("a", 1), ("b", 9), ("c", 4)]),
        ("UPDATE items SET name = ?, x = id * ? WHERE n <= ?", [("a", 2, 5), ("b", 3, 0)]),
        ("UPDATE items SET x = ? WHERE name LIKE ?", [(1.0, "a%"), (2.0, "é%")]),
        ("UPDATE items SET x = x + ? WHERE id = ?", [(1.0, 1), (10.0, 1), (5.0, 2)]),
        ("UPDATE items SET id = ? WHERE id = ?", [(1000, 1), (1001, 1000)]),
        ("UPDATE items SET x = ?", [(1.0,), (2.0,)]),
        ("DELETE FROM items WHERE id = ? AND n >= ?", [(1, 7), (2, 4), (3, None)]),
        ("DELETE FROM items WHERE n BETWEEN ? AND ?", [(1, 3), (7, 7)]),
    ],
)
def test_many_rows(both, text, rows):
    store, lite = both
    store.executemany(text, rows)
    lite.executemany(text, rows)
    same(store, lite)


def test_update_many_where(both):
    store, lite = both
    store.update_many("items", [{"id": 1, "x": 5.0}, {"id": 3, "x": 6.0}, {"id": 1, "x": 7.0}], where="id = ?", columns=["x"])
    lite.executemany("UPDATE items SET x = ? WHERE id = ?", [(5.0, 1), (6.0, 3), (7.0, 1)])
    same(store, lite)
    bands = [{"low": 0, "high": 5, "name": "a", "k": 1}, {"low": 3, "high": 9, "name": "b", "k": 2}]
    store.update_many("items", bands, where="n >= :low AND n < :high", columns=["name"])
    lite.executemany("UPDATE items SET name = :name WHERE n >= :low AND n < :high", bands)
    same(store, lite)
    assert store.update_many("items", [], where="id = ?") == 0


@pytest.mark.parametrize("seed", range(3))
def test_matches_by_brute_force(spark, monkeypatch, seed):
    """The last update row of each row, by keys and ranges with one end or two, that share ends and leaves; never a nested loop."""
    monkeypatch.setattr(dml, "LEAVES", [8, 64, 4096][seed])
    random.seed(seed)
    rows = [(i, random.choice("abc"), random.choice([None, float(random.randint(0, 30)), random.uniform(0, 30)])) for i in range(300)]
    updates = [(j, random.choice("abc"), random.choice([None, float(random.randint(0, 30))]), random.uniform(0, 35)) for j in range(50)]
    df, given, c = spark.createDataFrame(rows, "r long, k string, x double"), spark.createDataFrame(updates, "at long, uk string, lo double, hi double"), F.col
    key, low, high, other = dml.Term("EqualTo", c("k"), c("uk")), dml.Term("GreaterThanOrEqual", c("x"), c("lo")), dml.Term("LessThan", c("x"), c("hi")), dml.Term("", c("k") != c("uk"), None)
    real = lambda u: u[2] is not None
    for terms, holds in [
        ([low, high], lambda r, u: real(u) and u[2] <= r[2] < u[3]), ([key, low, high], lambda r, u: real(u) and r[1] == u[1] and u[2] <= r[2] < u[3]), ([low], lambda r, u: real(u) and u[2] <= r[2]),
        ([key, high], lambda r, u: r[1] == u[1] and r[2] < u[3]), ([high], lambda r, u: r[2] < u[3]), ([low, high, other], lambda r, u: real(u) and u[2] <= r[2] < u[3] and r[1] != u[1]),
    ]:
        found = dml.matches(df, given, terms, "r", "at")
        want = {r[0]: max(m) for r in rows if r[2] is not None and (m := [u[0] for u in updates if holds(r, u)])}
        assert {x.r: x.at for x in found.groupBy("r").agg(F.max("at").alias("at")).collect()} == want
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def broadcast_scans(df):
    """The scans of files that are below a broadcast in the plan, and whether anything is broadcast."""
    lines, found, depth = df._jdf.queryExecution().executedPlan().toString().splitlines(), [], None
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        depth = at if depth is None and "BroadcastExchange" in line else depth
        found += [line] if depth is not None and "FileScan" in line else []
    return found, any("Broadcast" in line for line in lines)


def staged_by(store, monkeypatch, change):
    """The frames that a change has staged, and its table's new state."""
    staged, states = [], []
    for name, kept in (("_put", staged), ("_replace", states)):
        monkeypatch.setattr(store, name, lambda table, df, *a, f=getattr(store, name), kept=kept, **b: (kept.append(df), f(table, df, *a, **b))[1])
    change()
    return staged, states


@pytest.mark.parametrize("most", [dml.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("text, rows", [("DELETE FROM items WHERE id > ? AND x <= ?", [(4, 2.0), (20, 5.0)]), ("DELETE FROM items WHERE name = ? AND id >= ?", [("5", 1), ("apple", 2)])])
def test_deletes_by_many_rows_broadcast_no_table(both, monkeypatch, text, rows, most):
    """Spark sizes a table by its small file, before its rows are multiplied by a tree's levels: rows of parameters are broadcast if they are few, a table never is."""
    store, lite = both
    monkeypatch.setattr(dml, "BROADCAST_BYTES", most)
    staged, states = staged_by(store, monkeypatch, lambda: store.executemany(text, rows))
    assert len(staged) == len(states) == 1 and not broadcast_scans(staged[0])[0]
    assert [broadcast_scans(df)[1] for df in (*staged, *states)] == [most > 0] * 2
    assert states[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == (0 if most else 2)  # whole rows are dealt out once
    lite.executemany(text, rows)
    same(store, lite)


@pytest.mark.parametrize("most", [dml.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("text, rows", [("UPDATE items SET name = ? WHERE n >= ? AND n < ?", [("a", 0, 5), ("b", 3, 9)]), ("UPDATE items SET name = ?, n = id + ? WHERE x > ?", [("c", 7, 0.5), ("d", 9, 2.0)])])
def test_updates_by_many_rows_broadcast_no_table(both, monkeypatch, text, rows, most):
    """As for deletes; where new values read the table's columns, it is joined once more, and not broadcast either."""
    store, lite = both
    monkeypatch.setattr(dml, "BROADCAST_BYTES", most)
    staged, states = staged_by(store, monkeypatch, lambda: store.executemany(text, rows))
    assert len(staged) == len(states) == 1 and not broadcast_scans(staged[0])[0]
    assert [broadcast_scans(df)[1] for df in (*staged, *states)] == [most > 0] * 2
    lite.executemany(text, rows)
    same(store, lite)


def test_merge(spark, tmp_path):
    db = Store(spark, tmp_path / "store")
    db.executescript("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'); CREATE TABLE s (id INTEGER, v TEXT); INSERT INTO s VALUES (1, 'x'), (2, 'y'), (9, 'z'), (8, 'w')")
    n = db.execute("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED AND s.v = 'x' THEN DELETE WHEN MATCHED THEN UPDATE SET v = t.v || s.v WHEN NOT MATCHED AND s.id = 9 THEN INSERT (id, v) VALUES (s.id, upper(s.v)) WHEN NOT MATCHED THEN INSERT *")
    assert n == 4 and sorted(map(tuple, db.read("t").collect())) == [(2, "by"), (3, "c"), (8, "w"), (9, "Z")]
    db.execute("INSERT INTO s VALUES (2, 'again')")
    with pytest.raises(IntegrityError):
        db.execute("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN DELETE")


def test_tables_by_statements(spark, tmp_path):
    db = Store(spark, tmp_path / "store")
    db.execute("CREATE TABLE IF NOT EXISTS p (id INTEGER PRIMARY KEY AUTOINCREMENT, text TEXT NOT NULL, blob BLOB, at DATETIME, k INT DEFAULT 3 UNIQUE)")
    db.execute("CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER, a INT, b INT, FOREIGN KEY (p) REFERENCES p(id), UNIQUE (a, b))")
    info = {r["name"]: (r["type"], r["notnull"], r["pk"], r["dflt_value"]) for r in db.execute("PRAGMA table_info(p)").collect()}
    assert info["id"] == ("INTEGER", 0, 1, None) and info["text"] == ("TEXT", 1, 0, None) and info["blob"][0] == "BLOB" and info["k"][3] == "3"
    db.execute("INSERT INTO p (text) VALUES ('a')")
    assert db.execute("SELECT id, k FROM p").collect() == [(1, 3)]
    for wrong in ("INSERT INTO p (text, k) VALUES (NULL, 9)", "INSERT INTO p (text) VALUES ('same k')", "INSERT INTO c (p) VALUES (77)", "INSERT INTO c VALUES (1, 1, 2, 3), (2, 1, 2, 3)"):
        with pytest.raises(IntegrityError):
            db.execute(wrong)
    db.execute("PRAGMA foreign_keys = OFF")
    assert db.execute("INSERT INTO c (p) VALUES (77)") == 1
    db.execute("ALTER TABLE c ADD COLUMN note TEXT DEFAULT 'none'")
    db.execute("ALTER TABLE c RENAME COLUMN note TO remark")
    assert db.execute("SELECT remark FROM c").first()[0] == "none"
    db.execute("CREATE UNIQUE INDEX one ON c (remark)")
    with pytest.raises(IntegrityError):
        db.execute("INSERT INTO c (a) VALUES (5)")
    db.execute("DROP TABLE IF EXISTS gone")
    for wrong in ("SELEC 1", "UPDATE c SET nothing = 1", "INSERT INTO c (a) VALUES (1, 2)", "DELETE FROM nowhere WHERE 1 = 1", "CREATE TABLE z (a INT CHECK (a > 0))", "SELECT ?"):
        with pytest.raises(Exception):
            db.execute(wrong).collect()
    db.execute("BEGIN")
    db.execute("DELETE FROM c WHERE 1 = 1")
    db.execute("ROLLBACK")
    assert db.get_row_count("c") == 1
    db.execute("CREATE TABLE d AS SELECT * FROM c")
    db.execute("ALTER TABLE d RENAME TO e")
    db.execute("TRUNCATE TABLE e")
    assert db.get_row_count("e") == 0
    db.writable = False
    with pytest.raises(ValueError):
        db.execute("DELETE FROM c WHERE 1 = 1")
    assert db.execute("SELECT updated_at FROM (SELECT 1 AS updated_at)").first()[0] == 1


def test_parameters_of_changes(both):
    store, lite = both
    assert store.count("items", "n > ? AND name LIKE ?", [2, "A%"]) == 2
    assert store.update("items", {"x": 0.5}, "id = :id", {"id": 3}) == 1 and store.delete("items", "n = ?", [9]) == 1
    lite.execute("UPDATE items SET x = 0.5 WHERE id = 3")
    lite.execute("DELETE FROM items WHERE n = 9")
    same(store, lite)


def test_generated_keys(spark, tmp_path):
    """One more than the largest key until then, whatever was given before or within, and by however many tasks the rows come."""
    db, lite = Store(spark, tmp_path / "store"), sqlite3.connect(":memory:")
    random.seed(1)
    for engine in (db, lite):
        engine.execute("CREATE TABLE k (id INTEGER PRIMARY KEY, v INTEGER)")
    value = 0
    for size, tasks in ((1, 1), (3, 1), (40, 3), (200, 4)):
        top = lite.execute("SELECT coalesce(max(id), 0) FROM k").fetchone()[0]
        rows = []
        for i in range(size):
            value += 1
            rows.append((top + 1000 * (i + 1) if random.random() < 0.2 else None, value))
        lite.executemany("INSERT INTO k VALUES (?, ?)", rows)
        db.insert_many("k", spark.createDataFrame(rows, "id long, v long").repartitionByRange(tasks, "v").sortWithinPartitions("v"))
        same(db, lite, "k")
