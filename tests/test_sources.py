import sqlite3

import pytest

from quarrylab.sources.delimited import read_csv, write_csv
from quarrylab.sources.sqlite import read_sqlite, tables


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, score REAL, data BLOB, ok BOOLEAN, made TIMESTAMP)")
        db.executemany("INSERT INTO users VALUES (?, ?, ?, ?, ?, ?)", [(i, f"u{i}", None if i == 3 else i / 2, bytes([i]), i % 2, "2024-01-01") for i in range(1, 51)])
        db.execute("INSERT INTO users VALUES (60, 'odd', 'text', NULL, NULL, NULL)")
        db.execute("CREATE TABLE none (a INTEGER)")
    df = read_sqlite(spark, path, "users")
    assert df.count() == 51 and df.where("score IS NULL").count() == 2 and df.dtypes[3] == ("data", "binary")
    assert df.where("ok").count() == 25 and read_sqlite(spark, path, "none").count() == 0
    assert tables(path) == ["none", "users"]
    with pytest.raises(FileNotFoundError):
        read_sqlite(spark, str(tmp_path / "y.db"), "users")


def test_csv_keeps_nulls_and_odd_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b\n\"c\"", b"\x00\xff"), (2, None, None), (3, "", b"")], "i long, s string, b binary")
    write_csv(df, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"), like=df)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


@pytest.fixture
def odd(tmp_path):
    path = str(tmp_path / "odd.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER, x REAL, s TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, i % 7, i / 2, f"s{i}") for i in range(1, 200)])
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(10**12, "text", "12", b"s5"), (10**12 + 1, 3.7, None, None), (10**12 + 2, None, "inf", 5)])
        db.execute("CREATE TABLE w (k INTEGER, s TEXT, PRIMARY KEY (k)) WITHOUT ROWID")
        db.executemany("INSERT INTO w VALUES (?, ?)", [(i * i, f"w{i}") for i in range(50)])
        db.execute("CREATE TABLE words (s TEXT PRIMARY KEY) WITHOUT ROWID")
        db.execute("INSERT INTO words VALUES ('a'), ('b')")
        db.execute("CREATE VIEW v AS SELECT id, s FROM t WHERE n = 3")
    return path


@pytest.mark.parametrize(
    "where",
    ["id = 5", "id >= 190", "n = 3", "n > 5", "n <> 3", "n IS NULL", "n IS NOT NULL", "n <=> 3", "x > 90", "x = 12", "x < 1", "s = 's5'", "s LIKE 's1%'", "s LIKE '%9%'", "s LIKE '%7'", "n IN (1, 2)", "NOT n IN (1, 2)", "s IN ('s1', '5')",
     "n = 3 OR id = 1", "n = 3 AND s LIKE 's1%' AND x > 20"],
)
def test_sqlite_filters(spark, odd, where):
    """With pushed filters as without them, whatever types of values the columns hold."""
    df = read_sqlite(spark, odd, "t", partitions=4)
    plain = spark.createDataFrame(df.collect(), df.schema)
    assert sorted(r.id for r in df.where(where).collect()) == sorted(r.id for r in plain.where(where).collect())


def test_sqlite_reader_gets_filters_and_ranges(spark, odd):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    from quarrylab.sources.sqlite import SqliteSource, ranges, row_number

    source = SqliteSource({"path": odd, "table": "t", "columns": "id\nn\ns"})
    reader = source.reader(source.schema())
    assert len(list(reader.pushFilters([EqualTo(("id",), 5), GreaterThan(("n",), 2), StringStartsWith(("s",), "s")]))) == 3
    assert reader.conditions[0] == '"id" = ?' and 'typeof("n")' in reader.conditions[1] and reader.values == [5, 2, 1, "s"]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(5, 5, "s5")]
    with sqlite3.connect(odd) as db:
        found = ranges(db, "t", "rowid", 6)
        assert found[0][0] == 1 and found[-1][1] == 10**12 + 2 and len(found) == 6
        sizes = [db.execute("SELECT count(*) FROM t WHERE rowid BETWEEN ? AND ?", r).fetchone()[0] for r in found]
        assert sum(sizes) == 202 and max(sizes) <= 60  # the gap takes no part of its own
        assert (row_number(db, "w"), row_number(db, "words"), row_number(db, "v")) == ('"k"', None, None)
    assert read_sqlite(spark, odd, "w").count() == 50 and read_sqlite(spark, odd, "words").count() == 2 and read_sqlite(spark, odd, "v").count() == 29
    assert read_sqlite(spark, odd, "t", columns=["s", "id"]).columns == ["s", "id"]
    with pytest.raises(Exception):
        read_sqlite(spark, odd, "t", columns=["none"]).count()


def test_sqlite_files_of_tasks(spark, tmp_path):
    from quarrylab.sources.sqlite import write_sqlite

    df = spark.range(100, numPartitions=3).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id / 2 END AS x", "CASE WHEN id % 3 > 0 THEN concat('s', id) END AS s", "id % 2 = 0 AS b")
    assert len(write_sqlite(df, str(tmp_path / "parts"), "t")) == 3
    assert sorted(map(str, read_sqlite(spark, str(tmp_path / "parts"), "t").collect())) == sorted(map(str, df.collect()))
