"""Queries that load given tables into a `Store` and use it as its users do: SQL statements, changes by methods, versions, arrays."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _DIFF, Tables, _versions, query
from .functions import arrays, chunks
from .operators import diff
from .plans.store import Store, scratch

SCHEMAS = {
    "orders": {"o_orderkey": "INTEGER PRIMARY KEY", "o_custkey": "INTEGER", "o_orderstatus": "TEXT", "o_totalprice": "REAL", "o_orderpriority": "TEXT"},
    "customer": {"c_custkey": "INTEGER PRIMARY KEY", "c_name": "TEXT NOT NULL", "c_nationkey": "INTEGER", "c_acctbal": "REAL", "c_mktsegment": "TEXT"},
    "part": {"p_partkey": "INTEGER PRIMARY KEY", "p_name": "TEXT", "p_brand": "TEXT", "p_type": "TEXT", "p_size": "INTEGER", "p_retailprice": "REAL"},
}


def lab(t: Tables, *names: str) -> Store:
    """A store in the shared folder that has whole given tables."""
    db = Store(t.spark, scratch(t.spark).removeprefix("file://"))
    db.sf_dir = t.sf_dir
    for name in names:
        db.create_table(name, SCHEMAS[name])
        db.insert_many(name, getattr(t, name).select(*SCHEMAS[name]))
    return db


def on_store(sql: str, *names: str):
    """Register a function of a store with these tables."""

    def register(f: Callable[[Store], DataFrame]):
        return query(sql)(functools.wraps(f)(lambda t: f(lab(t, *names))))

    return register


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
CUSTOMER = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


# Statements


@on_store(f"""{ORDERS} UNION ALL SELECT max(o_orderkey) + 1, 1, 'N', 42.0, NULL FROM orders UNION ALL SELECT max(o_orderkey) + 10, 2, 'N', 1.5, 'x' FROM orders
UNION ALL SELECT max(o_orderkey) + 11, 3, NULL, 2.0, NULL FROM orders""", "orders")
def store_insert(db):
    """A key that isn't given is one more than the largest until then, also within a statement."""
    top = db.execute("SELECT max(o_orderkey) AS k FROM orders").first()["k"]
    db.execute("INSERT INTO orders (o_custkey, o_orderstatus, o_totalprice) VALUES (?, ?, ?)", (1, "N", 42.0))
    db.execute("INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority) VALUES (?, 2, 'N', 1.5, 'x'), (NULL, 3, NULL, 2.0, NULL)", (top + 10,))
    return db.read("orders")


@on_store(f"{ORDERS} UNION ALL SELECT o_orderkey + 100000000, o_custkey, lower(o_orderstatus), o_totalprice * 2, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "orders", "customer")
def store_insert_select(db):
    db.execute("INSERT INTO orders SELECT o_orderkey + 100000000, o_custkey, lower(o_orderstatus), o_totalprice * 2, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
    return db.read("orders")


@on_store("SELECT o_orderkey, o_custkey, CASE WHEN hit THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN hit THEN o_totalprice + 99.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM (SELECT *, o_orderpriority ILIKE '1-u%' AND o_totalprice > 50000 AS hit FROM orders)", "orders")
def store_update(db):
    db.execute("UPDATE orders SET o_totalprice = o_totalprice + ?, o_orderstatus = 'X' WHERE o_orderpriority LIKE '1-u%' AND o_totalprice > ?", (99.0, 50000))
    return db.read("orders")


@on_store(f"{ORDERS} WHERE NOT (o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))", "orders", "customer")
def store_delete(db):
    db.execute("DELETE FROM orders WHERE o_orderstatus = ? AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", ("F",))
    return db.read("orders")


@on_store("""WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey + 1000000, c_acctbal, 0 FROM customer WHERE c_acctbal > 9000)
SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, CASE WHEN k IS NOT NULL AND n > 5 THEN round(total, 2) ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer LEFT JOIN s ON c_custkey = k WHERE NOT (k IS NOT NULL AND n <= 5 AND total < 300000)
UNION ALL SELECT k, 'new', NULL, round(total, 2), NULL FROM s WHERE k NOT IN (SELECT c_custkey FROM customer)""", "orders", "customer")
def store_merge(db):
    db.execute("""MERGE INTO customer AS c USING (SELECT o_custkey AS k, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey + 1000000, c_acctbal, 0 FROM customer WHERE c_acctbal > 9000) AS s
    ON c.c_custkey = s.k WHEN MATCHED AND s.n > 5 THEN UPDATE SET c_acctbal = round(s.total, 2) WHEN MATCHED AND s.total < 300000 THEN DELETE WHEN NOT MATCHED THEN INSERT (c_custkey, c_name, c_acctbal) VALUES (s.k, 'new', round(s.total, 2))""")
    return db.read("customer")


@on_store(f"""{CUSTOMER} WHERE c_custkey NOT IN (SELECT min(c_custkey) FROM customer) UNION ALL SELECT min(c_custkey), 'replaced', NULL, 1.0, NULL FROM customer UNION ALL SELECT max(c_custkey) + 5, 'added', NULL, 2.0, NULL FROM customer""", "customer")
def store_insert_or_replace(db):
    least, most = db.execute("SELECT min(c_custkey) AS a, max(c_custkey) AS b FROM customer").first()
    db.execute("INSERT OR REPLACE INTO customer (c_custkey, c_name, c_acctbal) VALUES (?, 'replaced', 1.0), (?, 'added', 2.0)", (least, most + 5))
    db.execute("INSERT OR IGNORE INTO customer (c_custkey, c_name, c_acctbal) VALUES (?, 'ignored', 3.0)", (most + 5,))
    return db.read("customer")


@on_store("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment", "customer")
def store_create_table_as(db):
    db.execute("CREATE TABLE totals AS SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
    db.execute("ALTER TABLE totals RENAME COLUMN c_mktsegment TO segment")
    db.execute("ALTER TABLE totals RENAME TO sums")
    return db.execute("SELECT * FROM sums")


# One statement for many rows


@on_store(f"{ORDERS} UNION ALL SELECT 200000000 + i, i, 'S' || i, i / 2.0, NULL FROM range(500) AS r(i)", "orders")
def store_executemany_insert(db):
    db.executemany("INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus, o_totalprice) VALUES (? + 200000000, ?, ?, ? / 2.0)", [(i, i, f"S{i}", i) for i in range(500)])
    return db.read("orders")


#: Bands of prices, of which later ones win where they overlap; the last of all is open upwards.
BANDS = [(f"band{i}", 1000.0 * i * i, 1000.0 * i * i + 30000.0) for i in range(20)]
_IN_BAND = " ".join(f"WHEN o_totalprice >= {low} AND o_totalprice < {high} THEN '{name}'" for name, low, high in reversed(BANDS))


@on_store(f"SELECT o_orderkey, o_custkey, CASE {_IN_BAND} ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders", "orders")
def store_update_many_where(db):
    """Ranges that overlap, one for each dict: no nested loop, and the last dict wins."""
    db.update_many("orders", [{"o_orderstatus": name, "low": low, "high": high} for name, low, high in BANDS], where="o_totalprice >= :low AND o_totalprice < :high", columns=["o_orderstatus"])
    return db.read("orders")


@on_store(f"{ORDERS} WHERE NOT ((o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_totalprice > 400000) OR (o_orderstatus = 'P' AND o_totalprice > 1))", "orders")
def store_executemany_delete(db):
    db.executemany("DELETE FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", [("F", 200000), ("O", 400000), ("P", 1), ("F", 300000), ("none", 0)])
    return db.read("orders")


# SQLite's answers


@on_store("SELECT p_partkey, p_name FROM part WHERE p_brand ILIKE 'BRAND#1%' AND p_type NOT ILIKE 'pro%'", "part")
def dialect_like(db):
    return db.get_rows("part", ["p_partkey", "p_name"], where="p_brand LIKE 'BRAND#1%' AND p_type NOT LIKE 'pro%'")


@on_store("SELECT p_partkey, p_partkey // 3 AS third, (p_size // 4 * 4)::BIGINT AS fours, p_retailprice / 2 AS half FROM part WHERE p_size // 2 = 10 OR p_partkey // 7 > 20", "part")
def dialect_division(db):
    return db.execute("SELECT p_partkey, p_partkey / 3 AS third, p_size / 4 * 4 AS fours, p_retailprice / 2 AS half FROM part WHERE p_size / 2 = 10 OR p_partkey / 7 > 20")


@on_store("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_partkey // (p_size % 5) END AS q, CASE WHEN p_size % 3 <> 0 THEN p_partkey % (p_size % 3) END AS m, NULL::DOUBLE AS z FROM part WHERE p_size % 5 = 0 OR p_partkey % 2 = 0", "part")
def dialect_zero(db):
    """What divides by zero is null and no error."""
    return db.execute("SELECT p_partkey, p_partkey / (p_size % 5) AS q, p_partkey % (p_size % 3) AS m, p_retailprice / 0 AS z FROM part WHERE p_partkey / (p_size % 5) IS NULL OR p_partkey % 2 = 0")


@on_store("SELECT o_orderkey, substr(o_orderpriority, 1, 1)::BIGINT AS first, coalesce(try_cast(regexp_extract(o_orderpriority, '^[0-9]+') AS DOUBLE), 0.0) AS real_first, 0::BIGINT AS none FROM orders WHERE substr(o_orderpriority, 1, 1)::BIGINT > 2", "orders")
def dialect_casts(db):
    """As much of a text as is a number; 0 if nothing is."""
    return db.execute("SELECT o_orderkey, CAST(o_orderpriority AS INTEGER) AS first, CAST(o_orderpriority AS REAL) AS real_first, CAST(o_orderstatus AS INTEGER) AS none FROM orders WHERE CAST(o_orderpriority AS INTEGER) > 2")


@on_store("SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_size > 40", "part")
def dialect_comparisons(db):
    """A text is compared with a number by the column's type, and one that is no number comes after all numbers."""
    return db.get_rows("part", ["p_partkey", "p_size"], where="p_size > '40' AND p_size < 'many' AND p_name > 5")


@on_store("SELECT n AS rowid, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n % 100 = 7", "orders")
def dialect_rowid(db):
    """Rows are numbered as they were inserted."""
    db.execute("CREATE TABLE sorted AS SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey")
    return db.execute("SELECT rowid, o_orderkey, o_totalprice FROM sorted WHERE rowid % 100 = 7")


# Change sets, hash trees and merges of two states of orders

_NEW = """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL (SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5)"""


@query(f"""WITH a AS (SELECT * FROM orders), b AS ({_NEW}) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'INSERT' WHEN b.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN 'o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' ELSE 'o_totalprice' END AS columns, a.o_totalprice AS before, b.o_totalprice AS after
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def vc_changes(t):
    """Each changed row with its values before and after."""
    return diff.changes(*_versions(t), ["o_orderkey"]).select("o_orderkey", "op", F.concat_ws(",", "columns").alias("columns"), F.col("before.o_totalprice").alias("before"), F.col("after.o_totalprice").alias("after"))


@query(_DIFF)
def vc_tree_diff(t):
    """Rows of buckets alone whose hashes differ between the states' trees."""
    before, after = _versions(t)
    trees = [diff.tree(diff.bucket_hashes(df, ["o_orderkey"])) for df in (before, after)]
    differing = diff.changed_buckets(*trees)
    return diff.changes(*[df.where(diff.bucket(["o_orderkey"]).isin(differing)) for df in (before, after)], ["o_orderkey"]).select("o_orderkey", "op")


@query("SELECT level::INTEGER AS level, TRUE AS same FROM range(3) AS r(level) WHERE (SELECT count(*) FROM orders) > 0")
def vc_tree_added(t):
    """Hashes of two parts of a table add up to those of the whole, so that a commit reads new files alone."""
    whole = diff.tree(diff.bucket_hashes(t.orders, ["o_orderkey"]))
    parts = diff.tree(diff.added_hashes(*[diff.bucket_hashes(t.orders.where(f"o_custkey % 3 {op} 0"), ["o_orderkey"]) for op in ("=", "<>")]))
    both = whole.join(parts.withColumnRenamed("hash", "other"), ["level", "node"], "full")
    return both.groupBy("level").agg(F.bool_and(F.col("hash").eqNullSafe(F.col("other"))).alias("same"))


@query(_NEW)
def vc_apply(t):
    before, after = _versions(t)
    return diff.apply(before, diff.changes(before, after, ["o_orderkey"]), ["o_orderkey"])


@query("SELECT * FROM orders")
def vc_apply_back(t):
    before, after = _versions(t)
    return diff.apply(after, diff.reverse(diff.changes(before, after, ["o_orderkey"])), ["o_orderkey"])


def _theirs(t: Tables) -> DataFrame:
    """Another state: other rows deleted, other columns changed, and one column of some rows changed otherwise than in the first state."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    kept = t.orders.where("o_orderkey % 17 <> 0")
    return kept.withColumn("o_orderstatus", F.when(key % 7 == 0, "T").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(key % 26 == 0, price + 5).otherwise(price))


_MERGED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'T' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 26 = 0 THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 11 <> 0 AND (o_orderkey % 17 <> 0 OR o_orderkey % 13 = 0)"""


@query(f"""{_MERGED.replace("CASE WHEN o_orderkey % 7 = 0", "CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 17 <> 0")} UNION ALL (SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5)""")
def vc_merge(t):
    """Both states' changes together, column by column; ours stays where both have changed a value."""
    before, ours = _versions(t)
    changed, _ = diff.merge(before, ours, _theirs(t), ["o_orderkey"])
    return diff.apply(ours, changed, ["o_orderkey"])


@query("""SELECT o_orderkey, 'o_totalprice' AS column FROM orders WHERE o_orderkey % 26 = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 17 <> 0
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 17 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 26 = 0)""")
def vc_conflicts(t):
    before, ours = _versions(t)
    return diff.merge(before, ours, _theirs(t), ["o_orderkey"])[1].select("o_orderkey", "column")


@on_store("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'UPDATE' ELSE 'DELETE' END AS op, CASE WHEN o_orderkey % 9 = 0 THEN 'o_orderstatus' ELSE 'o_custkey,o_orderstatus,o_totalprice,o_orderpriority' END AS columns FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 1", "orders")
def store_git_diff(db):
    """Replaced rows are updated ones, by the primary key."""
    db.git_init()
    first = db.git_commit("loaded")
    db.replace_many("orders", db.read("orders").where("o_orderkey % 9 = 0").withColumn("o_orderstatus", F.lit("R")))
    db.execute("DELETE FROM orders WHERE o_orderkey % 10 = 1 AND o_orderkey % 9 <> 0")
    second = db.git_commit("changed")
    return db.git_diff(first, second)["orders"].select("o_orderkey", "op", F.concat_ws(",", "columns").alias("columns"))


@on_store("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'B' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 100 <> 7
UNION ALL SELECT max(o_orderkey) + 1, 77, NULL, NULL, NULL FROM orders""", "orders")
def store_git_merge(db):
    """A branch and the main line change different columns and rows, and are merged."""
    db.git_init()
    db.git_commit("loaded")
    db.git_branch("side")
    db.execute("UPDATE orders SET o_totalprice = o_totalprice * 2 WHERE o_orderkey % 3 = 0")
    db.git_commit("prices")
    db.git_checkout("side")
    db.execute("UPDATE orders SET o_orderstatus = 'B' WHERE o_orderkey % 5 = 0")
    db.execute("DELETE FROM orders WHERE o_orderkey % 100 = 7 AND o_orderkey % 3 <> 0")
    db.execute("INSERT INTO orders (o_custkey) VALUES (77)")
    db.git_commit("states")
    db.git_checkout("main")
    db.execute("DELETE FROM orders WHERE o_orderkey % 100 = 7 AND o_orderkey % 3 = 0")
    db.git_commit("rest of the sevens")
    merged = db.git_merge("side", prefer="ours")
    return db.read("orders") if merged["commit"] else db.read("orders").limit(0)


# Arrays in chunks


@query("SELECT vec_id, unnest(range(len(embedding[11:40])))::INTEGER AS pos, unnest(embedding[11:40])::DOUBLE AS x FROM embeddings")
def array_slices(t):
    """Rows 10 to 39 of all arrays, from chunks of 16 rows each, of which those at the ends are not read."""
    path = f"{scratch(t.spark)}/chunks"
    cells = t.embeddings.select("vec_id", arrays.encode_column(F.col("embedding"), "float32").alias("cell"))
    chunks.chunked(cells, "vec_id", chunk_bytes=64).write.parquet(path)
    found = chunks.assembled(chunks.sliced(t.spark.read.parquet(path), "vec_id", 10, 40), "vec_id")
    return found.select("vec_id", arrays.decode_column(F.col("cell")).alias("v")).select("vec_id", F.posexplode("v").alias("pos", "x"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding[1:20], lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def store_array_slices(t):
    """Whole vectors kept as chunked arrays of a store; their first 20 rows summed."""
    db = Store(t.spark, scratch(t.spark).removeprefix("file://"))
    db.save_chunks("vectors", t.embeddings.select(F.col("vec_id").alias("id"), arrays.encode_column(F.col("embedding"), "float32").alias("cell")), chunk_bytes=40)
    values = db.read_slice("vectors", 0, 20).select("id", arrays.decode_column(F.col("cell")).alias("v"))
    return values.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# SQLite files


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority LIKE '1%'")
def sqlite_source(t):
    """Orders written to SQLite files by the tasks, and read with the filter in SQLite's own query."""
    from .sources.sqlite import read_sqlite, write_sqlite

    folder = f"{scratch(t.spark).removeprefix('file://')}/sqlite"
    write_sqlite(t.orders, folder, "orders")
    orders = read_sqlite(t.spark, folder, "orders", columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"])
    return orders.where("o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority LIKE '1%'").select("o_orderkey", "o_custkey", "o_totalprice")


# Statistics


@on_store("""SELECT column_name AS column, n, nulls, TRUE AS distinct_close, TRUE AS quartiles_close FROM (SELECT 'o_orderkey' AS column_name, count(*) AS n, count(*) - count(o_orderkey) AS nulls FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority) FROM orders)""")
def store_column_stats(db):
    """Estimates of merged sketches of two files, each read once, beside exact values: distinct ones within 3 %, quartiles within 1.5 % of the ranks."""
    db.create_table("orders", SCHEMAS["orders"])
    orders = Tables(db.spark, db.sf_dir).orders.select(*SCHEMAS["orders"])
    for half in ("=", "<>"):
        db.insert_many("orders", orders.where(f"o_custkey % 2 {half} 0"))
        db.analyze("orders")
    stats = db.get_column_stats("orders")
    exact = orders.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in orders.columns])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"d_{c}").alias("d")) for c in orders.columns])).alias("e")).select("e.*")
    numbers = [c for c, kind in orders.dtypes if kind != "string"]
    below = stats.where(F.col("column").isin(numbers)).select("column", F.posexplode("quantiles").alias("i", "q"))
    values = orders.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in numbers])).alias("e")).select("e.*")
    ranks = values.join(F.broadcast(below), F.col("name") == F.col("column")).groupBy("column", "i").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v") <= F.col("q"), 1)).alias("upto"), F.count(F.when(F.col("v") < F.col("q"), 1)).alias("under"))
    share = (F.col("i") + 1) * 0.25 * F.col("n")
    close = ranks.groupBy("column").agg(F.bool_and((F.col("upto") >= share - 0.015 * F.col("n") - 1) & (F.col("under") <= share + 0.015 * F.col("n") + 1)).alias("close"))
    joined = stats.join(exact, F.col("column") == F.col("name")).join(close.withColumnRenamed("column", "of"), F.col("column") == F.col("of"), "left")
    return joined.select("column", "n", "nulls", (F.abs(F.col("distinct") - F.col("d")) <= 0.03 * F.col("d") + 1).alias("distinct_close"), F.coalesce("close", F.lit(True)).alias("quartiles_close"))


# Objects


@query("SELECT event_id::VARCHAR AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none, event_type AS kind FROM events WHERE props IS NOT NULL")
def store_objects(t):
    """All objects' fields, from objects that tasks have encoded and decode again."""
    db = Store(t.spark, scratch(t.spark).removeprefix("file://"))
    notes = F.to_json(F.struct(F.col("event_type").alias("kind")))
    db.save_objects("objects", t.events.select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("json"), notes.alias("metadata")))
    field = lambda c, path, kind: F.try_variant_get(c, path, kind)
    return db.read_objects("objects").select("key", field("value", "$.k", "bigint").alias("k"), field("value", "$.none", "string").alias("none"), field("metadata", "$.kind", "string").alias("kind"))


@on_store("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 11 OR o_orderkey = 7", "orders")
def store_index_lookup(db):
    """Lookups by indexed columns, after the layout has followed the index."""
    db.create_index("orders", "o_custkey")
    db.optimize()
    return db.get_rows("orders", ["o_orderkey", "o_custkey", "o_totalprice"], where="o_custkey = 11 OR o_orderkey = 7")
