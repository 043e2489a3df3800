"""Queries on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays
from .operators import columns, constraints, dedup, diff, dml, rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str):
    """Register a function of Tables under its name, with the SQL of its result."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Reading


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def rows_project_filter(t):
    return rows.get_rows(t.orders, ["o_orderkey", "o_custkey", "o_totalprice"], where="o_orderstatus = 'F' AND o_totalprice > 100000")


@query("SELECT * FROM orders WHERE o_orderkey IN (1, 5, 17, 99, 1000000) AND o_totalprice > 1000")
def rows_by_id_list(t):
    return rows.get_rows(t.orders, ids=[1, 5, 17, 99, 1000000], where="o_totalprice > 1000", id_column="o_orderkey")


@query("SELECT * FROM customer WHERE c_custkey = 7")
def rows_by_id(t):
    return rows.get_rows(t.customer, ids=7, id_column="c_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def rows_topk(t):
    return rows.get_rows(t.orders, ["o_orderkey", "o_custkey", "o_totalprice"], where="o_orderstatus = 'F' AND o_totalprice > 1000", order_by="o_totalprice DESC, o_orderkey", limit=20, offset=5)


@query("SELECT * FROM lineitem ORDER BY l_orderkey NULLS FIRST, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity LIMIT 50 OFFSET 100")
def rows_page(t):
    return rows.get_rows(t.lineitem, order_by="l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity", limit=50, offset=100)


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 100")
def rows_no_blobs(t):
    stored = t.embeddings.select("vec_id", "label", F.encode(F.to_json("embedding"), "UTF-8").alias("data"))
    return rows.get_rows(stored, where="vec_id < 100", include_blobs=False)


@query("SELECT vec_id, label FROM embeddings")
def rows_no_blobs_all(t):
    stored = t.embeddings.select("vec_id", "label", F.encode(F.to_json("embedding"), "UTF-8").alias("data"))
    return rows.get_rows(stored, include_blobs=False)


@query("SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 100")
def row_count_where(t):
    return rows.count_rows(t.events, "event_type = 'purchase' AND value > 100")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 500")
def select_params(t):
    return rows.select(t.customer, ["c_custkey", "c_name"], "c_mktsegment = :segment AND c_acctbal > :least", {"segment": "BUILDING", "least": 500})


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) AS flag FROM lineitem WHERE l_quantity < 5")
def select_expressions(t):
    return rows.select(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "round(l_extendedprice * (1 - l_discount), 4) AS net", "upper(l_returnflag) AS flag"], "l_quantity < ?", [5])


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def table_head(t):
    return rows.head(t.nation, "n_nationkey").select("n_nationkey", "n_name")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, least(count(*), 100000) AS n, count(*) >= 100000 AS is_approximate FROM {t}" for t in TABLES))
def inspect_counts(t):
    found = None
    for name in TABLES:
        one = rows.bounded_count(getattr(t, name)).select(F.lit(name).alias("table_name"), "n", "is_approximate")
        found = one if found is None else found.union(one)
    return found


@query("SELECT page_id, '<BLOB ' || octet_length(encode(html)) || ' bytes>' AS html FROM pages")
def blob_placeholder(t):
    return rows.blob_placeholders(t.pages.select("page_id", F.encode("html", "UTF-8").alias("html")))


# Changing rows


@query("SELECT * FROM region UNION ALL SELECT 5, 'ARCTICA' UNION ALL SELECT 6, 'ATLANTIS'")
def insert_append(t):
    return dml.insert_rows(t.region, t.spark.createDataFrame([(5, "ARCTICA"), (6, "ATLANTIS")], "r_regionkey int, r_name string"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'ERIADOR', NULL")
def insert_missing_keys_null(t):
    return dml.insert_rows(t.nation, t.spark.createDataFrame([(100, "ERIADOR")], "n_nationkey int, n_name string"))


@query("SELECT * FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def insert_prefilter(t):
    return dml.insert_rows(t.customer, t.customer.withColumn("c_custkey", F.col("c_custkey") + 1000000), "c_acctbal > 9000")


@query("SELECT o_orderkey, o_custkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 99 END, c_nationkey) AS nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def insert_fk_inherit(t):
    new = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 99).alias("nationkey"))
    return dml.inherit_foreign(new, t.customer.withColumnRenamed("c_custkey", "o_custkey"), "nationkey", "c_nationkey", "o_custkey")


_SUPPLIERS = "SELECT s_suppkey, s_name || '-new' AS s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 1000001, 'added', 3, 1.5"


@query(f"SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({_SUPPLIERS})) UNION ALL SELECT * FROM ({_SUPPLIERS})")
def replace_upsert(t):
    old = t.supplier
    new = old.where("s_suppkey % 5 = 0").select("s_suppkey", F.concat("s_name", F.lit("-new")).alias("s_name"), "s_nationkey", (F.col("s_acctbal") * 2).alias("s_acctbal"))
    new = new.union(t.spark.createDataFrame([(1000001, "added", 3, 1.5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"))
    return dml.replace_rows(old, new, ["s_suppkey"])


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN 'Brand#X' ELSE p_brand END AS p_brand, p_type, CAST(CASE WHEN p_size > 40 THEN 41 ELSE p_size END AS INTEGER) AS p_size, p_retailprice FROM part")
def update_where_literal(t):
    return dml.update_where(t.part, {"p_brand": "Brand#X", "p_size": 41}, "p_size > 40")


@query("""SELECT c.c_custkey, c.c_name, c.c_nationkey, CASE WHEN u.k IS NOT NULL THEN u.v ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment
FROM customer c LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY o_custkey) u ON c.c_custkey = u.k""")
def update_many_keyed(t):
    updates = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return dml.update_keyed(t.customer, updates, ["c_custkey"])


@query("SELECT * FROM lineitem WHERE NOT coalesce(l_returnflag = 'R' AND l_quantity > 10, FALSE)")
def delete_where(t):
    return dml.delete_where(t.lineitem, "l_returnflag = 'R' AND l_quantity > 10")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderkey) AS n FROM orders) WHERE NOT (o_orderstatus = 'F' AND n <= 100)")
def delete_where_limit(t):
    return dml.delete_where(t.orders, "o_orderstatus = 'F'", limit=100, order_by="o_orderkey")


@query("SELECT * FROM orders WHERE o_orderpriority LIKE '1%'")
def copy_table_where(t):
    return dml.copy_rows(t.orders, "o_orderpriority LIKE '1%'")


# Columns


@query("SELECT *, 7 AS p_stock, CAST(NULL AS VARCHAR) AS p_note FROM part")
def add_column_default(t):
    return columns.add_column(columns.add_column(t.part, "p_stock", "INTEGER DEFAULT 7"), "p_note", "TEXT")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def drop_columns(t):
    return columns.drop_columns(t.part, ["p_brand", "p_type", "p_size"])


@query("SELECT p_partkey, p_name AS part_name, p_brand, p_type, p_size, p_retailprice FROM part")
def rename_column(t):
    return columns.rename_column(t.part, "p_name", "part_name")


@query("SELECT n_name, n_regionkey, n_nationkey FROM nation")
def reorder_columns(t):
    return columns.reorder_columns(t.nation, ["n_name", "n_regionkey", "n_nationkey"])


@query("SELECT p_partkey, p_brand, p_name, p_retailprice, p_size, p_type FROM part")
def sort_columns(t):
    return columns.sort_columns(t.part, key_columns_first=["p_partkey"])


@query("SELECT * FROM (VALUES (0, 'n_nationkey', 'INTEGER', 0, NULL, 1), (1, 'n_name', 'TEXT', 1, NULL, 0), (2, 'n_regionkey', 'INTEGER', 0, '0', 0)) AS v(cid, name, type, \"notnull\", dflt_value, pk)")
def schema_info(t):
    return columns.column_info(t.nation, ["n_nationkey"], ["n_name"], {"n_regionkey": "0"})


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sort_table(t):
    return t.nation.orderBy(*rows.order_columns("n_name DESC, n_nationkey"))


# Constraints and health


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(t):
    return constraints.unique_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0)")
def fk_violations(t):
    return constraints.foreign_key_violations(t.orders, "o_custkey", t.customer.where("c_custkey % 10 <> 0"), "c_custkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fk_documents_without_labels(t):
    return constraints.foreign_key_violations(t.documents.select("doc_id", "source"), "doc_id", t.labels, "doc_id")


@query("""WITH j AS (SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey)
SELECT 'c_custkey' AS column_name, count(*) FILTER (c_custkey IS NULL) AS nulls FROM j UNION ALL SELECT 'n_name', count(*) FILTER (n_name IS NULL) FROM j UNION ALL SELECT 'n_regionkey', count(*) FILTER (n_regionkey IS NULL) FROM j""")
def null_violations(t):
    joined = t.customer.join(t.nation.where("n_regionkey <> 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return constraints.null_violations(joined, ["c_custkey", "n_name", "n_regionkey"])


@query(f"""WITH n AS ({' UNION ALL '.join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES)}), v AS (SELECT count(*) AS orphans FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0))
SELECT CAST(count(*) AS BIGINT) AS tables, CAST(sum(n) AS BIGINT) AS total_rows, CAST(count(*) FILTER (n = 0) AS BIGINT) AS empty_tables, max(orphans) AS orphans,
CAST(greatest(0, 100 - 20 * (count(*) FILTER (n = 0) + max(CASE WHEN orphans > 0 THEN 1 ELSE 0 END))) AS BIGINT) AS health_score FROM n, v""")
def health_stats(t):
    from .plans.health import score

    orphans = constraints.foreign_key_violations(t.orders, "o_custkey", t.customer.where("c_custkey % 10 <> 0"), "c_custkey")
    return score({name: getattr(t, name) for name in TABLES}, orphans)


# Duplicates


@query("SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def dedup_keep_first(t):
    return dedup.keep_first(t.events, ["user_id", "event_type"], "event_id")


@query("SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text, lang, source, n_chars ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_all_columns(t):
    docs = t.documents
    return dedup.keep_first(docs, dedup.key_columns(docs, "all", ["doc_id"]), "doc_id")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def dedup_find_duplicates(t):
    return dedup.duplicates(t.documents, ["text"], "doc_id").select("doc_id", "source")


@query("SELECT count(*) AS total, count(*) - count(DISTINCT text) AS duplicates, (count(*) - count(DISTINCT text)) / count(DISTINCT text) AS rate FROM documents")
def dedup_rate(t):
    return dedup.duplicate_rate(t.documents, ["text"])


@query("SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id = 5 AND event_type = 'click' ORDER BY event_id) AS n FROM events) WHERE NOT (user_id = 5 AND event_type = 'click' AND n = 1)")
def dedup_delete_one(t):
    return dedup.delete_one(t.events, {"user_id": 5, "event_type": "click"}, "event_id")


# Arrays and objects


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def array_hash(t):
    return t.documents.select("doc_id", arrays.hash_of(F.encode("text", "UTF-8")).alias("hash"))


@query("SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings")
def array_roundtrip(t):
    cells = t.embeddings.select("vec_id", arrays.encode_column(F.col("embedding"), "float32", compress=True).alias("cell"))
    return cells.select("vec_id", arrays.decode_column(F.col("cell")).alias("v")).select("vec_id", F.posexplode("v").alias("pos", "x"))


@query("SELECT vec_id, TRUE AS data_ok FROM embeddings")
def array_verify(t):
    cells = t.embeddings.select("vec_id", arrays.encode_column(F.col("embedding"), "float64", compress=True).alias("c"))
    flat = cells.select("vec_id", F.col("c.data").alias("data"), F.col("c.is_compressed").alias("data_is_compressed"), F.col("c.hash").alias("data_hash"))
    return arrays.verify(flat, "data").select("vec_id", "data_ok")


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 9) AS mean, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS norm,
list_min(embedding)::DOUBLE AS min, list_max(embedding)::DOUBLE AS max FROM embeddings""")
def array_stats(t):
    mean, norm, least, most = arrays.statistics(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(mean, 9).alias("mean"), F.round(norm, 9).alias("norm"), least, most)


@query("SELECT label, CAST(sum(CASE WHEN vec_id % 7 = 0 THEN 64 ELSE 0 END) AS BIGINT) AS nans, CAST(sum(len(embedding)) AS BIGINT) AS cells FROM embeddings GROUP BY label")
def array_null_fill(t):
    cells = t.embeddings.select("label", arrays.null_fill(F.when(F.col("vec_id") % 7 != 0, F.col("embedding").cast("array<double>")), 64).alias("v"))
    return cells.groupBy("label").agg(F.sum(F.size(F.filter("v", F.isnan)).cast("long")).alias("nans"), F.sum(F.size("v").cast("long")).alias("cells"))


@query("SELECT label, pos::INTEGER AS pos, round(avg(x::DOUBLE), 9) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY ALL")
def array_stack_mean(t):
    return arrays.element_means(t.embeddings, "embedding", "label").withColumn("mean", F.round("mean", 9))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def blob_metadata_json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


# Versions


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.orders
    kept = old.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    added = old.orderBy("o_orderkey").limit(5).withColumn("o_orderkey", F.col("o_orderkey") + 100000000)
    return old, kept.unionByName(added)


_DIFF = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS op FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0
UNION ALL (SELECT o_orderkey + 100000000, 'INSERT' FROM orders ORDER BY o_orderkey LIMIT 5)"""


@query(_DIFF)
def vc_diff(t):
    return diff.diff(*_versions(t), ["o_orderkey"])


@query(f"SELECT op, count(*) AS n FROM ({_DIFF}) GROUP BY op")
def vc_status_summary(t):
    return diff.summary(diff.diff(*_versions(t), ["o_orderkey"]))


@query("SELECT * FROM (VALUES ('c3', 'c2', 0), ('c2', 'c1', 1), ('c1', NULL, 2)) AS v(hash, parent_hash, depth)")
def vc_log(t):
    return diff.history(t.spark.createDataFrame([("c1", None), ("c2", "c1"), ("c3", "c2"), ("b1", "c2"), ("x", "y"), ("y", "x")], "hash string, parent_hash string"), "c3")


@query("SELECT * FROM (VALUES ('x', 'y', 0), ('y', 'x', 1)) AS v(hash, parent_hash, depth)")
def vc_log_cycle(t):
    return diff.history(t.spark.createDataFrame([("x", "y"), ("y", "x")], "hash string, parent_hash string"), "x")


# Sources and sinks


@query("SELECT * FROM nation")
def csv_roundtrip(t):
    from .plans.store import scratch
    from .sources.delimited import read_csv, write_csv

    nation, path = t.nation, f"{scratch(t.spark)}/csv"
    write_csv(nation, path)
    return read_csv(t.spark, path, like=nation)


# Plain SQL, as `Store.execute` passes it on


def sql(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES if f"{{{n}}}" in text}
        return spark.sql(text, **used)

    QUERIES[name] = run
    ORACLE_SQL[name] = (oracle or text).replace("{", "").replace("}", "")


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def update_where_limit(t):
    return dml.update_where(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), {"o_orderstatus": "X"}, "o_totalprice > 100000", 50, "o_totalprice DESC, o_orderkey")


sql("sql_join_inner", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
sql("sql_join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
sql("sql_join_full", "SELECT c_custkey, s_suppkey FROM (SELECT * FROM {customer} WHERE c_custkey <= 50) FULL JOIN (SELECT * FROM {supplier} WHERE s_suppkey > 25) ON c_custkey = s_suppkey")
sql("sql_join_full_all", "SELECT c_custkey, s_suppkey FROM {customer} FULL JOIN {supplier} ON c_custkey = s_suppkey AND c_acctbal > 0")
sql("sql_join_semi", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("sql_join_anti", "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
sql("sql_join_range", "SELECT a.event_id AS first_id, b.event_id AS second_id FROM {events} a JOIN {events} b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
sql("sql_group_by_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM {lineitem} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
sql("sql_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}")
sql("sql_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority || o_orderstatus) AS kinds FROM {orders} GROUP BY o_orderstatus")
sql("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("sql_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("sql_window_rank", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)", "SELECT c_custkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
sql("sql_window_lag", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM {events}")
sql("sql_window_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM {events}")
sql("sql_ntile", "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS quarter FROM {supplier}", "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS INTEGER) AS quarter FROM supplier")
sql("sql_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql("sql_intersect", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}")
sql("sql_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")
sql("sql_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {orders})")
sql("sql_correlated", "SELECT n_name, (SELECT count(*) FROM {customer} WHERE c_nationkey = n_nationkey) AS customers FROM {nation}")
sql("sql_cte_recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r")
sql("sql_case_coalesce", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM {customer}")
sql("sql_strings", "SELECT p_partkey, upper(p_name) AS up, substr(p_brand, 1, 5) AS pre, trim(p_type) AS t, replace(p_brand, 'Brand', 'B') AS b, concat_ws('/', p_brand, p_type) AS joined, length(p_name) AS n FROM {part}",
    "SELECT p_partkey, upper(p_name) AS up, substr(p_brand, 1, 5) AS pre, trim(p_type) AS t, replace(p_brand, 'Brand', 'B') AS b, concat_ws('/', p_brand, p_type) AS joined, CAST(length(p_name) AS INTEGER) AS n FROM part")
sql("sql_like", "SELECT p_partkey FROM {part} WHERE p_name LIKE '%1%' AND p_type NOT LIKE 'S%' AND p_brand ILIKE 'brand%'")
sql("sql_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS first_day FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01'",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS first_day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
sql("sql_math", "SELECT s_suppkey, abs(s_acctbal) AS a, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, round(sqrt(abs(s_acctbal)), 6) AS r, s_suppkey % 7 AS m FROM {supplier}",
    "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, round(sqrt(abs(s_acctbal)), 6) AS r, s_suppkey % 7 AS m FROM supplier")
sql("sql_aggregate_filter", "SELECT event_type, count(*) FILTER (WHERE value > 250) AS high, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS sd FROM {events} GROUP BY event_type")
sql("sql_json", "SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM {events} GROUP BY 1", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
sql("sql_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM {lineitem}) PIVOT (count(l_quantity) AS n FOR l_linestatus IN ('O' AS o, 'F' AS f))",
    "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(t):
    from .streaming.windows import tumbling

    return tumbling(t.events, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")])


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def window_session(t):
    from .streaming.windows import sessions

    return sessions(t.events, "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def topk_per_group(t):
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("n", F.row_number().over(best)).where("n <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


from . import stored  # noqa: E402, F401 - registers the queries that run on a store
