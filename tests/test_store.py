import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylab.plans.store import Store
from quarrylab.types import ConflictError, IntegrityError, pandas_declaration


@pytest.fixture
def store(spark, tmp_path):
    with Store(spark, tmp_path / "store") as s:
        yield s


@pytest.fixture
def items(store):
    store.create_table("items", {"id": "INTEGER PRIMARY KEY", "name": "TEXT", "value": "REAL"})
    store.insert_many("items", [{"name": f"item_{i}", "value": float(i)} for i in range(20)])
    return store


def test_filter_order_and_page(items):
    assert len(items.get_rows("items", where="value > 10", return_as="list")) == 9
    top = items.get_rows("items", order_by="value DESC", limit=5, return_as="dict")
    assert [r["value"] for r in top] == [19.0, 18.0, 17.0, 16.0, 15.0]
    assert items.get_rows("items", order_by="id", limit=5, offset=10).count() == 5


def test_keys_are_given_to_rows_without_one(items):
    ids = [r["id"] for r in items.get_rows("items", ["id"], return_as="dict")]
    assert len(set(ids)) == 20 and None not in ids


def test_modes(spark, tmp_path, items):
    with pytest.raises(ValueError):
        Store(spark, tmp_path, mode="x")
    with pytest.raises(FileNotFoundError):
        Store(spark, tmp_path / "none", mode="rw")
    reader = Store(spark, items.root, mode="ro")
    assert reader.get_row_count("items") == 20
    with pytest.raises(ValueError):
        reader.insert("items", {"name": "x"})


def test_rollback_and_commit(items):
    with pytest.raises(RuntimeError):
        with items.transaction():
            items.insert("items", {"name": "x", "value": 1.0})
            assert items.get_row_count("items") == 21
            raise RuntimeError
    assert items.get_row_count("items") == 20
    with items.transaction():
        items.insert("items", {"name": "x", "value": 1.0})
    items.reconnect()
    assert items.get_row_count("items") == 21


def test_changes_of_rows(items):
    assert items.update_where("items", {"name": "high"}, "value >= 15") == 5
    assert items.get_row_count("items", "name = 'high'") == 5
    assert items.delete_where("items", "name = 'high'", limit=2) == 2
    assert items.get_row_count("items") == 18
    first = items.get_rows("items", order_by="value", limit=1, return_as="dict")[0]
    items.update_many("items", [{"id": first["id"], "value": -1.0}, {"id": first["id"], "value": -2.0}])
    assert items.get_rows("items", ids=first["id"], return_as="dict")[0]["value"] == -2.0
    items.replace_many("items", [{"id": first["id"], "name": "a"}, {"id": first["id"], "name": "b"}, {"id": 5000, "name": "c"}])
    assert items.get_row_count("items") == 19
    assert items.get_rows("items", ids=first["id"], return_as="list")[0][1:] == ("b", None)
    for wrong in ("", None):
        with pytest.raises(ValueError):
            items.delete_where("items", wrong)


def test_nothing_to_insert(items):
    items.insert_many("items", [])
    items.insert_many("items", [{"name": "x", "value": 1.0}], where="value > 5")
    assert items.get_row_count("items") == 20
    with pytest.raises(ValueError):
        items.insert("items", {"nothing": 1})


def test_unique_index_and_primary_key(items):
    items.create_index("items", "name", unique=True)
    with pytest.raises(IntegrityError):
        items.insert("items", {"name": "item_3"})
    with pytest.raises(IntegrityError):
        items.insert_many("items", [{"id": 900, "name": "p"}, {"id": 900, "name": "q"}])
    items.insert_many("items", [{"name": None}, {"name": None}])  # nulls are never equal
    items.drop_index("idx_items_name")
    items.insert("items", {"name": "item_3"})


def test_foreign_keys(store):
    store.create_table("departments", {"id": "INTEGER PRIMARY KEY", "name": "TEXT"})
    store.create_table("employees", {"id": "INTEGER PRIMARY KEY", "name": "TEXT", "dept_id": "INTEGER"}, [{"tgt_column": "dept_id", "src_table": "departments", "src_column": "id"}])
    store.insert("departments", {"id": 1, "name": "Engineering"})
    store.insert("employees", {"name": "A", "dept_id": 1})
    store.insert("employees", {"name": "B", "dept_id": None})
    with pytest.raises(IntegrityError):
        store.insert("employees", {"name": "C", "dept_id": 999})
    store.disable_foreign_keys()
    store.insert("employees", {"name": "C", "dept_id": 999})
    health = store.check_health()
    assert health["health_score"] == 80 and health["status"] == "HEALTHY" and "1 rows without" in health["issues"][0]


def test_not_null_and_defaults(store):
    store.create_table("t", {"id": "INTEGER PRIMARY KEY", "name": "TEXT NOT NULL", "n": "INTEGER DEFAULT 7"})
    store.insert("t", {"name": "x"})
    assert store.get_rows("t", return_as="dict")[0]["n"] == 7
    with pytest.raises(IntegrityError):
        store.insert("t", {"name": None})


def test_columns(items):
    assert items.add_column("items", "note", "TEXT DEFAULT 'none'")
    assert not items.add_column("items", "note", "TEXT")
    assert not items.add_column("items", "must", "TEXT NOT NULL")
    assert items.rename_column("items", "value", "amount") and not items.rename_column("items", "value", "x")
    assert items.reorder_columns("items", ["note", "amount", "name", "id"]) and not items.reorder_columns("items", ["id"])
    assert items.sort_columns("items", key_columns_first=["id"])
    assert items.read("items").columns == ["id", "amount", "name", "note"]
    assert items.drop_columns("items", ["note", "amount"]) and not items.drop_column("items", "gone")
    assert [c["name"] for c in items.get_column_info("items")] == ["id", "name"] and items.get_primary_key("items") == "id"
    assert items.add_column("items", "data", "BLOB") and items.column_exists("items", "data_hash")


def test_duplicates(store):
    store.create_table("people", {"id": "INTEGER PRIMARY KEY", "name": "TEXT", "value": "REAL"})
    names = ["Alice", "Bob", "Alice", "Charlie", "Bob", "Alice"]
    store.insert_many("people", [{"id": i, "name": n, "value": {"A": 100.0, "B": 200.0, "C": 300.0}[n[0]]} for i, n in enumerate(names, 1)])
    assert store.delete_duplicates("people") == (6, 3) and store.get_row_count("people") == 6
    assert store.delete_duplicates("people", dry_run=False) == (3, 3)
    assert sorted(r[0] for r in store.get_rows("people", ["id"], return_as="list")) == [1, 2, 4]
    store.sort_table("people", "name DESC")
    assert store.get_primary_key("people") == "id"


def test_empty_table(store):
    store.create_table("none", {"id": "INTEGER PRIMARY KEY", "name": "TEXT"})
    assert store.delete_duplicates("none", dry_run=False) == (0, 0) and store.get_row_count("none") == 0


def test_arrays(store):
    store.create_table("arrays", {"id": "INTEGER PRIMARY KEY", "name": "TEXT", "data": "BLOB"})
    array = np.random.default_rng(0).random((10, 20)).astype(np.float32)
    store.insert("arrays", {"id": 1, "name": "array_test"})
    store.save_array("arrays", array, "data", ids=1, compress=True)
    loaded = store.load_array("arrays", "data", ids=1)
    assert loaded.dtype == np.float32 and loaded.shape == (1, 10, 20) and (loaded[0] == array).all()
    assert store.verify_array_hash("arrays", "data", 1)
    store.insert("arrays", {"id": 2, "name": "empty"})
    assert np.isnan(store.load_array("arrays", "data")[1]).all()
    store.update_where("arrays", {"data_hash": "0" * 16}, "id = 1")
    assert not store.verify_array_hash("arrays", "data", 1)
    with pytest.raises(ValueError):
        store.save_array("arrays", [1, 2], "data")


def test_objects(store):
    big = np.arange(2000.0)
    store.save_blob("objects", {"x": 1}, "small", compress=True)
    store.save_blob("objects", big, "big", compress=True, metadata={"k": 1})
    store.save_blob("objects", {"x": 2}, "small")
    kept = {r["key"]: r for r in store.get_rows("objects", return_as="dict")}
    assert len(kept) == 2 and kept["small"]["compressed"] == 0 and kept["big"]["compressed"] == 1
    assert (store.load_blob("objects", "big") == big).all() and store.load_blob("objects")["small"] == {"x": 2}
    with pytest.raises(KeyError):
        store.load_blob("objects", "none")
    with pytest.raises(ValueError):
        store.save_blob("objects", {1, 2}, "set")
    store.save_blob("objects", {1, 2}, "set", pickled=True)
    assert store.load_blob("objects", "set", pickled=True) == {1, 2}


def test_csv(items, tmp_path):
    path = str(tmp_path / "out.csv")
    items.save_to_csv("items", path, where="value < 10", single=True, null="")
    items.create_table("imported", {"name": "TEXT", "value": "REAL"})
    items.load_from_csv("imported", path)
    assert items.get_row_count("imported") == 10 and items.read("imported").columns == ["name", "value"]
    with pytest.raises(FileNotFoundError):
        items.load_from_csv("imported", str(tmp_path / "none.csv"))


def test_pandas(store):
    df = pd.DataFrame({"a": [1, 2], "b": [0.5, 1.5], "c": ["x", "y"], "d": [True, False], "e": pd.to_datetime(["2024-01-01", "2024-01-02"])})
    assert [pandas_declaration(t) for t in df.dtypes] == ["INTEGER", "REAL", "TEXT", "BOOLEAN", "TIMESTAMP"]
    store.dataframe_to_sql(df, "frame")
    assert store.get_row_count("frame") == 2
    with pytest.raises(ValueError):
        store.dataframe_to_sql(df, "frame")
    store.dataframe_to_sql(df, "frame", if_exists="append")
    assert store.get_row_count("frame") == 4
    with pytest.raises(ValueError):
        store.dataframe_to_sql(df, "frame", if_exists="other")


def test_sql(items):
    assert items.execute_query("SELECT count(*) AS n FROM items WHERE value > ?", [15]) == [{"n": 4}]
    assert items.execute_query('SELECT "name" FROM items WHERE value = :v', {"v": 3.0}) == [{"name": "item_3"}]
    before = items.get_row_count("items")
    assert items.execute("DELETE FROM items WHERE value > ?", [15]) == 4 and items.get_row_count("items") == before - 4


def test_versions(items):
    items.git_init()
    first = items.git_commit("first")
    assert items.git_commit("again") is None
    items.update_where("items", {"name": "changed"}, "value = 3")
    items.delete_where("items", "value = 4")
    items.insert("items", {"name": "new"})
    assert items.git_status()["changes"] == {"items": {"UPDATE": 1, "DELETE": 1, "INSERT": 1}}
    second = items.git_commit("second")
    assert items.git_log(oneline=True) == [f"{second} second", f"{first} first"]
    items.git_branch("old")
    items.git_checkout(first)
    assert items.get_row_count("items", "name = 'changed'") == 0 and items.get_row_count("items") == 20
    items.git_checkout("main")
    assert items.get_row_count("items", "name = 'changed'") == 1
    assert {r["op"]: r["count"] for r in items.git_diff(first, second)["items"].groupBy("op").count().collect()} == {"UPDATE": 1, "DELETE": 1, "INSERT": 1}
    items.git_reset(first, "hard")
    assert items.get_row_count("items", "name = 'item_4'") == 1
    assert items.git_branch() == ["main", "old"]
    with pytest.raises(ValueError):
        items.git_checkout("nowhere")


def test_upkeep(items, spark, tmp_path):
    items.update_where("items", {"name": "x"}, "value = 1")
    assert items.vacuum() > 0
    items.backup(tmp_path / "copy")
    assert Store(spark, tmp_path / "copy", mode="ro").get_row_count("items") == 20
    items.optimize()
    assert items.get_table_stats("items")["row_count"] == 20
    report = items.inspect(sample_size=3)[0]
    assert report["row_count"] == 20 and len(report["sample_data"]) == 3
    assert items.inspect(skip_count=True)[0]["row_count"] == "Not counted"
    assert len(items.get_summaries()["items"]) == 5
    items.copy_table("items", "few", "value > 15")
    assert items.get_row_count("few") == 4
    items.rename_table("few", "some")
    items.drop_table("some")
    assert items.get_table_names() == ["items"]


def test_inner_rollback_keeps_the_outer_changes(items):
    items.create_index("items", "name", unique=True)
    with items.transaction():
        items.insert("items", {"name": "outer"})
        with pytest.raises(IntegrityError):
            items.insert("items", {"name": "item_3"})
        items.insert("items", {"name": "after"})
    items.reconnect()
    assert items.get_row_count("items", "name in ('outer', 'after')") == 2 and items.get_row_count("items") == 22


def test_conflicting_commits(spark, items):
    other = Store(spark, items.root)
    items.begin(), other.begin()
    items.insert("items", {"name": "one"})
    other.insert("items", {"name": "two"})
    items.commit()
    with pytest.raises(ConflictError):
        other.commit()
    assert other._depth == 0 and other.get_row_count("items", "name = 'one'") == 0
    other.insert("items", {"name": "two"})  # each change begins with what is there
    items.reconnect()
    assert items.get_row_count("items", "name in ('one', 'two')") == 2


def test_vacuum_leaves_open_transactions(spark, items):
    items.delete_where("items", "id < 3")
    with items.transaction():
        with pytest.raises(ValueError):
            items.vacuum()
    assert items.vacuum() == 1 and items.get_row_count("items") > 0


def test_update_many_leaves_columns_that_a_dict_does_not_name(store):
    store.create_table("t", {"id": "INTEGER PRIMARY KEY", "a": "TEXT", "b": "TEXT"})
    store.insert_many("t", [{"id": 1, "a": "x", "b": "y"}, {"id": 2, "a": "x", "b": "y"}, {"id": 3, "a": "x", "b": "y"}])
    store.update_many("t", [{"id": 1, "a": "A"}, {"id": 2, "b": "B"}, {"id": 3, "a": "A", "b": "B"}, {"id": 3, "a": None}])
    assert store.get_rows("t", order_by="id", return_as="list") == [(1, "A", "y"), (2, "x", "B"), (3, None, "B")]


def test_replace_many_by_unique_values(store):
    store.create_table("t", {"id": "INTEGER PRIMARY KEY", "name": "TEXT UNIQUE", "n": "INTEGER"})
    store.insert_many("t", [{"id": 1, "name": "a", "n": 1}, {"id": 2, "name": "b", "n": 2}, {"id": 3, "name": None, "n": 3}])
    # As rows put in one after the other: (7, c) takes c's place from (6, c), and (7, d) that of (7, c).
    store.replace_many("t", [{"id": 5, "name": "a", "n": 5}, {"id": 6, "name": "c", "n": 6}, {"id": 7, "name": "c", "n": 7}, {"id": 7, "name": "d", "n": 8}, {"id": 9, "name": None, "n": 9}])
    assert store.get_rows("t", order_by="id", return_as="list") == [(2, "b", 2), (3, None, 3), (5, "a", 5), (7, "d", 8), (9, None, 9)]


def test_keys_of_objects_are_no_sql(store):
    store.save_blob("objects", {"a": 1}, "O'Brien")
    store.save_blob("objects", {"a": 2}, "x' OR '1'='1")
    assert store.load_blob("objects", "O'Brien") == {"a": 1}
    with pytest.raises(KeyError):
        store.load_blob("objects", "y' OR '1'='1")


def test_parents_renamed_and_dropped(store):
    store.create_table("p", {"id": "INTEGER PRIMARY KEY"})
    store.create_table("c", {"id": "INTEGER PRIMARY KEY", "p_id": "INTEGER"}, [{"tgt_column": "p_id", "src_table": "p", "src_column": "id"}])
    store.insert("p", {"id": 1})
    store.rename_table("p", "q")
    store.insert("c", {"p_id": 1})
    with pytest.raises(IntegrityError):
        store.insert("c", {"p_id": 2})
    with pytest.raises(IntegrityError):
        store.drop_table("q")
    store.delete_where("c", "p_id = 1")
    store.drop_table("q")
    store.insert("c", {"p_id": 2})


def test_numbers_of_rows_from_several_tasks(spark, store):
    store.create_table("t", {"id": "INTEGER PRIMARY KEY", "n": "INTEGER"})
    many = spark.range(0, 900, numPartitions=7).select(F.when(F.col("id") == 5, 5000).alias("id"), F.col("id").alias("n"))
    store.insert_many("t", many)
    store.insert("t", {"n": 900})
    got = store.get_rows("t", order_by="n", return_as="list")
    assert got == [(n + 1 if n < 5 else 4995 + n, n) for n in range(901)]  # after a larger key, from there


def test_scripts_end_statements_outside_literals(store):
    found = store.executescript("SELECT 'a;b' AS x; -- a comment; with one\nSELECT 2 AS x /* ; */;\n;  -- nothing\n")
    assert [r.first()["x"] for r in found] == ["a;b", 2]


def test_update_of_the_first_rows(items):
    assert items.update_where("items", {"name": "low"}, "value >= 5", limit=3) == 3
    assert items.get_rows("items", ["value"], where="name = 'low'", order_by="value", return_as="list") == [(5.0,), (6.0,), (7.0,)]
    assert items.get_row_count("items") == 20
    assert items.update_where("items", {"name": "high"}, "value >= 18", limit=9) == 2
    with pytest.raises(ValueError):
        items.update_where("items", {"name": "x"}, "value > 1", limit=0)


def test_arrays_of_several_ids_and_frames(store):
    store.create_table("t", {"id": "INTEGER PRIMARY KEY", "data": "BLOB"})
    several = [np.arange(6.0).reshape(2, 3) + n for n in range(3)]
    store.save_array("t", several[0] * 9, ids=2)
    store.save_array("t", several, ids=[1, 2, 5])
    assert np.array_equal(store.load_array("t", ids=[5, 1, 2]), np.stack([several[2], several[0], several[1]]))
    for wrong in ([1, 2], [1, 2, 2], None):
        with pytest.raises(ValueError):
            store.save_array("t", several, ids=wrong)
    frame = store.get_rows("t", order_by="id", return_as="dataframe")
    assert np.array_equal(store.get_array_dict(frame)["data"], np.stack(several))
    decoded = store.decode_array_columns(frame)
    assert decoded["data"][1].shape == (2, 3) and isinstance(frame["data"][1], (bytes, bytearray))
    plain = pd.DataFrame({"x": [np.arange(4, dtype="int16").tobytes(), None]})
    assert store.decode_array_columns(plain, ["x"], "int16", (2, 2))["x"].tolist()[0].tolist() == [[0, 1], [2, 3]]
    with pytest.raises(ValueError):
        store.decode_array_columns(plain, ["x"])
    assert store.is_rows_loadable("t") and store.is_arrays_loadable() and store.is_blobs_loadable()
    store.update_where("t", {"data_hash": "0"}, "id = 5")
    assert store.is_rows_loadable("t") and not store.is_arrays_loadable("t") and not store.is_loadable()


def test_objects_that_do_not_unpack(store):
    store.save_blob("objects", list(range(2000)), "k", compress=True)
    assert store.is_blobs_loadable("objects")
    store.update_where("objects", {"data": b"damaged"}, "key = 'k'")
    assert not store.is_blobs_loadable("objects") and store.is_rows_loadable("objects")


def test_copies(items, tmp_path):
    with pytest.raises(ValueError), items.transaction():
        items.vacuum(tmp_path / "within")
    assert items.vacuum(tmp_path / "copy") == 0
    with items.working_copy(tmp_path / "work") as work:
        work.delete_where("items", "value > 3")
        assert work.get_row_count("items") == 4
    assert items.get_row_count("items") == 20
    assert items.get_primary_keys("items") == ["id"]


def test_arrays_in_batches_and_order(spark, store):
    store.create_table("a", {"id": "INTEGER PRIMARY KEY", "data": "BLOB"})
    store.save_array("a", [np.full((2, 3), i, "float32") for i in range(1, 8)], ids=range(1, 8))
    asked = [5, 2, 2, 7, 99, 1]
    assert store.load_array("a", ids=asked)[:, 0, 0].tolist() == [5, 2, 2, 7, 1]
    batches = list(store.load_arrays("a", "data", asked, batch_size=2))
    assert [b["data"][:, 1, 2].tolist() for b in batches] == [[5, 2], [2, 7], [1]]
    assert [len(b) for b in store.load_array("a", batch_size=4)] == [4, 3] and list(store.load_array("a", ids=[99], batch_size=4)) == []
    with pytest.raises(ValueError):
        store.load_arrays("a", batch_size=0)
    store.save_array("a", np.zeros(2), where="id >= 6")
    assert store.load_array("a", ids=[6])[0].tolist() == [0, 0] and store.load_array("a", ids=[5])[0].shape == (2, 3) and store.verify_array_hash("a", "data", 7)


@pytest.mark.parametrize("compress", [False, True])
def test_chunks(store, compress):
    rng = np.random.default_rng(2)
    kept = {1: rng.normal(size=(1000, 3)), 2: np.arange(7, dtype="int16"), 3: np.zeros((0, 4), "float32"), 4: np.array(5.0), 5: rng.normal(size=(3, 500, 2))}
    store.save_chunks("big", kept, chunk_bytes=4000, compress=compress)
    assert store.get_row_count("big", "id = 1") == 7 and store.get_row_count("big", "id = 5") == 3  # a row of 8,000 bytes is a chunk
    for first, last in [(0, None), (0, 1), (5, 400), (166, 167), (2, 3), (999, 2000), (5000, None)]:
        got = store.load_slice("big", first, last)
        for i, a in kept.items():
            want = a if a.ndim == 0 and first == 0 else None if a.ndim == 0 else a[first:last]
            if want is not None and want.size:
                assert got[i].dtype == a.dtype and np.array_equal(got[i], want)
            else:
                assert i not in got
    store.save_chunks("big", {2: np.arange(3)})
    assert store.load_slice("big", ids=[2, 1], last=2)[2].tolist() == [0, 1] and store.load_slice("big", ids=2).keys() == {2}
    plan = store.read("big").where("stop > 5 and start < 9")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(stop,5)" in plan and "LessThan(start,9)" in plan
    with pytest.raises(ValueError):
        store.load_slice("big", 5, 4)


def test_csv_files_keep_nulls_and_empty_texts(store, tmp_path):
    store.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT, x REAL, b BLOB)")
    store.insert_many("t", [{"id": 1, "s": "", "x": 1.5, "b": b"\x00\xff"}, {"id": 2, "s": None}, {"id": 3, "s": 'a,"b"\nc', "x": None}])
    for single in (False, True):
        path = str(tmp_path / f"out-{single}")
        store.save_to_csv("t", path, single=single)
        store.create_table(f"back{single}", {"id": "INTEGER PRIMARY KEY", "s": "TEXT", "x": "REAL", "b": "BLOB"})
        store.load_from_csv(f"back{single}", path, null="\\N")
        rows = lambda name: sorted((r.id, r.s, r.x, r.b) for r in store.read(name).collect())
        assert rows(f"back{single}") == rows("t")
    store.save_to_csv("t", str(tmp_path / "some.csv"), ["id", "x * 2 AS double"], where="id < 3", single=True, null="none")
    assert (tmp_path / "some.csv").read_text() == "id,double\n1,3.0\n2,none\n"


def test_column_statistics(spark, store):
    store.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT, x REAL)")
    store.insert_many("t", spark.range(5000).selectExpr("id", "CASE WHEN id % 10 > 0 THEN concat('s', id % 100) END AS s", "id / 2 AS x"))
    assert store.analyze("t") == 1 and store.analyze("t") == 0
    store.insert_many("t", spark.range(5000, 20000).selectExpr("id", "'often' AS s", "CAST(NULL AS DOUBLE) AS x"))
    assert store.analyze() == 1  # the new file alone
    found = {r.column: r for r in store.get_column_stats("t").collect()}
    assert (found["id"].n, found["id"].nulls, found["id"].least, found["id"].greatest) == (20000, 0, 0, 19999) and abs(found["id"].distinct - 20000) < 600
    assert all(abs(q - 20000 * share) < 300 for q, share in zip(found["id"].quantiles, (0.25, 0.5, 0.75)))
    assert (found["s"].nulls, found["s"].least_text, found["s"].greatest_text, found["s"].quantiles) == (500, "often", "s99", None) and abs(found["s"].distinct - 91) < 3
    assert found["s"].frequent[0].item == "often" and found["s"].frequent[0]["count"] == 15000 and found["x"].nulls == 15000
    store.vacuum()
    assert store.analyze() == 0 and store.get_column_stats("t").count() == 3
    store.optimize(analyze=True)
    assert store.analyze() == 0
    with pytest.raises(ValueError):
        store.execute("CREATE TABLE none (a INTEGER)")
        store.get_column_stats("none")


def test_entries_and_duplicates_by_path(spark, store):
    from quarrylab.plans.store import delete_sqlite3_duplicates

    store.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    store.execute("INSERT INTO t VALUES (1, 'x'), (1, 'x'), (2, NULL), (1, 'x')")
    assert store.verify_duplicated_index("t", {"a": 1, "b": "x"}) and not store.verify_duplicated_index("t", {"a": 2, "b": None})
    assert store.delete_entry("t", {"a": 1}) and store.get_row_count("t") == 4
    assert store.delete_entry("t", {"a": 1}, dry_run=False) and store.get_row_count("t") == 3 and not store.delete_entry("t", {"a": 9}, dry_run=False)
    assert delete_sqlite3_duplicates(spark, store.root, "t") == (3, 1) and store.get_row_count("t") == 3
    assert delete_sqlite3_duplicates(spark, store.root, "t", dry_run=False) == (2, 1)
    assert delete_sqlite3_duplicates(spark, "/nowhere/at/all", "t") == (None, None) == delete_sqlite3_duplicates(spark, store.root, "none")


def rows_scanned(df):
    """Rows that the scans of a plan gave out, by Spark's own count."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        while leaf.getClass().getSimpleName().endswith("QueryStageExec") or leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            leaf = leaf.executedPlan() if leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else leaf.plan()
        metrics = leaf.metrics()
        if metrics.contains("numOutputRows"):
            found += metrics.apply("numOutputRows").value()
    return found


def test_indexes_skip_files(spark, store):
    """Files whose bounds hold a key, but not the key: a Bloom filter tells."""
    def fill(table, indexed):
        store.execute(f"CREATE TABLE {table} (id INTEGER, code TEXT, v INTEGER)")
        if indexed:
            store.create_index(table, "code")
        for part in range(4):
            store.insert_many(table, spark.range(part, 4000, 4).selectExpr("id", "concat('c', id) AS code", "id % 7 AS v").coalesce(1))
        return rows_scanned(store.get_rows(table, where="code = 'c1234'"))

    assert fill("plain", False) == 4000 and fill("quick", True) <= 1000
    store.create_index("quick", "id", unique=True)
    assert rows_scanned(store.read("quick").where("code IN ('c5', 'none')")) <= 1000
    with pytest.raises(IntegrityError):
        store.insert("quick", {"id": 77, "code": "again"})
    store.insert("quick", {"id": 5000, "code": "c5000"})


def test_objects_in_bulk(spark, store):
    import json

    made = [("a", json.dumps({"x": 1, "tags": ["p", "q"]}), json.dumps({"from": "here"})), ("b", json.dumps({"x": 2.5, "long": "y" * 5000}), None), ("c", json.dumps([1, 2]), None), ("d", None, None)]
    store.save_objects("o", spark.createDataFrame(made, "key string, json string, metadata string"), compress=True)
    store.save_blob("o", np.arange(3), "array")
    assert store.load_blob("o", "b")["long"] == "y" * 5000 and store.load_blob("o", "c") == [1, 2] and store.load_blob("o", "a") == {"x": 1, "tags": ["p", "q"]}
    found = store.read_objects("o").selectExpr("key", "try_variant_get(value, '$.x', 'double') AS x", "try_variant_get(value, '$.tags[1]', 'string') AS tag", "try_variant_get(metadata, '$.from', 'string') AS src", "variant_get(metadata, '$.original_size', 'int') AS size").collect()
    assert sorted(map(tuple, found), key=str) == sorted([("a", 1.0, "q", "here", None), ("b", 2.5, None, None, len(made[1][1])), ("c", None, None, None, None), ("array", None, None, None, None)], key=str)
    assert store.read_objects("o", keys=["a", "zz"]).count() == 1 and store.read_objects("o", where="key LIKE 'A%'").count() == 2
    numbers = {r.key: r.rowid for r in store.execute("SELECT key, rowid FROM o").collect()}
    assert set(store.load_blob("o", ids=[numbers["a"], numbers["c"]])) == {"a", "c"} and set(store.load_blob("o", ids=numbers["b"])) == {"b"}
    store.save_objects("o", spark.createDataFrame([("a", '"new"')], "key string, json string"))
    assert store.load_blob("o", "a") == "new" and store.get_row_count("o") == 4
