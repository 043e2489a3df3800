import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylab.functions import arrays
from quarrylab.operators import columns, constraints, dedup, diff, dml, rows
from quarrylab.streaming.windows import tumbling
from quarrylab.types import parse, spark_type


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0), (4, "a", 1.0), (5, None, 3.0)], "id long, name string, value double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_order_of_nulls(people):
    assert [r["id"] for r in rows.get_rows(people, order_by="value, id").collect()] == [2, 1, 4, 3, 5]
    assert [r["id"] for r in rows.get_rows(people, order_by="coalesce(value, 9) DESC, id DESC NULLS FIRST").collect()] == [2, 5, 3, 4, 1]


def test_nulls_in_predicates(people):
    assert ids(dml.delete_where(people, "value > 2")) == [1, 2, 4]
    changed = dml.update_where(people, {"name": "z"}, "value > 2")
    assert ids(changed.where("name = 'z'")) == [3, 5]
    with pytest.raises(ValueError):
        dml.update_where(people, {}, "true")
    for limit in (0, -1, True, "2"):
        with pytest.raises(ValueError):
            dml.delete_where(people, "true", limit=limit, order_by="id")
    assert ids(dml.delete_where(people, "name = 'a'", limit=1, order_by="id")) == [2, 3, 4, 5]


def test_inherit(spark):
    parent = spark.createDataFrame([(7, "x"), (8, "x"), (9, None)], "pid long, name string")
    new = spark.createDataFrame([("x", None), ("x", 1), (None, None), ("y", None)], "name string, pid long")
    got = dml.inherit_foreign(new, parent, "pid", "pid", "name").select("name", "pid")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", 7), ("x", 1), (None, None), ("y", None)], key=str)


def test_replace_and_update(people, spark):
    new = spark.createDataFrame([(1, "n", 1), (1, "m", 2), (9, "o", 3)], "id long, name string, at int")
    got = {r["id"]: (r["name"], r["value"]) for r in dml.replace_rows(people, new, ["id"], "at").collect()}
    assert got[1] == ("m", None) and got[9] == ("o", None) and len(got) == 6
    got = {r["id"]: r["name"] for r in dml.update_keyed(people, new.drop("at").withColumn("name", F.lit(None).cast("string")).limit(1), ["id"]).collect()}
    assert got[1] is None and got[2] == "b"


def test_duplicates_with_nulls(people):
    assert ids(dedup.keep_first(people, ["name", "value"], "id")) == [1, 2, 3]
    assert ids(dedup.duplicates(people, ["name", "value"], "id")) == [4, 5]
    assert tuple(dedup.duplicate_rate(people, ["name", "value"]).first()) == (5, 2, 2 / 3)
    assert tuple(dedup.duplicate_rate(people.limit(0), ["name"]).first()) == (0, 0, 0.0)
    assert ids(dedup.delete_one(people, {"name": "a", "value": 1.0}, "id")) == [2, 3, 4, 5]
    assert ids(dedup.delete_one(people, {"name": None}, "id")) == [1, 2, 3, 4, 5]
    assert dedup.key_columns(people.withColumn("made_at", F.lit(1)).withColumn("b", F.lit(b"x")), "all", ["id"]) == ["name", "value"]


def test_hundred_rows(spark):
    df = spark.range(100).select("id", F.concat(F.lit("Person_"), F.col("id") % 20).alias("name"), (F.col("id") % 10).cast("double").alias("value"))
    assert dedup.keep_first(df, ["name", "value"], "id").count() == 20


def test_constraints(people):
    assert constraints.unique_violations(people, ["name"]).collect()[0]["n"] == 2
    assert {r["column_name"]: r["nulls"] for r in constraints.null_violations(people, ["name", "value"]).collect()} == {"name": 2, "value": 1}
    assert ids(constraints.foreign_key_violations(people, "name", people.where("id = 2"), "name")) == [1, 4]


def test_columns(people):
    with pytest.raises(ValueError):
        columns.drop_columns(people, ["id", "name", "value"])
    assert columns.add_column(people, "d", "BLOB").columns[-4:] == ["d_dtype", "d_shape", "d_is_compressed", "d_hash"]
    assert columns.sort_columns(people, reverse=True).columns == ["value", "name", "id"]


def test_declarations():
    found = parse("VARCHAR(10) NOT NULL UNIQUE DEFAULT 'it''s'")
    assert found == ("VARCHAR", False, True, True, "'it''s'")
    assert spark_type("REAL CHECK(x > 0)").typeName() == "double" and spark_type("whatever").typeName() == "string"


def test_diff(people, spark):
    after = people.where("id <> 2").withColumn("value", F.when(F.col("id") == 1, None).otherwise(F.col("value"))).unionByName(spark.createDataFrame([(9, "n", 0.0)], people.schema))
    assert {r["id"]: r["op"] for r in diff.diff(people, after, ["id"]).collect()} == {1: "UPDATE", 2: "DELETE", 9: "INSERT"}
    assert diff.diff(people, people, ["id"]).isEmpty()
    assert diff.table_hash(people).first() == diff.table_hash(people.orderBy(F.desc("id"))).first() != diff.table_hash(after).first()


@pytest.mark.parametrize("dtype", ["float32", "float64", "int64", "uint8", "bool", "complex64"])
@pytest.mark.parametrize("compress", [True, False])
def test_cells(dtype, compress):
    array = np.arange(600).reshape(20, 30).astype(dtype)
    cell = arrays.encode(array, compress)
    cell.pop("hash")
    back = arrays.decode(cell["data"], cell["dtype"], cell["shape"], "1" if cell["is_compressed"] else "0")
    assert back.dtype == array.dtype and (back == array).all()
    assert cell["is_compressed"] == (compress and array.nbytes > 1024)


def test_stack():
    a = np.ones((2, 3))
    assert arrays.stack([None, a]).shape == (2, 2, 3) and arrays.stack([None]) is None
    with pytest.raises(ValueError):
        arrays.stack([a, np.ones((3, 2))])
    with pytest.raises(ValueError):
        arrays.stack([a.astype(int), None])


def test_stream(spark, tmp_path):
    """The same windows on a stream of files as on the batch."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    made = tumbling(stream, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")], late="1 hour")
    running = made.writeStream.format("memory").queryName("days").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    batch = tumbling(events, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")])
    assert sorted(map(str, spark.table("days").collect())) == sorted(map(str, batch.collect()))
