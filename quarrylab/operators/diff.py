"""What has changed between two states of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of keys under a hash tree, and buckets under a node of it.
BUCKETS, FAN = 4096, 64


def row_hash(df: DataFrame, columns: Sequence[str]):
    """A hash of a row's values that tells nulls from texts."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with the operation that leads from before to after: INSERT, UPDATE or DELETE.

    One full join on the key of the rows' hashes: no row is compared but with its own former state.
    """
    columns = [c for c in before.columns if c not in keys]
    now = [c for c in after.columns if c not in keys]
    # A changed list of columns changes all rows.
    old = before.select(*keys, F.concat(F.lit(",".join(sorted(columns))), row_hash(before, sorted(columns))).alias("_old"))
    new = after.select(*keys, F.concat(F.lit(",".join(sorted(now))), row_hash(after, sorted(now))).alias("_new"))
    op = F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "DELETE").when(F.col("_old") != F.col("_new"), "UPDATE")
    return old.join(new, list(keys), "full").select(*keys, op.alias("op")).where("op is not null")


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def table_hash(df: DataFrame) -> DataFrame:
    """(rows, hash): a fingerprint of a table's rows in any order; equal rows count as often as they are there."""
    hashed = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)").alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum("h"), F.lit(0)).cast("string")), 256).alias("hash"))


def history(commits: DataFrame, head: str, limit: int | None = None) -> DataFrame:
    """The commits from head back along (hash, parent_hash), with their depth; a cycle ends where it closes."""
    query = """
    WITH RECURSIVE walk(hash, parent_hash, depth, seen) AS (
      SELECT hash, parent_hash, 0, array(hash) FROM {commits} WHERE hash = :head
      UNION ALL
      SELECT c.hash, c.parent_hash, w.depth + 1, concat(w.seen, array(c.hash)) FROM walk w JOIN {commits} c ON c.hash = w.parent_hash WHERE NOT array_contains(w.seen, c.hash)
    ) SELECT hash, parent_hash, depth FROM walk"""
    found = commits.sparkSession.sql(query, args={"head": head}, commits=commits)
    return found.where(F.col("depth") < limit) if limit is not None else found


# Change sets: rows of (keys, op, columns, before, after)


def _row(df: DataFrame, columns: Sequence[T.StructField]) -> Column:
    """A row's columns as a struct, with null for those that the table lacks."""
    return F.struct(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])


def _fields(keys: Sequence[str], *tables: DataFrame) -> list[T.StructField]:
    """All columns of some tables but the keys, each with its first type."""
    found: dict[str, T.StructField] = {}
    for df in tables:
        for f in df.schema:
            found.setdefault(f.name, f)
    return [f for n, f in found.items() if n not in keys]


def _states(keys: Sequence[str], tables: dict[str, DataFrame]) -> tuple[DataFrame, list[T.StructField]]:
    """Each key with the row that each table has for it, or null: one grouping by the keys, which must be unique in a table."""
    fields = _fields(keys, *tables.values())
    sides = [df.select(*keys, *[(_row(df, fields) if n == name else F.lit(None).cast(T.StructType(fields))).alias(n) for n in tables]) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, sides).groupBy(*keys).agg(*[F.any_value(n, True).alias(n) for n in tables]), fields


def _op(before: str, after: str) -> Column:
    return F.when(F.col(before).isNull() & F.col(after).isNotNull(), "INSERT").when(F.col(before).isNotNull() & F.col(after).isNull(), "DELETE").when(~F.col(before).eqNullSafe(F.col(after)), "UPDATE")


def _differing(before: str, after: str, fields: Sequence[T.StructField]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.col(before)[f.name].eqNullSafe(F.col(after)[f.name]), F.lit(f.name)) for f in fields])) if fields else F.array().cast("array<string>")


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What leads from before to after: keys, op, the columns that differ, and the row before and after, null where there is none.

    Only keys whose rows differ stay. A column that one side lacks is null there.
    """
    both, fields = _states(keys, {"before": before, "after": after})
    found = both.withColumn("op", _op("before", "after")).where("op is not null")
    return found.select(*keys, "op", _differing("before", "after", fields).alias("columns"), "before", "after")


def values(changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each value that differs in a change set: keys, op, column, and the value before and after, as text."""
    fields = changed.schema["after"].dataType.fields
    of = lambda side, f: F.col(side)[f.name].cast("string")
    each = F.array(*[F.struct(F.lit(f.name).alias("column"), of("before", f).alias("before"), of("after", f).alias("after")) for f in fields])
    return changed.select(*keys, "op", "columns", F.explode(each).alias("v")).where(F.array_contains("columns", F.col("v.column"))).select(*keys, "op", "v.column", "v.before", "v.after")


def reverse(changed: DataFrame) -> DataFrame:
    """The change set that leads back."""
    back = F.when(F.col("op") == "INSERT", "DELETE").when(F.col("op") == "DELETE", "INSERT").otherwise(F.col("op"))
    return changed.withColumns({"op": back, "before": F.col("after"), "after": F.col("before")})


def apply(df: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df after a change set: one full join by the keys; rows without a change stay as they are."""
    fields = [f for f in df.schema if f.name not in keys]
    known = [f.name for f in changed.schema["after"].dataType.fields]
    c = changed.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("op").alias("_op"), F.col("after").alias("_after"))
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"_c_{k}") for k in keys])
    joined = df.join(c, on, "full").where("_op is null or _op <> 'DELETE'")
    new = F.col("_op").isNotNull()
    value = lambda f: F.when(new, F.col("_after")[f.name]).otherwise(F.col(f"`{f.name}`")) if f.name in known else F.col(f"`{f.name}`")
    made = {f.name: value(f).cast(f.dataType) for f in fields} | {k: F.coalesce(F.col(f"_c_{k}"), F.col(f"`{k}`")) for k in keys}
    return joined.select(*[made[n].alias(n) for n in df.columns])


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str], prefer: str = "ours") -> tuple[DataFrame, DataFrame]:
    """(change set that leads from ours to the merged table, conflicts) of two tables that come from one.

    What one side alone has changed, added or deleted is taken, column by column. Where both have changed a column, or added
    a key, to different values, or one has deleted a row that the other has changed, `prefer` decides, and
    conflicts has a row: keys, column (null for a whole row), and the values of base, ours and theirs as text.
    """
    three, fields = _states(keys, {"base": base, "ours": ours, "theirs": theirs})
    b, o, t = (F.col(n) for n in ("base", "ours", "theirs"))
    mine, other = (o, t) if prefer == "ours" else (t, o)
    clash = {f.name: ~o[f.name].eqNullSafe(t[f.name]) & ~b[f.name].eqNullSafe(o[f.name]) & ~b[f.name].eqNullSafe(t[f.name]) for f in fields}
    column = lambda f: F.when(o[f.name].eqNullSafe(b[f.name]), t[f.name]).when(t[f.name].eqNullSafe(b[f.name]), o[f.name]).otherwise(mine[f.name]).alias(f.name)
    both = o.isNotNull() & t.isNotNull()
    whole = ~both & b.isNotNull() & ~o.eqNullSafe(t) & ~o.eqNullSafe(b) & ~t.eqNullSafe(b)  # deleted here, changed there
    merged = F.when(o.eqNullSafe(t), o).when(whole, mine).when(o.eqNullSafe(b), t).when(t.eqNullSafe(b), o).when(both & b.isNull(), mine).otherwise(F.struct(*[column(f) for f in fields]))
    made = three.withColumn("after", merged)
    text = lambda side, f: side[f.name].cast("string")
    apart = lambda f: F.when(b.isNull(), ~o[f.name].eqNullSafe(t[f.name])).otherwise(clash[f.name])
    each = [F.when(both & apart(f), F.struct(F.lit(f.name).alias("column"), text(b, f).alias("base"), text(o, f).alias("ours"), text(t, f).alias("theirs"))) for f in fields]
    row = F.when(whole, F.struct(F.lit(None).cast("string").alias("column"), F.to_json(b).alias("base"), F.to_json(o).alias("ours"), F.to_json(t).alias("theirs")))
    conflicts = three.select(*keys, F.explode(F.array_compact(F.array(*each, row))).alias("c")).select(*keys, "c.column", "c.base", "c.ours", "c.theirs")
    changed = made.withColumn("op", _op("ours", "after")).where("op is not null").select(*keys, "op", _differing("ours", "after", fields).alias("columns"), F.col("ours").alias("before"), "after")
    return changed, conflicts


# Hash trees over buckets of keys


def bucket(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def bucket_hashes(df: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, lo, hi): the rows of each bucket of keys, and sums of two parts of their hashes, so that hashes of rows that are added add up."""
    h = row_hash(df, sorted(df.columns))
    part = lambda at: F.conv(F.substring(F.col("_h"), at, 15), 16, 10).cast("decimal(38,0)")
    return df.select(bucket(keys, buckets).alias("bucket"), h.alias("_h")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("lo"), F.sum(part(16)).alias("hi"))


def added_hashes(*hashes: DataFrame) -> DataFrame:
    """The bucket hashes of tables put together."""
    return reduce(DataFrame.unionByName, hashes).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("lo").cast("decimal(38,0)").alias("lo"), F.sum("hi").cast("decimal(38,0)").alias("hi"))


def tree(hashes: DataFrame, fan: int = FAN) -> DataFrame:
    """(level, node, hash) of the tree over bucket hashes: level 0 are the buckets, and each node hashes those of its children that are there, in order.

    The last level has one node, 0, the table's own hash; an empty table has none.
    """
    level = hashes.select(F.lit(0).alias("level"), F.col("bucket").alias("node"), F.sha2(F.concat_ws(":", "n", "lo", "hi"), 256).alias("hash"))
    found, size, at = level, BUCKETS, 0
    while size > 1:
        size, at = -(-size // fan), at + 1
        up = level.groupBy(F.floor(F.col("node") / fan).cast("int").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("children"))  # `fan` at most
        level = up.select(F.lit(at).alias("level"), F.col("parent").alias("node"), F.sha2(F.concat_ws(",", F.transform("children", lambda c: F.concat_ws(":", c.node, c.hash))), 256).alias("hash"))
        found = found.union(level)
    return found


def changed_buckets(before: DataFrame, after: DataFrame) -> list[int]:
    """The buckets that differ between two trees; at most as many as there are, so that they may come to the driver."""
    level = lambda df, n: df.where(F.col("level") == 0).select("node", F.col("hash").alias(n))
    return sorted(r.node for r in level(before, "a").join(level(after, "b"), "node", "full").where("not (a <=> b)").select("node").collect())


# The graph of commits: (hash, parent_hash), a row for each parent


def ancestors(commits: DataFrame, head: str) -> DataFrame:
    """(hash, depth): head and all commits before it, each by its shortest way; cycles end."""
    query = """
    WITH RECURSIVE walk(hash, depth, seen) AS (
      SELECT CAST(:head AS STRING), 0, array(CAST(:head AS STRING))
      UNION ALL SELECT c.parent_hash, w.depth + 1, concat(w.seen, array(c.parent_hash)) FROM walk w JOIN {commits} c ON c.hash = w.hash WHERE c.parent_hash IS NOT NULL AND NOT array_contains(w.seen, c.parent_hash)
    ) SELECT hash, min(depth) AS depth FROM walk GROUP BY hash"""
    return commits.sparkSession.sql(query, args={"head": head}, commits=commits)


def common_ancestors(commits: DataFrame, one: str, other: str) -> DataFrame:
    """(hash, one_depth, other_depth): the commits before both that are before no other such commit, nearest first."""
    both = ancestors(commits, one).withColumnRenamed("depth", "one_depth").join(ancestors(commits, other).withColumnRenamed("depth", "other_depth"), "hash")
    passed = both.join(commits, "hash").where("parent_hash is not null").select(F.col("parent_hash").alias("hash")).distinct()
    return both.join(passed, "hash", "left_anti").orderBy(F.col("one_depth") + F.col("other_depth"), "hash")
