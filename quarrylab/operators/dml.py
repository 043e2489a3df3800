"""Changes of rows as functions from table to table: nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import order_columns

#: Ranges are laid out over so many leaves at most (a power of two), whose bounds are quantiles of the ranges' ends; fewer ends need fewer leaves.
LEAVES = 4096
#: A side of a join is broadcast only if it was counted and its rows, each of ROW_BYTES besides its values, have no more bytes than this.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def few(df: DataFrame) -> bool:
    """Whether df's rows, counted with their bytes, may be broadcast. By itself Spark goes by the size of compressed files, which an explode doesn't change."""
    size = F.lit(ROW_BYTES)
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif isinstance(f.dataType, T.AtomicType):
            size = size + 8
        else:
            return False
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def sized(df: DataFrame) -> DataFrame:
    """df with a hint for a join: broadcast if it is few, else sorted and merged."""
    return df.hint("broadcast" if few(df) else "merge")


def holds(where: str | Column) -> Column:
    """The predicate, false where it is null."""
    if isinstance(where, Column):
        return F.coalesce(where, F.lit(False))
    if not isinstance(where, str) or not where.strip():
        raise ValueError("a predicate is asked for")
    return F.coalesce(F.expr(where), F.lit(False))


def conform(new: DataFrame, df: DataFrame) -> DataFrame:
    """New rows with the columns and types of df; columns that they lack are null, unknown ones are an error."""
    unknown = [c for c in new.columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return new.select(*[(F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])


def insert_rows(df: DataFrame, new: DataFrame, where: str | None = None) -> DataFrame:
    """df and the new rows, those alone that `where` holds for."""
    return df.unionByName(conform(new.where(holds(where)) if where else new, df))


def inherit_foreign(new: DataFrame, parent: DataFrame, column: str, parent_column: str, key: str) -> DataFrame:
    """New rows with `column` filled, where it is missing or null, by parent_column of the parent row of the same key.

    Of several parent rows the least value counts. The parent is joined as it is: Spark broadcasts it if it is small.
    """
    looked_up = parent.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(parent_column).alias("_found"))
    own = F.col(f"`{column}`") if column in new.columns else F.lit(None)
    return new.join(looked_up, new[key] == looked_up["_key"], "left").withColumn(column, F.coalesce(own, F.col("_found"))).drop("_key", "_found")


def last_of_each(rows: DataFrame, keys: Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """The last row of each key by order_by; rows of a null key all stay, since null keys are never equal."""
    return marked_last(rows, [keys], order_by, "_stays").where("_stays").drop("_stays")


def marked_last(rows: DataFrame, key_sets: Sequence[Sequence[str]], order_by: str | Sequence[str], out: str) -> DataFrame:
    """rows with a column that is true where a row is the last by order_by of its key, for each of some keys; a null key is equal to none."""
    order = [F.expr(c) for c in ([order_by] if isinstance(order_by, str) else order_by)]
    stays = F.lit(True)
    for n, keys in enumerate(key_sets):
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        # Rows of a null key are dealt out by their order, so that they don't meet in one task.
        last = Window.partitionBy(*keys, F.when(null, F.xxhash64(*order))).orderBy(*[c.desc() for c in order])
        rows = rows.withColumn(f"_n{n}", F.row_number().over(last)).withColumn(f"_n{n}", (F.col(f"_n{n}") == 1) | null)
        stays = stays & F.col(f"_n{n}")
    return rows.withColumn(out, stays).drop(*[f"_n{n}" for n in range(len(key_sets))])


def replace_rows(df: DataFrame, new: DataFrame, keys: Sequence[str], order_by: str | None = None) -> DataFrame:
    """df without the rows whose key is among the new rows, and the new rows; of equal new keys the last by order_by."""
    if order_by:
        new = last_of_each(new, keys, order_by)
    return df.join(new.select(*keys), list(keys), "left_anti").select(*df.columns).unionByName(conform(new.select(*[c for c in new.columns if c in df.columns]), df))


def update_where(df: DataFrame, updates: dict, where: str, limit: int | None = None, order_by: str | None = None) -> DataFrame:
    """df with the columns of updates set, to a literal or a Column, in the rows that `where` holds for; with a limit, in
    the first so many of them by order_by alone, which must tell rows apart."""
    if not updates:
        raise ValueError("no updates")
    missing = [c for c in updates if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")
    hit, kinds, source = holds(where), {f.name: f.dataType for f in df.schema}, df
    if limit is not None:
        first, on = _first(df, where, limit, order_by)
        source, hit = df.join(first.withColumn("_hit", F.lit(True)), on, "left"), F.col("_hit").isNotNull()
    value = lambda v, c: (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])
    return source.select(*[F.when(hit, value(updates[c], c)).otherwise(F.col(f"`{c}`")).alias(c) if c in updates else F.col(f"`{c}`") for c in df.columns])


def update_keyed(df: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: str | None = None, given: Sequence[str] = ()) -> DataFrame:
    """df with the columns of the update row of the same key, also if they are null there; the last of equal keys wins.

    A column c among `given` counts only in the update rows for which the column _given_c is true, and wins by itself.
    """
    values = [c for c in updates.columns if c in df.columns and c not in keys]
    if given:
        sets = lambda c: F.max_by(F.struct(c), F.when(F.col(f"_given_{c}") if c in given else F.lit(True), F.expr(order_by)))
        updates = updates.groupBy(*keys).agg(*[sets(c).alias(c) for c in values])
    elif order_by:
        updates = last_of_each(updates, keys, order_by)
    other = updates.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_v_{c}") for c in values], F.lit(True).alias("_hit"))
    on = F.lit(True)
    for k in keys:
        on = on & (df[k] == other[f"_k_{k}"])
    kinds = {f.name: f.dataType for f in df.schema}
    joined = df.join(other, on, "left")
    value = lambda c: F.when(F.col(f"_v_{c}").isNotNull(), F.col(f"_v_{c}")[c].cast(kinds[c])) if given else F.when(F.col("_hit"), F.col(f"_v_{c}").cast(kinds[c]))
    return joined.select(*[value(c).otherwise(df[c]).alias(c) if c in values else df[c] for c in df.columns])


def delete_where(df: DataFrame, where: str, limit: int | None = None, order_by: str | None = None) -> DataFrame:
    """df without the rows that `where` holds for; with a limit, without the first so many of them by order_by alone.

    The limit's rows are found by a top-k of the matching rows' order columns, which must tell rows apart.
    """
    if limit is None:
        return df.where(~holds(where))
    first, on = _first(df, where, limit, order_by)
    return df.join(first, on, "left_anti")


def _first(df: DataFrame, where: str, limit: int, order_by: str | None) -> tuple[DataFrame, Column]:
    """The order columns of the first `limit` rows that `where` holds for, and the condition that finds them in df."""
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
        raise ValueError("limit must be a positive whole number")
    if not order_by:
        raise ValueError("a limit needs an order")
    columns = [c.strip().split()[0] for c in order_by.split(",")]
    first = df.where(holds(where)).orderBy(*order_columns(order_by)).limit(limit).select(*[F.col(c).alias(f"_o_{c}") for c in columns])
    on = F.lit(True)
    for c in columns:
        on = on & df[c].eqNullSafe(first[f"_o_{c}"])
    return first, on


def copy_rows(df: DataFrame, where: str | None = None) -> DataFrame:
    return df.where(holds(where)) if where else df


class Term(NamedTuple):
    """A part of a predicate over a table and update rows: a comparison of an expression of the table (left) with one of the
    update rows, by the name of Spark's node; or, without such a name, a whole predicate over both (left)."""

    kind: str
    left: Column
    right: Column | None

    def holds(self) -> Column:
        return {
            "EqualTo": lambda: self.left == self.right, "LessThan": lambda: self.left < self.right, "LessThanOrEqual": lambda: self.left <= self.right,
            "GreaterThan": lambda: self.left > self.right, "GreaterThanOrEqual": lambda: self.left >= self.right, "": lambda: self.left,
        }[self.kind]()


def _leaf(x: Column, bounds: list[float], leaves: int) -> Column:
    """The number of bounds, fewer than leaves, that are no greater than x, by a search that halves what is left; monotonous in x."""
    padded = F.array(*[F.lit(b) for b in bounds + [float("inf")] * (leaves - len(bounds))])
    halves = F.array(*[F.lit(leaves >> i) for i in range(1, leaves.bit_length())])
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.element_at(padded, at + half) <= x, at + half).otherwise(at))


def matches(df: DataFrame, updates: DataFrame, terms: Sequence[Term], row: str, at: str) -> DataFrame:
    """(row, at) of rows of df and update rows for which all terms hold: all such pairs or, where ranges alone decide, fewer, but each row's last.

    Equal keys join as they are. A range (an expression of df between ends that the update rows give, one of which may be
    missing) is no nested loop: leaves are cut at quantiles of the ends, df's rows know their leaf, and an update row is put
    on the few nodes of a binary tree over the leaves between its ends' leaves, where of all update rows the last alone counts, and
    on its ends' own leaves, where of those of the same end the last alone counts and is compared. So neither wide ranges nor
    popular ends bring rows and update rows together pair by pair. Terms of other kinds are tested on joined pairs. It is the
    update rows that are broadcast, if they are few: df, with a row for each level of the tree, never is.
    """
    keys = [t for t in terms if t.kind == "EqualTo"]
    ranged = [t for t in terms if t.kind not in ("", "EqualTo")]
    measured = str(ranged[0].left) if ranged else None
    lows = [t for t in ranged if t.kind.startswith("Greater") and str(t.left) == measured]
    highs = [t for t in ranged if t.kind.startswith("Less") and str(t.left) == measured]
    rest = [t for t in terms if t not in keys and t not in lows[:1] and t not in highs[:1]]
    numeric = ranged and dict(df.select(ranged[0].left.alias("x")).dtypes)["x"] not in ("string", "binary", "boolean")
    every = reduce(and_, [t.holds() for t in terms], F.lit(True))
    if not numeric:
        return df.join(sized(updates), every).select(row, at)
    low, high = (lows or [None])[0], (highs or [None])[0]
    timed = dict(df.select(ranged[0].left.alias("x")).dtypes)["x"] in ("date", "timestamp_ntz")
    as_double = lambda c: (c.cast("timestamp") if timed else c).cast("double")
    ends = updates.select(*[(as_double(t.right) if t else F.lit(None).cast("double")).alias(n) for t, n in ((low, "lo"), (high, "hi"))])
    shares = [i / LEAVES for i in range(1, LEAVES)]
    found = ends.select(F.explode(F.array("lo", "hi")).alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).approxQuantile("x", shares, 0.25 / LEAVES)
    bounds = sorted({*found})
    leaves = max(2, 1 << len(bounds).bit_length())
    key_names = [f"_k{i}" for i in range(len(keys))]
    df = df.where(ranged[0].left.isNotNull())
    side = df.select(row, *[t.left.alias(n) for t, n in zip(keys, key_names)], ranged[0].left.alias("_x")).withColumn("_leaf", _leaf(as_double(F.col("_x")), bounds, leaves)) if not rest else df.withColumn("_leaf", _leaf(as_double(ranged[0].left), bounds, leaves))
    real = reduce(and_, [t.right.isNotNull() for t in (low, high) if t], F.lit(True))
    lo_leaf = _leaf(as_double(low.right), bounds, leaves) if low else F.lit(-1)
    hi_leaf = _leaf(as_double(high.right), bounds, leaves) if high else F.lit(leaves)
    placed = updates.where(real).withColumns({"_lo_leaf": lo_leaf, "_hi_leaf": hi_leaf}).where("_lo_leaf <= _hi_leaf")
    if rest:  # every pair is tested: update rows on all the leaves that they reach
        spread = placed.withColumn("_on", F.explode(F.sequence(F.greatest("_lo_leaf", F.lit(0)), F.least("_hi_leaf", F.lit(leaves - 1)))))
        return side.join(sized(spread), every & (F.col("_leaf") == F.col("_on"))).select(row, at)
    own = placed.select(
        *[t.right.alias(f"_u{n}") for t, n in zip(keys, key_names)], (low.right if low else F.lit(None).cast("double")).alias("_lo"), (high.right if high else F.lit(None).cast("double")).alias("_hi"), "_lo_leaf", "_hi_leaf", at,
    )
    of = [f"_u{n}" for n in key_names]
    same_keys = reduce(and_, [F.col(n) == F.col(f"_u{n}") for n in key_names], F.lit(True))
    # Leaves that hold an end: what is compared there is that end alone, or both if they share the leaf.
    nothing = lambda n: F.lit(None).cast(dict(own.dtypes)[n])
    place = lambda leaf, lo, hi, when: F.when(when, F.struct(F.col(leaf).alias("on"), lo.alias("lo"), hi.alias("hi")))
    apart, lo, hi = F.col("_lo_leaf") < F.col("_hi_leaf"), F.col("_lo"), F.col("_hi")
    ends = [place("_lo_leaf", lo, hi, ~apart)] + ([place("_lo_leaf", lo, nothing("_hi"), apart)] if low else []) + ([place("_hi_leaf", nothing("_lo"), hi, apart)] if high else [])
    listed = own.select(*of, at, F.explode(F.filter(F.array(*ends), lambda e: e.isNotNull())).alias("end"))
    edge = listed.select(*of, F.col("end.on").alias("_on"), F.col("end.lo").alias("_lo"), F.col("end.hi").alias("_hi"), at).groupBy(*of, "_on", "_lo", "_hi").agg(F.max(at).alias(at))
    x = F.col("_x")
    above = F.col("_lo").isNull() | ((x > F.col("_lo")) if low and low.kind == "GreaterThan" else (x >= F.col("_lo")))
    below = F.col("_hi").isNull() | ((x < F.col("_hi")) if high and high.kind == "LessThan" else (x <= F.col("_hi")))
    near = side.join(sized(edge), same_keys & (F.col("_leaf") == F.col("_on")) & above & below).select(row, at)
    # Leaves between the ends: nodes of the tree, the least number of them.
    levels = leaves.bit_length()
    first, last = F.col("_lo_leaf") + 1, F.col("_hi_leaf") - 1
    inner = own.where(first <= last).select(*of, first.alias("_a"), last.alias("_b"), at)
    found = []
    for level in range(levels):
        size = 1 << level
        a, b = F.ceil(F.col("_a") / size).cast("int"), (F.floor((F.col("_b") + 1) / size) - 1).cast("int")
        # A node of this level is taken if it is within, and the node above it isn't.
        up_a, up_b = F.ceil(F.col("_a") / (2 * size)) * 2, F.floor((F.col("_b") + 1) / (2 * size)) * 2 - 1
        ends = F.array(F.struct(F.lit(level).alias("level"), a.alias("on")), F.struct(F.lit(level).alias("level"), b.alias("on")))
        found.append(F.filter(F.array_distinct(ends), lambda n: (n.on >= a) & (n.on <= b) & ((up_a > up_b) | (n.on < up_a) | (n.on > up_b))))  # noqa: B023
    nodes = inner.select(*of, at, F.explode(F.flatten(F.array(*found))).alias("n")).select(*of, F.col("n.level").alias("_level"), F.col("n.on").alias("_on"), at)
    node = nodes.groupBy(*of, "_level", "_on").agg(F.max(at).alias(at))
    up = side.select("*", F.posexplode(F.array(*[F.shiftright("_leaf", level) for level in range(levels)])).alias("_at_level", "_node"))
    covered = up.join(sized(node), same_keys & (F.col("_at_level") == F.col("_level")) & (F.col("_node") == F.col("_on"))).select(row, at)
    return near.union(covered)
