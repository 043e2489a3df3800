"""Change sets, hash trees, merges and the graph of commits: against plain Python, and on a store."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylab.operators import diff
from quarrylab.plans.store import Store

FIELDS = "k long, a string, b double"


def states(seed):
    """Three states of a table as dicts by key; theirs and ours come from base."""
    r = random.Random(seed)
    value = lambda: (r.choice(["x", "y", "z", None]), r.choice([1.0, 2.0, None, float("nan")]))
    base = {k: value() for k in range(60)}

    def changed():
        new = {}
        for k, (a, b) in base.items():
            what = r.random()
            if what < 0.15:
                continue
            new[k] = (r.choice(["x", "y", "q"]), b) if what < 0.35 else (a, r.choice([7.0, 8.0])) if what < 0.55 else value() if what < 0.65 else (a, b)
        return new | {k: value() for k in r.sample(range(100, 120), 8)}

    return base, changed(), changed()


def frame(spark, state):
    return spark.createDataFrame([(k, *v) for k, v in state.items()], FIELDS)


def rows(df):
    return {r[0]: tuple(map(str, r[1:])) for r in df.collect()}


def as_text(state):
    return {k: tuple(map(str, v)) for k, v in state.items()}


def same(a, b):
    return str(a) == str(b)


@pytest.mark.parametrize("seed", range(3))
def test_changes(spark, seed):
    old, new, _ = states(seed)
    before, after = frame(spark, old), frame(spark, new)
    found = diff.changes(before, after, ["k"])
    want = {k: ("INSERT" if k not in old else "DELETE" if k not in new else "UPDATE") for k in {*old, *new} if not same(old.get(k), new.get(k))}
    assert {r.k: r.op for r in found.collect()} == want
    for r in found.where("op = 'UPDATE'").collect():
        assert r.columns == [c for c, x, y in zip("ab", old[r.k], new[r.k]) if not same(x, y)] and same(tuple(r.before), old[r.k]) and same(tuple(r.after), new[r.k])
    listed = diff.values(found.where("op = 'UPDATE'"), ["k"]).collect()
    assert len(listed) == sum(len(r.columns) for r in found.where("op = 'UPDATE'").collect())
    assert rows(diff.apply(before, found, ["k"])) == as_text(new) and rows(diff.apply(after, diff.reverse(found), ["k"])) == as_text(old)


def merged_by_hand(base, ours, theirs, prefer):
    merged, conflicts = {}, set()
    for k in {*base, *ours, *theirs}:
        b, o, t = base.get(k), ours.get(k), theirs.get(k)
        mine = o if prefer == "ours" else t
        if same(o, t) or same(t, b):
            new = o
        elif same(o, b):
            new = t
        elif o is None or t is None:
            new = mine
            conflicts.add((k, None))
        else:
            new = []
            for i, c in enumerate("ab"):
                if b is None or not same(o[i], b[i]) and not same(t[i], b[i]):
                    conflicts |= {(k, c)} if not same(o[i], t[i]) else set()
                    new.append(mine[i])
                else:
                    new.append(t[i] if same(o[i], b[i]) else o[i])
            new = tuple(new)
        if new is not None:
            merged[k] = new
    return merged, conflicts


@pytest.mark.parametrize("prefer", ["ours", "theirs"])
@pytest.mark.parametrize("seed", range(4))
def test_merge(spark, seed, prefer):
    base, ours, theirs = states(seed)
    changed, conflicts = diff.merge(*(frame(spark, s) for s in (base, ours, theirs)), ["k"], prefer)
    want, clashes = merged_by_hand(base, ours, theirs, prefer)
    assert rows(diff.apply(frame(spark, ours), changed, ["k"])) == as_text(want)
    assert {(r.k, r.column) for r in conflicts.collect()} == clashes


def test_trees(spark):
    old, new, _ = states(1)
    before, after = frame(spark, old), frame(spark, new)
    trees = [diff.tree(diff.bucket_hashes(df, ["k"])) for df in (before, after)]
    keys = {k for k in {*old, *new} if not same(old.get(k), new.get(k))}
    buckets = {r.b for r in spark.createDataFrame([(k,) for k in keys], "k long").select(diff.bucket(["k"]).alias("b")).collect()}
    assert set(diff.changed_buckets(*trees)) == buckets and diff.changed_buckets(trees[0], trees[0]) == []
    top = lambda t: t.where("level = 2").first().hash
    assert top(trees[0]) != top(trees[1]) and top(trees[0]) == top(diff.tree(diff.bucket_hashes(before.repartition(7), ["k"])))
    assert diff.tree(diff.bucket_hashes(before.limit(0), ["k"])).count() == 0
    pruned = after.where(diff.bucket(["k"]).isin(sorted(buckets)))
    assert "Filter" in pruned._jdf.queryExecution().executedPlan().toString()


def test_graph(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("m", "c"), ("m", "e"), ("n", "m"), ("x", "y"), ("y", "x"), ("a", None)]
    commits = spark.createDataFrame(edges, "hash string, parent_hash string")
    assert {r.hash: r.depth for r in diff.ancestors(commits, "m").collect()} == {"m": 0, "c": 1, "e": 1, "b": 2, "d": 2, "a": 3}
    assert {r.hash for r in diff.ancestors(commits, "x").collect()} == {"x", "y"}
    assert [r.hash for r in diff.common_ancestors(commits, "c", "e").collect()] == ["b"]
    assert [r.hash for r in diff.common_ancestors(commits, "n", "e").collect()] == ["e"] and diff.common_ancestors(commits, "a", "x").count() == 0


@pytest.fixture
def store(spark, tmp_path):
    db = Store(spark, tmp_path / "store")
    db.executescript("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT, w INTEGER); CREATE TABLE plain (v TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"v{i}", i) for i in range(1, 30)])
    db.execute("INSERT INTO plain VALUES ('a'), ('b')")
    db.git_init()
    return db


def table(db):
    return {r.id: (r.v, r.w) for r in db.read("t").collect()}


def test_store_diff_reads_what_differs(store):
    first = store.git_commit("first")
    store.replace_many("t", [{"id": 3, "v": "new", "w": 3}])
    store.execute("INSERT INTO t (id, v) VALUES (100, 'added')")
    store.execute("INSERT INTO plain VALUES ('c')")
    assert store.git_status()["changes"] == {"t": {"UPDATE": 1, "INSERT": 1}, "plain": {"INSERT": 1}}
    second = store.git_commit("second")
    found = store.git_diff(first, second)
    (row,) = found["t"].where("op = 'UPDATE'").collect()
    assert (row.id, row.columns, row.before.v, row.after.v) == (3, ["v"], "v3", "new")
    # Of the table without a key the new file alone is read, and of the other one the buckets that differ.
    assert len(found["plain"].inputFiles()) == 1 and "IN (" in found["t"]._jdf.queryExecution().optimizedPlan().toString()
    trees = store._git()["trees"]
    assert trees[first]["t"]["root"] != trees[second]["t"]["root"]
    whole = diff.tree(diff.bucket_hashes(store._stored("plain"), ["__rowid"])).orderBy(F.desc("level")).first().hash
    assert trees[second]["plain"]["root"] == whole  # added up from the first commit's and the new rows'
    store.vacuum()
    assert store.git_diff(first, second)["t"].count() == 2
    back = diff.reverse(store.git_diff(first, second)["t"])
    assert store.git_apply_changes("t", back) == 2 and store.git_diff(first)["t"].count() == 0


def test_store_merge(store):
    base = store.git_commit("base")
    store.git_branch("side")
    store.execute("UPDATE t SET v = 'ours' WHERE id <= 3")
    store.execute("DELETE FROM t WHERE id = 9")
    ours = store.git_commit("ours")
    store.git_checkout("side")
    store.execute("UPDATE t SET w = w + 100 WHERE id <= 5")
    store.execute("INSERT INTO t VALUES (50, 'side', 50)")
    theirs = store.git_commit("theirs")
    assert store.git_merge_base(ours, theirs) == base and store.git_find_path(ours, theirs) == [ours, base, theirs] and store.git_find_path(base, base) == [base]
    assert store.git_is_ancestor(base, "side") and not store.git_is_ancestor(ours, "side") and store.git_is_ancestor("side")
    store.git_checkout("main")
    done = store.git_merge("side")
    got = table(store)
    assert done["conflicts"] == {} and got[1] == ("ours", 101) and got[5] == ("v5", 105) and got[50] == ("side", 50) and 9 not in got and len(got) == 29
    assert store.git_is_ancestor(ours) and store.git_is_ancestor(theirs) and store.git_merge("side")["commit"] == done["commit"]
    assert store.git_merge_base("main", "side") == theirs and store.git_find_path("side", "main") == [theirs, done["commit"]]
    store.git_checkout("side")
    assert store.git_merge("main")["commit"] == done["commit"] and table(store) == got  # nothing of its own: forward


def test_store_merge_with_conflicts(store):
    store.git_commit("base")
    store.git_branch("side")
    store.execute("UPDATE t SET v = 'ours' WHERE id = 1")
    store.git_commit("ours")
    store.git_checkout("side")
    store.execute("UPDATE t SET v = 'theirs', w = 7 WHERE id = 1")
    store.git_commit("theirs")
    store.git_checkout("main")
    before = table(store)
    stopped = store.git_merge("side")
    assert stopped["commit"] is None and [(r.id, r.column, r.base, r.ours, r.theirs) for r in stopped["conflicts"]["t"].collect()] == [(1, "v", "v1", "ours", "theirs")]
    assert table(store) == before
    assert store.git_merge("side", prefer="theirs")["commit"] and table(store)[1] == ("theirs", 7)
    store.execute("UPDATE t SET w = 0 WHERE id = 2")
    with pytest.raises(ValueError):
        store.git_merge("side")
