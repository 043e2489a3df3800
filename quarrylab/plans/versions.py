"""Commits, branches and differences of a store's tables: a commit names the snapshots that were current."""

from __future__ import annotations

import copy
import hashlib
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import diff


class Versions:
    """Version control of a Store; checking a commit out brings its rows back."""

    def git_init(self, force: bool = False) -> None:
        if self._manifest["git"] is None or force:
            with self._change():
                self._manifest["git"] = {"commits": {}, "branches": {"main": None}, "head": "main", "trees": {}}

    def _git(self) -> dict:
        if self._manifest["git"] is None:
            raise ValueError("git_init comes first")
        return self._manifest["git"]

    def _files_of_commits(self) -> set[str]:
        git = self._manifest["git"] or {"commits": {}}
        trees = {x for c in git.get("trees", {}).values() for t in c.values() for x in (t["hashes"], t["tree"])}
        return {f for c in git["commits"].values() for meta in c["tables"].values() for f in meta["files"]} | trees

    def _resolve(self, ref: str | None) -> str | None:
        git = self._git()
        if ref in (None, "HEAD"):
            ref = git["head"]
        if ref in git["branches"]:
            return git["branches"][ref]
        if ref in git["commits"]:
            return ref
        raise ValueError(f"unknown ref: {ref}")

    def _identity(self, meta: dict) -> list[str]:
        """What tells a table's rows apart between states: the primary key, or without one the row's number."""
        return list(meta["primary_key"]) or ["__rowid"]

    def _tree(self, table: str, meta: dict, parent: str | None) -> dict:
        """Where the hash tree of a table lies. Files that the parent commit has are not read again: hashes add up."""
        before = self._manifest["git"].get("trees", {}).get(parent, {}).get(table)
        old = self._manifest["git"]["commits"][parent]["tables"][table] if before else {"files": [], "schema": None}
        keys, kept = self._identity(meta), set(old["files"]) <= set(meta["files"]) and old["schema"] == meta["schema"] and before and before["keys"] == self._identity(meta)
        if kept and before and set(old["files"]) == set(meta["files"]):
            return before
        new = [f for f in meta["files"] if not kept or f not in old["files"]]
        rows = self.spark.read.schema(T.StructType.fromJson(meta["schema"])).parquet(*new)
        hashes = diff.bucket_hashes(rows if keys == ["__rowid"] else rows.drop("__rowid"), keys)
        hashes = diff.added_hashes(self.spark.read.parquet(before["hashes"]), hashes) if kept else hashes
        at = self._write(table, hashes)
        over = self._write(table, diff.tree(self.spark.read.parquet(at)).coalesce(1))
        root = self.spark.read.parquet(over).orderBy(F.desc("level")).first()
        return {"keys": keys, "hashes": at, "tree": over, "root": root["hash"] if root else None}

    def git_commit(self, message: str, author: str = "", merged: str | None = None) -> str | None:
        """The new commit's hash; None if nothing has changed since the last one."""
        with self._change():
            git, parent = self._git(), self._resolve("HEAD")
            tables = self._manifest["tables"]
            if parent and git["commits"][parent]["tables"] == tables:
                return None
            made = time.time()
            name = hashlib.sha256(f"{parent}:{message}:{author}:{made}:{json.dumps(tables, sort_keys=True)}".encode()).hexdigest()[:8]
            git["commits"][name] = {"hash": name, "parent_hash": parent, "message": message, "author": author, "timestamp": made, "tables": copy.deepcopy(tables)}
            if merged:
                git["commits"][name]["merge_parent"] = merged
            git.setdefault("trees", {})[name] = {table: self._tree(table, meta, parent) for table, meta in tables.items() if meta["files"]}
            if git["head"] in git["branches"]:
                git["branches"][git["head"]] = name
            else:
                git["head"] = name
            return name

    def git_checkout(self, ref: str) -> None:
        with self._change():
            git, commit = self._git(), self._resolve(ref)
            if commit:
                self._manifest["tables"] = copy.deepcopy(git["commits"][commit]["tables"])
            git["head"] = ref

    def git_branch(self, name: str | None = None, delete: bool = False) -> list[str]:
        """The branches by name; with a name, after making or deleting it."""
        git = self._git()
        if name is not None:
            with self._change():
                git = self._git()
                if delete:
                    if name == git["head"] or name not in git["branches"]:
                        raise ValueError(f"can't delete {name}")
                    del git["branches"][name]
                else:
                    git["branches"][name] = self._resolve("HEAD")
        return sorted(git["branches"])

    def git_log(self, limit: int = 10, oneline: bool = False) -> list:
        git, at, found = self._git(), self._resolve("HEAD"), []
        while at and len(found) < limit and at not in (c["hash"] for c in found):
            found.append({k: v for k, v in git["commits"][at].items() if k != "tables"})
            at = git["commits"][at]["parent_hash"]
        return [f"{c['hash']} {c['message'][:50]}" for c in found] if oneline else found

    def _at(self, ref: str | None, table: str) -> DataFrame | None:
        """A table as a commit has it, or as it is now."""
        tables = self._manifest["tables"] if ref is None else (self._git()["commits"].get(self._resolve(ref)) or {"tables": {}})["tables"]
        if table not in tables:
            return None
        schema = T.StructType.fromJson(tables[table]["schema"])
        files = tables[table]["files"]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def git_diff(self, from_ref: str = "HEAD", to_ref: str | None = None) -> dict[str, DataFrame]:
        """Per table that differs: keys, op, the columns that differ, and the row before and after. Without to_ref up to the tables as they are now.

        Rows are the same by the primary key, or by their number. Files that both states have are not read, and between commits
        only keys in buckets whose hashes differ are compared.
        """
        tables = lambda ref: self._manifest["tables"] if ref is None else (self._git()["commits"].get(self._resolve(ref)) or {"tables": {}})["tables"]
        trees = lambda ref: {} if ref is None else self._git().get("trees", {}).get(self._resolve(ref), {})
        old, new, found = tables(from_ref), tables(to_ref), {}
        for name in sorted({*old, *new}):
            a, b = old.get(name), new.get(name)
            keys = self._identity(b or a)
            if a and b and (a["files"], a["schema"]) == (b["files"], b["schema"]) or a and self._identity(a) != keys:
                if a and self._identity(a) != keys:
                    raise ValueError(f"{name} has another primary key now")
                continue
            shared = {*a["files"]} & {*b["files"]} if a and b and a["schema"] == b["schema"] else set()
            before, after = (self._files(m, shared) for m in (a, b))
            before = after.limit(0) if before is None else before
            after = before.limit(0) if after is None else after
            roots = trees(from_ref).get(name), trees(to_ref).get(name)
            if all(roots) and roots[0]["keys"] == roots[1]["keys"] == keys:
                if roots[0]["root"] == roots[1]["root"]:
                    continue
                differing = diff.changed_buckets(*[self.spark.read.parquet(t["tree"]) for t in roots])
                before, after = (df.where(diff.bucket(keys).isin(differing)) for df in (before, after))
            strip = lambda df: df if keys == ["__rowid"] else df.drop("__rowid")
            found[name] = diff.changes(strip(before), strip(after), keys)
        return found

    def _files(self, meta: dict | None, without: set[str]) -> DataFrame | None:
        """A state's rows but for those of some files."""
        if meta is None:
            return None
        schema, files = T.StructType.fromJson(meta["schema"]), [f for f in meta["files"] if f not in without]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _graph(self) -> DataFrame:
        """(hash, parent_hash) of all commits, a row for each parent."""
        commits = self._git()["commits"].values()
        rows = [(c["hash"], p) for c in commits for p in {c["parent_hash"], c.get("merge_parent")} - ({None} if c["parent_hash"] else set())]
        return self.spark.createDataFrame(rows, "hash string, parent_hash string")

    def git_is_ancestor(self, ancestor: str, ref: str = "HEAD") -> bool:
        """Whether a commit is before another one, or is that one."""
        return not diff.ancestors(self._graph(), self._resolve(ref)).where(F.col("hash") == self._resolve(ancestor)).isEmpty()

    def git_merge_base(self, one: str, other: str) -> str | None:
        """The nearest commit before both; None if there is none."""
        found = diff.common_ancestors(self._graph(), self._resolve(one), self._resolve(other)).first()
        return found["hash"] if found else None

    def git_find_path(self, from_ref: str, to_ref: str) -> list[str]:
        """The commits from one to another: back to the nearest commit before both, then forward."""
        commits, start, end = self._git()["commits"], self._resolve(from_ref), self._resolve(to_ref)
        base = self.git_merge_base(start, end)
        if base is None:
            raise ValueError(f"no commit is before both {from_ref} and {to_ref}")

        def down(at: str) -> list[str]:
            """The shortest way from a commit back to the base."""
            ways = [[at]]
            while ways[0][-1] != base:
                way = ways.pop(0)
                ways += [[*way, p] for p in (commits[way[-1]]["parent_hash"], commits[way[-1]].get("merge_parent")) if p]
            return ways[0]

        return down(start) + down(end)[-2::-1]

    def git_apply_changes(self, table: str, changed: DataFrame) -> int:
        """Apply a change set (of git_diff, or `diff.reverse` of one) to a table as it is now; the number of changed rows.

        Rows that a change finds keep their number; the others are added.
        """
        with self._change():
            meta, stored = self._meta(table), self._stored(table)
            keys, columns = self._identity(meta), [c for c in self.read(table).columns]
            changed = self._put(table, changed)
            on = [F.col(f"s.`{k}`") == F.col(f"c.`{k}`") for k in keys]
            joined = stored.alias("s").join(changed.alias("c"), on, "left").where("c.op is null or c.op <> 'DELETE'")
            known = [f.name for f in changed.schema["after"].dataType.fields]
            value = lambda c: F.when(F.col("c.op").isNotNull(), F.col("c.after")[c]).otherwise(F.col(f"s.`{c}`")) if c in known and c not in keys else F.col(f"s.`{c}`")
            new = changed.where("op <> 'DELETE'").alias("c").join(stored.alias("s"), on, "left_anti")
            rows = new.select(*[(F.col(f"c.`{c}`") if c in keys else F.col("c.after")[c] if c in known else F.lit(None)).alias(c) for c in columns])
            added = self._put(table, self._typed(table, rows))
            self._replace(table, joined.select(*[value(c).alias(c) for c in columns], F.col("s.__rowid").alias("__rowid")), check=False)
            self._append(table, self._rows(table, added))
            return changed.count()

    def git_merge(self, ref: str, message: str | None = None, author: str = "", prefer: str | None = None) -> dict:
        """Merge another commit's tables into the current branch: {"commit", "base", "conflicts": {table: rows}}.

        What is not committed must be committed first. With conflicts nothing is changed, unless `prefer` ("ours" or "theirs") says whose values stay.
        """
        if prefer not in (None, "ours", "theirs"):
            raise ValueError("prefer must be ours or theirs")
        git, head, other = self._git(), self._resolve("HEAD"), self._resolve(ref)
        if git["commits"][head]["tables"] != self._manifest["tables"]:
            raise ValueError("there are changes that are not committed")
        base = self.git_merge_base(head, other)
        if base == other:
            return {"commit": head, "base": base, "conflicts": {}}
        with self._change():
            git = self._git()
            if base == head:  # nothing of our own since then
                self._manifest["tables"] = copy.deepcopy(git["commits"][other]["tables"])
                git["branches" if git["head"] in git["branches"] else "head"] = git["branches"] | {git["head"]: other} if git["head"] in git["branches"] else other
                return {"commit": other, "base": base, "conflicts": {}}
            at = {n: git["commits"][c]["tables"] for n, c in (("base", base), ("ours", head), ("theirs", other)) if c}
            at.setdefault("base", {})
            planned, conflicts = {}, {}
            for name in sorted(at["theirs"]):
                theirs, ours, first = (at[n].get(name) for n in ("theirs", "ours", "base"))
                if theirs == first or theirs == ours:
                    continue
                if ours is None:
                    if first is None:
                        self._manifest["tables"][name] = copy.deepcopy(theirs)
                    continue
                keys = self._identity(ours)
                if keys == ["__rowid"]:
                    raise ValueError(f"{name} has no primary key to merge by")
                states = [(self._files(m, set()) if m else self._files(ours, {*ours["files"]})).drop("__rowid") for m in (first, ours, theirs)]
                changed, clashes = diff.merge(*states, keys, prefer or "ours")
                planned[name], clashes = changed, self._put(name, clashes)
                if not clashes.isEmpty():
                    conflicts[name] = clashes
            for name in [n for n in at["base"] if n not in at["theirs"] and at["ours"].get(n) == at["base"][n]]:
                del self._manifest["tables"][name]
            if conflicts and prefer is None:
                return {"commit": None, "base": base, "conflicts": conflicts}
            for name, changed in planned.items():
                self.git_apply_changes(name, changed)
            done = self.git_commit(message or f"merge {ref}", author, merged=other)
            return {"commit": done, "base": base, "conflicts": conflicts}

    def git_status(self) -> dict:
        git = self._git()
        changes = {name: {r["op"]: r["n"] for r in diff.summary(d).collect()} for name, d in self.git_diff().items()}
        return {"branch": git["head"], "commit": self._resolve("HEAD"), "changes": {n: c for n, c in changes.items() if c}}

    def git_reset(self, ref: str, mode: str = "mixed") -> None:
        """Move the current branch to ref; "hard" brings the tables along."""
        if mode not in ("soft", "mixed", "hard"):
            raise ValueError("mode must be soft, mixed or hard")
        with self._change():
            git, commit = self._git(), self._resolve(ref)
            if git["head"] in git["branches"]:
                git["branches"][git["head"]] = commit
            else:
                git["head"] = commit
            if mode == "hard" and commit:
                self._manifest["tables"] = copy.deepcopy(git["commits"][commit]["tables"])

    def table_hash(self, table: str) -> str:
        return diff.table_hash(self.read(table).select(F.col("*"))).first()["hash"]
