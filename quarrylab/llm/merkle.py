"""A Merkle manifest of a dataset: hash trees over each source's records and over the sources, and a proof for every record (op11_merkle_manifest).

A vertex of the computation is a block: a subtree of FAN ** height consecutive nodes. In an upward superstep each node
messages its block; a block that has all its nodes hashes `height` levels and messages its own node on. In a downward
superstep each block tells its nodes the siblings on their way up, until every leaf holds its whole path to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, read, stage

#: Nodes under a parent; levels that a superstep climbs; leaves that a task holds at most (roughly).
FAN, HEIGHT, TASK_LEAVES = 3, 6, 400_000
DIGEST = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[bytes]) -> bytes:
    """The hash of a run of nodes, which are joined as hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def climb(nodes: list[bytes], total: int, height: int, fan: int = FAN) -> list[list[bytes]]:
    """The levels over a block's nodes, themselves first; `total` nodes has the tree at their level."""
    levels = [nodes]
    while total > 1 and len(levels) <= height:
        nodes = [digest(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        total = -(-total // fan)
        levels.append(nodes)
    return levels


def siblings(levels: list[list[bytes]], at: int, fan: int = FAN) -> bytes:
    """The siblings on the way from a block's node `at` up to the block's own, level by level, left to right."""
    found = []
    for nodes in levels[:-1]:
        first = at - at % fan
        found += nodes[first:at] + nodes[at + 1 : first + fan]
        at //= fan
    return b"".join(found)


def fold(leaf: bytes, path: bytes, at: int, total: int, fan: int = FAN) -> tuple[bytes, bytes]:
    """What a leaf's siblings make of it, `at` among `total`; and the rest of the path, that of the tree above."""
    while total > 1:
        first = at - at % fan
        run = min(fan, total - first)
        others = [path[i : i + DIGEST] for i in range(0, (run - 1) * DIGEST, DIGEST)]
        path = path[(run - 1) * DIGEST :]
        leaf = digest([*others[: at - first], leaf, *others[at - first :]])
        at, total = at // fan, -(-total // fan)
    return leaf, path


def ordered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with `at`, each row's place in its group by `order` from 0 without gaps, and `total`, the group's rows.

    Rows are sorted in ranges, and ranges counted: no group, and no run of equal rows, is in one task. Nulls come first.
    """
    keys = [group, *order, "_tie"]
    sorted_ = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(sorted_.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id()}), "ordered")
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(
        placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_n").alias("_first"))
        .select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("rows").over(whole).alias("total")),
        "counts",
    )
    joined = placed.join(bounded(counts), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("at", F.col("_n") + F.col("_shift")).drop("_part", "_n", "_group", "_of", "_shift")


class Block(NamedTuple):
    """The nodes of a block in order, of a tree of `total` nodes at their level; leaves have items and second digests."""

    tree: str | None
    block: int
    total: int
    nodes: bytes
    items: list[str | None]
    others: bytes

    def digests(self) -> list[bytes]:
        return [bytes(self.nodes[i : i + DIGEST]) for i in range(0, len(self.nodes), DIGEST)]


BLOCK = "tree string, block long, total long, nodes binary, items array<string>, others binary"


class Forest:
    """Hash trees over leaves (tree, at, total, item, node, other): `other` is a second digest that the item brings along."""

    def __init__(self, leaves: DataFrame, fan: int = FAN, height: int = HEIGHT):
        self.spark, self.fan, self.height, self.width = leaves.sparkSession, fan, height, fan**height
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tasks = max(usual, -(-leaves.count() // TASK_LEAVES))
        width = self.width
        messages = leaves.select("tree", "at", "total", "node", "item", "other").rdd.map(lambda r: ((r[0], r[1] // width), (r[1] % width, r[2], bytes(r[3]), r[4], bytes(r[5] or b""))))
        self.levels = [self._blocks(messages)]
        while not self._unfinished(self.levels[-1]).isEmpty():
            self.levels.append(self._blocks(self._upward(self.levels[-1])))

    def _unfinished(self, level: DataFrame) -> DataFrame:
        return level.where(F.col("total") > self.width)

    def _blocks(self, messages: RDD) -> DataFrame:
        """Each block with the nodes that messaged it. A block's group is bounded by its width; the table cuts the lineage."""

        def gathered(pair) -> tuple:
            (tree, block), nodes = pair
            nodes = sorted(nodes, key=lambda m: m[0])
            return tree, block, nodes[0][1], b"".join(m[2] for m in nodes), [m[3] for m in nodes], b"".join(m[4] for m in nodes)

        return stage(self.spark.createDataFrame(messages.groupByKey(self.tasks).map(gathered), BLOCK, verifySchema=False), "blocks")

    def _upward(self, level: DataFrame) -> RDD:
        """The messages of complete blocks to the blocks that they are nodes of."""
        fan, height, width = self.fan, self.height, self.width

        def message(row) -> tuple:
            b = Block(*row)
            top = climb(b.digests(), b.total, height, fan)[-1][0]
            return (b.tree, b.block // width), (b.block % width, -(-b.total // width), top, None, b"")

        return self._unfinished(level).rdd.map(message)

    def tops(self) -> DataFrame:
        """(tree, node, level) of each tree: its topmost node, and the superstep that found it."""
        fan, height = self.fan, self.height
        found = None
        for n, level in enumerate(self.levels):
            done = level.where(F.col("total") <= self.width).rdd.map(lambda row, n=n: (row[0], climb(Block(*row).digests(), row[2], height, fan)[-1][0], n))
            found = done if found is None else found.union(done)
        return stage(self.spark.createDataFrame(found, "tree string, node binary, level int", verifySchema=False), "tops")

    def downward(self, told: RDD) -> RDD:
        """(leaf's Block, its levels, place in it, path, told) of every leaf, for `told`, (tree, (level, path above, anything to pass on))."""
        fan, height, width = self.fan, self.height, self.width
        told = told.map(lambda m: ((m[0], 0), m[1]))
        messages: RDD | None = None
        for n in range(len(self.levels) - 1, -1, -1):
            seeds = told.filter(lambda m, n=n: m[1][0] == n).map(lambda m: (m[0], m[1][1:]))
            messages = seeds if messages is None else messages.union(seeds)
            blocks = self.levels[n].rdd.map(lambda row: ((row[0], row[1]), tuple(row)))
            joined = blocks.join(messages, self.tasks)

            def pass_on(pair) -> Iterator[tuple]:
                _, (row, (path, more)) = pair
                b = Block(*row)
                levels = climb(b.digests(), b.total, height, fan)
                for i in range(len(levels[0])):
                    yield (b.tree, b.block * width + i), (siblings(levels, i, fan) + path, more)

            if n:
                messages = joined.flatMap(pass_on)
        return joined


def manifest(docs: DataFrame, changed: Column, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """One row for each row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `changed` is the text as it is found later: folded_root is what that text's leaf and the siblings recorded now lead
    to, and verified says whether it is the root. Records of a source are in order of doc_id, nulls first, then by their leaf,
    so that equal doc_ids have one order; equal records are equal leaves. Nulls of all columns are told from empty texts;
    texts of any length are hashed whole; a null source is one of its own and comes first; an empty table gives an empty
    one; further columns are ignored. A superstep's groups hold fan ** height nodes; paths grow with the logarithm of
    the rows.
    """
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    named = docs.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS], changed.alias("changed"))
    record = lambda text: F.unhex(F.sha2(F.concat(*[field(F.col(c)) for c in COLUMNS[:-1]], field(F.col(text))), 256))
    other = F.when(F.col("text").eqNullSafe(F.col("changed")), F.col("node")).otherwise(record("changed"))
    leaves = named.withColumn("node", record("text")).select(F.col("source").alias("tree"), F.col("doc_id").cast("long").alias("item"), "node", other.alias("other"))
    leaves = ordered(leaves, "tree", ["item", "node", "other"]).withColumn("item", F.col("item").cast("string"))
    trees = Forest(leaves, fan, height)

    tops = trees.tops()
    level = tops.select(F.lit("sources").alias("tree"), F.col("tree").alias("item"), "node", F.unhex(F.lpad(F.hex("level"), 2, "0")).alias("other"))
    above = Forest(ordered(level, "tree", ["item"]), fan, height)
    root = above.tops().rdd.map(lambda r: (r[0], (r[2], b"", bytes(r[1]))))
    step = above.width

    def to_sources(pair) -> Iterator[tuple]:
        """Each source's message: where its tree's top is, the path from there, and what its leaves need to know."""
        _, (row, (path, root)) = pair
        b = Block(*row)
        levels = climb(b.digests(), b.total, height, fan)
        for i, (source, subroot, at) in enumerate(zip(b.items, levels[0], bytes(b.others))):  # a byte each: the superstep's number
            yield source, (at, siblings(levels, i, fan) + path, (root, subroot, b.block * step + i))

    sources = tops.count()

    def to_leaves(pair) -> Iterator[tuple]:
        _, (row, (path, (root, subroot, source))) = pair
        b = Block(*row)
        nodes = b.digests()
        levels = climb(nodes, b.total, height, fan)
        for i, item in enumerate(b.items):
            way = siblings(levels, i, fan) + path
            made, rest = fold(bytes(b.others[i * DIGEST : (i + 1) * DIGEST]), way, b.block * step + i, b.total, fan)
            made, _ = fold(made, rest, source, sources, fan)
            proof = hashlib.sha256(way.hex().encode()).hexdigest()
            yield item and int(item), nodes[i].hex(), subroot.hex(), root.hex(), proof, made.hex(), made == root

    rows = trees.downward(above.downward(root).flatMap(to_sources)).flatMap(to_leaves)
    fields = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return docs.sparkSession.createDataFrame(rows, fields, verifySchema=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(read(spark, sf_dir, "documents"), F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


#: The trees level by level, each leaf's siblings gathered from all of them, and each text folded on its own.
OP11_SQL = r"""
WITH RECURSIVE table_ AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda k: k::UBIGINT)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) AS r(i)),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::UBIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 2 = 0 AS odd FROM documents, table_),
f AS (SELECT doc_id, source, text, CASE WHEN odd THEN replace(text, chr(10), '') ELSE text END AS changed,
  coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head FROM d),
leaves AS MATERIALIZED (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total, leaf, other FROM
  (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS other FROM f)),
tree AS MATERIALIZED (SELECT source, 0 AS level, pos, total, leaf AS node FROM leaves
  UNION ALL SELECT source, level + 1, pos // 3, (any_value(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE total > 1 GROUP BY source, level, pos // 3),
subroots AS MATERIALIZED (SELECT source, level AS height, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1),
high AS MATERIALIZED (SELECT 0 AS level, pos, total, subroot AS node FROM subroots UNION ALL SELECT level + 1, pos // 3, (any_value(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE total > 1 GROUP BY level, pos // 3),
ways AS (SELECT l.source, l.pos AS leaf_at, t.level, t.pos, t.node, l.pos // pow(3, t.level)::BIGINT AS own FROM leaves l JOIN tree t ON t.source IS NOT DISTINCT FROM l.source AND t.pos // 3 = l.pos // pow(3, t.level + 1)::BIGINT AND t.total > 1
  UNION ALL SELECT l.source, l.pos, 1000 + h.level, h.pos, h.node, s.pos // pow(3, h.level)::BIGINT FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN high h ON h.pos // 3 = s.pos // pow(3, h.level + 1)::BIGINT AND h.total > 1),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, leaf_at ORDER BY level) AS step FROM
  (SELECT source, leaf_at, level, string_agg(node, '' ORDER BY pos) FILTER (pos < own) AS lefts, string_agg(node, '' ORDER BY pos) FILTER (pos > own) AS rights FROM ways GROUP BY source, leaf_at, level)),
folds(source, leaf_at, step, node) AS (SELECT source, pos, 0::BIGINT, other FROM leaves
  UNION ALL SELECT f.source, f.leaf_at, f.step + 1, sha256(coalesce(s.lefts, '') || f.node || coalesce(s.rights, '')) FROM folds f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.leaf_at = f.leaf_at AND s.step = f.step + 1),
folded AS (SELECT source, leaf_at, arg_max(node, step) AS folded_root FROM folds GROUP BY source, leaf_at),
proofs AS (SELECT source, leaf_at, string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' ORDER BY level) AS proof FROM steps GROUP BY source, leaf_at)
SELECT l.doc_id, l.leaf, s.subroot, r.node AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, fo.folded_root, fo.folded_root = r.node AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN folded fo ON fo.source IS NOT DISTINCT FROM l.source AND fo.leaf_at = l.pos
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.leaf_at = l.pos, (SELECT node FROM high WHERE total = 1) AS r
"""
