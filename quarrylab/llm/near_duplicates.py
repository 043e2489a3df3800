"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find (op9_near_duplicates)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, in_slices, read, stage
from .components import components
from .shingles import band_hashes, fingerprint, shingle_set, shingle_sets, superminhash

#: 45 bands of 5 slots: a pair of similarity 0.75 shares a band but for 5 in a million times.
BANDS, ROWS = 45, 5
#: Shingles that a task of the verification holds for each of its two blocks.
BLOCK_SHINGLES = 2_000_000
#: Shingles whose signatures are made at once.
BATCH_SHINGLES = 300_000


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, lo and hi (the set's fingerprint), bands; lo, hi and bands are null without words."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(pa.array(batch.text, pa.string(), from_pandas=True), size)
            begin, total = 0, np.cumsum([len(s) for s in sets])
            while begin < len(sets):
                before = total[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, before + BATCH_SHINGLES, "right")))
                yield rows_of(batch.iloc[begin:end], sets[begin:end])
                begin = end

    def rows_of(batch: pd.DataFrame, sets: list[np.ndarray]) -> pd.DataFrame:
        full = [i for i, s in enumerate(sets) if len(s)]
        found = band_hashes(superminhash([sets[i] for i in full], bands * rows), bands, rows)
        lo, hi, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        for i, h in zip(full, found):
            (lo[i], hi[i]), keys[i] = fingerprint(sets[i]), h
        return pd.DataFrame({"doc_id": batch.doc_id.to_numpy(), "text_hash": batch.text_hash.to_numpy(), "n_shingles": [len(s) for s in sets], "lo": pd.array(lo, "Int64"), "hi": pd.array(hi, "Int64"), "bands": keys})

    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return in_slices(source, make, "doc_id long, text_hash long, n_shingles long, lo long, hi long, bands array<long>")


def _linked(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join what the sets' similarities join: a search from set to set that looks at unreached ones only."""
    sizes = np.array([len(s) for s in sets])
    left = np.arange(len(sets))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            fits = (sizes[left] * 100 >= sizes[at] * percent) & (sizes[at] * 100 >= sizes[left] * percent)
            near = left[fits]
            if not len(near):
                continue
            items = np.concatenate([sets[i] for i in near])
            place = np.searchsorted(sets[at], items)
            place[place == sizes[at]] = 0
            starts = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
            common = np.add.reduceat((sets[at][place] == items).astype(np.int64), starts)
            got = near[100 * common >= percent * (sizes[at] + sizes[near] - common)]
            yield from ((at, i) for i in got)
            queue += got.tolist()
            left = np.setdiff1d(left, got, assume_unique=True)


def verify(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) between sets of `members` (text, root, i, j, blocks sorted together) whose similarity suffices."""

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, nodes, sets = None, [], []

        def links() -> pd.DataFrame:
            found = list(_linked(sets, percent)) if len(sets) > 1 else []
            return pd.DataFrame({"a": [nodes[a] for a, _ in found], "b": [nodes[b] for _, b in found]}, dtype="int64")

        for batch in batches:
            for root, i, j, node, lo, hi, text in zip(batch.root, batch.i, batch.j, batch.node, batch.lo, batch.hi, batch.text):
                if (root, i, j) != key:
                    yield links()
                    key, nodes, sets = (root, i, j), [], []
                found = shingle_set(text, size)
                # Other texts of the same hash aren't asked for.
                if len(found) and fingerprint(found) == (lo, hi) and (not nodes or nodes[-1] != node):
                    nodes.append(node)
                    sets.append(found)
        yield links()

    return members.mapInPandas(tiles, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, text_hash, n_shingles, component_id, kept, component.

    component is a number of the component's; null without words. Exact copies of a shingle set are one class from the start. Classes that share a band are candidates; the
    candidates' connected components are cut into tiles of bounded size, and within a tile every class that
    isn't reached yet is compared on full sets with those reached. So no component is settled by estimates, no group
    sits in one task, and no pairs within a group are emitted but a spanning forest of them.

    Null or wordless texts have no shingles and are linked with nothing. Rows with equal texts are linked, also if
    they share a doc_id; kept is true for all rows of the component's smallest doc_id. A null doc_id is no
    candidate for component_id. An empty table gives an empty one; other columns are ignored.
    """
    made = stage(sketches(docs, size, bands, rows), "sketches")
    grouped = made.where("lo is not null").groupBy("lo", "hi")
    # Each class is read again from one text of its own: doc_id alone may be on many rows.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash")))
    classes = grouped.agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    # A number of its own stands for each set, so that no two sets are one node.
    classes = classes.withColumns({"first_id": F.col("first.doc_id"), "first_hash": F.col("first.text_hash")}).drop("first")
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub != other").select("band", "hub")
    candidates = components(banded.join(shared, "band").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    classes = classes.drop("bands")

    picked = stage(classes.join(candidates, "node").select("node", "lo", "hi", "first_id", "first_hash", "n_shingles", "root"), "picked")
    blocks = picked.groupBy("root").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("lo", "hi"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
    placed = (
        picked.join(blocks, "root").withColumn("block", block).withColumn("with", F.explode(others))
        .select("root", "node", "lo", "hi", "first_id", "first_hash", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    )
    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    texts = source.join(bounded(placed), F.expr("doc_id <=> first_id AND text_hash <=> first_hash")).select("root", "i", "j", "node", "lo", "hi", "text")
    repeated = stage(made.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash").join(picked, F.expr("doc_id <=> first_id AND text_hash <=> first_hash")).select("node"), "repeated")
    if not repeated.isEmpty():  # copies of a row with its doc_id: one of them, found in tasks before the shuffle
        once = texts.join(bounded(repeated), "node", "left_semi").select(*texts.columns).dropDuplicates(["root", "i", "j", "node"])
        texts = texts.join(bounded(repeated), "node", "left_anti").select(*texts.columns).union(once)
    tiled = texts.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    linked = components(verify(tiled, size, percent))

    grouped = classes.join(linked, "node", "left").withColumn("label", F.coalesce("root", "node"))
    least = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1")
    several = grouped.join(least.select("label", "component_id"), "label", "left").select("lo", "hi", "component_id", "label")
    return (
        made.select("doc_id", "text_hash", "n_shingles", "lo", "hi").join(several, ["lo", "hi"], "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "text_hash", F.col("label").alias("component"))
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash", "component")


#: Shingles spelled out, all pairs that share one counted, and the links' closure.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id, w.doc_id = min(root) AS kept
FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
