"""Approximate nearest neighbours: inverted lists of product-quantised residuals and exact reranking (op3_nearest)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stage

#: The quantisers are fitted on at most so many vectors, those of the smallest hash of vec_id; all rows are indexed.
FIT_ROWS = 20_000
#: Lists: twice the square root of the rows, and no more than this.
LISTS = 4096
#: Share of the lists that a query looks into, nearest first. Random vectors without clusters need as many as this.
PROBE = 0.8
#: Numbers of a residual that are quantised together, to one of CODES values.
WIDTH, CODES = 4, 256
#: Indexed rows in a block, the unit of work; longer lists are split.
BLOCK_ROWS = 4000
#: Standard deviations of the approximation's error within which a row may still be among the k best and is reranked.
MARGIN = 2.0


class Quantiser(NamedTuple):
    centroids: np.ndarray  # (lists, dimensions)
    codewords: np.ndarray  # (parts, codes, WIDTH)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2, axis=1)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        """(parts, rows, WIDTH), with zeros to a multiple of WIDTH."""
        padded = np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))
        return padded.reshape(len(x), -1, WIDTH).transpose(1, 0, 2)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """(rows, parts) codes of the residuals."""
        parts = self._parts(x - self.centroids[lists])
        return np.stack([np.argmax(p @ w.T - (w**2).sum(axis=1) / 2, axis=1) for p, w in zip(parts, self.codewords)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of what the codes miss of the residuals."""
        parts = self._parts(x - self.centroids[lists])
        return np.sqrt(sum(((p - w[c]) ** 2).sum(axis=1) for p, w, c in zip(parts, self.codewords, codes.T)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): the part of an inner product that each code stands for."""
        return np.stack([p @ w.T for p, w in zip(self._parts(queries), self.codewords)], axis=1)


def _cluster(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's iterations from k different rows; an empty cluster keeps its place."""
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ at.T - (at**2).sum(axis=1) / 2, axis=1)
        n = np.bincount(near, minlength=len(at))
        sums = np.stack([np.bincount(near, x[:, d], len(at)) for d in range(x.shape[1])], axis=1)
        at[n > 0] = sums[n > 0] / n[n > 0, None]
    return at


def fit(sample: np.ndarray, rows: int) -> Quantiser:
    k = max(1, min(LISTS, len(sample) // 4, round(2 * math.sqrt(rows))))
    coarse = Quantiser(_cluster(sample, k), np.zeros((0, 0, WIDTH)))
    parts = coarse._parts(sample - coarse.centroids[coarse.lists(sample)])
    return Quantiser(coarse.centroids, np.stack([np.pad(w, ((0, CODES - len(w)), (0, 0)), mode="edge") for w in (_cluster(p, CODES) for p in parts)]))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: of finite numbers, not all zero, and as many as most rows have."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (common["n"] if common else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, probe: float = PROBE, margin: float = MARGIN) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest rows of vectors by inner product, but for its own vec_id.

    vectors and queries: (vec_id, embedding), other columns are ignored; of several queries of one vec_id the one of the least
    vector is taken, repeated rows of vectors are found once each. Scores are of the original vectors, in double precision. A query looks into `probe`
    of the lists and as many more as it takes to meet 4 * k rows. There, rows are rated by the tables of asymmetric
    distances, and all that may be among the k best for all that the error of their codes can tell are reranked. Index blocks have a bounded size, however many
    rows a list has; queries are streamed past them. Ties go to the smaller vec_id. Rows that are null, zero or not
    finite, or of another length than most, take no part; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    fields = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], fields)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toPandas()
    quantiser = fit(_matrix(sample.embedding), total)
    shared = spark.sparkContext.broadcast(quantiser)  # bounded by LISTS and CODES

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch.embedding)
            lists = shared.value.lists(x)
            codes = shared.value.encode(x, lists)
            yield batch.assign(list=lists.astype(np.int32), codes=[c.tobytes() for c in codes], error=shared.value.errors(x, lists, codes))

    indexed = stage(rows.mapInPandas(index, "vec_id long, embedding array<double>, list int, codes binary, error double"), "ivf")
    # Lists are laid out in a row, as many rows to a block, long ones over several: from the list's size alone.
    sizes = np.zeros(len(quantiser.centroids), np.int64)
    for r in indexed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    pieces, before = np.maximum(1, -(-sizes // BLOCK_ROWS)), np.cumsum(sizes) - sizes
    layout = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(sizes)), "before": before, "size": sizes, "pieces": pieces}), "list int, before long, size long, pieces long")  # LISTS rows at most
    piece = F.pmod(F.xxhash64("vec_id"), F.col("pieces"))
    block = F.expr(f"((before * pieces + _piece * size) div (pieces * {BLOCK_ROWS}))").cast("int")
    stored = indexed.join(F.broadcast(layout), "list").withColumn("_piece", piece).withColumn("block", block)
    least = max(1, math.ceil(probe * len(sizes)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, out = _matrix(batch.embedding), []
            order = np.argsort(-(x @ shared.value.centroids.T), axis=1, kind="stable")
            enough = np.maximum(least, 1 + np.argmax(np.cumsum(sizes[order], axis=1) >= min(4 * k + 1, total), axis=1))
            for query, vector, lists, n in zip(batch.vec_id, batch.embedding, order, enough):
                chosen = lists[:n]
                blocks: dict[int, list[int]] = {}
                for l in chosen[sizes[chosen] > 0].tolist():
                    for b in np.unique((before[l] * pieces[l] + np.arange(pieces[l]) * sizes[l]) // (pieces[l] * BLOCK_ROWS)).tolist():
                        blocks.setdefault(b, []).append(l)
                out += [(b, query, vector, ls) for b, ls in blocks.items()]
            yield pd.DataFrame(out, columns=["block", "id", "embedding", "lists"])

    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInPandas(route, "block int, id long, embedding array<double>, lists array<int>")
    both = stored.select("block", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "embedding", F.array("list").alias("lists"), "codes", "error").union(
        asked.select("block", F.lit(1), "id", "embedding", "lists", F.lit(None).cast("binary"), F.lit(None).cast("double"))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, ready = None, [], None
        for batch in batches:
            for (b, kind), part in batch.groupby(["block", "kind"], sort=True):
                if b != block:
                    block, held, ready = b, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if ready is None and held:
                    rows = pd.concat(held).sort_values("id", kind="stable")
                    ready = (rows.id.to_numpy(), _matrix(rows.embedding), np.array([x[0] for x in rows.lists]), np.frombuffer(b"".join(rows.codes), np.uint8).reshape(len(rows), -1), rows.error.to_numpy())
                if ready:
                    for at in range(0, len(part), 64):
                        yield _best(shared.value, ready, part.iloc[at : at + 64], k, margin)

    found = both.repartition("block").sortWithinPartitions("block", "kind", "id").mapInPandas(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(quantiser: Quantiser, block: tuple, part: pd.DataFrame, k: int, margin: float) -> pd.DataFrame:
    """The k best rows of a block, in ascending order of id, for each of some queries."""
    ids, vectors, lists, codes, errors = block
    queries = _matrix(part.embedding)
    tables, coarse = quantiser.tables(queries).astype(np.float32), (queries @ quantiser.centroids.T).astype(np.float32)
    slack = margin * np.sqrt((queries**2).sum(axis=1) / queries.shape[1])
    out = []
    for i, (query, probed) in enumerate(zip(part.id.tolist(), part.lists.tolist())):
        open_lists = np.zeros(len(quantiser.centroids), bool)
        open_lists[probed] = True
        at = np.flatnonzero(open_lists[lists] & (ids != query))
        if len(at) > k:
            near = coarse[i, lists[at]]
            for p in range(codes.shape[1]):
                near = near + tables[i, p, codes[at, p]]
            unsure = slack[i] * errors[at]
            at = at[near + unsure >= np.partition(near - unsure, -k)[-k] - 1e-5]
        exact = (vectors[at] * queries[i]).sum(axis=1)
        best = np.lexsort((ids[at], -exact))[:k]
        out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][best], "score": exact[best]}))
    return pd.concat(out)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
