"""Quality classifier by importance resampling over hashed n-grams (op1_importance_resampling).

w(text) = P(text | target) / P(text | raw), the ratio of two generative models of hashed n-grams, and the sample is the
k texts of largest log w plus Gumbel noise. Raw text is a mixture: of target text and of a model for each reason to
turn a text down, in the shares that they have among the labelled documents. So w is 1 / share of target at most, and
near 0 for a text that one of the other models explains better.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, mapped, read, stage
from .components import components
from .near_duplicates import sketches
from .shingles import GOLDEN, mix
from .words import distinct, frames, split, spread

#: Bits of a hash bucket: so many that a text rarely meets a bucket of weight by chance.
BITS = 32
#: At most so many labelled documents are learned from: those of the smallest hash of doc_id.
FIT_ROWS = 20_000
#: Shrinkage: a model has a bucket's own share only where that differs from target's by this G statistic (p about 8e-6) ...
SIGNIFICANT = 20.0
#: ... and by this log ratio; elsewhere it has target's, so that the ratio is 1.
EFFECT = 2.5
#: Bands and their slots by which labelled texts resemble each other: at a similarity of 0.3 two of three do.
BANDS = (12, 2)
#: n-grams that a fitting task holds before it hands on their counts.
_HELD = 1_000_000
#: Noise of the query: w ** 4 is what it samples in proportion to, as it keeps nearly all that is target (see op1_importance_resampling).
TEMPERATURE = 0.25
POOLS = {"low_quality": "quality = 0", "toxic": "toxic = 1 and quality <> 0"}

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Letters of a word's beginning.
_BEGINNING = 5
_MARK, _UPPER, _OTHER, _AGAIN = range(4)


def _token(token: str) -> tuple[int, int]:
    """A token's lower-case hash, with its shape in the lowest two bits, and the hash of its beginning."""
    shape = _MARK if not (token[0].isalnum() or token[0] == "_") else _UPPER if len(token) > 1 and token.isupper() else _OTHER
    lower = token.lower()
    return xxhash.xxh3_64_intdigest(lower) & ~3 | shape, xxhash.xxh3_64_intdigest(lower[:_BEGINNING], seed=1)


def buckets_of(texts: pa.Array) -> list[np.ndarray]:
    """The buckets of each text's n-grams, as often as it has them: words, word pairs, runs of four token shapes; and, once each,
    beginnings of words that it has once, twice and three times. None for a null text."""
    words = split(texts)
    known, at = distinct(words.words)
    tokens = [_TOKEN.findall(w) for w in known]
    codes = np.array([_token(t) for each in tokens for t in each], np.uint64).reshape(-1, 2)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    place = spread((np.cumsum(sizes) - sizes)[at], sizes[at])
    ends = np.concatenate([[0], np.cumsum(sizes[at])])[words.ends]
    first = np.zeros(len(place) + 1, bool)
    first[np.concatenate([[0], ends])] = True
    code, starts = codes[place].T
    values, shapes = code & ~np.uint64(3), (code & np.uint64(3)).astype(np.uint64)
    shapes[1:][(values[1:] == values[:-1]) & ~first[1:-1]] = _AGAIN
    pairs = mix(values[:-1] * GOLDEN + values[1:])
    runs = mix(shapes[:-3] * np.uint64(64) + shapes[1:-2] * np.uint64(16) + shapes[2:-1] * np.uint64(4) + shapes[3:] + np.uint64(1)) if len(shapes) > 3 else values[:0]
    values, found = mix(values), []
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
        begun, times = np.unique(starts[a:b], return_counts=True)
        found.append(np.concatenate([values[a:b], pairs[a : max(a, b - 1)], runs[a : max(a, b - 3)], *(mix(begun[times >= n] + np.uint64(n)) for n in (1, 2, 3))]) >> np.uint64(64 - BITS))
    return found


class Model(NamedTuple):
    """Shares of target and of each pool among the labelled documents; per pool, buckets in order with the log ratio of target to it."""

    target: float
    shares: list[float]
    buckets: list[np.ndarray]
    ratios: list[np.ndarray]

    def log_weight(self, seen: np.ndarray) -> float:
        """log P(seen | target) / P(seen | raw); a bucket counts once however often it is seen."""
        parts = [math.log(self.target)] if self.target else []
        for share, known, ratios in zip(self.shares, self.buckets, self.ratios):
            if share:
                at = np.minimum(np.searchsorted(known, seen), max(len(known) - 1, 0))
                hit = np.unique(at[known[at] == seen]) if len(known) else at[:0]
                parts.append(math.log(share) - float(ratios[hit].sum()))
        return -float(np.logaddexp.reduce(parts)) if parts else 0.0


def labelled(docs: DataFrame, labels: DataFrame, pools: dict[str, str], rows: int) -> DataFrame:
    """(text, classes, weight) of a bounded sample of the labels' doc_ids; classes has a bit for target and for each pool.

    No row is left out, but texts of the same classes that resemble each other (they share one of BANDS bands, by chains) weigh as
    one text together, so that the words of a text copied and edited a thousand times aren't taken for its class's.
    """
    worst = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id is not null")
    picked = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    flags = [F.coalesce(F.expr(c), F.lit(False)).cast("int") for c in pools.values()]
    classes = F.when(sum(flags) == 0, 1).otherwise(0) + sum(f * (2 << k) for k, f in enumerate(flags))
    picked = picked.select(F.col("doc_id").cast("long"), classes.alias("classes"))
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")  # picked: at most `rows` rows
    sample = stage(found.select(F.monotonically_increasing_id().alias("doc_id"), "text", "classes"), "labelled")
    banded = sketches(sample, 5, *BANDS).select("doc_id", F.explode("bands").alias("band")).join(sample.select("doc_id", "classes"), "doc_id")
    banded = stage(banded, "labelled-bands")
    hubs = banded.groupBy("band", "classes").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).where("hub != other")
    groups = components(banded.join(hubs, ["band", "classes"]).select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    weights = groups.join(groups.groupBy("root").agg((1 / F.count(F.lit(1))).alias("weight")), "root").select(F.col("node").alias("doc_id"), "weight")
    return sample.join(weights, "doc_id", "left").select("text", "classes", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def fit(docs: DataFrame, labels: DataFrame, pools: dict[str, str] = POOLS, rows: int = FIT_ROWS) -> Model:
    """Learn the models from a bounded sample of the labelled documents.

    Target is what no pool's condition on the labels holds for. A document counts once for each of its buckets, so that
    one repetitive text doesn't make a bucket count, and texts that resemble each other count as one (see labelled).
    Several labels of one doc_id count as the worst. A share is (documents with the bucket + 1/2) / (documents + 1).
    n-grams of a single document can't reach SIGNIFICANT among so few rows and aren't kept.
    """
    kinds = 2 << len(pools)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, weights, size = [], [], 0
        for batch in batches:
            for seen, bits, weight in zip(buckets_of(pa.array(batch.text, pa.string(), from_pandas=True)), batch.classes, batch.weight):
                # Bucket -1 counts documents.
                held.append(np.append(np.unique(seen).astype(np.int64), -1) * kinds + int(bits))
                weights.append(np.full(len(held[-1]), weight))
                size += len(held[-1])
                if size >= _HELD:
                    yield counted(held, weights)
                    held, weights, size = [], [], 0
        if held:
            yield counted(held, weights)

    def counted(held: list[np.ndarray], weights: list[np.ndarray]) -> pd.DataFrame:
        codes, at = np.unique(np.concatenate(held), return_inverse=True)
        return pd.DataFrame({"bucket": codes // kinds, "classes": codes % kinds, "n": np.bincount(at, np.concatenate(weights))})

    names = ["target", *pools]
    sums = [F.sum(F.when(F.col("classes").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0.0)).alias(name) for k, name in enumerate(names)]
    found = in_slices(labelled(docs, labels, pools, rows), count, "bucket long, classes long, n double").groupBy("bucket").agg(*sums)
    counts = stage(found.where(" or ".join(f"{name} > 1" for name in names) + " or bucket = -1"), "ngrams")
    sizes = counts.where("bucket = -1").first()
    size = {name: float(sizes[name]) if sizes else 0.0 for name in names}
    total = sum(size.values())
    if not size["target"] or size["target"] == total:  # nothing to tell apart
        return Model(1.0, [], [], [])
    model = Model(size["target"] / total, [size[p] / total for p in pools], [], [])
    for pool in pools:
        n, m = size["target"], size[pool]
        a, b = F.col("target").cast("double"), F.col(pool).cast("double")
        part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
        gap = 2 * (part(a, (a + b) * n / (n + m)) + part(b, (a + b) * m / (n + m)))
        ratio = F.log((a + 0.5) / (n + 1) / ((b + 0.5) / (m + 1)))
        kept = counts.where((F.col("bucket") >= 0) & (gap >= SIGNIFICANT) & (F.abs(ratio) >= EFFECT)).select("bucket", ratio.alias("ratio"))
        kept = kept.toArrow().sort_by("bucket") if m else pa.table({"bucket": pa.array([], pa.int64()), "ratio": pa.array([], pa.float64())})  # bounded by FIT_ROWS
        model.buckets.append(kept["bucket"].to_numpy().astype(np.uint64)), model.ratios.append(kept["ratio"].to_numpy())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, n_grams (how many were looked at) and log_weight of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_ROWS

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for frame in frames(batches, "text"):
            seen = buckets_of(frame["text"])
            made = [frame["doc_id"], frame["text_hash"], pa.array([len(x) for x in seen], pa.int64()), pa.array([model.log_weight(x) for x in seen], pa.float64())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "text_hash", "n_grams", "log_weight"])

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return mapped(source, rate, "doc_id long, text_hash long, n_grams long, log_weight double")


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise, the same for the same key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int, few: int = 10_000) -> float:
    """The k-th largest value of key, by counts in ever narrower ranges; only `few` values ever reach the driver."""
    if k < 1:
        return math.inf
    low, high = df.agg(F.min(key), F.max(key)).first()
    held = df.count()
    while held > few and low < high and k <= held:
        width = (high - low) / 1000
        if low + width <= low:
            break
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(999))
        counts = {r["at"]: r for r in df.where(F.col(key).between(low, high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()}
        for at in sorted(counts, reverse=True):
            if k <= counts[at]["n"]:
                low, high, held = counts[at]["low"], counts[at]["high"], counts[at]["n"]
                break
            k -= counts[at]["n"]
    if low is None or k > held:
        return -math.inf
    if held > few:
        return low
    return sorted((r[0] for r in df.where(F.col(key).between(low, high)).select(key).collect()), reverse=True)[k - 1]


def resample(scored: DataFrame, k: int, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """The k rows of largest log_weight + temperature * Gumbel noise, with that sum as sample_key; ties stay together.

    At temperature 1 rows are drawn without replacement in proportion to their weights. Noise goes by doc_id, so equal rows stay or go together.
    """
    keyed = scored.withColumn("sample_key", F.col("log_weight") + temperature * gumbel(F.coalesce("doc_id", F.lit(-1)), seed))
    return keyed.where(F.col("sample_key") >= kth_largest(keyed, "sample_key", k))


def importance_resampling(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0) -> DataFrame:
    """The sampled rows of docs (doc_id, text) as doc_id, text_hash, n_grams, log_weight, sample_key.

    Without k: as many rows as are likelier target than not, w * share of target >= 1/2. Null and empty texts
    hold no n-gram; target and raw give them the same probability. Without labels, or without target or raw rows among
    them, all weights are 1 and all rows stay. Rows may repeat; other columns are ignored, whatever their names, also those of labels; a text
    of any length is looked at as a whole.
    """
    model = fit(docs, labels)
    scored = stage(score(docs, model), "weights")
    if k is None:
        k = scored.where(F.col("log_weight") + F.lit(math.log(2 * model.target)) >= 0).count()
    return resample(scored, k, temperature)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k is about the number of target texts, so that at temperature 1 the tail of the noise would decide over the last rows."""
    return importance_resampling(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), temperature=TEMPERATURE).drop("text_hash")
