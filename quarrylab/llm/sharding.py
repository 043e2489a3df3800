"""Sharding by weighted rendezvous hashing of stable record keys, and its query op4_sharding. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless, read, stage

#: Rows of one shard that one task numbers.
SLOT_ROWS = 20_000


def cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight for a u in (0, 1) drawn by the hash of key and shard; the least cost over shards wins.

    A shard wins with a probability in proportion to its weight, whatever other shards there are.
    """
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def winner(key: Column, weights: dict[int, float]) -> Column:
    """struct(cost, shard) of the shard of the least cost, ties to the smaller shard; shards of weight 0 get nothing."""
    usable = {s: w for s, w in sorted(weights.items()) if w > 0}
    if not usable or any(w < 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be finite, none negative, one positive at least")
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in usable.items()])
    return F.array_min(F.transform(shards, lambda x: F.struct(cost(key, x.shard, x.weight).alias("cost"), x.shard.alias("shard"))))


def rendezvous(df: DataFrame, key: Column, weights: list[float], grown_weight: float | None = None, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add the shard of each row, and with grown_weight the shard it has once one more shard is there.

    Row-local: no shuffle, no state; a null key is a key like any other. Rows that move at growth all move into the
    new shard. A key that many rows share keeps them together, as the key alone decides.
    """
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    df = df.withColumn("_won", winner(key, dict(enumerate(weights))))
    n = len(weights)
    if grown_weight:
        df = df.withColumn(grown, F.when(cost(key, F.lit(n), F.lit(float(grown_weight))) < F.col("_won.cost"), F.lit(n)).otherwise(F.col("_won.shard")))
    return df.withColumn(shard, F.col("_won.shard")).drop("_won")


def shard_documents(docs: DataFrame, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """Put documents into shards by doc_id, and number each shard's rows from 0 without gaps.

    Null texts count as empty, texts of any length are hashed whole; equal doc_ids (and null ones) share a shard; repeated rows get
    slots of their own; other columns are ignored, whatever their names; an empty table gives an empty one. Slots are numbered in parts that go by a
    number of the row's own, so that a doc_id on many rows is in no one task.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    rows = stage(rendezvous(rows, F.col("doc_id"), weights, grown_weight).withColumn("_row", F.monotonically_increasing_id()), "sharded")
    buckets = max(1, math.ceil(rows.count() / len(weights) / SLOT_ROWS))
    return gapless(rows, "shard", ["doc_id", "text_crc32", "size"], F.col("_row"), buckets, "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), [1.0] * 40)
