"""Benchmark decontamination by a positional inverted index (op5_decontamination). DataFrame functions only.

Postings (term, document, position) of the training tokens are stored document by document, so that building them
takes no shuffle. A test window occurs where the postings of its terms, each moved back by its offset in the test
item, meet. The lists of each window's two rarest terms are intersected first; only documents where they meet are
looked at term by term.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, plain_words, read, stage

#: The term of a posting that stands for the document itself, at position -1.
DOCUMENT = -1


class PositionalIndex(NamedTuple):
    """terms: (word, term); postings: (row, doc_id, n_words, text_hash, term, pos), pos counted in words from 0.

    Each row of the documents has a posting of the term DOCUMENT, and a row number of its own, so that rows may repeat.
    text_hash is on that posting alone.
    """

    terms: DataFrame
    postings: DataFrame

    def documents(self) -> DataFrame:
        return self.postings.where(F.col("term") == DOCUMENT).select("row", "doc_id", "n_words", "text_hash")

    def frequencies(self) -> DataFrame:
        return self.postings.where(F.col("term") != DOCUMENT).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> PositionalIndex:
    """Store the postings of docs (doc_id, text); of the words in vocabulary (word) alone, if that is given."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), plain_words(F.col("text")).alias("words"))
    if vocabulary is None:
        vocabulary = rows.select(F.explode("words").alias("word"))
    terms = stage(vocabulary.where("word is not null").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
    # The empty word, which no text holds, stands for the document.
    known = terms.union(docs.sparkSession.createDataFrame([("", DOCUMENT)], "word string, term long"))
    at = rows.select("row", "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
    postings = at.join(bounded(known), "word").select("row", "doc_id", "n_words", F.when(F.col("pos") == 0, F.col("text_hash")).alias("text_hash"), "term", (F.col("pos").cast("long") - 1).alias("pos"))
    return PositionalIndex(terms, stage(postings, "postings"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words) of each different row of benchmark (item_id, text) that has words."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), plain_words(F.col("text")).alias("words"))
    return stage(words.where(F.size("words") > 0).distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "words"), "items")


def item_terms(index: PositionalIndex, items: DataFrame) -> DataFrame:
    """(item, q, term, freq, n_item): the words of the items by place; freq is null for words no document has."""
    places = items.select("item", F.size("words").alias("n_item"), F.posexplode("words").alias("q", "word"))
    return stage(places.join(index.terms, "word", "left").join(index.frequencies(), "term", "left").select("item", "q", "term", "freq", "n_item"), "item-terms")


def anchors(places: DataFrame, window: int) -> DataFrame:
    """(item, q, term, n_item) of the two rarest places of each window whose words all occur."""
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - window + 1), F.least(F.col("q"), F.greatest(F.lit(0), F.col("n_item") - window)))
    inside = places.withColumn("w", F.explode(starts))
    each = Window.partitionBy("item", "w")
    ranked = inside.withColumn("found", F.count("freq").over(each)).withColumn("all", F.count(F.lit(1)).over(each)).withColumn("rank", F.row_number().over(each.orderBy("freq", "q")))
    return ranked.where("found = all and rank <= 2").select("item", "q", "term", "n_item").distinct()


def phrase_runs(index: PositionalIndex, places: DataFrame, window: int) -> DataFrame:
    """(row, item, first, last): document places of maximal runs of item words, a window long at least."""
    rare = anchors(places, window)
    lists = index.postings.select("row", "term", "pos").join(bounded(rare), "term")
    starts = lists.groupBy("row", "item", (F.col("pos") - F.col("q")).alias("d")).agg(F.min("q").alias("low"), F.max("q").alias("high"), F.first("n_item").alias("n_item"))
    meeting = stage(starts.where((F.col("low") < F.col("high")) | (F.least("n_item", F.lit(window)) == 1)).select("row", "item", "d", "n_item"), "meeting")
    postings = index.postings.where(F.col("term") != DOCUMENT).select("row", "term", "pos").join(bounded(meeting.select("row").distinct()), "row", "left_semi")
    q = F.col("pos") - F.col("d")
    matched = (
        postings.join(meeting, "row").where(q.between(0, F.col("n_item") - 1)).select("row", "item", "d", "n_item", "term", q.cast("int").alias("q"))
        .join(bounded(places.select("item", "q", "term")), ["item", "q", "term"])
    )
    along = Window.partitionBy("row", "item", "d").orderBy("q")
    runs = matched.withColumn("run", F.col("q") - F.row_number().over(along)).groupBy("row", "item", "d", "run").agg(F.min("q").alias("a"), F.max("q").alias("b"), F.first("n_item").alias("n_item"))
    return runs.where(F.col("b") - F.col("a") + 1 >= F.least("n_item", F.lit(window))).select("row", "item", (F.col("d") + F.col("a")).alias("first"), (F.col("d") + F.col("b")).alias("last"))


def proximity(index: PositionalIndex, items: DataFrame, slop: int) -> DataFrame:
    """(row, doc_id, item_id): documents that hold the two rarest different words of an item at most slop places apart.

    Places are paired by blocks of slop + 1 places, so that a document's places aren't all paired.
    """
    places = item_terms(index, items).where("freq is not null").groupBy("item", "term").agg(F.first("freq").alias("freq"))
    ranked = places.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("freq", "term")))
    block = F.floor(F.col("pos") / (slop + 1))
    one, two = (index.postings.select("row", "term", "pos").join(bounded(ranked.where(F.col("rank") == k)), "term").select("row", "item", "pos", block.alias("block")) for k in (1, 2))
    near = one.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1))).withColumnRenamed("pos", "pos1")
    found = near.join(two, ["row", "item", "block"]).where(F.abs(F.col("pos1") - F.col("pos")) <= slop).select("row", "item").distinct()
    return found.join(items.select("item", "item_id"), "item").join(index.documents(), "row").select("row", "doc_id", "item_id")


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    A null or wordless text has no words and isn't contaminated; wordless items are ignored, repeated items count
    once, and an item shorter than the window is one window. Extra columns are ignored; empty tables are fine.
    """
    items = items_of(benchmark)
    index = build_index(docs, items.select(F.explode("words").alias("word")))
    runs = stage(phrase_runs(index, item_terms(index, items), window), "runs")
    before = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.select("row", "first", "last").distinct().withColumn("reached", F.coalesce(F.max("last").over(before), F.lit(-1)))
    hits = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.col("reached") + 1) + 1)).alias("n_hit"))
    named = runs.select("row", "item").distinct().join(bounded(items.select("item", "item_id")), "item").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    found = hits.join(named, "row")
    return (
        index.documents().join(found, "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce(F.size("ids").cast("long"), F.lit(0)).alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "text_hash",
        )
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win
       FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
dw AS (SELECT r, i, n, array_to_string(words[i:i + n - 1], ' ') AS win
       FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
