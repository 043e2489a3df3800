"""License scans: phrases, and an exact set-similarity join of text blocks with templates (op6_licenses).

A block matches a template if it holds at least the threshold's share of the template's distinct words. Words are
ordered by how often the corpus holds them, rarest first. A match shares so many words that one of the template's
first few (its prefix) is among the first few of the block; blocks are joined with templates on these alone, then
the length and positional filters bound what the rest can add, and what is left is counted. DataFrame functions only.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, lower_ascii, plain_words, read, stage

#: Phrases to find as consecutive words, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that texts carry, with their labels.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2.0"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]
#: For each template, words that must stand in this order in what matches it, and words that mustn't come next: without them it's another licence.
MARKS = [
    ("gnu general public", ""), ("lesser general public", ""), ("affero general public", ""), ("apache", ""), ("cc by", "nc nd sa"),
    ("attribution", "sharealike share noncommercial non noderivatives noderivs no"), ("attribution sharealike", ""), ("waived", ""), ("mit", ""), ("hereby granted", ""),
    ("redistribution", ""), ("mozilla public", ""), ("rights reserved", ""),
]
THRESHOLD = 0.8
#: Blocks end at a line's end and at a sentence's.
BLOCK_ENDS = r"\n|[.!?](?=\s)"


class Template(NamedTuple):
    label: str
    words: list[str]  # distinct, by frequency
    least: int  # words that a match shares with it

    @property
    def prefix(self) -> list[str]:
        return self.words[: len(self.words) - self.least + 1]


def ordered_templates(templates: list[tuple[str, list[str]]], often: dict[str, int], threshold: float) -> list[Template]:
    """The templates (label, words) that have words, each with its distinct words by frequency, rarest first."""
    order = lambda w: (often.get(w, 0), w)
    return [Template(label, sorted(set(words), key=order), math.ceil(threshold * len(set(words)) - 1e-9)) for label, words in templates if words]


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def phrase_places(words: Column, phrase: str) -> Column:
    """Places in words where the phrase's words stand consecutively."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))
    here = lambda i: F.forall(F.array(*[F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)]), lambda same: same)
    possible = (F.size(words) >= len(parts)) & F.array_contains(words, max(parts, key=len))
    return F.when(possible, F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    score is 1 where a phrase stands, else the largest share of a template in a block that reaches the threshold,
    else 0. Null texts are empty and hold nothing. Rows may repeat; other columns are ignored; an empty table or an empty list of
    templates or phrases is fine. All matches of a block come from one join, in which no key is on more rows than one document. The texts are
    split once: what is staged of a block is its template words. Templates are a parameter, their words kept in the plan; a text of
    any length is one row.
    """
    spark = docs.sparkSession
    split = spark.createDataFrame([(t,) for _, t in templates], "text string").select(plain_words(F.col("text")).alias("w")).collect()
    parts = [(label, r["w"]) for (label, _), r in zip(templates, split)]
    known = sorted({w for _, ws in parts for w in ws})
    least = min((math.ceil(threshold * len(set(ws)) - 1e-9) for _, ws in parts if ws), default=0)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lower_ascii(F.col("text")).alias("low"))
    rows = rows.withColumn("words", plain_words(F.col("low")))
    places = rows.select("*", *[phrase_places(F.col("words"), p).alias(f"at{k}") for k, p in enumerate(phrases)])
    at = [F.col(f"at{k}") for k in range(len(phrases))]
    all_at = F.concat(*at) if at else F.array().cast("array<int>")
    named = F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(at, phrases.values())])).cast("array<string>")
    blocks = F.transform(F.split("low", BLOCK_ENDS), lambda b: F.array_intersect(F.split(b, SEPARATORS), strings(known)))
    kept = F.when(F.arrays_overlap("words", strings(known)), F.filter(blocks, lambda b: F.size(b) >= max(least, 1))) if known else F.lit(None).cast("array<array<string>>")
    base = stage(places.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"), F.size(all_at).cast("long").alias("n_base"),
        F.array_min(all_at).cast("long").alias("first_word"), F.array_max(all_at).cast("long").alias("last_word"), named.alias("named"), kept.alias("blocks"),
    ), "blocks")

    # Frequencies over the blocks that can match; the order of words decides over speed alone.
    counted = base.select(F.explode(F.flatten("blocks")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = {r["word"]: r["n"] for r in counted.collect()}  # words of templates alone
    found = ordered_templates(parts, often, threshold)
    vocabulary = sorted(known, key=lambda w: (often.get(w, 0), w))
    base = base.withColumn("blocks", F.transform("blocks", lambda b: F.array_intersect(strings(vocabulary), b)))

    entries = [(w, k, len(t.words), t.least, j, t.label, t.words) for k, t in enumerate(found) for j, w in enumerate(t.prefix)]
    index = spark.createDataFrame(entries, "word string, template int, size int, least int, place int, label string, template_words array<string>")
    carried = [c for c in base.columns if c != "blocks"]
    each = base.select(*carried, F.posexplode_outer("blocks").alias("block", "sign"))
    head = F.slice("sign", 1, F.greatest(F.size("sign") - least + 1, F.lit(0)))
    probes = each.select("*", F.posexplode_outer(head).alias("spot", "word"))
    # Length and position: the words from here on must be enough to reach the template's least number.
    room = F.least(F.size("sign") - F.col("spot"), F.col("size") - F.col("place"))
    joined = probes.join(F.broadcast(index), (probes["word"] == index["word"]) & (F.size("sign") >= F.col("least")) & (room >= F.col("least") - F.least("spot", "place")), "left")
    shared = F.size(F.array_intersect("sign", "template_words"))
    rated = joined.withColumn("share", F.when(shared >= F.col("least"), shared / F.col("size")))
    hit = F.col("share").isNotNull()
    grouped = rated.groupBy("row").agg(
        *[F.first(c).alias(c) for c in carried if c != "row"],
        F.collect_set(F.when(hit, F.col("label"))).alias("more"), F.max("share").alias("share"), F.size(F.collect_set(F.when(hit, F.col("block")))).cast("long").alias("n_blocks"),
    )
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return grouped.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("named")).alias("base_labels"), listed(F.concat("named", "more")).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), "n_blocks",
    )


def mark_places(words: Column, template: Column) -> Column:
    """Places in words where the template's mark stands, and isn't followed by a word that makes it another."""
    mark = template["mark"]
    here = lambda i: (F.slice(words, i + 1, F.size(mark)) == mark) & ~F.array_contains(template["not_next"], F.coalesce(F.get(words, i + F.size(mark)), F.lit("")))
    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def license_notices(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, marks: list[tuple[str, str]] = MARKS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, notices (labels of templates matched with their marks), score (the largest share, else 0).

    A template matches a block of the text as in license_scan, if its mark stands in the block too; or as many words in
    a row as it has itself, around its mark, wherever lines, sentences and paragraphs end. Null texts hold nothing, rows may repeat, other columns are ignored. Row-local: only rows that hold enough of a template's words
    are looked at closely, without a shuffle.
    """
    if len(templates) != len(marks):
        raise ValueError("each template needs one mark")
    fields = "array<struct<label: string, words: array<string>, length: int, least: int, mark: array<string>, not_next: array<string>>>"
    split = docs.sparkSession.createDataFrame([(t, m, n) for (_, t), (m, n) in zip(templates, marks)], "text string, mark string, not_next string")
    split = split.select(*[plain_words(F.col(c)).alias(c) for c in split.columns]).collect()
    known, listed = set(), []
    for (label, _), r in zip(templates, split):
        distinct = list(dict.fromkeys(r["text"]))
        known |= {*distinct, *r["mark"]}
        if distinct:
            listed.append(F.struct(
                F.lit(label).alias("label"), strings(distinct).alias("words"), F.lit(len(r["text"])).alias("length"), F.lit(math.ceil(threshold * len(distinct) - 1e-9)).alias("least"),
                strings(r["mark"]).alias("mark"), strings(r["not_next"]).alias("not_next"),
            ))
    low = docs.select("doc_id", lower_ascii(F.col("text")).alias("low"))
    rows = low.withColumn("words", plain_words(F.col("low")))
    present = rows.withColumn("present", F.array_intersect("words", strings(sorted(known))))
    enough = lambda t: (F.size(F.array_intersect(F.col("present"), t["words"])) >= t["least"]) & (F.size(F.array_except(t["mark"], F.col("present"))) == 0)
    close = present.withColumn("near", F.filter(F.array(*listed).cast(fields), enough))
    blocks = F.transform(F.split("low", BLOCK_ENDS), lambda b: F.array_remove(F.split(b, SEPARATORS), ""))

    def share(t: Column) -> Column:
        shared = lambda words: F.size(F.array_intersect(words, t["words"]))
        of_blocks = F.transform(blocks, lambda b: F.when(shared(b) >= t["least"], F.when(F.size(mark_places(b, t)) > 0, shared(b))))
        # All windows of the template's length that hold the mark, over the whole text.
        size, last = F.size("words"), F.greatest(F.size("words") - t["length"], F.lit(0))
        starts = F.transform(mark_places(F.col("words"), t), lambda p: F.sequence(F.greatest(p + F.size(t["mark"]) - t["length"], F.lit(0)), F.least(p, last)))
        of_windows = F.transform(F.array_distinct(F.flatten(starts)), lambda s: shared(F.slice("words", s + 1, F.least(t["length"], size))))
        most = F.array_max(F.concat(of_blocks, F.filter(of_windows, lambda n: n >= t["least"])))
        return most / F.size(t["words"])

    hits = F.filter(F.transform("near", lambda t: F.struct(t["label"].alias("label"), share(t).alias("share"))), lambda x: x["share"].isNotNull())
    found = close.withColumn("hits", F.when(F.size("near") > 0, hits))
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.coalesce("hits.label", F.array().cast("array<string>")))), ",").alias("notices"), F.coalesce(F.array_max("hits.share"), F.lit(0.0)).alias("score"))


def op6_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(read(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("n_blocks")


def oracle() -> str:
    """DuckDB SQL that compares every block with every template."""
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda text: f"regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS low FROM documents),
w AS (SELECT r, doc_id, low, {words("low")} AS words FROM d),
p(parts, label) AS (VALUES {phrases}),
a AS (SELECT r, label, unnest(list_filter(range(0, greatest(0, len(words) - len(parts) + 1)), lambda i: words[i + 1:i + len(parts)] = parts)) AS pos FROM w CROSS JOIN p),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM a GROUP BY r),
t AS (SELECT label, list_distinct({words("text")}) AS parts FROM (VALUES {templates}) AS x(label, text)),
k AS (SELECT r, list_distinct({words("block")}) AS parts FROM (SELECT r, unnest(string_split_regex(regexp_replace(low, '([.!?])([ \t\n\r\f\v])', E'\\1\n\\2', 'g'), '\n')) AS block FROM d)),
m AS (SELECT r, t.label, len(list_intersect(k.parts, t.parts)) / len(t.parts) AS share FROM k CROSS JOIN t WHERE len(list_intersect(k.parts, t.parts)) >= ceil({THRESHOLD} * len(t.parts) - 1e-9)),
s AS (SELECT r, max(share) AS share, list(DISTINCT label) AS more FROM m GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN s USING (r)
"""
