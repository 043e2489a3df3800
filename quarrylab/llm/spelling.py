"""Spelling variants by anagram keys: words of one letter's difference, the common form of each, and its root (op13_spelling_variants)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, read, stage

#: Keys are sums of letters to this power, modulo a prime, so that no length of a word overflows them.
POWER, PRIME = 5, (1 << 61) - 1
#: Shortest words, fewest occurrences, and how many times as common as the word its form is.
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many occurrences (by checksum of document and word) is read without one of its letters.
SLIP = 31


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    value = code
    for _ in range(POWER - 1):
        value = value * code
    return value


def letters(word: Column) -> Column:
    return F.split(word, "")


def anagram_key(word: Column) -> Column:
    """The sum of the letters' powers: one number for all orders of the same letters."""
    return F.aggregate(letters(word), F.lit(0).cast("long"), lambda total, c: F.pmod(total + letter_value(c), F.lit(PRIME)))


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): letter runs of docs (doc_id, text), A-Z lower-cased, some read without a letter, that are long and frequent enough.

    Counted in tasks before the shuffle, so that a word of any frequency is a row a task.
    """
    run = F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit("[a-zÀ-ÿ]{%d,}" % least_letters), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), run.alias("_run"))
    sum_ = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    word = F.when(F.col("_h") % slip == 0, F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))).otherwise(F.col("_run"))
    counted = runs.withColumn("_h", sum_).select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for words (word, n), each pair of one inserted, deleted or replaced letter in both directions.

    Removing a letter takes its value from the anagram key. Two words of an exchanged letter have such a reduced key in
    common; a word with a letter too many has a reduced key that is the other word's own. As one letter's edit leaves
    one half of a word as it was, keys are joined together with the hash of a half, so that the many words of the same
    letters don't all meet; the letters' order is then verified by the edit distance. A pair that meets by both halves
    counts once. Each word has at most 90 different letters, so it emits a bounded number of keys whatever its length.
    Both sides are sorted and merged: Spark sizes them by the words' file, without what the letters and halves multiply.
    """
    key, size = F.col("key"), F.length("word")
    keyed = words.withColumn("key", anagram_key(F.col("word")))

    def halves(df: DataFrame, length: Column) -> DataFrame:
        """Rows for each half that an edit may leave alone, of what is left (of that length) without the edited letter."""
        first = F.floor(length / 2).cast("int")
        front, back = F.xxhash64(F.left("word", first)), F.xxhash64(F.right("word", length - first))
        return df.withColumns({"length": length, "front": front, "half": F.explode(F.array(F.struct(F.lit(0).alias("side"), front.alias("hash")), F.struct(F.lit(1).alias("side"), back.alias("hash"))))})

    letter = F.explode(F.array_distinct(letters(F.col("word"))))
    reduced = halves(keyed.withColumn("letter", letter).withColumn("key", F.pmod(key - letter_value(F.col("letter")), F.lit(PRIME))).drop("letter"), size - 1)
    own = halves(keyed, size)
    names = ["key", "length", "half", "front", "word", "n"]
    a = reduced.select(*names)
    b = reduced.select(*names, F.lit(False).alias("shorter")).union(own.select(*names, F.lit(True).alias("shorter")))
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    met = a.hint("merge").join(b, (F.col("key") == F.col("b_key")) & (F.col("length") == F.col("b_length")) & (F.col("half.side") == F.col("b_half.side")) & (F.col("half.hash") == F.col("b_half.hash")) & (F.col("word") != F.col("b_word")))
    near = met.where(((F.col("half.side") == 0) | (F.col("front") != F.col("b_front"))) & (F.levenshtein("word", "b_word", 1) == 1))
    there = F.struct(F.col("word"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n"))
    back = F.struct(F.col("b_word").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Exchanges meet from either side; a missing letter is met by the longer word alone.
    return near.select(F.explode(F.when(F.col("b_shorter"), F.array(there, back)).otherwise(F.array(there))).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form), each word once: where the forms lead in the end. Pointers double in each round.

    Forms lead to ever more frequent words, so there is no cycle, and a chain of length c takes log2(c) rounds. Words are
    as many as the texts', so neither side is broadcast by the size of its compressed file.
    """
    at = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        moved = stage(at.hint("merge").join(further, F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP) -> DataFrame:
    """One row a word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    form is the word's most frequent near word (ties: the smallest by code points), if that is `ratio` times as
    frequent; root is where forms lead in the end, the word itself without a form. Null and empty texts have no words;
    a null doc_id counts as an empty text in the checksum; repeated rows count as often as they are there; a text or
    a word may have any length; other columns are ignored; an empty table gives an empty one.
    """
    words = stage(word_counts(docs, least_letters, least_count, slip), "words")
    best = F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))
    every = words.select("word", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"), "n")
    pairs = near_words(words).select("word", "near", "near_n", F.lit(None).cast("long").alias("n"))
    grouped = every.union(pairs).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min(F.when(F.col("near").isNotNull(), best)).alias("best"))
    common = -F.col("best.n") >= ratio * F.col("n")
    found = stage(grouped.select("word", "n", "n_near", F.when(common, F.col("best.word")).alias("form"), F.when(common, -F.col("best.n")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null"))
    return found.hint("merge").join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


#: The checksum worked out byte by byte, words without a letter joined, and the forms followed.
OP13_SQL = r"""
WITH RECURSIVE table_ AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda k: k::UBIGINT)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) AS r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT *, list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [(192 + (unicode(c) >> 6))::UBIGINT, (128 + (unicode(c) & 63))::UBIGINT] END))) AS b FROM counted),
summed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM bytes, table_),
read_ AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM read_ WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min({'word': near, 'n': near_n}, {'n': -near_n, 'word': near}) AS f FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN f.n >= 10 * w.n THEN f.word END AS form, CASE WHEN f.n >= 10 * w.n THEN f.n END AS form_n FROM words w LEFT JOIN best ON w.word = best.word),
walk(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word AND formed.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk ON walk.word = f.word JOIN formed last ON last.word = walk.root AND last.form IS NULL
"""
