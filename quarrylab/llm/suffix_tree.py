"""Language-model scoring by probabilistic suffix trees (op2_suffix_tree).

A tree gives the next symbol's distribution after a variable number of symbols. A context of up to `depth` symbols
becomes a state if its next-symbol counts differ from those of its suffix by a divergence test; a state's distribution
is smoothed towards that of its longest suffix that is a state; and a text is scored symbol by symbol in the
state of the longest suffix that there is.

Two trees make the model. One runs over word classes (the most frequent words for themselves, the others by their
ending), learned from all tokens. Within a class a word is drawn by its discounted count, and what the discount
sets free goes to the spelling of the word, by the second tree, which runs over letters, from a word's last to its first, and is
learned from all distinct words. A word's spelling is given its class: its probability is divided by that of all words of the class. So seen and unseen words have a probability, and the trees' sizes are bounded by their alphabets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, read, stage
from .words import frames

#: A context seen less often is never a state; nor one whose G statistic is less than this share of the symbols'
#: number plus four of its standard deviations (p about 1e-4).
LEAST_COUNT = 20
#: Weight of the suffix's distribution, in symbols.
SMOOTHING = 4.0
#: Up to so many contexts, a depth's states are kept as a table by context.
DENSE = 1 << 20
#: What each distinct word's count gives to spelling.
DISCOUNT = 0.75
#: Frequent words that are a class each, and endings of two bytes that are one.
CLASS_WORDS, CLASS_ENDINGS = 128, 126
#: The most frequent words are looked up in tasks, the counts of all others are joined: a bound on memory alone.
FREQUENT_WORDS = 300_000
#: Entries that a task holds before it hands them on.
_HELD = 2_000_000
#: Bytes of words that are spelt at once, but for a single longer word.
_SPELT = 1 << 18


class Alphabet(NamedTuple):
    bits: int
    depth: int

    @property
    def symbols(self) -> int:
        return 1 << self.bits

    def contexts(self, symbols: np.ndarray, pad: int = 0) -> np.ndarray:
        """The `depth` symbols before each symbol as one number; pads stand before the first."""
        past = np.concatenate([np.full(self.depth, pad, np.int64), symbols])
        code = np.zeros(len(symbols), np.int64)
        for k in range(self.depth):
            code = (code << self.bits) | past[k : k + len(symbols)]
        return code

    def runs(self, symbols: np.ndarray, pad: int = 0) -> np.ndarray:
        """Each symbol with its context before it."""
        return self.contexts(symbols, pad) << self.bits | symbols


#: Word classes: 0 is the end of a text, the last is all words without a class of their own.
CLASSES = Alphabet(8, 2)
#: Letters: end of word, a-z, digits, other ASCII, first and later bytes of other characters.
LETTERS = Alphabet(5, 5)
_LETTER = np.array([b - 96 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 28 if b < 128 else 30 if b < 192 else 29 for b in range(256)], np.int64)


def words_of(text: str | None) -> list[bytes]:
    """The text's words, A-Z in lower case."""
    return text.encode().lower().split() if text else []


class Tree:
    """The states by depth, and log10 of their next-symbol distributions."""

    def __init__(self, alphabet: Alphabet, root: np.ndarray):
        self.alphabet, self.dense_depth, self.dense, self.sparse = alphabet, 0, np.zeros(1, np.int32), []
        self.log10_next = np.log10(root)[None]

    def states(self, contexts: np.ndarray) -> np.ndarray:
        """The state of the longest suffix that is one, for each context."""
        found = self.dense[contexts & (len(self.dense) - 1)]
        for depth, known, first in self.sparse:
            suffixes = contexts & ((1 << self.alphabet.bits * depth) - 1)
            at = np.minimum(np.searchsorted(known, suffixes), len(known) - 1)
            found = np.where(known[at] == suffixes, first + at, found)
        return found

    def steps(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.log10_next[self.states(contexts), symbols]

    def add(self, depth: int, contexts: np.ndarray, counts: np.ndarray) -> None:
        """Make states of contexts of this depth, in ascending order, from their next-symbol counts."""
        suffixes = 10.0 ** self.log10_next[self.states(contexts & ((1 << self.alphabet.bits * (depth - 1)) - 1))]
        smooth = (counts + SMOOTHING * suffixes) / (counts.sum(axis=1, keepdims=True) + SMOOTHING)
        first = len(self.log10_next)
        self.log10_next = np.concatenate([self.log10_next, np.log10(smooth)])
        if self.alphabet.symbols**depth <= DENSE:
            self.dense = np.tile(self.dense, self.alphabet.symbols)  # each context has its suffix's state, but for the new ones
            self.dense[contexts] = np.arange(first, first + len(contexts))
        elif len(contexts):
            self.sparse.append((depth, contexts, first))


def grow(counts: DataFrame, alphabet: Alphabet) -> Tree:
    """The tree of (code, n), the counts of runs of depth + 1 symbols.

    All contexts are tested in Spark; only the states' rows come to the driver. A state has been seen LEAST_COUNT times
    and differs from its suffix, so that states saturate with the alphabet, not with the corpus.
    """
    size = alphabet.symbols
    least_gap = size - 1 + 4 * math.sqrt(2 * (size - 1))
    counts = stage(counts.select("code", "n"), "runs")
    level = lambda d: counts.groupBy((F.col("code") % (size ** (d + 1))).alias("code")).agg(F.sum("n").alias("n"))
    table = lambda d: level(d).select(F.expr(f"code div {size}").alias("context"), (F.col("code") % size).cast("int").alias("next"), "n")
    root = np.ones(size)
    for r in table(0).collect():
        root[r["next"]] += r["n"]
    tree = Tree(alphabet, root / root.sum())
    for d in range(1, alphabet.depth + 1):
        suffix = table(d - 1).select(F.col("context").alias("suffix"), "next", F.col("n").alias("m"))
        each = Window.partitionBy("context")
        below = Window.partitionBy("suffix")
        suffix = suffix.withColumn("below", F.sum("m").over(below))
        seen = table(d).withColumn("total", F.sum("n").over(each)).where(F.col("total") >= LEAST_COUNT).withColumn("suffix", F.col("context") % (size ** (d - 1)))
        gap = 2 * F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / (F.col("m") / F.col("below"))))
        kept = seen.join(suffix, ["suffix", "next"]).groupBy("context").agg(gap.alias("gap"), F.collect_list(F.struct("next", "n")).alias("seen")).where(F.col("gap") >= least_gap)
        found = kept.select("context", F.explode("seen").alias("x")).select("context", "x.next", "x.n").toArrow()
        contexts, at = np.unique(found["context"].to_numpy(), return_inverse=True)
        n = np.zeros((len(contexts), size))
        n[at, found["next"].to_numpy()] = found["n"].to_numpy()
        tree.add(d, contexts, n)
    return tree


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, letters, starts) of words in a row, each from its end to its beginning, after so many ends of word that no context reaches back."""
    gap, words = b" " * LETTERS.depth, [w[::-1] for w in words]
    spelling = np.frombuffer(gap + gap.join(words) + b" ", np.uint8)
    letters = np.where(spelling == 0x20, 0, _LETTER[spelling])
    lengths = np.array([len(w) + LETTERS.depth for w in words])
    return spelling, letters, np.concatenate([[0], np.cumsum(lengths)[:-1]]) + LETTERS.depth


class Speller(NamedTuple):
    tree: Tree
    log10_byte: np.ndarray

    def score(self, words: list[bytes], whole: bool = True) -> np.ndarray:
        """log10 probability of each word's bytes from the last to the first, and of the end of word; if not whole, of all words that end so."""
        held = np.cumsum([0, *(len(w) + LETTERS.depth for w in words)]) // _SPELT
        cuts = [*np.unique(held[:-1], return_index=True)[1].tolist(), len(words)]
        return np.concatenate([np.zeros(0), *(self._score(words[a:b], whole) for a, b in zip(cuts, cuts[1:]))])

    def _score(self, words: list[bytes], whole: bool) -> np.ndarray:
        spelling, letters, starts = spelled(words)
        steps = self.tree.steps(LETTERS.contexts(letters), letters) + self.log10_byte[spelling]
        sums = np.concatenate([[0], np.cumsum(steps, dtype=np.float64)])
        ends = starts + np.array([len(w) for w in words]) + whole
        return sums[ends] - sums[starts]

    def masses(self, classes: Classes) -> np.ndarray:
        """log10 probability of all words of each class together; 0 of a class that is one word."""
        top, endings = list(classes.words), list(classes.endings)
        pairs, single = [e for e in endings if len(e) == 2], [e for e in endings if len(e) == 1]
        found = np.zeros(CLASSES.symbols)
        found[[classes.endings[e] for e in pairs]] = 10.0 ** self.score(pairs, whole=False)
        found[[classes.endings[e] for e in single]] = 10.0 ** self.score(single)
        found[-1] = 1.0 - found[:-1].sum() - 10.0 ** self.score([b""])[0]  # no word is empty
        for word, p in zip(top, 10.0 ** self.score(top)):
            found[classes.endings.get(word[-2:], CLASSES.symbols - 1)] -= p  # it has a class of its own
        found[: 1 + len(top)] = 1.0
        return np.log10(np.maximum(found, 1e-12))


class Classes(NamedTuple):
    """Which class a word is of; tokens and distinct words of each class."""

    words: dict[bytes, int]
    endings: dict[bytes, int]

    def of(self, word: bytes) -> int:
        return self.words.get(word) or self.endings.get(word[-2:], CLASSES.symbols - 1)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of docs (text); the empty word counts ends of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                known.update(words_of(text))
                known[b""] += 1
                if len(known) >= _HELD // 4:
                    yield rows(known)
                    known = Counter()
        yield rows(known)

    def rows(known: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(known), pa.binary()).cast(pa.string()), pa.array(list(known.values()), pa.int64())], ["word", "n"])

    return stage(mapped(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def choose_classes(words: DataFrame) -> Classes:
    """The most frequent words, then the most frequent endings of the others, by tokens."""
    spelt = words.where("word <> ''").withColumn("bytes", F.encode("word", "UTF-8"))
    top = [r["word"].encode() for r in spelt.orderBy(F.desc("n"), "word").limit(CLASS_WORDS).collect()]
    ending = F.expr("substring(bytes, -2, 2)").alias("ending")
    others = spelt.where(~F.col("word").isin([w.decode() for w in top])) if top else spelt
    endings = [bytes(r["ending"]) for r in others.groupBy(ending).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(CLASS_ENDINGS).collect()]
    return Classes({w: k for k, w in enumerate(top, 1)}, {e: k for k, e in enumerate(endings, 1 + CLASS_WORDS)})


def count_runs(batches: Iterator, codes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for codes in codes_of(batch):
            held.append(codes)
            size += len(codes)
            if size >= _HELD:
                yield _counted(held)
                held, size = [], 0
    if held:
        yield _counted(held)


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    codes, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])


def learn_classes(docs: DataFrame, classes: Classes) -> Tree:
    """The tree over word classes, of all tokens."""

    def codes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in batch["text"].to_pylist():
            yield CLASSES.runs(np.array([*map(classes.of, words_of(text)), 0], np.int64))

    runs = mapped(docs.select("text"), lambda batches: count_runs(batches, codes), "code long, n long")
    return grow(runs.groupBy("code").agg(F.sum("n").alias("n")), CLASSES)


def learn_spelling(words: DataFrame, classes: Classes) -> tuple[Speller, np.ndarray, np.ndarray]:
    """The tree over letters, of all distinct words; and tokens and distinct words of each class.

    Negative codes count bytes (from -256), then tokens (from -1000) and distinct words (from -2000) by class.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, distinct, seen = np.zeros(CLASSES.symbols, np.int64), np.zeros(CLASSES.symbols, np.int64), np.zeros(256, np.int64)

        def codes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            nonlocal seen
            words = batch["word"].cast(pa.binary()).to_pylist()
            for word, n in zip(words, batch["n"].to_pylist()):
                k = classes.of(word) if word else 0
                tokens[k] += n
                distinct[k] += 1
            words = [w for w in words if w]
            if words:
                spelling, letters, starts = spelled(words)
                seen += np.bincount(spelling, minlength=256)
                real = np.zeros(len(letters), bool)
                real[starts] = True
                ends = starts + np.array([len(w) for w in words]) + 1
                real = np.cumsum(np.bincount(starts, minlength=len(letters) + 1) - np.bincount(ends, minlength=len(letters) + 1))[:-1] > 0
                yield LETTERS.runs(letters)[real]

        yield from count_runs(batches, codes)
        at = np.concatenate([np.arange(256) - 256, np.arange(CLASSES.symbols) - 1000, np.arange(CLASSES.symbols) - 2000])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([seen, tokens, distinct]))], ["code", "n"])

    counts = stage(mapped(words, count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "letter-counts")
    tree = grow(counts.where("code >= 0"), LETTERS)
    rest = {r["code"]: r["n"] for r in counts.where("code < 0").collect()}
    seen = np.array([1.0 + rest.get(b - 256, 0) for b in range(256)])
    space = [*range(9, 14), 0x20]  # in no word; a blank is an end of word here
    seen[space] = 0.0
    share = seen / np.bincount(_LETTER, seen, LETTERS.symbols)[_LETTER]
    share[space] = 1.0
    by_class = lambda base: np.array([rest.get(k - base, 0) for k in range(CLASSES.symbols)], np.float64)
    return Speller(tree, np.log10(share)), by_class(1000), by_class(2000)


class Model(NamedTuple):
    classes: Classes
    tree: Tree
    speller: Speller
    tokens: np.ndarray
    distinct: np.ndarray
    masses: np.ndarray

    def shares(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, unit, spelt) of each word, the last two as log10: its share in its class is max(count - DISCOUNT, 0) * unit + spelt."""
        kinds = np.array([self.classes.of(w) if w else 0 for w in words], np.int64)
        alone = kinds <= len(self.classes.words)
        tokens, distinct = self.tokens[kinds], self.distinct[kinds]
        unit = -np.log10(np.maximum(tokens, 1))
        free = np.where(tokens > 0, math.log10(DISCOUNT) + np.log10(np.maximum(distinct, 1)) + unit, 0.0)
        # A class of one word is all that word's.
        return kinds, np.where(alone, -np.inf, unit), np.where(alone, 0.0, free + self.speller.score(words) - self.masses[kinds])


def log10_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of 10**a + 10**b, however small they are."""
    return np.logaddexp(a * math.log(10), b * math.log(10)) / math.log(10)


def frequent_words(words: DataFrame, model: Broadcast) -> pa.Table:
    """(word, kind, log_count, log_share) of the most frequent words, worked out once for all tasks."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy().astype(np.float64)
            kinds, unit, spelt = model.value.shares(batch["word"].cast(pa.binary()).to_pylist())
            log_share = log10_sum(np.log10(n - DISCOUNT) + unit, spelt)
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(kinds), pa.array(np.log10(n + 1)), pa.array(log_share)], ["word", "kind", "log_count", "log_share"])

    return mapped(words.orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS), share, "word string, kind long, log_count double, log_share double").toArrow()


class Vocabulary(dict):
    """word -> its place in the columns below, in a task; words that aren't frequent get places as they come."""

    def __init__(self, frequent: pa.Table):
        words = frequent["word"].cast(pa.binary()).to_pylist()
        super().__init__(zip(words, range(len(words))))
        self.frequent, self.late = len(words), []
        self.kinds, self.log_count, self.log_share = (frequent[c].to_numpy() for c in ("kind", "log_count", "log_share"))

    def __missing__(self, word: bytes) -> int:
        self[word] = place = self.frequent + len(self.late)
        self.late.append(word)
        return place

    def forget(self) -> None:
        for word in self.late:
            del self[word]
        self.late = []


def rated_rows(frame: pa.RecordBatch, known: Vocabulary, model: Model) -> pa.RecordBatch:
    """Each text's score but for its words that aren't frequent: those, how often they stand there and what is known of their shares."""
    places = [np.array([known[w] for w in (*words_of(text), b"")], np.int64) for text in frame["text"].to_pylist()]
    late = known.late
    late_kinds, unit, spelt = model.shares(late)
    kinds = np.concatenate([known.kinds, late_kinds])
    found, rare, times = [], [], []
    for place in places:
        sure, unsure = place[place < known.frequent], place[place >= known.frequent] - known.frequent
        symbols = kinds[place]
        score = float(model.tree.steps(CLASSES.contexts(symbols), symbols).sum(dtype=np.float64) + known.log_share[sure].sum())
        found.append((len(place), len(sure), float(known.log_count[sure].sum()), score))
        for held, x in zip((rare, times), np.unique(unsure, return_counts=True)):
            held.append(x)
    known.forget()
    ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
    which = np.concatenate(rare)
    lists = [pa.array(late, pa.binary()).cast(pa.string()).take(pa.array(which)), pa.array(np.concatenate(times), pa.int32()), pa.array(unit[which]), pa.array(spelt[which])]
    columns = [*(frame[c] for c in ("row", "doc_id", "held_out")), *map(pa.array, zip(*found)), *(pa.ListArray.from_arrays(ends, x) for x in lists)]
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times", "unit", "spelt"])


def score_documents(docs: DataFrame) -> DataFrame:
    """Score all rows of docs (doc_id, text) by a model learned from those whose crc32(doc_id as text) mod 7 is not 2.

    Null texts are empty: an end of text alone. Rows may repeat; a null doc_id counts as an empty one; an empty table
    gives an empty one; without training rows the trees' symbols are equally likely. Other columns are ignored. A text of any
    length is scored as a whole, and a word of any length by all its bytes, in logarithms, so that no probability is too small.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    words = count_words(training)
    n_tokens, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    classes = choose_classes(words)
    speller, tokens, distinct = learn_spelling(words, classes)
    model = spark.sparkContext.broadcast(Model(classes, learn_classes(training, classes), speller, tokens, distinct, speller.masses(classes)))
    frequent = spark.sparkContext.broadcast(frequent_words(words, model))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(frequent.value)
        for frame in frames(batches, "text"):
            yield rated_rows(frame, known, model.value)

    fields = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>, times array<int>, unit array<double>, spelt array<double>"
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "held_out", "text")
    rated = stage(mapped(numbered, rate, fields), "scores")
    model.destroy()
    frequent.destroy()
    # What isn't among the frequent words: rare ones, so that no key of this join is a hot one.
    rare = rated.select("row", F.explode(F.arrays_zip("rare", "times", "unit", "spelt")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times", "x.unit", "x.spelt")
    n = F.coalesce("n", F.lit(0)).cast("double")
    own = F.when(n > 0, F.log10(n - DISCOUNT) + F.col("unit")).otherwise(F.lit(float("-inf")))
    most = F.greatest(own, F.col("spelt"))
    share = most + F.log10(F.pow(F.lit(10.0), own - most) + F.pow(F.lit(10.0), F.col("spelt") - most))
    late = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + 1)).alias("late_base"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("late_known"),
        F.sum(F.col("times") * share).alias("late_score"),
    )
    size = math.log10(n_tokens + n_distinct + 1)
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    return rated.join(late, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "late_known", 0).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (plus("base", "late_base", 0.0) - F.col("n_tokens") * F.lit(size)).alias("base_score"), plus("score", "late_score", 0.0).alias("score"),
    )


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
