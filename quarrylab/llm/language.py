"""Language identification by a string kernel: Nyström landmarks and one-versus-rest kernel ridge regression (op12_language_id)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_slices, read, stage
from .words import remembered

#: Lengths of the character runs whose presence the kernel compares (a blended spectrum), and the hash space they share.
SPECTRUM, BITS = (1, 2, 3, 4), 16
#: Bounds of what is learned from: labelled texts (dealt to the languages alike), languages (the most frequent), landmarks.
MOST_ROWS, MOST_LANGUAGES, LANDMARKS = 20_000, 200, 160
#: Weight of the ridge; texts in a matrix product; characters hashed at once; tasks that add up the equations.
RIDGE, BATCH, CHUNK, FIT_TASKS = 1e-4, 64, 1 << 20, 16
UNKNOWN = "und"


_letter_table: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters; made once a worker."""
    global _letter_table
    if _letter_table is None:
        _letter_table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter_table


def plain(text: str) -> np.ndarray:
    """The code points of a text in lower case, with a single blank in the place of whatever stands between letters, and around it."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, np.uint32(32))
    blank = codes == 32
    return codes[~blank | np.concatenate([[True], ~blank[:-1]])]


def presence(text: str, into: np.ndarray) -> None:
    """Mark the buckets of a text's character runs in a zeroed row; a text of any length is hashed chunk by chunk."""
    codes, longest = plain(text), max(SPECTRUM)
    for begin in range(0, len(codes), CHUNK):
        part = codes[begin : begin + CHUNK + longest - 1]
        run, shift = part, np.uint32(32 - BITS)
        for n in range(1, longest + 1):
            if n > 1:
                run = run[:-1] * np.uint32(0x01000193) + part[n - 1 :]
            if n in SPECTRUM and len(run):
                mixed = (run ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                into[(mixed ^ mixed >> np.uint32(15)) * np.uint32(0xC2B2AE35) >> shift] = True


class Model(NamedTuple):
    """packed: the landmarks' buckets as bits; weights: a column of dual coefficients for each language."""

    languages: list[str]
    packed: np.ndarray
    weights: np.ndarray

    def kernels(self) -> Kernels:
        return Kernels(self.packed)


class Kernels:
    """Normalised presence kernels of texts and landmarks: shared runs by the root of the product of both counts."""

    def __init__(self, packed: np.ndarray):
        marks = np.unpackbits(packed, axis=1, count=1 << BITS).astype(bool)
        self.used = np.flatnonzero(marks.any(axis=0))  # other buckets are shared with no landmark
        self.marks = np.ascontiguousarray(marks[:, self.used].T, np.float32)
        self.norms = np.sqrt(np.maximum(marks.sum(axis=1), 1))

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = np.empty((len(texts), self.marks.shape[1]))
        for begin in range(0, len(texts), BATCH):
            batch = texts[begin : begin + BATCH]
            rows = np.zeros((len(batch), 1 << BITS), bool)
            for text, row in zip(batch, rows):
                presence(text, row)
            shared = rows[:, self.used].astype(np.float32) @ self.marks
            found[begin : begin + BATCH] = shared / (np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None] * self.norms)
        return found


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, most_rows: int = MOST_ROWS, most_languages: int = MOST_LANGUAGES, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of labelled texts, docs (doc_id, text, lang); None without any that has a language and a letter.

    Learned from at most about most_rows rows, which a hash deals out so that each of the most_languages most frequent
    languages has a like number of them, or all of its rows. Landmarks are whole texts, as many for each language. The
    normal equations are added up in tasks; what reaches the driver is bounded by languages and landmarks: their
    bits (8 KB a landmark) and FIT_TASKS matrices of landmarks by landmarks and languages.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("dealt")).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return None
    languages, share = sorted(counts), most_rows / len(counts)
    part = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, share / counts[lang]))])[F.col("lang")]
    sample = stage(known.where(F.pmod("dealt", F.lit(1 << 30)) < part * (1 << 30)), "sample")
    sampled = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    first = Window.partitionBy("lang").orderBy("dealt", "text")
    chosen = sample.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max(1, landmarks // len(languages)))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text in batch.text:
                row = np.zeros(1 << BITS, bool)
                presence(text, row)
                made.append(np.packbits(row).tobytes())
            yield pd.DataFrame({"lang": batch.lang, "n": batch.n, "bits": made})

    marks = sorted(in_slices(chosen.select("lang", "n", "text"), bits, "lang string, n int, bits binary").collect())
    packed = np.frombuffer(b"".join(bytes(r.bits) for r in marks), np.uint8).reshape(len(marks), -1)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernels = Kernels(packed)
        left, right = np.zeros((len(packed), len(packed))), np.zeros((len(packed), len(languages)))
        place = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            k = kernels(batch.text.tolist())
            own = batch.lang.map(place).to_numpy()
            weight = 1.0 / batch.lang.map(sampled).to_numpy()  # each language weighs as much as any other
            left += k.T @ (k * weight[:, None])
            np.add.at(right.T, own, k * weight[:, None])
        yield pd.DataFrame({"sides": [np.concatenate([left, right], axis=1).tobytes()]})

    sides = sum(np.frombuffer(r.sides).reshape(len(packed), -1) for r in in_slices(sample.select("lang", "text").coalesce(FIT_TASKS), equations, "sides binary").collect())
    left, right = sides[:, : len(packed)] / len(languages), sides[:, len(packed) :] / len(languages)
    marks = np.unpackbits(packed, axis=1, count=1 << BITS).astype(np.float32)
    norms = np.sqrt(np.maximum(marks.sum(axis=1), 1))
    among = (marks @ marks.T) / (norms[:, None] * norms)
    weights = np.linalg.solve(left + ridge * among + 1e-9 * np.eye(len(packed)), right)
    return Model(languages, packed, weights)


def language_id(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, lang_pred, score.

    Row-local, and by the text alone. The language of the largest regression value, cut to 0 .. 1 as the score; ties go to
    the first by name. A null text, or one without a letter, is `und` with score 0, as all are without a model. A
    text that shares no run with a landmark gets the first language, with score 0. Texts are read whole, rows may
    repeat, other columns are ignored, and an empty table gives an empty one.
    """
    key = uuid.uuid4().hex

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            real = np.flatnonzero(batch.text.notna().to_numpy())
            if model and len(real):
                kernels = remembered(key, model.kernels)
                values = kernels(batch.text.iloc[real].tolist()) @ model.weights
                best = values.argmax(axis=1)
                lang[real] = np.array(model.languages, object)[best]
                score[real] = np.clip(values[np.arange(len(real)), best], 0.0, 1.0)
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "lang_pred": lang, "score": score})

    source = docs.select(F.col("doc_id").cast("long"), F.when(has_letter(F.col("text")), F.col("text")).alias("text"))
    return in_slices(source, scored, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the checksum of a doc_id puts its row aside; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
