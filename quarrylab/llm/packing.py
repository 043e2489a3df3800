"""Packing along a space-filling curve: hashed document vectors, a Hilbert key, range sort, fixed-length cuts (op7_packing)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import mapped, over_cores, read, stage
from .shingles import GOLDEN, mix
from .tokens import encoded, packed

#: Buckets of the hashed vectors, dimensions they are projected to, bits of each.
VECTOR, DIMENSIONS, BITS = 1 << 16, 3, 20
#: Bytes of ids in a range of the curve, the work of one task.
RANGE_BYTES = 8 << 20


def projection(buckets: int = VECTOR, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed random matrix (buckets, dimensions) with entries in (-1, 1)."""
    cells = np.arange(1, buckets * dimensions + 1, dtype=np.uint64) * GOLDEN
    return ((mix(cells) >> np.uint64(11)).astype(np.float64) / (1 << 52) - 1).reshape(buckets, dimensions)


def coordinates(ids: np.ndarray, ends: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """(texts, dimensions): the hashed vector of each text's ids (of all texts in a row), of length 1, projected.

    A bucket weighs 1 + log of the number of times that the text has it, so that neither length nor repetition alone
    sets texts apart.
    """
    owner = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(ends, prepend=0))
    code, n = np.unique(owner * np.uint64(VECTOR) | mix(ids.astype(np.uint64)) % np.uint64(VECTOR), return_counts=True)
    owner, weight = (code // np.uint64(VECTOR)).astype(np.int64), 1 + np.log(n)
    sums = lambda x: np.bincount(owner, x, len(ends))
    at = matrix[(code % np.uint64(VECTOR)).astype(np.int64)]
    norm = np.sqrt(np.maximum(sums(weight**2), 1e-300))
    return np.stack([sums(weight * at[:, d]) / norm for d in range(matrix.shape[1])], axis=1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of points (n, dimensions) with coordinates from 0 to 2**bits - 1, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            flip = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ flip)
            x[i] ^= flip if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(points: list[str], centre: list[float], spread: list[float]) -> Column:
    """The place on the curve of points given as columns, each coordinate scaled by its share of the texts below it, were they normal."""

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        cells = [np.clip(1 / (1 + np.exp(-1.702 * (x.to_numpy() - m) / (s or 1.0))) * (1 << BITS), 0, (1 << BITS) - 1) for x, m, s in zip(columns, centre, spread)]
        return pd.Series(hilbert(np.stack(cells, axis=1)))

    return key(*points)


def on_curve(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, int]:
    """(doc_id, width, ids, key) for each row of docs (doc_id, text): its packed ids, and its place on the curve; and the bytes of all ids."""
    points = [f"x{d}" for d in range(DIMENSIONS)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection()
        for frame, ids, ends in encoded(batches, tokenizer, end_id):
            at = coordinates(ids, ends, matrix)
            width = pa.array(np.full(len(ends), ids.itemsize, np.int32))
            yield pa.RecordBatch.from_arrays([frame["doc_id"], width, packed(ids, ends), *map(pa.array, at.T)], ["doc_id", "width", "ids", *points])

    source = over_cores(docs.select(F.col("doc_id").cast("long"), "text"))
    tokens = stage(mapped(source, apply, "doc_id long, width int, ids binary, " + ", ".join(f"{x} double" for x in points)), "token-rows")
    measured = tokens.agg(F.sum(F.octet_length("ids")), *[f(x) for f in (F.avg, F.stddev_pop) for x in points]).first()
    centre, spread = ([float(v or 0.0) for v in measured[at : at + DIMENSIONS]] for at in (1, 1 + DIMENSIONS))
    return tokens.select("doc_id", "width", "ids", curve_key(points, centre, spread).alias("key")), measured[0] or 0


def powers(length: int) -> list[int]:
    """The powers of two that add up to length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of documents, placed in sequences of `limit` tokens: one row for each piece.

    Documents are sorted by the Hilbert key of their hashed vector, then by doc_id (so that equal texts spread
    over partitions), and each partition's ids are cut every `limit` tokens. What is left at its end is cut
    at powers of two, lengths that need no padding: at most log2(limit) short sequences a partition. The number of
    partitions follows the bytes of all ids. A text is encoded once, where it is read; a text of any length is one row.
    A null or empty text is the end id alone. Rows may repeat; other columns are ignored. with_ids adds the ids.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows, held, filled, sequence = [], [], 0, part << 32

        def close() -> None:
            nonlocal sequence, filled, held
            at = 0
            for doc_id, start, ids, total in held:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at) + ((ids.tolist(),) if with_ids else ()))
                at += len(ids)
            sequence, filled, held = sequence + 1, 0, []

        def add(doc_id, start: int, ids: np.ndarray, total: int, room: int) -> np.ndarray:
            """Put what fits into the open sequence; what doesn't is returned."""
            nonlocal filled
            fits = ids[: room - filled]
            held.append((doc_id, start, fits, total))
            filled += len(fits)
            return ids[len(fits) :]

        for batch in batches:
            for doc_id, width, packed_ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "width", "ids"))):
                ids = rest = np.frombuffer(packed_ids, f"<u{width}").astype("<u4")
                while len(rest):
                    rest = add(doc_id, len(ids) - len(rest), rest, len(ids), limit)
                    if filled == limit:
                        close()
            yield frame(rows)
            rows.clear()
        tail, held, left = held, [], filled
        filled = 0
        for room in powers(left):
            while filled < room:
                doc_id, start, ids, total = tail.pop(0)
                rest = add(doc_id, start, ids, total, room)
                if len(rest):
                    tail.insert(0, (doc_id, start + len(ids) - len(rest), rest, total))
            close()
        yield frame(rows)

    schema = to_arrow_schema(StructType.fromDDL(fields))

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    keyed, size = on_curve(docs, tokenizer, end_id)
    ordered = keyed.repartitionByRange(max(1, math.ceil(size / RANGE_BYTES)), "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return mapped(ordered.select("doc_id", "width", "ids"), place, fields)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
