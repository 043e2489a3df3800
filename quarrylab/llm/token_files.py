"""Token files of directly addressable codes (method: DACs), and their query op8_token_files.

A segment holds the ids of some consecutive documents. Each id is cut into chunks of `bits` bits, lowest first.
Level k holds the k-th chunks of the ids that have one, a bitmap that says which of them go on to level k+1, and a
rank directory (ones before each 512th bit). The ids i..j of level k that go on lie side by side in level k+1, from
rank(i) on, so any token or range is read without decoding what stands before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import in_slices, mapped, read, shared_dir, stage
from .tokens import token_rows

MAGIC = b"QDAC"
RANK_STEP = 512
#: A segment is closed once it holds so many tokens; only a longer single document makes a longer one.
SEGMENT_TOKENS = 1 << 20
SEGMENT_SCHEMA = "part int, seg int, doc_ids array<long>, starts array<long>, n_tokens long, payload binary"


def encode(ids: np.ndarray, bits: int = 8) -> bytes:
    """The bytes of a segment; ids: unsigned 32-bit. bits: 8 or 16."""
    kind = {8: "<u1", 16: "<u2"}[bits]
    rest, levels = np.asarray(ids, np.uint64), []
    while True:
        more = rest >> np.uint64(bits) > 0
        ones = np.concatenate([[0], np.cumsum(more)]).astype("<u4")
        levels.append(((rest & np.uint64((1 << bits) - 1)).astype(kind).tobytes(), np.packbits(more, bitorder="little").tobytes(), ones[:-1:RANK_STEP].tobytes(), len(rest)))
        if not more.any():
            break
        rest = rest[more] >> np.uint64(bits)
    head = struct.pack("<4sBBQ", MAGIC, bits, len(levels), len(ids))
    table = b"".join(struct.pack("<QQQQ", n, len(c), len(m), len(r)) for c, m, r, n in levels)
    return head + table + b"".join(c + m + r for c, m, r, _ in levels)


class Segment:
    """Random access to the ids of a segment; nothing is decoded when it is opened."""

    def __init__(self, payload: bytes):
        magic, bits, depth, self.n_tokens = struct.unpack_from("<4sBBQ", payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.bits, self.levels = bits, []
        at, kind = struct.calcsize("<4sBBQ") + depth * 32, f"<u{bits // 8}"
        for k in range(depth):
            n, c, m, r = struct.unpack_from("<QQQQ", payload, struct.calcsize("<4sBBQ") + 32 * k)
            self.levels.append((np.frombuffer(payload, kind, n, at), np.frombuffer(payload, np.uint8, m, at + c), np.frombuffer(payload, "<u4", r // 4, at + c + m)))
            at += c + m + r

    def _rank(self, k: int, i: int) -> int:
        """Ones before bit i of level k."""
        _, bitmap, ranks = self.levels[k]
        if i == 0:
            return 0
        block = (i - 1) // RANK_STEP
        begin = block * RANK_STEP
        got = np.unpackbits(bitmap[begin // 8 : (i + 7) // 8], bitorder="little")[: i - begin]
        return int(ranks[block]) + int(got.sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1."""
        out, where, shift = np.zeros(stop - start, np.uint64), None, 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if start >= stop:
                break
            part = chunks[start:stop].astype(np.uint64) << np.uint64(shift)
            if where is None:
                out += part
            else:
                out[where] += part
            more = np.unpackbits(bitmap[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            where = np.flatnonzero(more) if where is None else where[more]
            start = self._rank(k, start)
            stop, shift = start + len(where), shift + self.bits
        return out.astype("<u4")

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, bits: int = 8) -> None:
    """Write the segments of all documents, in ascending doc_id order, as rows of Parquet files under path.

    A null or empty text is the end id alone. Rows with the same doc_id stand side by side, by their ids' bytes; null doc_ids
    come first. Columns besides doc_id and text are ignored. `part` ascends with doc_id over the files, `seg`
    within a part. Texts are encoded where they are read, and their packed ids alone are shuffled. A text of any
    length is one row and stays in one segment.
    """

    fields = to_arrow_schema(StructType.fromDDL(SEGMENT_SCHEMA))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, held, documents, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, held)])
            row = [part, seg, documents, starts[:-1].tolist(), int(starts[-1]), encode(np.concatenate(held), bits)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fields)], schema=fields)

        for batch in batches:
            for doc_id, width, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "width", "ids"))):
                documents.append(doc_id)
                held.append(np.frombuffer(ids, f"<u{width}"))
                size += len(held[-1])
                if size >= SEGMENT_TOKENS:
                    yield close()
                    seg, held, documents, size = seg + 1, [], [], 0
        if documents:
            yield close()

    tokens = stage(token_rows(docs, tokenizer, end_id), "token-rows")
    mapped(tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids"), segments, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32, first_id and last_id."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                segment, starts = Segment(r.payload), np.append(r.starts, r.n_tokens).astype(int)
                ids = [segment.slice(a, b) for a, b in zip(starts[:-1], starts[1:])]
                yield pd.DataFrame({
                    "part": r.part, "seg": r.seg, "doc_id": pd.array(list(r.doc_ids), "Int64"), "local": starts[:-1], "n_tokens": np.diff(starts),
                    "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                    "first_id": [int(x[0]) for x in ids], "last_id": [int(x[-1]) for x in ids],
                })

    rows = in_slices(segments, documents, "part int, seg int, doc_id long, local long, n_tokens long, ids_crc32 long, first_id long, last_id long", by="payload")
    # Sizes of parts, then of segments within a part: no window sees more than the parts of one write.
    sizes = segments.select("part", "seg", "n_tokens")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before().orderBy("part")), F.lit(0)).alias("part_start"))
    segs = sizes.select("part", "seg", F.coalesce(F.sum("n_tokens").over(before("part").orderBy("seg")), F.lit(0)).alias("seg_start"))
    starts = segs.join(parts, "part")
    return rows.join(starts, ["part", "seg"]).select(
        "doc_id", (F.col("part_start") + F.col("seg_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "first_id", "last_id"
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
