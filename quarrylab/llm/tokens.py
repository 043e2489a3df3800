"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words already encoded."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, over_cores
from .words import distinct, frames, remembered, split, spread

#: Words kept in a worker's memory before it starts anew.
MEMORY_WORDS = 250_000
#: ASCII marks that may end a word as one piece; the apostrophe is left out, since it may open a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The normaliser and splitter of the tokenizers whose words are encoded one by one; others get whole texts.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: How byte-level vocabularies spell bytes: printable ones as themselves, the others as letters from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

#: Stands for the ids of a stem that isn't one piece.
ODD = memoryview(b"")


class WordEncoder:
    """ids(text) equals encode(text, add_special_tokens=False).ids.

    A tokenizer as in BY_WORDS drops white space and encodes what stands between on its own, so that a text's ids are
    its words' ids in a row. A word of Latin letters followed by marks is two pieces (composed letters up to U+017F are
    normalised and have a plain lower case): each different piece of a frame is looked up once, and encoded once as long as
    it is remembered, by the vocabulary's merges alone. Any other word is encoded whole. By any other
    tokenizer texts are encoded whole. Ids are packed unsigned integers, 16 bits wide if the vocabulary allows.
    """

    def __init__(self, path: str, memory: int = MEMORY_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        added = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].split() == [t["content"]] and "<" in t["content"] for t in shape["added_tokens"])
        plain = shape["model"]["type"] == "BPE" and not (shape["post_processor"] or shape["truncation"] or shape["padding"])
        self.by_words = added and plain and all(shape[k] == v for k, v in BY_WORDS.items())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memory, self.stems, self.whole = memory, {}, {}
        self.model = self.tokenizer.model
        self.packed_id = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that is in lower case already and that the tokenizer doesn't split."""
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return b"".join([self.packed_id[t.id] for t in self.model.tokenize(spelled)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of each stem, or ODD for those that aren't one piece."""
        known = self.stems
        each = list(map(known.get, stems))
        for i, stem in enumerate(stems):
            if each[i] is None:
                one = not stem or stem.isalpha() and (stem.isascii() or max(stem) < "\u0180" and "\u0130" not in stem)
                each[i] = known[stem] = self._piece(stem.lower()) if one else ODD
        return each

    def _ends(self, words: list[str]) -> list[bytes]:
        """Ids of the marks that the words end in."""
        known = {}
        marks = [w[len(w.rstrip(MARKS)) :] for w in words]
        for m in set(marks):
            known[m] = self._piece(m)
        return list(map(known.get, marks))

    def _whole_word(self, word: str) -> bytes:
        known = self.whole.get(word)
        if known is None:
            known = self.whole[word] = self._whole(word)
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in a row, and where each text's end; null texts have none."""
        if not self.by_words:
            each = [self._whole(t) if t else b"" for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), self.dtype), np.cumsum([len(x) // self.dtype.itemsize for x in each], dtype=np.int64)
        for known in (self.stems, self.whole):
            if len(known) > self.memory:
                known.clear()
        words = split(texts)
        bare = pc.utf8_rtrim(words.words, MARKS)
        stems, first = distinct(pc.ascii_lower(bare))
        each, second = self._stems(stems), np.full(len(first), len(stems))
        one_piece = np.fromiter((x is not ODD for x in each), bool, len(stems))
        each.append(b"")
        plain = one_piece[first] if len(first) else np.zeros(0, bool)
        marked = plain & pc.less(pc.binary_length(bare), pc.binary_length(words.words)).to_numpy(zero_copy_only=False)
        if marked.any():
            ends, at = distinct(words.words.filter(pa.array(marked)))
            second[marked] = len(each) + at
            each += self._ends(ends)
        if not plain.all():
            others, at = distinct(words.words.filter(pa.array(~plain)))
            first = first.astype(np.int64)
            first[~plain] = len(each) + at
            each += [self._whole_word(w) for w in others]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        begins, order = np.cumsum(sizes) - sizes, np.stack([first, second], axis=1).ravel()
        ids = np.frombuffer(b"".join(each), self.dtype)[spread(begins[order], sizes[order])]
        return ids, np.concatenate([[0], np.cumsum(sizes[first] + sizes[second])])[words.ends]

    def ids(self, text: str | None) -> np.ndarray:
        return self.encode(pa.array([text], pa.string()))[0].astype("<u4")


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    return remembered(f"tokens of {path}", lambda: WordEncoder(path))


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids, wide enough for end_id, with that id after each text's."""
    wide = ids if end_id <= np.iinfo(ids.dtype).max else ids.astype("<u4")
    return np.insert(wide, ends, end_id), ends + np.arange(1, len(ends) + 1)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Frames of batches (with a column text), with the ids of their texts, each followed by end_id, and the places where they end."""
    encode = encoder(tokenizer)
    for frame in frames(batches, "text"):
        yield frame, *with_end(*encode.encode(frame["text"]), end_id)


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each text as one binary value."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]) * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, width, ids) for each row of docs (doc_id, text): the ids and end_id, packed, little-endian, width bytes each."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, ids, ends in encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([frame["doc_id"], pa.array(np.full(len(ends), ids.itemsize, np.int32)), packed(ids, ends)], ["doc_id", "width", "ids"])

    return mapped(over_cores(docs.select(F.col("doc_id").cast("long"), "text")), apply, "doc_id long, width int, ids binary")
