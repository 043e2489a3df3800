"""Words of many texts at once: split and looked up by Arrow, so that Python sees each different word of a frame once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows, and bytes of text, that a task works on at once; a longer text is a frame of its own.
FRAME_ROWS, FRAME_BYTES = 500, 1 << 20


class Words(NamedTuple):
    """words: all words of some texts in a row; ends: where each text's words end."""

    words: pa.Array
    ends: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def owners(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.ends)), self.sizes)


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words between ASCII white space; with lower, A-Z in lower case. Null texts have none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0)
    return Words(flat.filter(real), np.cumsum(np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))))


def distinct(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """The different words (none holds a blank), and each word's place among them."""
    coded = words.dictionary_encode()
    known = coded.dictionary
    kind = pa.LargeListArray if pa.types.is_large_string(known.type) else pa.ListArray
    # One long string, cut by Python, takes a tenth of the time of a Python string made from each value.
    joined = pc.binary_join(kind.from_arrays([0, len(known)], known), " ")[0].as_py()
    return joined.split(" ") if len(known) else [], coded.indices.to_numpy()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1 for each i, in a row."""
    begins = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - begins, sizes)


def frames(batches: Iterator[pa.RecordBatch], column: str, rows: int = FRAME_ROWS, size: int = FRAME_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in frames of at most `rows` rows and, but for a single longer one, `size` bytes of that column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy().astype(np.int64)
        total, at = np.cumsum(lengths), 0
        while at < len(lengths):
            before = total[at] - lengths[at]
            end = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


_held: dict[str, object] = {}


def trim() -> None:
    """Give free memory back to the system: workers are used again by the next stage."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def remembered(key: str, make: Callable[[], object]) -> object:
    """What this worker holds under key. What it held for other operators is let go, since a worker outlives its task."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]
