"""Shingle sets of texts and their SuperMinHash signatures, vectorised over the documents of a batch."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash

from .words import distinct, split

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its word shingles; of all words as one, if there are fewer; empty without words."""
    words = split(texts, lower=True)
    known, codes = distinct(words.words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[codes]
    owner, sizes = words.owners(), words.sizes
    # A shingle starts at each word but the last few of its text; a short text's one shingle starts at its first.
    left = words.ends[owner] - np.arange(len(owner))
    length = np.minimum(sizes[owner], size)
    start = np.flatnonzero(left >= length)
    found = length[start].astype(np.uint64)
    mixed = np.append(mix(hashes), np.zeros(size, np.uint64))
    for k in range(size):
        found = np.where(k < length[start], found * GOLDEN + mixed[start + k], found)
    found, per_text = mix(found), np.bincount(owner[start], minlength=len(sizes))
    ends = np.cumsum(per_text)
    return [np.unique(found[end - n : end]) for n, end in zip(per_text, ends)]


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), size)[0]


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit integers."""
    return tuple(np.frombuffer(hashlib.md5(shingles.tobytes()).digest(), "<i8").tolist())


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of m slots, one row for each set; no set may be empty.

    Each element walks its own random permutation of the slots; at step j it offers j plus a random fraction to the
    slot it stands on, and a slot keeps the least offer. As step j offers lie in [j, j+1), a set needs no further
    step once all its slots are filled. Steps are taken for all elements of all unfinished sets at once. Offers
    are integers here: j in the high half, the fraction in the low one.
    """
    out = np.full((len(sets), m), EMPTY, np.uint64)
    flat = out.reshape(-1)
    item = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(item):
            break
        drawn = mix(item + np.uint64(int(GOLDEN) * (j + 1) % (1 << 64)))
        place = (j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int32)).astype(np.int32)
        slot = place.copy()
        for i in range(j - 1, -1, -1):  # undo the swaps of this element's shuffle so far
            slot[slot == swaps[i]] = i
        np.minimum.at(flat, row * m + slot, (np.uint64(j) << np.uint64(32)) | (drawn >> np.uint64(32)))
        swaps.append(place)
        rows = np.unique(row)
        open_rows = np.zeros(len(sets), bool)
        open_rows[rows] = (out[rows] == EMPTY).any(axis=1)
        left = open_rows[row]
        if not left.all():
            item, row, swaps = item[left], row[left], [s[left] for s in swaps]
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of each signature; different bands never share one on purpose."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    found = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        found = mix(found * GOLDEN + parts[:, :, k])
    return found.view(np.int64)
