"""Hashes of word shingles, in Arrow batches: a small numpy helper of tasks.

A text is words parted by single blanks. A shingle's hash is 64 bits, the same in every process; it tells shingles apart up to chance, so
whoever needs certainty compares words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are cut into words at once.
STEP = 256


def _factors(n: int) -> np.ndarray:
    """n odd factors, as the golden ratio's multiples are mixed (splitmix64)."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the n-word shingles of each text; none for nulls and shorter texts."""
    for at in range(0, len(texts), STEP):
        part = pc.split_pattern(texts.slice(at, STEP).cast(pa.large_string()).fill_null(""), " ")
        ends = np.asarray(part.offsets).astype(np.int64)
        encoded = part.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends -= ends[0]
        codes = np.asarray(encoded.indices)
        words = pd.util.hash_array(encoded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)[codes]
        whole = max(len(words) - n + 1, 0)
        grams = np.zeros(whole, np.uint64)
        for k, factor in enumerate(_factors(n)):
            grams += words[k : k + whole] * factor
        grams = _mixed(grams)
        for a, b in zip(ends[:-1], ends[1:]):
            yield np.unique(grams[a : max(b - n + 1, a)])


def set_key(hashes: np.ndarray) -> str | None:
    """What says a set of hashes: a digest of 128 bits and the size; null of an empty set."""
    return f"{hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()}-{len(hashes)}" if len(hashes) else None


def shingle_set(text: str, n: int) -> frozenset[str]:
    """The n-word shingles of a text themselves."""
    words = text.split(" ")
    return frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
