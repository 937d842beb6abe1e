"""Words and Rabin-Karp hashes shared by the operators on word sequences.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``, which is what
``bytes.split()`` yields. Hashes are polynomials modulo 2**64 over 64-bit word fingerprints.
"""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MEMO_WORDS = 150_000


class Fingerprints(dict):
    """Word to 64-bit fingerprint. The memo is emptied when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def release() -> None:
    """Gives freed memory back. Workers are kept for later tasks, of other stages too; what the
    allocators of C and Arrow hold on to would add up in them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run):
    """A task's generator that gives its freed memory back when it ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def rolling(values: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every window of ``size`` values, by Horner's rule over all windows at once."""
    count = len(values) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out, base = np.zeros(count, np.uint64), np.uint64(base)
    for k in range(size):
        out *= base
        out += values[k : k + count]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads a polynomial hash over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(batch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)
