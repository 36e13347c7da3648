"""Word-shingle sets as 64-bit hashes, and min-max signatures of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from logweave.llm.words import SPACE_LOWER, Alphabet, Words, binary_bytes, split_words

_RANDOM = np.random.default_rng(20240607)
#: Odd multipliers: one for each word of a shingle (cycled beyond), then pairs for the hash functions.
_WORD_FACTORS = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERMUTATIONS = 256
_FACTORS = _RANDOM.integers(0, 2**63, _PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, _PERMUTATIONS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Longer words are hashed one by one.
_LONG_WORD = 1 << 12
_BYTES = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(_LONG_WORD, _WORD_FACTORS[0]))))


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """Of each word the sum of its bytes' random numbers, each times a power of an odd factor by its place; longer words by xxh3."""
    offsets, data = binary_bytes(dictionary)
    if not len(data):
        return np.zeros(len(dictionary), np.uint64)
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    out = mix(np.add.reduceat(_BYTES[data] * _POWERS[np.minimum(place, _LONG_WORD)], offsets[:-1]))  # no word is empty
    for i in np.flatnonzero(lengths > _LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
    return out


def _hashed(words: Words) -> np.ndarray:
    return word_hashes(words.dictionary)[words.index] if len(words.index) else np.zeros(0, np.uint64)


def runs_of(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row, over text ends too."""
    if len(hashed) < size:
        return np.zeros(0, np.uint64)
    whole = hashed[: len(hashed) - size + 1] * _WORD_FACTORS[0]
    for j in range(1, size):
        whole += hashed[j : len(hashed) - size + 1 + j] * _WORD_FACTORS[j % 64]
    return mix(whole)


def word_stream(words: Words) -> np.ndarray:
    """Hashes of all words in order."""
    return _hashed(words)


def range_sets(hashed: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """For each range of words the sorted distinct hashes of its shingles; a range of fewer words, but not none, is one shingle."""
    whole = runs_of(hashed, size)
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= size:
            own = whole[a : b - size + 1].copy()
            own.sort()
            out.append(own)
        elif b > a:
            short = (hashed[a:b] * _WORD_FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    if not out:
        return out
    ends = np.cumsum([len(x) for x in out])
    flat = np.concatenate(out)
    repeats = np.flatnonzero(flat[1:] == flat[:-1]) + 1
    for i in np.unique(np.searchsorted(ends, repeats, "right")).tolist():  # sets that may hold an element twice
        x = out[i]
        if len(x) > 1:
            out[i] = x[np.concatenate(([True], x[1:] != x[:-1]))]
    return out


def shingle_sets(column: pa.Array, size: int, letters: Alphabet = SPACE_LOWER) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words, but not none, is one shingle."""
    words = split_words(column, letters)
    return range_sets(_hashed(words), words.first[:-1], words.first[1:], size)


def signatures(sets: list[np.ndarray], permutations: int, first: int = 0) -> np.ndarray:
    """One row of ``2 * permutations`` uint32 for each non-empty set: of every hash function both the least and the greatest value.

    The two ends of a permutation agree between two sets each with probability equal to their similarity, so one evaluation
    yields two unbiased signature values. The hash functions are those from number ``first`` on.
    """
    starts = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    x = np.concatenate(sets)
    out = np.empty((len(sets), 2 * permutations), np.uint32)
    for i in range(permutations):
        v = ((x * _FACTORS[first + i] + _SHIFTS[first + i]) >> np.uint64(32)).astype(np.uint32)
        np.minimum.reduceat(v, starts, out=out[:, 2 * i])
        np.maximum.reduceat(v, starts, out=out[:, 2 * i + 1])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 (n, bands): a hash of each band's values and its number."""
    wide = signature[:, : bands * rows].astype(np.uint64).reshape(len(signature), bands, rows)
    keys = (wide * _WORD_FACTORS[:rows]).sum(axis=2, dtype=np.uint64)
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * _WORD_FACTORS[63]).view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    """Equal for equal sets, different otherwise but for a 128-bit collision."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
