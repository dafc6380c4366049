"""Word shingles of whole texts as sets of 64-bit hashes, by arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash

_MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII blanks, A to Z lower-cased, as UTF-8."""
    return text.encode("utf-8").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    codes, kinds = pd.factorize(np.array(words, dtype=object))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))[codes]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sets_of(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, one after the other, and where each text's begin.

    A text of fewer than ``width`` words has its whole sequence as one; a text
    without words has none.  ``starts`` has an end for the last one too.
    """
    lists = [words_of(t) for t in texts]
    lengths = np.array([len(x) for x in lists], np.int64)
    hashes = word_hashes([w for x in lists for w in x]) if lengths.sum() else np.zeros(0, np.uint64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    n = len(hashes)
    shingles = np.zeros(n, np.uint64)
    for k in range(width):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = hashes[k:]
        shingles = _mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1))
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(n) - begins[owner]
    whole = lengths[owner] >= width
    keep = whole & (place <= lengths[owner] - width)
    for i in np.flatnonzero((lengths > 0) & (lengths < width)):
        own = hashes[begins[i] : begins[i + 1]]
        value = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little")
        shingles[begins[i]] = value
        keep[begins[i]] = True
    shingles, owner = shingles[keep], owner[keep]
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    first = np.ones(len(shingles), bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[first], owner[first]
    return shingles, np.searchsorted(owner, np.arange(len(texts) + 1))


def digest_of(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else b""


def multipliers(n: int) -> np.ndarray:
    """``n`` odd 32-bit numbers, each a permutation of the 32-bit numbers by multiplication."""
    return np.frombuffer(hashlib.shake_128(b"permutations").digest(4 * n), "<u4") | np.uint32(1)


def min_max(shingles: np.ndarray, starts: np.ndarray, n_permutations: int) -> np.ndarray:
    """For each set that has elements, the least and the greatest value under each permutation, side by side."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.empty((len(starts) - 1, 2 * n_permutations), np.uint32)
    full = np.flatnonzero(np.diff(starts) > 0)
    if not len(full):
        return out[:0]
    # A few thousand elements at a time stay in the processor's cache.
    a = multipliers(n_permutations)
    begin = 0
    while begin < len(full):
        end = int(np.searchsorted(starts, starts[full[begin]] + 16_384, "right")) - 1
        end = max(begin + 1, int(np.searchsorted(full, end, "left")))
        part = full[begin:end]
        piece = x[starts[part[0]] : starts[part[-1] + 1]]
        at = starts[part] - starts[part[0]]
        for k in range(n_permutations):
            y = piece * a[k]
            out[part, 2 * k] = np.minimum.reduceat(y, at)
            out[part, 2 * k + 1] = np.maximum.reduceat(y, at)
        begin = end
    return out[full]
