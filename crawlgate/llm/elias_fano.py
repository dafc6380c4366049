"""Monotone sequences in Elias-Fano form, and a two-level n-gram trie made of them.

Everything of a trie is in one flat buffer and is read in place: from bytes,
from an Arrow buffer, or from a mapped file (``mmap``), without a copy.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits each, as 64-bit words; a spare word ends them."""
    out = np.zeros((len(values) * bits + 63) // 64 + 1, np.uint64)
    step = 1 << 16
    # 65536 numbers end on a whole word whatever their width is.
    for begin in range(0, len(values) if bits else 0, step):
        part = values[begin : begin + step]
        plane = ((part[:, None] >> np.arange(bits, dtype=np.uint64)) & _ONE).astype(np.uint8)
        packed = np.packbits(plane.ravel(), bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)
        out[begin * bits // 64 : begin * bits // 64 + len(packed)] = packed
    return out


#: Words of the bit vector that one entry of the directory is for.
_STEP = 8
#: Elements looked up together, so that the arrays stay small whatever the sequence's length is.
_LOOKUP = 1 << 16
_BYTE_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.uint8)
#: Place of the k-th one in each byte.
_IN_BYTE = np.array([[next((i for i in range(8) if b >> i & 1 and bin(b & (1 << i) - 1).count("1") == k), 8) for k in range(8)] for b in range(256)], np.uint8)


def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one in each word."""
    parts = words[:, None].view(np.uint8) if words.flags.c_contiguous else np.ascontiguousarray(words)[:, None].view(np.uint8)
    sums = np.cumsum(_BYTE_ONES[parts], axis=1, dtype=np.uint8)
    at = (sums <= k[:, None]).sum(1)
    row = np.arange(len(words))
    before = np.where(at > 0, sums[row, at - 1], 0)
    return 8 * at + _IN_BYTE[parts[row, at], k - before]


class EliasFano:
    """A non-decreasing sequence: low bits side by side, high bits as a unary bit vector with a directory.

    Elements are found by select on the bit vector as it is; nothing of the
    sequence is unpacked, so opening one takes no memory.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, np.uint64(bits), low, high, ones

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        """The parts of the buffer: four numbers, low words, high words, and the ones before each ``_STEP`` of these."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64) if bits < 64 else np.zeros(n, np.int64)
        vector = np.zeros(-(-(n + (int(high[-1]) if n else 0) + 2) // (64 * _STEP)) * 64 * _STEP, np.uint8)
        vector[high + np.arange(n)] = 1
        vector = np.packbits(vector, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(vector).reshape(-1, _STEP).sum(1, dtype=np.uint64)
        ones = (np.cumsum(ones) - ones).astype(np.uint64)
        low = _pack(values & np.uint64((1 << bits) - 1), bits)
        return [np.array([n, bits, len(low), len(vector)], np.uint64), low, vector, ones]

    @staticmethod
    def read(words: np.ndarray, at: int) -> tuple["EliasFano", int]:
        """The sequence that begins at a word of a buffer, as views of it, and where it ends."""
        n, bits, a, b = (int(x) for x in words[at : at + 4])
        at += 4
        c = b // _STEP
        return EliasFano(n, bits, words[at : at + a], words[at + a : at + a + b], words[at + a + b : at + a + b + c]), at + a + b + c

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        place = i.astype(np.uint64) * self.bits
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        value = self.low[word] >> shift
        over = shift > 0
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & ((_ONE << self.bits) - _ONE)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one, or zero, of the bit vector; there must be so many."""
        out = np.empty(len(k), np.int64)
        before = self.ones if one else np.arange(len(self.ones), dtype=np.uint64) * np.uint64(64 * _STEP) - self.ones
        for begin in range(0, len(k), _LOOKUP):
            asked = k[begin : begin + _LOOKUP].astype(np.uint64)
            block = np.searchsorted(before, asked, "right") - 1
            rest = (asked - before[block]).astype(np.int64)
            words = self.high[block[:, None] * _STEP + np.arange(_STEP)]
            if not one:
                words = ~words
            sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
            at = (sums <= rest[:, None]).sum(1)
            row = np.arange(len(block))
            rest -= np.where(at > 0, sums[row, at - 1], 0)
            out[begin : begin + _LOOKUP] = (block * _STEP + at) * 64 + _in_word(words[row, at], rest)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements by their places."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << self.bits) | self._lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element of ``x`` or more, and whether it is ``x``."""
        x = np.asarray(x, np.uint64)
        high = x >> self.bits
        # Elements of a high part stand between the zeros before and after it; there are fewer zeros than the last one's.
        zeros = 64 * len(self.high) - self.n
        inside = high < np.uint64(max(0, zeros - 1))
        part = np.where(inside, high, np.uint64(0)).astype(np.int64)
        stop = np.where(inside, np.minimum(self._select(part, False) - part, self.n), self.n)
        after = part > 0
        at = np.full(len(x), self.n, np.int64)
        at[inside & ~after] = 0
        both = inside & after
        at[both] = np.minimum(self._select(part[both] - 1, False) - part[both] + 1, self.n)
        end = stop.copy()
        low = x & ((_ONE << self.bits) - _ONE)
        # Halving inside the elements of one high part; most have one or two.
        left = np.flatnonzero(at < end)
        while len(left):
            middle = (at[left] + end[left]) >> 1
            less = self._lows(middle) < low[left]
            at[left[less]] = middle[less] + 1
            end[left[~less]] = middle[~less]
            left = left[at[left] < end[left]]
        hit = at < stop
        hit[hit] = self._lows(at[hit]) == low[hit]
        return at, hit


#: Levels of a quantised base-10 logarithm between 0 and LEAST.
LEVELS = 65535
LEAST = -12.0


class Trie:
    """Contexts, pointers to their successors, successors by context-relative number, quantised probabilities.

    ``buffer`` is read in place: bytes, an Arrow buffer, or a mapped file.
    Stored are Witten-Bell's discounted probabilities c(v, w) / (c(v) + t(v));
    what they leave of each context's probability is t(v) / (c(v) + t(v)).
    """

    def __init__(self, buffer):
        words = np.frombuffer(buffer, np.uint64)
        at = 0
        self.contexts, at = EliasFano.read(words, at)
        self.words, at = EliasFano.read(words, at)
        self.pointers, at = EliasFano.read(words, at)
        self.successors, at = EliasFano.read(words, at)
        self.counts, at = EliasFano.read(words, at)
        self.codes = words[at:].view(np.uint16)[: self.successors.n]

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, owner: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
        """The buffer of a trie.

        ``contexts`` and ``words`` are sorted numbers; the n-gram i is context
        ``owner[i]`` before word ``word[i]``, in order, and was seen
        ``count[i]`` times.
        """
        totals = np.bincount(owner, weights=count, minlength=len(contexts)).astype(np.int64)
        kinds = np.bincount(owner, minlength=len(contexts))
        code = np.round(np.log10(count / (totals + kinds)[owner]) / LEAST * LEVELS).astype(np.uint16) if len(owner) else np.zeros(0, np.uint16)
        code = np.concatenate([code, np.zeros(-len(code) % 4, np.uint16)])
        # A word's number among the words, raised by its context's place: one monotone sequence.
        relative = owner.astype(np.uint64) * np.uint64(max(1, len(words))) + word.astype(np.uint64)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (kinds, totals)]
        parts = [*EliasFano.encode(contexts), *EliasFano.encode(words), *EliasFano.encode(sums[0]), *EliasFano.encode(relative), *EliasFano.encode(sums[1]), code.view(np.uint64)]
        return b"".join(p.tobytes() for p in parts)

    def context(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each context (-1: unknown), how often it was seen, and its distinct successors."""
        at, hit = self.contexts.successor(numbers)
        seen, kinds = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for out, sums in ((seen, self.counts), (kinds, self.pointers)):
            out[hit] = (sums.get(at[hit] + 1) - sums.get(at[hit])).astype(np.int64)
        return np.where(hit, at, -1), seen, kinds

    def number(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one that no context has."""
        at, hit = self.words.successor(words)
        return np.where(hit, at, -1)

    def code(self, place: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The quantised probability of words, by number, after contexts, by place, plus one; 0 if never seen."""
        out = np.zeros(len(place), np.uint32)
        if not self.successors.n:
            return out
        ask = np.flatnonzero((number >= 0) & (place >= 0))
        at, hit = self.successors.successor(place[ask].astype(np.uint64) * np.uint64(self.words.n) + number[ask].astype(np.uint64))
        out[ask[hit]] = self.codes[at[hit]].astype(np.uint32) + 1
        return out


def probability(code: np.ndarray) -> np.ndarray:
    """What ``Trie.code`` stands for; 0 for 0."""
    return np.where(code > 0, 10.0 ** (LEAST * (code.astype(np.float64) - 1) / LEVELS), 0.0)
