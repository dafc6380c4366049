"""Deep-shallow sorting of the suffixes at given places, to a given length.

Shallow: multikey quicksort with three-way partition, whose characters are
words of eight bytes, for ``SHALLOW`` words.  A group of suffixes is parted by
the word of a pivot into smaller, equal and larger ones; the equal ones go on
with the next word.  All groups are parted together, by arrays.

Deep: the groups of suffixes that share all these words are put into blind
tries, which keep for each suffix only where it leaves the path of another one
and by which byte.  The tries are read in order at the end.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 4


def big_endian_words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that orders like them; zero bytes follow the end."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    out = np.zeros(len(buffer), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(buffer)]
    return out


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros(len(x), np.int64), x.copy()
    for bits in (32, 16, 8):
        high = (x >> np.uint64(64 - bits)) == 0
        out += high * (bits // 8)
        x[high] <<= np.uint64(bits)
    return out


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes, one after the other: the run of each element, and its place in the run."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - (np.cumsum(sizes) - sizes)[run]


def multikey_quicksort(words: np.ndarray, places: np.ndarray, order: np.ndarray, group: np.ndarray, sizes: np.ndarray, depth: int) -> None:
    """Sorts ``order`` inside the first groups, of ``sizes``, by ``depth`` words from each place.

    ``group`` becomes the first slot of the run of equal ones that a slot is in.
    """
    rng = np.random.default_rng(0)
    begin, read = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
    keep = sizes > 1
    begin, sizes, read = begin[keep], sizes[keep], read[keep]
    while len(sizes):
        run, inside = _runs(sizes)
        slot = begin[run] + inside
        own = order[slot]
        key = words[places[own] + 8 * read[run]]
        first = np.cumsum(sizes) - sizes
        # The median of three at random.
        pivot = np.sort(key[first[:, None] + rng.integers(0, sizes[:, None], (len(sizes), 3))], axis=1)[:, 1][run]
        side = (key > pivot).astype(np.int8) - (key < pivot)
        counts = np.zeros((len(sizes), 3), np.int64)
        to = np.zeros(len(slot), np.int64)
        for k in range(3):
            mine = side == k - 1
            seen = np.cumsum(mine)
            before = np.where(first > 0, seen[first - 1], 0)
            counts[:, k] = seen[first + sizes - 1] - before
            to[mine] = (seen - 1 - before[run])[mine] + counts[:, :k].sum(1)[run][mine]
        order[begin[run] + to] = own
        begins = begin[:, None] + np.cumsum(counts, axis=1) - counts
        group[slot] = np.repeat(begins.ravel(), counts.ravel())
        reads = read[:, None] + np.array([0, 1, 0])
        keep = (counts > 1) & (reads < depth)
        begin, sizes, read = begins[keep], counts[keep], reads[keep]


class BlindTries:
    """Tries of groups of suffixes that are equal in their first bytes.

    A suffix is a leaf.  The first of a group is the path that the others are
    put along: each is held by the leaf whose path it leaves, the depth where
    it does, and the byte that it goes on with.  Those that leave a path at one
    depth by one byte are put along the path of the first of them, and so on.
    """

    def __init__(self, buffer: np.ndarray, words: np.ndarray, places: np.ndarray, sizes: np.ndarray, begin: int, length: int):
        n = len(places)
        self.run, inside = _runs(sizes)
        self.parent = np.arange(n)
        self.depth, self.byte = np.full(n, length, np.int64), np.zeros(n, np.int64)
        #: Whether a leaf is smaller (-1) or larger (1) than its parent's path, or equal to it (0).
        self.side = np.zeros(n, np.int64)
        #: Leaves in the order in which they were put in, a round after the other.
        self.rounds: list[np.ndarray] = []
        path = (np.cumsum(sizes) - sizes)[self.run]
        left = np.flatnonzero(inside > 0)
        while len(left):
            depth, byte, side = self._leave(buffer, words, places[left], places[path[left]], begin, length)
            # Leaves of one edge stand together, the first of them is the path of the others.
            by = np.lexsort((left, byte, depth, path[left]))
            left, depth, byte, side = left[by], depth[by], byte[by], side[by]
            new = np.ones(len(left), bool)
            new[1:] = (path[left][1:] != path[left][:-1]) | (depth[1:] != depth[:-1]) | (byte[1:] != byte[:-1])
            new |= depth == length  # equal ones have no more bytes to go by
            at = left[new]
            self.parent[at], self.depth[at], self.byte[at], self.side[at] = path[at], depth[new], byte[new], side[new]
            self.rounds.append(at)
            path[left] = np.where(new, path[left], at[np.cumsum(new) - 1])
            left = left[~new]

    @staticmethod
    def _leave(buffer: np.ndarray, words: np.ndarray, here: np.ndarray, path: np.ndarray, begin: int, length: int) -> tuple[np.ndarray, ...]:
        """Where suffixes leave a path, by which byte, and on which side."""
        depth = np.full(len(here), length, np.int64)
        byte, side = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
        left = np.arange(len(here))
        for d in range(begin, length, 8):
            x, y = words[here[left] + d], words[path[left] + d]
            off = np.flatnonzero(x != y)
            at = left[off]
            depth[at] = d + _leading_zero_bytes(x[off] ^ y[off])
            byte[at] = buffer[here[at] + depth[at]]
            side[at] = np.where(x[off] < y[off], -1, 1)
            left = left[x == y]
            if not len(left):
                break
        return depth, byte, side

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of each leaf among all, groups in their order, and the leaf that stands for its class."""
        n = len(self.parent)
        size = np.ones(n, np.int64)
        for at in reversed(self.rounds):
            np.add.at(size, self.parent[at], size[at])
        child = np.flatnonzero(self.parent != np.arange(n))
        # Along a path: smaller ones from the first to leave to the last, the path, its equals, larger ones the other way.
        by = child[np.lexsort((self.byte[child], np.where(self.side[child] > 0, -self.depth[child], self.depth[child]), self.side[child], self.parent[child]))]
        sums = np.cumsum(size[by]) - size[by]
        new = np.ones(len(by), bool)
        new[1:] = self.parent[by][1:] != self.parent[by][:-1]
        before = np.zeros(n, np.int64)
        before[by] = sums - sums[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        smaller = np.zeros(n, np.int64)
        low = child[self.side[child] < 0]
        np.add.at(smaller, self.parent[low], size[low])
        root = np.flatnonzero(self.parent == np.arange(n))
        start = np.zeros(n, np.int64)
        start[root] = np.cumsum(size[root]) - size[root]
        for at in self.rounds:
            up = self.parent[at]
            start[at] = start[up] + before[at] + (self.side[at] >= 0)
        return start + smaller, np.where(self.side == 0, self.parent, np.arange(n))


def deep_shallow(buffer: np.ndarray, places: np.ndarray, length: int, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of ``places`` in the order of the ``length`` bytes there, and a class for each slot of that order.

    Slots of one class hold equal strings; the class is its first slot.  Every
    place must have ``length`` bytes, a multiple of eight, before the end.  With
    ``sizes``, only places of one run of so many are compared with each other.
    """
    words = big_endian_words(buffer)
    n = len(places)
    sizes = np.array([n], np.int64) if sizes is None else np.asarray(sizes, np.int64)
    order = np.arange(n)
    group = np.repeat(np.cumsum(sizes) - sizes, sizes)
    shallow = min(SHALLOW, length // 8)
    multikey_quicksort(words, places, order, group, sizes, shallow)
    if 8 * shallow >= length or not n:
        return order, group
    counts = np.bincount(group, minlength=n)
    slot = np.flatnonzero(counts[group] > 1)
    if len(slot):
        own = order[slot]
        tries = BlindTries(buffer, words, places[own], counts[counts > 1], 8 * shallow, length)
        place, first = tries.ordered()
        order[slot[place]] = own
        group[slot[place]] = slot[place[first]]
    return order, group
