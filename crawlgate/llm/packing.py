"""Best-fit packing of tokenized documents by bin completion.

Sizes are whole numbers up to the capacity, so what matters of a corpus is how
many pieces have each size: at most ``capacity`` counts, whatever its length.
The search runs on these counts on the driver and fills many sequences of one
kind at once.  Best fit gives the first solution.  Bin completion looks for a
better one: around the largest size left it enumerates the fillings that no
other filling dominates, branches over them, and prunes a branch that wastes
more than the best solution less one bin can spare, or whose lower bound is
too high.  It does so for all items, and then for those of a few bins of the
best solution at a time, which are to fit into one bin less.  ``STEPS`` bounds
the search, not the pieces: every piece is in every solution.

Pieces find their place by their size and their rank among the pieces of that
size, which is the rank within their partition plus a sum over the partitions
before.

Defined results: an empty or null text has its closing id alone.  Null ids and
repeated rows are packed as any other.  An empty table has no pieces.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlgate.llm.bpe_automaton import WORDS, automaton, byte_of_char, split_pattern, tokenizer_text
from crawlgate.llm.common import lean, small_batches, table, written

CAPACITY = 1024
END = 2
#: Fillings that the search makes at most: in all, for all items at once, and for those of a few bins.
STEPS = 12_000
WHOLE_STEPS = 2500
PART_STEPS = 1500

PIECES = "doc_id {id}, piece int, start long, length int, ids_crc32 long, part int, place long"


@lru_cache(None)
def _dual_feasible(capacity: int, most: int = 24) -> np.ndarray:
    """Weights of each size, a row a function: items of one bin weigh 1 at most together."""
    size = np.arange(capacity + 1, dtype=np.int64)
    k = np.arange(1, most + 1, dtype=np.int64)[:, None]
    whole = (k + 1) * size % capacity == 0
    return np.where(whole, size * k, (k + 1) * size // capacity * capacity) / (k * capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by total size, by dual-feasible functions, and by items that cannot share a bin."""
    n = np.zeros(capacity + 1, np.int64)
    for s, k in counts.items():
        n[s] = k
    size = np.arange(capacity + 1)
    half = capacity // 2
    # Less a share that covers the rounding of the weights' sum.
    weighed = int(np.ceil((_dual_feasible(capacity) @ n).max() * (1 - 1e-12) - 1e-9))
    number, total = np.cumsum(n), np.cumsum(n * size)
    # Items over capacity - k fill bins alone; those over half one each, with room for items of k at least.
    k = np.arange(1, half + 1)
    alone = number[-1] - number[capacity - k]
    over_half = number[capacity - k] - number[half]
    room = capacity * over_half - (total[capacity - k] - total[half])
    rest = total[half] - total[k - 1]
    return int(max(weighed, -(-total[-1] // capacity), (alone + over_half + np.maximum(0, -(-(rest - room) // capacity))).max(initial=0)))


def _sums(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each place in ``sizes``: the sums up to ``room`` that items from there on can make, as bits of a number."""
    within = (1 << room + 1) - 1
    out, sums = [1], 1
    for s in reversed(sizes):
        most, step = min(counts[s], room // s), 1
        while most:
            step = min(step, most)
            sums |= sums << step * s & within
            most, step = most - step, 2 * step
        out.append(sums)
    return out[::-1]


def _raised(bits: int, most: int) -> int:
    """``bits`` moved up by 0 to ``most`` places, together."""
    step = 1
    while most > 0:
        step = min(step, most)
        bits |= bits << step
        most, step = most - step, 2 * step
    return bits


def undominated(items: tuple[int, ...], waste: int, counts: dict[int, int], sizes: int) -> bool:
    """Whether no item left would do better in a filling of ``items``; ``sizes`` has a bit for each size there is.

    One would, if it fits into the waste, or in the place of two items or more
    that are no larger together, or in the place of a smaller one.
    """
    one = two = 0
    for x in items:
        two |= (one | two) << x
        one |= 1 << x
    better = _raised(two, waste)
    if waste:
        better |= _raised((one | 1) << 1, waste - 1)
    better &= sizes
    while better:
        s = better.bit_length() - 1
        if counts[s] > items.count(s):
            return False
        better ^= 1 << s
    return True


def fillings(counts: dict[int, int], room: int, waste: int) -> Iterator[tuple[int, ...] | None]:
    """Multisets of sizes that leave ``waste`` of ``room`` or less, None for a dominated one; least waste first, then large items first.

    ``_sums`` tells which items can still be part of a filling, so that none is
    tried in vain.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    sums = _sums(sizes, counts, room)
    falling, every = [-s for s in sizes], sum(1 << s for s in sizes)

    def exact(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        i = max(i, bisect_left(falling, -total))
        while i < len(sizes) and sums[i] >> total & 1:
            s = sizes[i]
            for m in range(min(counts[s], total // s), 0, -1):
                if sums[i + 1] >> (total - m * s) & 1:
                    for rest in exact(i + 1, total - m * s):
                        yield (s,) * m + rest
            i += 1

    for left in range(min(waste, room) + 1):
        if sums[0] >> (room - left) & 1:
            for items in exact(0, room - left):
                yield items if undominated(items, left, counts, every) else None


Plan = list[tuple[tuple[int, ...], int]]


def _take(counts: dict[int, int], items: tuple[int, ...]) -> int:
    """Bins of this filling that can be made while it uses up one of its sizes."""
    return min(counts[s] // items.count(s) for s in set(items))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing on counts: each item goes to the fullest bin that has room for it."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            left = min((r for r, kinds in bins.items() if r >= s and kinds), default=None)
            if left is None:
                each = capacity // s
                for k, items in ((n // each, (s,) * each), (int(n % each > 0), (s,) * (n % each))):
                    if k:
                        kinds = bins.setdefault(capacity - sum(items), {})
                        kinds[items] = kinds.get(items, 0) + k
                n = 0
                break
            items, k = next(iter(bins[left].items()))
            each = min(left // s, n)
            m = min(k, n // each)
            for change, kind, room in ((-m, items, left), (m, (*items, *(s,) * each), left - s * each)):
                kinds = bins.setdefault(room, {})
                kinds[kind] = kinds.get(kind, 0) + change
                if not kinds[kind]:
                    del kinds[kind]
            n -= m * each
    return [(items, k) for kinds in bins.values() for items, k in kinds.items()]


def completed(counts: dict[int, int], capacity: int, target: int, steps: int) -> tuple[Plan | None, int]:
    """A packing in ``target`` bins or fewer, None if none was found, and the steps not taken.

    Depth-first over the fillings around the largest item left; one that
    wastes more than ``target`` bins can spare is not looked at.  A step is a
    filling made, dominated or not.  With steps left, there is no such packing.
    """
    spare = target * capacity - sum(s * n for s, n in counts.items())

    def branches(left: dict[int, int], spare: int) -> Iterator[tuple[tuple[int, ...], int] | None]:
        """Fillings, each as often as it can be made; then, where that was more than once, each once."""
        top = max(left)
        less = left | {top: left[top] - 1}
        for once in (False, True):
            again = False
            for items in fillings(less, capacity - top, spare):
                if items is None:
                    yield None
                    continue
                full = (top, *items)
                most, waste = _take(left, full), capacity - top - sum(items)
                if waste:
                    most = min(most, spare // waste)
                again = again or most > 1
                if not once or most > 1:
                    yield full, 1 if once else most
            if not again:
                break

    if spare < 0:
        return None, steps
    path = [(counts, spare, 0, branches(counts, spare))] if counts else []
    made: Plan = []
    while path and steps > 0:
        left, spare, used, rest = path[-1]
        steps -= 1
        try:
            step = next(rest)
        except StopIteration:
            path.pop()
            if made:
                made.pop()
            continue
        if step is None:
            continue
        full, k = step
        after = left.copy()
        for s in full:
            after[s] -= k
        after = {s: n for s, n in after.items() if n}
        if not after:
            return [*made, step], steps
        if used + k + lower_bound(after, capacity) <= target:
            made.append(step)
            spare -= k * (capacity - sum(full))
            path.append((after, spare, used + k, branches(after, spare)))
    return None, steps


def _counted(plan: Plan) -> dict[int, int]:
    out: Counter[int] = Counter()
    for items, k in plan:
        for s in items:
            out[s] += k
    return dict(out)


def _joined(plan: Plan) -> Plan:
    out: Counter[tuple[int, ...]] = Counter()
    for items, k in plan:
        out[tuple(sorted(items, reverse=True))] += k
    return list(out.items())


def _chosen(plan: Plan, capacity: int, rng: np.random.Generator, bins: int) -> Plan:
    """So many bins of the plan: wasteful ones before all, and some at random, whose items can take the waste in."""
    waste = np.array([capacity - sum(items) for items, _ in plan], float)
    number = np.array([k for _, k in plan])
    # Each bin's place is drawn by a weight, the largest come first (Gumbel's trick); only so many of a kind matter.
    kind = np.repeat(np.arange(len(plan)), np.minimum(number, bins))
    spice = rng.choice([0.3, 1.0, 3.0])
    order = np.argsort(-(np.log(waste[kind] + spice) + rng.gumbel(size=len(kind)) * 0.5), kind="stable")
    picked = Counter(kind[order[:bins]].tolist())
    return [(plan[i][0], k) for i, k in picked.items()]


def pack(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """Fillings and how many sequences get each; together they hold every item.

    Best fit gives the first solution.  Bin completion then looks for one of
    fewer bins: first for all items, and then, as long as there are steps, for
    the items of a few bins at a time, into one bin less than they have.
    """
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("a piece is larger than the capacity, or empty")
    best = _joined(best_fit(counts, capacity))
    n_best, least = sum(k for _, k in best), lower_bound(counts, capacity)
    whole = min(steps, WHOLE_STEPS)
    while n_best > least and whole > 0:
        found, left = completed(counts, capacity, n_best - 1, whole)
        steps, whole = steps - (whole - left), left
        if found is None:
            break
        best, n_best = _joined(found), sum(k for _, k in found)
    if whole > 0:
        return best  # the search came to its end: it is the least number
    rng = np.random.default_rng(0)
    while n_best > least and steps > 0:
        bins = int(rng.choice([8, 16, 32]))
        part = _chosen(best, capacity, rng, bins)
        own, n = _counted(part), sum(k for _, k in part)
        tried = min(steps, PART_STEPS)
        steps -= 1
        if lower_bound(own, capacity) >= n:
            continue
        found, left = completed(own, capacity, n - 1, tried)
        steps -= tried - left
        if found is not None:
            rest = Counter(dict(best))
            rest.subtract(dict(part))
            best = _joined([(items, k) for items, k in rest.items() if k] + found)
            n_best -= n - sum(k for _, k in found)
    return best


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be short."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


_CODERS: dict[int, Callable] = {}


def coder(spec: str, pattern: str) -> Callable[[list], list[bytes]]:
    """Texts -> packed ids.

    Where a file's ids rise with the ranks of its merges, tiktoken gives the
    same ids as the tokenizers library; other files go to the automaton.
    """
    key = zlib.crc32(spec.encode())
    if key not in _CODERS:
        read = json.loads(spec)
        vocab, byte = read["model"]["vocab"], byte_of_char()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in read["model"]["merges"]]
        rising = all(x < y for x, y in zip(merged, merged[1:])) and sorted(set(vocab.values()) - set(merged)) == list(range(256))
        special = {x["content"]: x["id"] for x in read.get("added_tokens", ())}
        if rising and read["model"]["type"] == "BPE" and not read.get("normalizer") and (read.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
            quick = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
            _CODERS[key] = lambda texts: [quick.encode_to_numpy(t or "", allowed_special="all").astype("<u4").tobytes() for t in texts]
        else:
            _CODERS[key] = automaton(spec, pattern).encode_all
    return _CODERS[key]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's pieces, with the partition they were made in and their place among its pieces of that length."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast((tokenizer_text(path), split_pattern()))
    closing = end.to_bytes(4, "little")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(*spec.value)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += closing
                for k, (start, length) in enumerate(_cut(len(ids) // 4, capacity)):
                    for column, x in zip(out, (i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length]))):
                        column.append(x)
                    seen[length] += 1
            arrays = [batch.column(0).take(pa.array(out[0], pa.int64()))]
            arrays += [pa.array(x, t) for x, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(lean(made), PIECES.format(id=rows.dtypes[0][1]))


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut``, as ``pieces`` makes it, with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    cut = written(cut, "pieces")
    sums = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "sums")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most

    # For each length: ranks from which on a filling's bins take it, and what they are.
    runs: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in counts}
    ranks, base = dict.fromkeys(counts, 0), 0
    for items, k in pack(counts, capacity):
        offset = 0
        for s in sorted(set(items), reverse=True):
            each = items.count(s)
            runs[s].append((ranks[s], base, each, offset))
            ranks[s] += each * k
            offset += each * s
        base += k
    if ranks != counts:
        raise AssertionError("the plan does not hold every piece once")
    plan = spark.sparkContext.broadcast({s: np.array(x, np.int64).reshape(-1, 4) for s, x in runs.items()})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                at, run = np.flatnonzero(length == s), plan.value[int(s)]
                first, begin, each, place = run[np.searchsorted(run[:, 0], rank[at], "right") - 1].T
                sequence[at] = begin + (rank[at] - first) // each
                offset[at] = place + (rank[at] - first) % each * s
            keep = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays([*keep, batch.column("length").cast(pa.int64()), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(cut.dtypes)["doc_id"]
    ranked = cut.join(sums.drop("n"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(lean(placed), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the whole table packed into sequences of 1024 tokens."""
    return packed(pieces(table(spark, sf_dir, "documents")))
