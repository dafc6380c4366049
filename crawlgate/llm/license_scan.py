"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them.

Each template's grams of ``GRAM`` words are hashed and winnowed (the least of
each ``WINNOW`` in a row is kept) into an inverted index.  All grams of a text
are looked up; hits on nearby diagonals of one template are one candidate,
which is aligned word by word inside a band around its diagonals, again for
each copy in it, with the words of those before masked.  A copy
is reported if ``COVERAGE`` of the template's words are matched; where reports
overlap, those with more matched words less unmatched ones stay.  A copy with
GRAM + WINNOW - 1 template words in a row unchanged is always a candidate.

Defined results: a null text, or one without words, has no report.  Words are
letters and digits in lower case, and spans are characters of the text as it
is.  Rows are scanned alone: null ids and repeated rows are reported as they come.  Texts
are read whole.  The index is of the templates' size, whatever the table's is.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.llm.common import small_batches, table
from crawlgate.llm.license_templates import TEMPLATES
from crawlgate.llm.shingles import _mixed, word_hashes

GRAM = 3
WINNOW = 3
BAND = 12
COVERAGE = 0.8
ROWS = 1000

_WORD = re.compile(r"[^\W_]+")


def lowered(text: str) -> str:
    """The text in lower case, each character in its place: the one that would become two is read as an i."""
    return text.replace("\u0130", "i").lower()


@dataclass(frozen=True)
class Match:
    license: str
    template: int
    matched: int
    words: int
    #: First word and the one after the last, in the text.
    begin: int
    end: int

    @property
    def weight(self) -> int:
        return 2 * self.matched - (self.end - self.begin) - (self.words - self.matched)


def grams(hashes: np.ndarray) -> np.ndarray:
    """A hash of each run of ``GRAM`` words."""
    n = max(0, len(hashes) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n] + np.uint64(k + 1))
    return out


def winnowed(values: np.ndarray) -> list[int]:
    """Places of the least of each ``WINNOW`` values in a row, the last of equal ones."""
    if len(values) <= WINNOW:
        return [len(values) - 1 - int(np.argmin(values[::-1]))] if len(values) else []
    kept = []
    for i in range(len(values) - WINNOW + 1):
        part = values[i : i + WINNOW]
        at = i + WINNOW - 1 - int(np.argmin(part[::-1]))
        if not kept or kept[-1] != at:
            kept.append(at)
    return kept


class Index:
    """Winnowed fingerprints of all templates: hash -> (template, place)."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.names: list[tuple[str, int]] = []
        self.words: list[list[str]] = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, texts in templates.items():
            for k, text in enumerate(texts):
                words = _WORD.findall(lowered(text))
                values = grams(word_hashes([w.encode() for w in words]))
                for at in winnowed(values):
                    self.places[int(values[at])].append((len(self.words), at))
                self.names.append((name, k))
                self.words.append(words)
        self.hashes = np.sort(np.fromiter(self.places, np.uint64, len(self.places)))


def aligned(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int]:
    """Matched words, first and end place in ``words`` of the best alignment of the template on diagonals low to high.

    A match earns 2 and a word left out of either side costs 1; words of the
    text before and after the alignment are free.
    """
    least = -(10**9)
    width = high - low + 1
    # best[d]: (score, matched, first place, end place) with the template read up to row i, on diagonal low + d.
    best = [(0, 0, max(0, low + d), max(0, low + d)) if 0 <= low + d <= len(words) else (least, 0, 0, 0) for d in range(width)]
    for i, word in enumerate(template):
        now = []
        for d in range(width):
            j = low + d + i
            options = [(least, 0, 0, 0)]
            if 0 <= j < len(words) and words[j] == word and best[d][0] > least:
                s, m, a, _ = best[d]
                options.append((s + 2, m + 1, a if m else j, j + 1))
            if d + 1 < width and best[d + 1][0] > least:
                s, m, a, e = best[d + 1]  # the template's word is left out
                options.append((s - 1, m, a, e))
            if now and now[-1][0] > least and 0 <= j - 0 <= len(words):
                s, m, a, e = now[-1]  # the text's word is left out
                options.append((s - (1 if m else 0), m, a, e))
            now.append(max(options, key=lambda x: (x[0], x[1], -x[3])))
        best = now
    score, matched, first, end = max(best, key=lambda x: (x[0], x[1], -x[3]))
    return matched, first, end


def copies(template: list[str], words: list[str], low: int, high: int) -> list[tuple[int, int, int]]:
    """Alignments of all the template's copies on diagonals low to high, the best first; each one's words are masked for the next.

    Many diagonals are read in parts, half of each in common with the next, so
    that the work does not grow with the square of the copies, and then at once
    for copies that are stretched over more than a part.
    """
    size, known = len(template), set(template)

    def rest(left: list[str | None], a: int, b: int) -> list[tuple[int, int, int]]:
        out = []
        while sum(w in known for w in left[max(0, a) : max(0, b + size)]) >= COVERAGE * size:
            matched, first, end = aligned(template, left, a, b)
            if matched < COVERAGE * size:
                break
            # What goes round words taken before would overlap a better one.
            if None not in left[first:end]:
                out.append((matched, first, end))
            left[first:end] = [None] * (end - first)
        return out

    part, out, masked = size + 3 * BAND, [], list(words)
    if high - low > 2 * part:
        for a in range(low, high - part + 1, part):
            b = min(high, a + 2 * part)
            # Only the words in reach: first of them is word ``begin`` of the text.
            begin = max(0, a)
            out += [(m, x + begin, y + begin) for m, x, y in rest(words[begin : b + size], a - begin, b - begin)]
        for _, first, end in out:
            masked[first:end] = [None] * (end - first)
    return out + rest(masked, low, high)


def matches(words: list[str], hits: list[int], values: np.ndarray, index: Index) -> list[Match]:
    """Reports of a text from the places where a gram of it is in the index."""
    diagonals: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at in hits:
        for template, place in index.places[int(values[at])]:
            diagonals[template].append((at - place, at))
    found = []
    for template, places in diagonals.items():
        text, places = index.words[template], sorted(places)
        groups, size = [], len(text)
        for d, at in sorted(places, key=lambda x: (x[1], x[0])):
            # Hits belong together while their templates' copies would overlap near one diagonal.
            for g in groups:
                if abs(d - g[0]) <= BAND and at - g[1] <= size + BAND:
                    g[0], g[1], g[2], g[3] = d, at, min(g[2], d), max(g[3], d)
                    break
            else:
                groups.append([d, at, d, d])
        for _, _, low, high in groups:
            found += [Match(*index.names[template], matched, size, first, end) for matched, first, end in copies(text, words, low - BAND, high + BAND)]
    kept: list[Match] = []
    for m in sorted(set(found), key=lambda m: (-m.weight, m.begin, m.license, m.template)):
        at = bisect(kept, m.begin, key=lambda k: k.begin)
        if (not at or kept[at - 1].end <= m.begin) and (at == len(kept) or m.end <= kept[at].begin):
            kept.insert(at, m)
    return kept


def scan_texts(texts: list[str | None], index: Index) -> list[list[tuple[Match, int, int]]]:
    """Each text's reports, with their first and end characters."""
    lists = [_WORD.findall(lowered(t)) if t else [] for t in texts]
    lengths = np.array([len(x) for x in lists], np.int64)
    out: list[list[tuple[Match, int, int]]] = [[] for _ in texts]
    if not lengths.sum():
        return out
    values = grams(word_hashes([w.encode("utf-8", "replace") for x in lists for w in x]))
    begin = np.cumsum(lengths) - lengths
    hit = np.flatnonzero(np.isin(values, index.hashes))
    owner = np.searchsorted(begin + lengths, hit, "right")
    inside = hit + GRAM <= (begin + lengths)[owner]
    by_text = defaultdict(list)
    for i, at in zip(owner[inside].tolist(), hit[inside].tolist()):
        by_text[i].append(at - int(begin[i]))
    for i, hits in by_text.items():
        found = matches(lists[i], hits, values[begin[i] : begin[i] + lengths[i]], index)
        if found:
            spans = [m.span() for m in _WORD.finditer(lowered(texts[i]))]
            out[i] = [(m, spans[m.begin][0], spans[m.end - 1][1]) for m in found]
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """A row for each report: id, licence, template, matched words and coverage, characters from and to."""
    small_batches(docs.sparkSession)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [(i, m, a, b) for i, found in enumerate(scan_texts(part.column(1).to_pylist(), index)) for m, a, b in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1].license for r in rows], pa.string()),
                        pa.array([r[1].template for r in rows], pa.int32()),
                        pa.array([r[1].matched for r in rows], pa.int64()),
                        pa.array([r[1].matched / r[1].words for r in rows], pa.float64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                    ],
                    names=["doc_id", "license", "template", "matched_words", "coverage", "start_char", "end_char"],
                )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = f"doc_id {rows.dtypes[0][1]}, license string, template int, matched_words long, coverage double, start_char long, end_char long"
    return rows.mapInArrow(scanned, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every licence notice in every document."""
    return scan(table(spark, sf_dir, "documents"))
