"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two strings sums, over all subsequences of ``ORDER`` characters
that both have, ``DECAY`` to the power of the stretches they span, so a letter
put in, or a gap between letters, weakens a match and does not end it.  It is
approximated from landmarks (Nyström): a string's features are its kernels with
them, whitened by the landmarks' own.  A sentence's kernel with a landmark is the
largest of its pieces': words, letters written one by one joined into one, or
windows of a long word.  A linear machine is trained on sentences labelled by
their documents: a toxic document is a bag of which the strongest sentence
counts, and sentences of clean documents are all negative.  Two words of a
sentence that are no insult alone can be one together.

Some words are no proof in one sentence: clean documents have them too, but far
less often.  A second machine over the same features tells the pieces that toxic
documents favour by rate, and the number of different ones in a document is
weighed against its length as a ratio of two Poisson likelihoods.  A document's
score is the larger of two calibrated ones: the margin of its strongest sentence,
and that ratio.

What is bounded: ``TOXIC`` and ``CLEAN`` labelled documents, first by a hash of
their id, are learnt from.  Texts to score are read whole.

Defined results: a text without pieces (null, empty, blanks) has the margin of
the empty string.  Labels that are null, and labels of ids that are not there,
are not learnt from; an id is learnt from once, with its first text by hash,
however often it and its label are repeated.  Without labels of both kinds
nothing is learnt and every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.llm.common import bucket_of, small_batches, table

ORDER = 3
DECAY = 0.7
TOXIC = 2000
CLEAN = 4000
#: Landmarks that toxic documents favour, and ordinary ones beside them.
FOUND, ORDINARY = 30, 10
#: Clean documents that tell which words are ordinary.
USUAL = 400
#: Lengths of the word beginnings that may be landmarks, beside whole words.
STEMS = (4, 5, 6, 8)
#: A longer piece is read in windows of so many characters, half of them in common.
WINDOW = 24
#: Put before each piece for the kernel: how a word begins tells more than what it has inside.
START = "\x02"
#: Pieces whose kernels a Python process keeps, and words handled together.
MOST_PIECES = 1_000_000
WORDS = 100_000
#: Pieces whose kernels are made together, so that the arrays stay in the processor's cache.
TOGETHER = 1024
#: Subsequences looked up together, for the same reason.
CELLS = 30_000

_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
#: A word that ends a sentence.
_END = regex.compile(r"[.!?]\p{P}*$")


def piece(word: str) -> str:
    """A word in lower case without the signs around it."""
    return word.lower() if word[0].isalnum() and word[-1].isalnum() else _EDGE.sub("", word.lower())


def _ends(word: str) -> bool:
    """Whether a sentence ends with the word."""
    return not word[-1].isalnum() and _END.search(word) is not None


def pieces(words: list[str]) -> list[str]:
    """The pieces of a run of words: each word, and letters written one by one as one."""
    out, run = [], []
    for p in map(piece, words):
        if len(p) == 1:
            run.append(p)
            continue
        if len(run) >= ORDER:
            out.append("".join(run))
        run = []
        if p:
            out.append(p)
    if len(run) >= ORDER:
        out.append("".join(run))
    return out


def _codes(strings: list[str], width: int) -> np.ndarray:
    """Strings as rows of code points, shorter ones with -1 behind."""
    if all(len(s) == width for s in strings):
        return np.frombuffer("".join(strings).encode("utf-32-le"), np.int32).reshape(len(strings), width).copy()
    out = np.full((len(strings), width), -1, np.int32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le"), np.int32)
    return out


class Triples:
    """Subsequences of ``ORDER`` (three) letters of strings (rows of codes, which may end in -2), and what each is worth in each string.

    The kernel of a string with these is the sum of its own subsequences' worths,
    as it is defined, whatever the number of letters in each of these.  They grow
    with the cube of the string's length, so strings are to be short ones.
    """

    def __init__(self, y: np.ndarray):
        self.letters = np.unique(y[y >= 0])
        self.size = len(self.letters) + 1  # the last one stands for all other letters
        found: defaultdict[tuple[int, int, int], np.ndarray] = defaultdict(lambda: np.zeros(len(y), np.float32))
        for row, string in enumerate(y):
            codes = np.searchsorted(self.letters, string[string >= 0]).tolist()
            for i, j, k in combinations(range(len(codes)), ORDER):
                found[codes[i], codes[j], codes[k]][row] += DECAY ** (k - i + 1)
        # The first is worth nothing: it stands for all that none has.
        self.worth = np.array([np.zeros(len(y)), *found.values()], np.float32)
        # Places in ``third`` of two letters that begin one (0: none do), and the number of one by its beginning and its last letter.
        pairs = {p: k for k, p in enumerate(dict.fromkeys(t[:2] for t in found), 1)}
        self.pair = np.zeros(self.size * self.size, np.int32)
        self.third = np.zeros((len(pairs) + 1) * self.size, np.int32)
        for (first, second), k in pairs.items():
            self.pair[first * self.size + second] = k * self.size
        for at, (first, second, last) in enumerate(found, 1):
            self.third[self.pair[first * self.size + second] + last] = at

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Kernels of strings of one length (rows of ``x``) with all of these; not normalised."""
        n, length = x.shape
        out = np.zeros((n, self.worth.shape[1]), np.float32)
        if length < ORDER or len(self.worth) == 1:
            return out
        codes = np.searchsorted(self.letters, x)
        codes[self.letters[np.minimum(codes, self.size - 2)] != x] = self.size - 1
        first, second, pair, last, weights = _places(length)
        able = np.flatnonzero((codes < self.size - 1).sum(1) >= ORDER)
        step = max(1, CELLS // len(pair))
        for begin in range(0, len(able), step):
            rows = able[begin : begin + step]
            c = codes[rows]
            at = self.third[self.pair[c[:, first] * self.size + c[:, second]][:, pair] + c[:, last]]
            # Those found, at the front of each row.
            owner, place = np.nonzero(at)
            counts = np.bincount(owner, minlength=len(rows))
            front = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            found, weight = np.zeros((len(rows), counts.max()), np.int32), np.zeros((len(rows), 1, counts.max()), np.float32)
            found[owner, front], weight[owner, 0, front] = at[owner, place], weights[place]
            out[rows] = (weight @ self.worth[found])[:, 0]
        return out


@lru_cache(maxsize=64)
def _places(length: int) -> tuple[np.ndarray, ...]:
    """Places of the first two letters of subsequences, then which of these a whole one begins with, its last place, and its weight."""
    two = list(combinations(range(length), 2))
    at = {p: i for i, p in enumerate(two)}
    three = list(combinations(range(length), ORDER))
    weights = np.array([DECAY ** (k - i + 1) for i, _, k in three], np.float32)
    return np.array([i for i, _ in two]), np.array([j for _, j in two]), np.array([at[i, j] for i, j, _ in three]), np.array([k for _, _, k in three]), weights


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Kernels of strings of one length (rows of ``x``) with those of ``y``, whose rows may end in -2; not normalised."""
    return Triples(y).kernel(x)


@dataclass
class Rate:
    """The second machine, and how often a word has its pieces in toxic and in clean documents."""

    weights: np.ndarray
    bias: float
    toxic: float
    clean: float
    slope: float = 1.0
    offset: float = 0.0

    def ratio(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of so many different pieces in so many words."""
        return hits * math.log(self.toxic / self.clean) - words * (self.toxic - self.clean)


@dataclass
class Model:
    """Landmarks and what a piece's kernels with them are worth."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    rate: Rate | None = None

    def __post_init__(self):
        marked = [START + x for x in self.landmarks]
        width = max((len(x) for x in marked), default=1)
        y = _codes(marked, width)
        self.triples = Triples(y)
        self.own = np.array([_self(x) for x in marked], np.float32)
        #: Places of known pieces in ``kernels``, and those that the second machine takes.
        self.known: dict[str, int] = {}
        self.kernels = np.zeros((0, len(marked)), np.float32)
        self.hits: set[str] = set()

    def features(self, strings: list[str]) -> np.ndarray:
        """Normalised kernels of strings, those with ``START`` before them that begin a word, with the landmarks."""
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        by_length = defaultdict(list)
        for i, s in enumerate(strings):
            if len(s) > ORDER:
                by_length[len(s)].append(i)
        for length, at in by_length.items():
            for begin in range(0, len(at), TOGETHER):
                part = at[begin : begin + TOGETHER]
                x = _codes([strings[i] for i in part], length)
                norm = np.sqrt(_selves(x)[:, None] * self.own[None, :])
                out[part] = self.triples.kernel(x) / np.maximum(norm, 1e-12)
        return out

    def kernels_of(self, found: list[str]) -> np.ndarray:
        """A row for each piece: its kernels with the landmarks, of a long one the largest of its windows."""
        new = list(dict.fromkeys(p for p in found if p not in self.known))
        if len(self.known) + len(new) > MOST_PIECES:
            self.known = {}
            self.hits.clear()
            new = list(dict.fromkeys(found))
        windows, owner = [], []
        for i, p in enumerate(new):
            cut = [p[k : k + WINDOW] for k in range(0, max(1, len(p) - WINDOW // 2), WINDOW // 2)] if len(p) > WINDOW else [p]
            windows += [START + cut[0], *cut[1:]]
            owner += [i] * len(cut)
        if new:
            raw = self.features(windows)
            best = np.maximum.reduceat(raw, np.searchsorted(owner, np.arange(len(new))))
            if self.rate:
                self.hits.update(new[owner[i]] for i in np.flatnonzero(raw @ self.rate.weights + self.rate.bias > 0))
            begin, end = len(self.known), len(self.known) + len(new)
            if end > len(self.kernels):
                room = np.zeros((max(end, 2 * len(self.kernels)), self.kernels.shape[1]), np.float32)
                room[:begin] = self.kernels[:begin]
                self.kernels = room
            self.kernels[begin:end] = best
            self.known.update(zip(new, range(begin, end)))
        return self.kernels[[self.known[p] for p in found]]

    def strongest(self, kernels: np.ndarray, codes: np.ndarray, last: np.ndarray) -> float | np.ndarray:
        """Margins of sentences: words are rows of ``kernels`` by number, and ``last`` says where a sentence ends."""
        return _largest(kernels, codes, np.cumsum(last) - last) @ self.weights + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts, in 0 to 1."""
        if not self.landmarks:
            return np.zeros(len(texts))
        lists = [(t or "").split() for t in texts]
        lengths = np.array([len(x) for x in lists], np.int64)
        best = np.full(len(texts), self.bias)
        hits, words = np.zeros(len(texts)), np.zeros(len(texts))
        if lengths.sum():
            codes, kinds = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
            plain = [piece(w) for w in kinds]
            none = np.array([len(p) < 2 for p in plain])
            single = np.array([len(p) == 1 for p in plain])
            kernels = self.kernels_of(plain)
            kernels[none] = 0
            begin = np.cumsum(lengths) - lengths
            full = lengths > 0
            last = np.array([_ends(w) for w in kinds])[codes]
            last[(begin + lengths - 1)[full]] = True
            margin = self.strongest(kernels, codes, last)
            # The first sentence of each text that has any.
            sentence = np.cumsum(last) - last
            best[full] = np.maximum.reduceat(margin, sentence[begin[full]])
            # Texts with ORDER single letters in a row, also inside signs.
            alone = single[codes]
            run = alone.copy()
            for k in range(1, ORDER):
                run[: len(run) - k] &= alone[k:]
                run[max(0, len(run) - k) :] = False
            owner = np.repeat(np.arange(len(texts)), lengths)
            words[full] = np.add.reduceat(~none[codes], begin[full], dtype=float)
            ids = {p: k for k, p in enumerate(self.hits)}
            hit = np.array([ids.get(p, -1) if len(p) > 1 else -1 for p in plain])[codes]
            pairs = {(i, k) for i, k in zip(owner[hit >= 0].tolist(), hit[hit >= 0].tolist())}
            np.add.at(hits, [i for i, _ in pairs], 1)
            for i in np.unique(owner[run]):
                found = _sentences(lists[i])
                every = [p for x in found for p in x]
                if every:
                    ends = np.zeros(len(every), bool)
                    ends[np.cumsum([len(x) for x in found]) - 1] = True
                    best[i] = max(best[i], self.strongest(self.kernels_of(every), np.arange(len(every)), ends).max())
                hits[i], words[i] = len(self.hits.intersection(every)), len(every)
        score = _logistic(self.slope * best + self.offset)
        if self.rate:
            score = np.maximum(score, _logistic(self.rate.slope * self.rate.ratio(hits, words) + self.rate.offset))
        return score


def _largest(kernels: np.ndarray, codes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """For each sentence the largest of its words' kernels; ``WORDS`` words at a time, so that no long text is held as kernels."""
    out = np.zeros((int(sentence[-1]) + 1, kernels.shape[1]), np.float32)
    for begin in range(0, len(codes), WORDS):
        own = sentence[begin : begin + WORDS]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        at = own[first]
        out[at] = np.maximum(out[at], np.maximum.reduceat(kernels[codes[begin : begin + WORDS]], first))
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _selves(x: np.ndarray) -> np.ndarray:
    """Each row's kernel with itself."""
    s, letters = x.shape[1], np.ascontiguousarray(x.T)
    lam, lam2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    total, none = np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)
    # As both strings are one, only the sums with the second prefix no longer than the first are made.
    before = [[none] for _ in range(ORDER - 1)]
    for j in range(s):
        now = [[none] for _ in range(ORDER - 1)]
        for k in range(j + 1):
            match = (letters[j] == letters[k]) * lam2
            for i in range(ORDER):
                ends = match if not i else match * before[i - 1][k]
                if i == ORDER - 1:
                    total += ends if k == j else 2 * ends
                else:
                    now[i].append(ends + lam * ((before[i][k + 1] if k < j else now[i][k]) + now[i][k] - lam * before[i][k]))
        before = now
    return total


def _self(string: str) -> float:
    return float(_selves(_codes([string], len(string)))[0])


def _sentences(words: list[str]) -> list[list[str]]:
    """Sentences of a text's words, as their pieces; those without any are left out."""
    out, begin = [], 0
    for i, w in enumerate(words):
        if i + 1 == len(words) or _ends(w):
            out.append(pieces(words[begin : i + 1]))
            begin = i + 1
    return [x for x in out if x]


def _distinct(texts: list[str]) -> list[list[list[str]]]:
    """Sentences of texts, less those texts of which half the sentences or more came before: copies."""
    seen, out, same = set(), [], {}
    for text in texts:
        # Equal pieces are one object.
        sentences = [[same.setdefault(p, p) for p in s] for s in _sentences(text.split())]
        own = [hash(tuple(s)) for s in sentences]
        if own and 2 * sum(s in seen for s in own) < len(own):
            out.append(sentences)
        seen.update(own)
    return out


def _landmarks(toxic: list[list[list[str]]], clean: list[list[list[str]]]) -> tuple[list[str], list[str]]:
    """Words and word beginnings that toxic documents favour by their share of the words, and frequent ordinary words.

    They are chosen one after the other; a document that has one counts half
    for the next, so that one family of words does not take all places.
    """

    def forms(sentences: list[list[str]], wanted: set[str] | None = None) -> Counter[str]:
        out: Counter[str] = Counter()
        for p, times in Counter(p for s in sentences for p in s if len(p) >= ORDER).items():
            for k in {*STEMS, len(p)}:
                if k <= min(len(p), WINDOW) and (wanted is None or p[:k] in wanted):
                    out[p[:k]] += times
        return out

    # Only forms of three toxic documents are counted in clean ones, and only some clean ones tell which are ordinary.
    shared = Counter(p for d in toxic for p in forms(d))
    wanted = {p for p, k in shared.items() if k >= 3}
    a, b, shown = [forms(d, wanted) for d in toxic], Counter(), Counter()
    for i, d in enumerate(clean):
        b.update(forms(d, wanted))
        if i < USUAL:
            shown.update(forms(d).keys())
    n = len(a) or 1
    read, read_clean = (sum(len(s) for d in docs for s in d) + 1 for docs in (toxic, clean))
    where: dict[str, list[int]] = defaultdict(list)
    times: Counter[str] = Counter()
    for i, own in enumerate(a):
        times.update(own)
        for p in own:
            where[p].append(i)
    # At least three documents, and a share of the words well over that among clean ones.
    rise = {p: times[p] / read * read_clean / (b[p] + 1) for p, at in where.items() if len(at) >= 3}
    able = {p: np.array(where[p]) for p, x in rise.items() if x > 8}
    weight, found = np.ones(n), []
    while able and len(found) < FOUND:
        worth = {p: weight[at].sum() * math.log(rise[p]) for p, at in able.items()}
        best = min(worth, key=lambda p: (-worth[p], -len(p), p))
        if weight[able[best]].sum() < 1.5:
            break
        found.append(best)
        weight[able.pop(best)] *= 0.5
    ordinary = [p for p, _ in sorted(shown.items(), key=lambda x: (-x[1], x[0])) if p not in found and len(p) >= 4]
    return found, ordinary[:ORDINARY]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine, the last one for the bias, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    q, alpha, w = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            step = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / q[i], 0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _garbled(p: str) -> list[str]:
    """The piece with a sign put into it, at each place, and between all letters."""
    return [p[:k] + sign + p[k:] for k in range(1, len(p)) for sign in "-.*_"] + [s.join(p) for s in "-.* "]


def _bags(kernels: np.ndarray, at: dict[str, int], docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Kernels of all sentences of documents, and the document of each."""
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    lengths = np.array([len(s) for d in docs for s in d], np.int64)
    codes = np.fromiter((at[p] for d in docs for s in d for p in s), np.int32, int(lengths.sum()))
    return _largest(kernels, codes, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)), owner


def _first_machine(marks: list[str], found: list[str], white: np.ndarray, kernels: np.ndarray, garbled: np.ndarray, at: dict[str, int], bags: list, rest: list) -> Model:
    """The machine over sentences, calibrated on whole documents."""
    toxic, of = _bags(kernels, at, bags)
    clean, of_clean = _bags(kernels, at, rest)
    # At first the sentences nearest to a landmark found, then what the machine holds to be positive; one of each document at least.
    strength, weights, bias = toxic[:, : len(found)].max(1), np.zeros(len(marks)), -1.0
    hardest = clean[:, : len(found)].max(1)
    for turn in range(3):
        top = np.full(len(bags), -np.inf)
        np.maximum.at(top, of, strength)
        best = strength >= top[of]
        witness = toxic[best & (strength > -1) | (strength > 0) if turn else best]
        hard = clean[np.argsort(-hardest, kind="stable")[:3000]]
        # The empty sentence is clean, for certain.
        negative = np.vstack([np.zeros((1, len(marks)), np.float32), hard, clean[np.random.default_rng(0).permutation(len(clean))[:1500]]])
        x = np.vstack([witness, garbled, negative]) @ white
        y = np.concatenate([np.ones(len(witness) + len(garbled)), -np.ones(len(negative))])
        cost = np.where(y > 0, 1.0, 5.0 * max(1.0, (y > 0).sum() / len(negative)))
        cost[len(y) - len(negative)] = 1000.0
        w = _machine(x, y, cost)
        weights, bias = (white @ w[:-1]).astype(np.float32), float(w[-1])
        strength, hardest = toxic @ weights + bias, clean @ weights + bias
    model = Model(marks, weights, bias)
    margin = np.full(len(bags) + len(rest), -np.inf)
    np.maximum.at(margin, of, strength)
    np.maximum.at(margin, len(bags) + of_clean, hardest)
    model.slope, model.offset = _calibrated(margin, np.arange(len(margin)) < len(bags))
    return model


def learn(toxic: list[str], clean: list[str]) -> Model:
    """A model of labelled texts."""
    bags, rest = _distinct(toxic), _distinct(clean)
    del toxic, clean
    found, ordinary = _landmarks(bags, rest)
    marks = found + ordinary
    if not found or not rest:
        return Model([], np.zeros(0), 0.0)
    bare = Model(marks, np.zeros(len(marks)), 0.0)
    gram = bare.features([START + p for p in marks]).astype(float)
    # features: landmark x landmark kernels; whitening is their inverse root.
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    white = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    words = np.array([sum(map(len, d)) for d in (*bags, *rest)])
    every = sorted({p for d in (*bags, *rest) for s in d for p in s})
    at = {p: i for i, p in enumerate(every)}
    kernels = np.empty((len(every), len(marks)), np.float32)
    for k in range(0, len(every), 20_000):
        kernels[k : k + 20_000] = bare.features([START + p[:WINDOW] for p in every[k : k + 20_000]])
    # Garbled forms of the whole words among the landmarks are positive too.
    garbled = bare.features([START + g for p in found if p in at for g in _garbled(p)])
    model = _first_machine(marks, found, white, kernels, garbled, at, bags, rest)
    label = np.arange(len(bags) + len(rest)) < len(bags)
    bags, rest = ([sorted({p for s in d for p in s}) for d in docs] for docs in (bags, rest))
    clean_at = np.array(sorted({at[p] for r in rest for p in r}))
    # The second machine: what begins like a landmark found against all else, whichever documents have it.
    favoured = np.array([p.startswith(tuple(found)) for p in every])
    positive = np.array(sorted({at[p] for d in bags for p in d if favoured[at[p]]}))
    others = clean_at[~favoured[clean_at]]
    nearest = kernels[:, : len(found)].max(1)
    hard = others[np.argsort(-nearest[others], kind="stable")[:2000]]
    negative = np.unique(np.concatenate([hard, np.random.default_rng(1).permutation(others)[:1000]]))
    if not len(negative):
        return model
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.where(y > 0, 5.0 * max(1.0, len(negative) / len(positive)), 5.0)
    w = _machine(kernels[np.concatenate([positive, negative])] @ white, y, cost)
    weights, bias = (white @ w[:-1]).astype(np.float32), float(w[-1])
    hit = kernels @ weights + bias > 0
    hits = np.array([sum(hit[at[p]] for p in d) for d in (*bags, *rest)])
    rates = [float((hits[x].sum() + 0.5) / (words[x].sum() + 1)) for x in (label, ~label)]
    if rates[0] > rates[1]:
        rate = Rate(weights, bias, *rates)
        rate.slope, rate.offset = _calibrated(rate.ratio(hits, words), label)
        model.rate = rate
    return model


def _calibrated(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, fitted to targets short of 0 and 1."""
    target = np.where(label, (label.sum() + 1) / (label.sum() + 2), 1 / ((~label).sum() + 2))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((np.logaddexp(0, z) - target * z).sum()) + 0.05 * a * a

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g, h = target - p, p * (1 - p) + 1e-6
        ga, gb = (g * margin).sum() - 0.1 * a, g.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 0.1, (h * margin).sum(), h.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        while step > 1e-4 and loss(a + step * da, b + step * db) > loss(a, b):
            step /= 2
        a, b = a + step * da, b + step * db
        if abs(step * da) + abs(step * db) < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], list[str]]:
    """Texts of ``TOXIC`` ids labelled 1 and ``CLEAN`` labelled 0, first by a hash of their id; one text for each id."""
    out = []
    for value, most in ((1, TOXIC), (0, CLEAN)):
        ids = labels.filter(F.col(label) == value).select(F.col(doc_id).alias("id")).filter("id IS NOT NULL").distinct()
        chosen = ids.orderBy(F.xxhash64("id"), "id").limit(most)  # so few rows can be broadcast
        rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.length("text") > 0).join(F.broadcast(chosen), "id")
        rows = rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        out.append([r["text"] for r in rows.orderBy(F.xxhash64("id"), "id").collect()])
    return out[0], out[1]


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> score."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.landmarks, model.weights, model.bias, model.slope, model.offset, model.rate))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = Model(*sent.value)
        for batch in batches:
            texts = batch.tolist()
            parts = [built.scores(texts[k : k + 1000]) for k in range(0, len(texts), 1000)]
            yield pd.Series(np.concatenate(parts) if parts else [], index=batch.index, dtype=float)

    return score


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose label is never learnt from."""
    return F.coalesce(bucket_of(doc_id, 5) == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's toxicity, learnt from labels outside the held-out rows."""
    docs = table(spark, sf_dir, "documents")
    model = learn(*sample(docs, table(spark, sf_dir, "labels").filter(~held_out())))
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(spark, model)("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
