"""Byte-level BPE encoding and decoding with a tokenization automaton.

The automaton starts as one state with a loop for each byte.  Each merge
(u, v), in rank order, adds a gadget: states that u leads to lose their arc v,
and where a state had the path u, v it gets the arc uv to where the path led.
What a token leads to depends on the token alone, so a state is the token read
last, and the whole construction is held by each token's two halves and rank:
``leads`` unrolls the gadgets for one (state, arc) when it is first needed and
the transition table keeps the answer.  A word is accepted along one path only,
and the labels of its arcs are the word's tokens.

Texts are cut at special tokens, split into words by the tokenizer's pattern,
and each word is walked by table-driven transitions; words seen before are
looked up.  Decoding joins the arcs' labels.

Defined results: a null or empty text has no tokens and decodes to the empty
text.  Rows are handled alone; texts are read whole, of any length.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.llm.common import table

#: The split into words that byte-level pre-tokenizers do (a published, fixed pattern).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries after which a word cache or a transition table starts anew.
MOST_WORDS = 500_000
MOST_ARCS = 2_000_000
#: Characters of texts whose words are learnt together.
BLOCK_CHARS = 4_000_000


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def split_pattern() -> str:
    """``WORDS`` by the Unicode version of the tokenizers library, to which newer letters and numbers are unassigned.

    Only characters that this Python's older tables do not know are asked for.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    newer = [c for like, kind in (("a", "L"), ("1", "N")) for c in "".join(regex.findall(rf"\p{{{kind}}}+", unknown)) if len(split(like + c)) > 1]
    spans: list[list[int]] = []
    for c in sorted(set(map(ord, newer))):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    if not spans:
        return WORDS
    some = "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in spans)
    return WORDS.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{some}]]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{some}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{some}]]+")


def latin_pattern(words: regex.Pattern) -> re.Pattern:
    """What ``words`` does to characters below 256, by classes that it is asked for."""
    kinds = {"L": "", "N": "", "S": ""}
    for c in map(chr, range(256)):
        like = next((k for k, x in (("L", "a"), ("N", "1"), ("S", " \n ")) if len(words.findall(x + c)) == 1), None)
        if like:
            kinds[like] += re.escape(c)
    letters, numbers, blanks = kinds.values()
    return re.compile(f" ?[{letters}]++|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]++| ?[^{blanks}{letters}{numbers}]++|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


class Automaton:
    """The deterministic automaton of one list of merges."""

    def __init__(self, spec: str, pattern: str | None = None):
        """``spec``: the text of a byte-level BPE file of the tokenizers library."""
        read = json.loads(spec)
        model = read["model"]
        if model["type"] != "BPE" or read.get("normalizer") or (read.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or read["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE file")
        byte = byte_of_char()
        as_bytes = lambda s: bytes(byte[c] for c in s)
        vocab = model["vocab"]
        self.labels: dict[int, bytes] = {i: as_bytes(s) for s, i in vocab.items()}
        self.born = dict.fromkeys(self.labels, -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            t, u, v = vocab[u + v], vocab[u], vocab[v]
            if t in self.left:
                raise ValueError("two merges make one token")
            self.rank[u << 32 | v] = n
            self.left[t], self.right[t], self.born[t] = u, v, n
        self.special: dict[str, int] = {}
        for x in read.get("added_tokens", ()):
            if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]:
                raise ValueError("added tokens with stripping or normalizing are not handled")
            self.special[x["content"]] = x["id"]
            self.labels[x["id"]] = x["content"].encode()
        named = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.at_special = regex.compile(f"({named})") if named else None
        self.words = regex.compile(pattern or split_pattern(), regex.V1)
        self.latin = latin_pattern(self.words)
        # A gadget adds its arc only where the path of its halves is; without one its token is never read.
        made = {t: True for t in self.born if t not in self.left}
        for t, u in self.left.items():
            v = self.right[t]
            made[t] = made.get(u, False) and made.get(v, False) and self._unrolled(u, v, self.born[t])
        # Labels read backwards, a node for each suffix; the key -1 has the token.
        self.ending: dict = {}
        for t, label in self.labels.items():
            if made.get(t) and (len(label) == 1 or t in self.left):
                node = self.ending
                for b in reversed(label):
                    node = node.setdefault(b, {})
                node[-1] = t
        self.arcs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def leads(self, state: int, arc: int) -> bool:
        """Whether ``arc`` leaves ``state`` after all gadgets."""
        key = state << 32 | arc
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._unrolled(state, arc)
        return found

    def _unrolled(self, x: int, y: int, end: int | None = None) -> bool:
        """``leads`` with the gadgets before ``end`` in force, or all."""
        born, rank = self.born, self.rank
        if end is None:
            end = len(rank) + 1
        while True:
            n = rank.get(x << 32 | y)
            if n is not None and n < end:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if bx >= by:
                # x's state is a copy of its right half's state just before x's gadget.
                end = min(end, bx)
                x = self.right[x]
            else:
                # The arc y came with its gadget, where the arc of its left half was left.
                end = min(end, by + 1)
                y = self.left[y]

    def split(self, text: str) -> list[str]:
        """The words of a text; a narrower pattern is enough, and quicker, for Latin-1 texts."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return self.latin.findall(text)

    def paths(self, words: list[bytes]) -> Iterator[list[int]]:
        """The labels of each word's path; words that follow one another share the walk of their common beginning."""
        root, arcs, leads = self.ending, self.arcs, self.leads
        last, begin, before = [-1], [0], b""
        for word in words:
            n, k = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                k += 1
            del last[k + 1 :], begin[k + 1 :]
            before = word
            for i in range(k + 1, n + 1):
                node, j = root, i
                ending = []
                while j:
                    j -= 1
                    node = node.get(word[j])
                    if node is None:
                        break
                    t = node.get(-1)
                    if t is not None:
                        ending.append((j, t))
                # One of them fits; most often it is the longest.
                for j, t in reversed(ending):
                    if j:
                        ok = arcs.get(last[j] << 32 | t)
                        if ok is None:
                            ok = leads(last[j], t)
                        if not ok:
                            continue
                    last.append(t)
                    begin.append(j)
                    break
                else:
                    raise ValueError("a byte has no token")
            out = []
            while n:
                out.append(last[n])
                n = begin[n]
            yield out[::-1]

    def learn(self, words: set[str]) -> None:
        """Hold the ids of all these words."""
        if len(self.known) + len(words) > MOST_WORDS:
            self.known.clear()
        new = sorted(w.encode("utf-8") for w in words if w not in self.known)
        for w, path in zip(new, self.paths(new)):
            self.known[w.decode("utf-8")] = array("I", path).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text, each id as four little-endian bytes."""
        out: list[bytes] = []
        block: list[list] = []
        size = 0
        for text in texts:
            parts = self.at_special.split(text or "") if self.at_special else [text or ""]
            block.append([self.special[x].to_bytes(4, "little") if i % 2 else self.split(x) for i, x in enumerate(parts)])
            size += len(text or "")
            if size >= BLOCK_CHARS:
                out += self._joined(block)
                block, size = [], 0
        return out + self._joined(block)

    def _joined(self, block: list[list]) -> list[bytes]:
        self.learn(set().union(*(part for parts in block for part in parts[::2])))
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, x)) if isinstance(x, list) else x for x in parts) for parts in block]

    def encode(self, text: str | None) -> bytes:
        """``encode_all`` of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text that the ids' labels spell; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", "replace")


_BUILT: dict[int, Automaton] = {}


def automaton(spec: str, pattern: str | None = None) -> Automaton:
    """The automaton of a file's text, one for each Python process."""
    key = zlib.crc32(spec.encode())
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(spec, pattern)
    return _BUILT[key]


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer file's text, read on the driver; it is a few MB of fixed size."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder(spark: SparkSession, path: str | None = None):
    """A column function: text -> ids as binary."""
    spec = spark.sparkContext.broadcast((tokenizer_text(path), split_pattern()))

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = automaton(*spec.value)
        for batch in batches:
            yield pd.Series(built.encode_all(batch.tolist()), index=batch.index, dtype=object)

    return encode


def decoder(spark: SparkSession, path: str | None = None):
    """A column function: ids as binary -> text."""
    spec = spark.sparkContext.broadcast((tokenizer_text(path), split_pattern()))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = automaton(*spec.value)
        for batch in batches:
            yield pd.Series([built.decode(x or b"") for x in batch], index=batch.index, dtype=object)

    return decode


def recoder(spark: SparkSession, path: str | None = None):
    """A column function: text -> struct of ``ids`` and of the text ``decoded`` from them, in one pass through Python."""
    spec = spark.sparkContext.broadcast((tokenizer_text(path), split_pattern()))

    @F.pandas_udf("ids binary, decoded string")
    def recode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        built = automaton(*spec.value)
        for batch in batches:
            ids = built.encode_all(batch.tolist())
            yield pd.DataFrame({"ids": ids, "decoded": [built.decode(x) for x in ids]})

    return recode


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document encoded and decoded; digests of both."""
    docs = table(spark, sf_dir, "documents")
    back = docs.select("doc_id", recoder(spark)("text").alias("x"))
    return back.select(
        "doc_id",
        (F.octet_length("x.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("x.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("x.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
