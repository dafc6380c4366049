"""Language-model scoring with Elias-Fano n-gram tries, trained and queried shard by shard.

The model is a bigram with Witten-Bell smoothing over the additive unigram of
the base score:

  p(w | v) = (c(v, w) + t(v) p1(w)) / (c(v) + t(v))

with t(v) the distinct successors of v, and the text's begin and end as a
context and as a token.  All counts are of all training texts.  The tries hold
the first part, c(v, w) / (c(v) + t(v)), quantised; the second is what it
leaves, times the unigram.

1. Blocks of texts are tokenized once: each holds its words as 64-bit hashes
   and its texts as numbers into them.
2. A block sends each shard the words and the distinct pairs that fall to it,
   with their training counts.  Contexts that make up over ``HOT`` of all tokens
   (a thousand at most) are split over ``PARTS`` shards by their successors.
3. A shard sums the counts, builds its trie, asks it for every pair that a
   block sent, and returns the answers in the block's order; parts of split
   contexts go back to all blocks as sums.
4. A block scores its texts with the answers.

What moves is in proportion to the input; no model has to fit on one machine.
There is a shard for each ``SHARD_TOKENS`` tokens of the input, and shards and
blocks are dealt to as many partitions, so a task does not grow with the input.
Each block sends each shard one message: their number grows with the square of
the input, and where they would hold a few pairs each, blocks and shards are to
be made larger.

Defined results: a null or empty text is its end alone.  Without training
texts every word is unknown and N is 0; base and score are then those of a
uniform choice of one (0).  Rows are told apart by their place in the block,
so null and repeated ids, of any type that text can hold, are scored as they
come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.llm.common import bucket_of, small_batches, table, written
from crawlgate.llm.elias_fano import Trie, probability
from crawlgate.llm.shingles import _mixed, word_hashes, words_of

#: The end of a text as a token, and its begin as a context.
END, BEGIN = np.uint64(0), np.uint64(1)
ALPHA = 0.1
HOT = 0.001
PARTS = 64
BLOCK_TOKENS = 1_800_000
SHARD_TOKENS = 1_500_000
#: Texts hashed together.
ROWS = 500


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; the first bytes of all numbers come first, then the second, and so on."""
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *planes]))


def _unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def _steps(rising: np.ndarray) -> np.ndarray:
    """What each number adds to the one before; ``np.cumsum`` undoes it."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def _blocks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``train`` -> blocks: their ids, texts as numbers, words, and frequent contexts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        hashed: list[np.ndarray] = []
        sizes: list[int] = []
        train: list[bool] = []
        tokens = 0

        def done() -> pa.RecordBatch:
            lengths = np.array(sizes, np.int64) + 1
            learn = np.array(train, bool)
            flat = np.concatenate(hashed)
            flat = np.where(flat <= BEGIN, flat + np.uint64(2), flat)  # 0 and 1 are taken
            every = np.full(lengths.sum(), END, np.uint64)
            inner = np.ones(len(every), bool)
            inner[np.cumsum(lengths) - 1] = False
            every[inner] = flat
            words, codes, often = np.unique(every, return_inverse=True, return_counts=True)
            # Frequent words get small numbers, which compress well.
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            words, codes = words[order], place[codes]
            counts = np.bincount(codes[np.repeat(learn, lengths)], minlength=len(words))
            n = int(counts.sum())
            frequent = np.flatnonzero(counts * 2 > HOT * max(n, 1))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | seq], pa.int64()),
                    pa.array([ids], pa.list_(pa.string())),
                    pa.array([_packed(lengths, learn, codes, words, counts)], pa.binary()),
                    pa.array([words[frequent].view(np.int64)], pa.list_(pa.int64())),
                    pa.array([counts[frequent]], pa.list_(pa.int64())),
                    pa.array([n], pa.int64()),
                    pa.array([len(codes)], pa.int64()),
                ],
                names=["block", "ids", "body", "frequent", "seen", "n", "tokens"],
            )

        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part_ids, texts, learns = (c.to_pylist() for c in batch.slice(begin, ROWS).columns)
                lists = [words_of(t) for t in texts]
                flat = [w for x in lists for w in x]
                ids += part_ids
                hashed.append(word_hashes(flat) if flat else np.zeros(0, np.uint64))
                sizes += map(len, lists)
                train += map(bool, learns)
                tokens += len(flat) + len(lists)
                if tokens >= BLOCK_TOKENS:
                    yield done()
                    ids, hashed, sizes, train, tokens, seq = [], [], [], [], 0, seq + 1
        if ids:
            yield done()

    return docs.mapInArrow(made, "block long, ids array<string>, body binary, frequent array<long>, seen array<long>, n long, tokens long")


def _pairs(lengths: np.ndarray, codes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context and word as one number, and the contexts' hashes (the words', then BEGIN)."""
    context = np.empty(len(codes), np.int64)
    context[1:] = codes[:-1]
    context[np.cumsum(lengths) - lengths] = len(words)
    return context * len(words) + codes, np.append(words, BEGIN)


def _shard_of(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    part = np.where(np.isin(context, hot), _mixed(word) % np.uint64(PARTS), np.uint64(0))
    return (_mixed(context + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)


def _split(keys: np.ndarray, words: np.ndarray, contexts: np.ndarray, hot: np.ndarray, shards: int):
    """The block's distinct pairs in the order of their shards: numbers into contexts and words, and where each shard's begin."""
    owner, word = np.divmod(keys, max(1, len(words)))
    shard = _shard_of(contexts[owner], words[word], hot, shards)
    order = np.lexsort((words[word], contexts[owner], shard))
    return order, owner[order], word[order], np.searchsorted(shard[order], np.arange(shards + 1))


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether each element differs from the one before; the first does."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _sent(hot: np.ndarray, shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lengths, learn, codes, words, counts = _unpacked(body, np.int64, bool, np.int32, np.uint64, np.int64)
                pairs, contexts = _pairs(lengths, codes, words)
                keys, at = np.unique(pairs, return_inverse=True)
                seen = np.bincount(at, weights=np.repeat(learn, lengths), minlength=len(keys)).astype(np.int32)
                order, owner, word, bounds = _split(keys, words, contexts, hot, shards)
                seen = seen[order]
                home = (_mixed(words) % np.uint64(shards)).astype(np.int64)
                by_home = np.argsort(home, kind="stable")
                homes = np.searchsorted(home[by_home], np.arange(shards + 1))
                by_hash = np.argsort(words)
                rank = np.empty(len(words), np.int32)
                rank[by_hash] = np.arange(len(words), dtype=np.int32)
                for s in range(shards):
                    i, j = bounds[s], bounds[s + 1]
                    own = by_home[homes[s] : homes[s + 1]]
                    begins = np.flatnonzero(_changes(owner[i:j]))
                    runs = np.diff(begins, append=j - i).astype(np.int32)
                    ws, w = np.unique(rank[word[i:j]], return_inverse=True)
                    data = _packed(words[own], counts[own], _steps(contexts[owner[i:j][begins]]), runs, _steps(words[by_hash[ws]]), w.astype(np.int32), seen[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "data"])

    return send


_KINDS = (np.uint64, np.int64, np.uint64, np.int32, np.uint64, np.int32, np.int32)


def _received(data: bytes) -> list[np.ndarray]:
    words, counts, cs, runs, ws, w, seen = _unpacked(data, *_KINDS)
    return [words, counts, np.cumsum(cs), np.repeat(np.arange(len(runs)), runs), np.cumsum(ws), w, seen]


def shard_trie(parts: list[list[np.ndarray]]) -> bytes:
    """The trie of a shard's pairs, from what the blocks sent."""
    contexts = np.unique(np.concatenate([p[2] for p in parts]))
    words = np.unique(np.concatenate([p[4] for p in parts]))
    keys, seen = [], []
    for _, _, cs, c, ws, w, n in parts:
        key = np.searchsorted(contexts, cs)[c] * max(1, len(words)) + np.searchsorted(words, ws)[w]
        keys.append(key[n > 0])
        seen.append(n[n > 0])
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate(seen), minlength=len(key)).astype(np.int64)
    owner, word = np.divmod(key, max(1, len(words)))
    # Contexts and words that no training pair has are left out.
    cs, c = np.unique(owner, return_inverse=True)
    ws, w = np.unique(word, return_inverse=True)
    return Trie.build(contexts[cs], words[ws], c, w, count)


def _answered(hot: np.ndarray):
    def answer(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_received(x) for x in group["data"]]
        trie = Trie(shard_trie(parts))
        vocabulary = np.unique(np.concatenate([p[0] for p in parts]))
        total = np.zeros(len(vocabulary), np.int64)
        for p in parts:
            total[np.searchsorted(vocabulary, p[0])] += p[1]
        mine = hot
        _, c_hot, t_hot = trie.context(mine)
        sums = np.array([total.sum(), (total > 0).sum()], np.int64)
        out = []
        for words, _, cs, c, ws, w, _ in parts:
            place, c_all, t_all = trie.context(cs)
            codes = trie.code(place[c], trie.number(ws)[w])
            out.append(_packed(total[np.searchsorted(vocabulary, words)], codes, c_all, t_all, c_hot, t_hot, sums))
        return pd.DataFrame({"block": group["block"], "shard": group["shard"], "answer": out})

    return answer


def _scored(hot: np.ndarray, shards: int):
    def score(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(blocks):
            return pd.DataFrame(columns=columns)
        lengths, learn, codes, words, _ = _unpacked(blocks["body"][0], np.int64, bool, np.int32, np.uint64, np.int64)
        pairs, contexts = _pairs(lengths, codes, words)
        keys, at = np.unique(pairs, return_inverse=True)
        del pairs
        order, owner, word, bounds = _split(keys, words, contexts, hot, shards)
        home = (_mixed(words) % np.uint64(shards)).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        homes = np.searchsorted(home[by_home], np.arange(shards + 1))
        total, ratio, part = np.zeros(len(words), np.int64), np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        c_of, t_of = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        c_hot, t_hot, sums = np.zeros(len(hot), np.int64), np.zeros(len(hot), np.int64), np.zeros(2, np.int64)
        for s, data in zip(answers["shard"], answers["answer"]):
            n, code, c_all, t_all, c_more, t_more, more = _unpacked(data, np.int64, np.uint32, *(np.int64,) * 5)
            total[by_home[homes[s] : homes[s + 1]]] = n
            i, j = bounds[s], bounds[s + 1]
            change = _changes(owner[i:j])
            cs, c = owner[i:j][change], np.cumsum(change) - 1
            ratio[i:j], part[i:j] = probability(code), (c_all + t_all)[c]
            c_of[cs], t_of[cs] = c_all, t_all
            c_hot, t_hot, sums = c_hot + c_more, t_hot + t_more, sums + more
        at_hot = np.searchsorted(hot, contexts)
        is_hot = np.isin(contexts, hot)
        c_of[is_hot], t_of[is_hot] = c_hot[at_hot[is_hot]], t_hot[at_hot[is_hot]]
        n, v = sums.tolist()
        unigram = (total + ALPHA) / (n + ALPHA * (v + 1))
        # A distinct pair has one probability, wherever it stands.
        weight, rest = c_of[owner] + t_of[owner], t_of[owner] * unigram[word]
        log_p = np.empty(len(keys))
        log_p[order] = np.log10(np.where(weight > 0, (ratio * part + rest) / np.maximum(weight, 1), unigram[word]))
        begin = np.cumsum(lengths) - lengths
        return pd.DataFrame(
            {
                "doc_id": blocks["ids"][0],
                "train": learn,
                "n_tokens": lengths,
                "n_known": np.add.reduceat((total[codes] > 0).astype(np.int64), begin),
                "train_tokens": n,
                "base_score": np.add.reduceat(np.log10(unigram)[codes], begin),
                "score": np.add.reduceat(log_p[at], begin),
            },
            columns=columns,
        )

    return score


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that the model never learns from."""
    return F.coalesce(bucket_of(doc_id, 10) == 0, F.lit(False))


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row by a model of the rows where ``train`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"), train.alias("train"))
    blocks = written(_blocks(rows), "blocks")
    # Words over HOT of all tokens: fewer than 1 / HOT of them.
    n, tokens, n_blocks = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    shards, n_blocks = max(1, -(-tokens // SHARD_TOKENS)), max(1, n_blocks)
    often = blocks.select(F.explode(F.arrays_zip("frequent", "seen")).alias("x")).groupBy("x.frequent").agg(F.sum("x.seen").alias("n")).filter(F.col("n") > HOT * n)
    hot = np.sort(np.array([r["frequent"] for r in often.collect()], np.int64).view(np.uint64))
    hot = np.union1d(hot, np.array([BEGIN])).astype(np.uint64)
    sent = blocks.select("block", "body").mapInArrow(_sent(hot, shards), "shard int, block long, data binary")
    answers = sent.repartition(shards, "shard").groupBy("shard").applyInPandas(_answered(hot), "block long, shard int, answer binary").repartition(n_blocks, "block")
    out = "doc_id string, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = blocks.select("block", "ids", "body").repartition(n_blocks, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_scored(hot, shards), out)
    # Ids go along as text, which holds every number whole, null or not.
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.select(F.col(f"`{doc_id}`")).dtypes[0][1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document, scored by a model of those not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, ~held_out())
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
