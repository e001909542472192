"""Language-model scores by a weighted backoff automaton.

States are the n-gram histories seen in the training documents; a seen n-gram is
an arc with its smoothed log10 probability, and every state has a failure arc
to the history without its first word, with the weight its unseen words share:

    p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k)      (h seen in training)
    p(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))

A text is read once from left to right, carrying the state; where no arc fits,
failure weights are added until one does. Every order sums to one.

The model is never in one place. Documents are written once as blocks of a few
million tokens with a local vocabulary. Each block asks for the counts of its own
distinct n-grams: (key, count) slices go to hash ranges, which add them up over
all blocks and send each block's counts back in its own order. A block's task
then holds exactly the part of the automaton its texts can reach. A hash range
and a block are bounded by parameters, whatever the corpus; no word or document
can make them uneven, since a word is one key per block.

Cases: null text is empty text (only the end token); a null id counts as the
empty string in the fold and so is held out; repeated rows are each scored and
each counted; with no training documents all counts are 0; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import pick, ship_package, written
from ferrylake.llm.words import mix, space_words

BLOCK_TOKENS = 1_500_000
RANGE_KEYS = 3_000_000      # (block, n-gram) pairs that one hash range adds up
ORDER = 2
PRIOR = 4.0                 # k: weight of the shorter history
ADD = 0.1                   # fixed value of the base contract

END, START = 0, 1           # local ids in every block's vocabulary
_END_KEY, _START_KEY = (xxhash.xxh64_intdigest(x) for x in (b" end", b" start"))

_BLOCKS = ("block long, n_tokens long, doc_ids array<long>, held array<boolean>, "
           "ends array<int>, vocab binary, tokens binary")
_ASKED = "part long, block long, ord int, keys binary, counts binary"
_TOLD = "block long, ord int, part long, counts binary, total long, n_distinct long"
_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _expand(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self) + 2
        return k


def blocks(docs: DataFrame, id: str = "doc_id", text: str = "text", fold: int = 10,
           block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of about ``block_tokens`` tokens with a vocabulary of their own.
    Write the result before use: block numbers belong to this run."""
    ship_package(docs.sparkSession)
    d = pick(docs, doc_id=id, text=text)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                 (F.crc32(name.cast("binary")) % fold == 0).alias("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 24
        vocab, ids, held, parts, ends, n = _Vocabulary(), [], [], [], [], 0
        end = np.array([END], np.int32)

        def row() -> pd.DataFrame:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, vocab), np.uint64, len(vocab))
            keys = np.concatenate([np.array([_END_KEY, _START_KEY], np.uint64), keys])
            return pd.DataFrame({
                "block": [number], "n_tokens": [n], "doc_ids": [ids], "held": [held],
                "ends": [ends], "vocab": [keys.tobytes()],
                "tokens": [_squeeze(np.concatenate(parts))]})

        for b in batches:
            for doc, t, h in zip(b["doc_id"], b["text"], b["held"], strict=True):
                words = space_words(t, lower=True)
                parts.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
                parts.append(end)
                n += len(words) + 1
                ids.append(None if pd.isna(doc) else int(doc))
                held.append(bool(h))
                ends.append(n)
                if n >= block_tokens:
                    yield row()
                    number += 1
                    vocab, ids, held, parts, ends, n = _Vocabulary(), [], [], [], [], 0
        if ids:
            yield row()

    return d.mapInPandas(run, _BLOCKS)


class Grams:
    """The distinct n-grams of one block, order by order.

    ``at[n]`` has the n-gram number that ends at each token (-1: the text is
    shorter there), ``keys[n]`` the global key of each number, ``history[n]`` and
    ``shorter[n]`` the numbers, one order below, of its history and of itself
    without the first word.
    """

    def __init__(self, ends: np.ndarray, vocab: np.ndarray, tokens: np.ndarray, order: int):
        n = len(tokens)
        first = np.zeros(n, bool)
        first[np.concatenate([[0], ends[:-1]]).astype(np.int64)] = True
        self.at = {1: tokens.astype(np.int64)}
        self.keys = {1: vocab}
        self.history, self.shorter = {}, {}
        before = np.concatenate([[START], self.at[1][:-1]])
        before[first] = START
        for k in range(2, order + 1):
            ok = before >= 0
            code = before[ok] * len(vocab) + self.at[1][ok]
            distinct, where, number = np.unique(code, return_index=True, return_inverse=True)
            at = np.full(n, -1, np.int64)
            at[ok] = number
            places = np.flatnonzero(ok)[where]
            self.at[k] = at
            self.history[k] = distinct // len(vocab)
            self.shorter[k] = self.at[k - 1][places]
            with np.errstate(over="ignore"):
                self.keys[k] = mix(self.keys[k - 1][self.history[k]]
                                   * np.uint64(0x9E3779B97F4A7C15)
                                   + vocab[distinct % len(vocab)] + np.uint64(k))
            before = np.concatenate([[-1], at[:-1]])
            before[first] = -1

    def counts(self, k: int, train: np.ndarray) -> np.ndarray:
        ok = train & (self.at[k] >= 0)
        return np.bincount(self.at[k][ok], minlength=len(self.keys[k])).astype(np.uint32)


def _open(block, order: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    """Grams, ends and the per-token training flag of a block row."""
    ends = np.asarray(block.ends, np.int64)
    tokens = _expand(block.tokens, np.int32)
    train = np.repeat(~np.asarray(block.held, bool), np.diff(ends, prepend=0))
    return Grams(ends, np.frombuffer(block.vocab, np.uint64), tokens, order), ends, train


def _parts_bits(parts: int) -> int:
    return max(parts - 1, 0).bit_length()


def _part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)


def asked_counts(blk: DataFrame, order: int, bits: int) -> DataFrame:
    """Per block, order and hash range: its sorted keys and training counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.itertuples(index=False):
                g, _, train = _open(block, order)
                for k in range(1, order + 1):
                    sort = np.argsort(g.keys[k])
                    keys, counts = g.keys[k][sort], g.counts(k, train)[sort]
                    cut = np.flatnonzero(np.diff(_part_of(keys, bits))) + 1
                    rows = [(int(_part_of(x[:1], bits)[0]), int(block.block), k, x.tobytes(),
                             _squeeze(c))
                            for x, c in zip(np.split(keys, cut), np.split(counts, cut),
                                            strict=True) if len(x)]
                    yield pd.DataFrame(rows, columns=["part", "block", "ord", "keys", "counts"])

    return blk.mapInPandas(run, _ASKED)


def told_counts(asked: DataFrame) -> DataFrame:
    """Per hash range: the counts over all blocks, given back to each block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64) for x in group["keys"]]
        counts = np.concatenate([_expand(x, np.uint32) for x in group["counts"]])
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, weights=counts, minlength=len(distinct)).astype(np.int64)
        cut = np.cumsum([len(x) for x in keys])[:-1]
        out = group[["block", "ord", "part"]].copy()
        out["counts"] = [_squeeze(x) for x in np.split(total[number], cut)]
        out["total"], out["n_distinct"] = 0, 0
        out.iloc[0, 4], out.iloc[0, 5] = int(total.sum()), int((total > 0).sum())
        return out

    return asked.groupBy("ord", "part").applyInPandas(run, _TOLD)


class BackoffAutomaton:
    """The part of the automaton that one block's texts can reach.

    ``counts[k]`` are corpus counts by n-gram number of ``grams``. ``arc[k]`` is
    the log10 weight of each n-gram's arc where it was seen, ``failure[k]`` the
    weight of leaving its history, ``total[k]`` the weight of reading its last
    word from its history, over failures if need be.
    """

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], n: int, v: int,
                 prior: float = PRIOR):
        self.grams, self.order = grams, max(counts)
        self.arc, self.failure = {}, {}
        with np.errstate(divide="ignore"):
            self.total = {1: np.log10((counts[1] + ADD) / (n + ADD * (v + 1)))}
        self.arc[1] = self.total[1]
        context = counts[1].copy()
        context[START] = counts[1][END]        # as many starts as ends
        for k in range(2, self.order + 1):
            c, h = counts[k], context[grams.history[k]]
            lower = self.total[k - 1][grams.shorter[k]]
            self.failure[k] = np.where(h > 0, np.log10(prior / (h + prior)), 0.0)
            self.arc[k] = np.log10((c + prior * 10.0 ** lower) / (h + prior))
            self.total[k] = np.where(c > 0, self.arc[k], self.failure[k] + lower)
            context = c

    def read(self) -> np.ndarray:
        """log10 probability of each token, read left to right from the longest
        state its text allows."""
        out = self.total[1][self.grams.at[1]]
        for k in range(2, self.order + 1):
            ok = self.grams.at[k] >= 0
            out[ok] = self.total[k][self.grams.at[k][ok]]
        return out


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER,
          fold: int = 10, prior: float = PRIOR, block_tokens: int = BLOCK_TOKENS,
          range_keys: int = RANGE_KEYS) -> DataFrame:
    """Train on the documents outside fold 0 and score all documents."""
    blk = written(blocks(docs, id, text, fold, block_tokens), "lm-blocks")
    n_all = blk.agg(F.sum("n_tokens")).first()[0] or 0
    bits = _parts_bits(-(-n_all // range_keys))
    told = written(told_counts(asked_counts(blk, order, bits)), "lm-counts")
    sums = told.filter("ord = 1").agg(F.sum("total"), F.sum("n_distinct")).first()
    n, v = sums[0] or 0, sums[1] or 0

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples(index=False))
        g, ends, _ = _open(row, order)
        counts = {}
        for k in range(1, order + 1):
            own = answers[answers["ord"] == k].sort_values("part")
            got = np.concatenate([_expand(x, np.int64) for x in own["counts"]])
            counts[k] = np.empty(len(got), np.int64)
            counts[k][np.argsort(g.keys[k])] = got
        model = BackoffAutomaton(g, counts, n, v, prior)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        known = (counts[1][g.at[1]] > 0).astype(np.int64)
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids],
                               dtype="Int64"),
            "held_out": np.asarray(row.held, bool),
            "n_tokens": np.diff(ends, prepend=0),
            "n_known": np.add.reduceat(known, starts),
            "train_tokens": n,
            "base_score": np.add.reduceat(model.total[1][g.at[1]], starts),
            "score": np.add.reduceat(model.read(), starts)})

    return (blk.groupBy("block").cogroup(told.groupBy("block"))
            .applyInPandas(run, _SCORES))
