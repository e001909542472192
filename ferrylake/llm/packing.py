"""Packing of token pieces into sequences of fixed length by swap-based local
search.

Texts are tokenised in Spark tasks; only (id, piece, start, length, checksum)
rows go on. Full pieces are a sequence each, wherever they are. The others, one a
text at most, are dealt by hash into groups of about ``group_pieces``, and each
group is packed by one task: a greedy first packing, then one-for-one and
two-for-one exchanges and moves between underfull bins, each of which raises the
sum of squared fills, until the emptiest bins can be closed. A group holds nothing
else, so its memory is bounded by ``group_pieces``. The search ends at the lower
bound of bins or when no underfull bin has a change left.

Cases: null text is empty text and still yields the end token; a text longer
than a sequence is cut into full pieces and a rest; equal rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import pick, ship_package, written
from ferrylake.llm.partids import Numbers, PartIds, byte_letters, laid

SEQUENCE = 2048
GROUP_PIECES = 30_000
CACHE_CHUNKS = 150_000     # a generation of a worker's store
PAIR_BINS = 16            # bins and items that a two-for-one exchange looks at
PAIR_ITEMS = 4

_PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long")


class Tokens:
    """Token ids of texts by a word vocabulary (word ends marked ``</w>``), kept for the
    blank-free chunks that texts are made of.

    The pre-tokeniser never joins characters across a blank, so the ids of a text are
    those of its chunks in order. New chunks of letters, digits and ASCII signs are cut
    where it cuts them, into runs of letters, single digits and runs of signs. The merges
    of such a part run on its bytes with a blank behind them, which stands for the word
    end, so many parts are encoded as one text and cut at the word ends. Chunks with an
    apostrophe (contractions), with ``<|`` (control strings), with marks or other signs,
    or whose letters do not stay letters when composed and lower-cased, go to the
    tokeniser itself.
    """

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {}
        self.ends = np.zeros(len(vocab), bool)
        specials = self.tokenizer.get_added_tokens_decoder()
        for entry, i in vocab.items():
            if i not in specials:
                self.ends[i] = entry.endswith(end)
                ranks[bytes(byte[c] for c in entry.removesuffix(end))
                      + (b" " if self.ends[i] else b"")] = i
        first = len(ranks) - len(model["merges"])
        for k, m in enumerate(model["merges"]):
            if vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] != first + k:
                raise ValueError(f"{path}: ids are not in the order of the merges")
        self.words = tiktoken.Encoding("words", pat_str=r"\S+ ", mergeable_ranks=ranks,
                                       special_tokens={})
        self.store = PartIds(self._learn, 1, limit)

    def _learn(self, chunks: list[str]) -> tuple[Numbers]:
        parts, counts = [], []
        for c in chunks:
            if c.isalpha():
                found = (c,)
            elif c[-1:] in (",", ".") and c[:-1].isalpha():
                found = (c[:-1], c[-1])
            elif _PLAIN.fullmatch(c) and "<|" not in c:
                found = _PARTS.findall(c)
            else:
                found = ()
            parts += found
            counts.append(len(found))
        n_parts = np.array(counts, np.int64)
        text = unicodedata.normalize("NFC", " ".join(parts))
        plain = text.lower().split(" ") if parts else []
        # a capital sigma's lower case depends on its place in Python
        odd = np.fromiter((not (p.isalpha() or p.isascii()) for p in plain), bool, len(plain))
        if "\u03a3" in text:
            odd |= np.fromiter(("\u03a3" in p for p in text.split(" ")), bool, len(plain))
        of = np.repeat(np.arange(len(chunks)), n_parts)
        whole = n_parts == 0
        whole[of[odd]] = True
        kept = ~whole[of]
        words = [p for p, k in zip(plain, kept.tolist()) if k]
        ids = [np.asarray(self.words.encode_ordinary(" ".join(words[k:k + 500]) + " "), np.int32)
               for k in range(0, len(words), 500)]
        fast = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        after = np.flatnonzero(self.ends[fast]) + 1           # one a part
        n = np.zeros(len(chunks), np.int64)
        fill = np.flatnonzero(~whole)
        n[fill] = np.diff(np.concatenate([[0], after])[np.concatenate(
            [[0], np.cumsum(n_parts[fill])])])
        slow = np.flatnonzero(whole)
        n[slow], made = laid([e.ids for e in self.tokenizer.encode_batch_fast(
            [chunks[k] for k in slow.tolist()], add_special_tokens=False)])
        flat = np.empty(int(n.sum()), np.int32)
        from_slow = np.repeat(whole, n)
        flat[from_slow], flat[~from_slow] = made, fast
        return ((n, flat),)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        store = self.store
        store.turn()
        chunks = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                  for t in texts]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        rows = store.rows(itertools.chain.from_iterable(chunks), int(sizes.sum()))
        store.learn()
        n, flat = store.ids(rows)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        return [flat[s:e].astype(np.uint32) for s, e in zip(ends[:-1], ends[1:])]


_PLAIN = re.compile(r"(?:[^\W\d_]|[!-&(-/0-9:-@\[-`{-~])+")
_PARTS = re.compile(r"[^\W\d_]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

_TOKENS: dict[tuple[str, int], Tokens] = {}


def tokens_of(path: str, limit: int) -> Tokens:
    """One store per Python worker, kept over its tasks."""
    if (path, limit) not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path, limit] = Tokens(path, limit)
    return _TOKENS[path, limit]


def text_runs(texts, chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``chars`` characters."""
    run, first, size = [], 0, 0
    for k, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= chars:
            yield first, run
            run, first, size = [], k + 1, 0
    if run:
        yield first, run


def text_pieces(ids: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids."""
    raw = ids.astype("<u4")
    for k, start in enumerate(range(0, len(raw), size)):
        part = raw[start:start + size]
        yield k, start, len(part), zlib.crc32(part.tobytes())


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE,
           id: str = "doc_id", text: str = "text", end_id: int = 0,
           cache: int = CACHE_CHUNKS) -> DataFrame:
    """One row per piece of each document: its ids end with ``end_id``. ``cache`` is
    the number of chunks a generation of a Python worker's store holds (about 200 bytes
    each, two generations)."""
    ship_package(docs.sparkSession)
    d = pick(docs, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokens_of(tokenizer_path, cache)
        end = np.array([end_id], np.uint32)
        for b in batches:
            docs = b["doc_id"].astype("Int64")
            rows, out = [], []
            for first, texts in text_runs(b["text"]):
                for k, ids in enumerate(tok.batch(texts)):
                    for p in text_pieces(np.concatenate([ids, end]), size):
                        rows.append(first + k)
                        out.append(p)
            frame = pd.DataFrame(out, columns=["piece", "start", "length", "ids_crc32"])
            frame.insert(0, "doc_id", docs.iloc[rows].array)
            yield frame

    return d.mapInPandas(run, _PIECES)


def _first_packing(lengths: list[int], size: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that still takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []          # sorted (free space, bin)
    for i in order:
        n = lengths[i]
        at = bisect.bisect_left(free, (n, -1))
        if at == len(free):
            bins.append([i])
            rest = (size - n, len(bins) - 1)
        else:
            space, b = free.pop(at)
            bins[b].append(i)
            rest = (space - n, b)
        if rest[0]:
            bisect.insort(free, rest)
    return bins


def local_search(lengths: list[int], size: int = SEQUENCE,
                 bins: list[list[int]] | None = None,
                 steps: int | None = None) -> list[list[int]]:
    """Pack items of the given lengths; returns bins of item numbers.

    The emptiest bin is the donor. Each step looks over all its items and all
    other underfull bins at least as full for the change that lowers the donor
    most: a move of an item into free room, else an exchange of one of its items
    for one shorter item, or for two that are shorter together (two-for-one looks
    at the ``PAIR_BINS`` roomiest bins). Every change moves length from a bin to
    one at least as full, so the sum of squared fills rises and the search ends.
    An emptied bin closes; a donor without such a change is set aside until the
    next one closes or all are set aside. The search stops at the lower bound of bins
    or when no donor has a change (``steps`` stops it earlier).
    """
    if bins is None:
        bins = _first_packing(lengths, size)
    if not bins:
        return []
    n = np.asarray(lengths, np.int64)
    at = np.empty(len(n), np.int64)
    for k, items in enumerate(bins):
        at[items] = k
    fill = np.bincount(at, weights=n, minlength=len(bins)).astype(np.int64)
    bound = max(-(-int(n.sum()) // size), int((2 * n > size).sum()))
    stuck = np.zeros(len(bins), bool)
    alive, changed = len(bins), False
    for _ in itertools.count() if steps is None else range(steps):
        donors = np.flatnonzero((fill > 0) & (fill < size) & ~stuck)
        if alive <= bound or not (len(donors) or changed):
            break
        if not len(donors):
            stuck[:] = changed = False
            continue
        donor = donors[np.argmin(fill[donors])]
        change = _best_change(int(donor), n, at, fill, size)
        if change is None:
            stuck[donor] = True
            continue
        changed = True
        item, receiver, back = change
        at[item] = receiver
        at[back] = donor
        moved = n[item] - n[back].sum()
        fill[receiver] += moved
        fill[donor] -= moved
        if not fill[donor]:
            alive -= 1
            stuck[:] = changed = False
    out: dict[int, list[int]] = {}
    for i, k in enumerate(at.tolist()):
        out.setdefault(k, []).append(i)
    return list(out.values())


def _best_change(donor: int, n: np.ndarray, at: np.ndarray, fill: np.ndarray,
                 size: int) -> tuple[int, int, list[int]] | None:
    mine = np.flatnonzero(at == donor)
    mine = mine[np.argsort(-n[mine], kind="stable")]
    receivers = np.flatnonzero((fill >= fill[donor]) & (fill < size))
    receivers = receivers[receivers != donor]
    if not len(receivers):
        return None
    room = size - fill[receivers]
    for item in mine:                          # a move: the fullest bin that takes it
        fits = np.flatnonzero(room >= n[item])
        if len(fits):
            return int(item), int(receivers[fits[np.argmin(room[fits])]]), []
    is_receiver = np.zeros(len(fill), bool)
    is_receiver[receivers] = True
    other = np.flatnonzero(is_receiver[at])
    spare = size - fill[at[other]]
    best: tuple[int, int, int, list[int]] | None = None
    for item in np.unique(n[mine], return_index=True)[1][::-1]:
        gain = n[mine[item]] - n[other]
        gain[gain > spare] = 0
        k = int(np.argmax(gain))
        if gain[k] > 0 and (best is None or gain[k] > best[0]):
            best = (int(gain[k]), int(mine[item]), int(at[other[k]]), [int(other[k])])
    for b in receivers[np.argsort(-room, kind="stable")[:PAIR_BINS]]:
        free = int(size - fill[b])
        if best is not None and free <= best[0]:
            break
        items = np.flatnonzero(at == b)
        for item in mine[:PAIR_ITEMS]:
            pair = _pair(n[items], int(n[item]) - free, int(n[item]))
            if pair and (best is None or n[item] - pair[0] > best[0]):
                best = (int(n[item]) - pair[0], int(item), int(b),
                        [int(items[pair[1]]), int(items[pair[2]])])
    return best and best[1:]


def _pair(lengths: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """Two places whose summed length is the least in [low, high)."""
    order = np.argsort(lengths, kind="stable")
    by = lengths[order].tolist()
    best = None
    lo, hi = 0, len(by) - 1
    while lo < hi:
        s = by[lo] + by[hi]
        if s < low:
            lo += 1
            continue
        if s < high and (best is None or s < best[0]):
            best = (s, int(order[lo]), int(order[hi]))
        hi -= 1
    return best


def pack(parts: DataFrame, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` rows plus ``sequence_id`` and ``offset``. ``parts`` is counted
    and then packed, so pass a written table. Full pieces are a sequence each
    and need no search: they are numbered where they are, after the groups' numbers.
    The others are dealt by hash into groups."""
    ship_package(parts.sparkSession)
    n = parts.filter(F.col("length") < size).count()
    groups = max(1, -(-n // group_pieces))
    schema = _PIECES + ", sequence_id long, offset long"
    key = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32",
                     F.monotonically_increasing_id())
    full = parts.filter(F.col("length") >= size).select(
        "*", (F.lit(groups << 32) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    dealt = parts.filter(F.col("length") < size).withColumn("_g", F.pmod(key, F.lit(groups)).cast("long"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"],
                                  ascending=[False, True, True, True, True],
                                  kind="stable").reset_index(drop=True)
        lengths = group["length"].tolist()
        base = int(group["_g"].iat[0]) << 32
        seq = np.zeros(len(group), np.int64)
        off = np.zeros(len(group), np.int64)
        for k, items in enumerate(local_search(lengths, size)):
            at = 0
            for i in sorted(items):
                seq[i], off[i] = base + k, at
                at += lengths[i]
        group["sequence_id"], group["offset"] = seq, off
        return group.drop(columns="_g")

    return full.union(dealt.groupBy("_g").applyInPandas(run, schema))


def packed(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE,
           group_pieces: int = GROUP_PIECES, id: str = "doc_id",
           text: str = "text", cache: int = CACHE_CHUNKS) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece with its place."""
    parts = pieces(docs, tokenizer_path, size, id, text, cache=cache)
    return pack(written(parts, "pieces"), size, group_pieces)
