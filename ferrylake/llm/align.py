"""Alignment of two tokenizers over the same bytes, and how often ids are linked.

A byte-level vocabulary (A) and a SentencePiece vocabulary (B) cut the same bytes.
Where tokens of both end at one byte, a group ends; every A token of a group is
linked to every B token of it. The merge is done in lockstep: a run of documents is
laid end to end, one lane a document (a long one gets several, each started at an
offset where both cut). A NumPy state vector holds every lane's A and B token; a
step links the two, cuts where they end together, advances the side that ends first
(both at a cut) and drops the lanes that are through.

A run is written as one block: per-document figures, the distinct id pairs of the
run, and each document's pairs as places in that list. Pairs are counted once a
document, added up inside a block first; hash ranges of pairs add the blocks' counts
and send each block's counts back in its own order. A pair is one key a block, so no
pair, however common, makes a range uneven; a block and a range are bounded by
``BLOCK_CHARS`` (or one text) and ``RANGE_KEYS``. Only the highest count of each A id
goes to the driver: at most one number an entry of A's vocabulary.

Cases: null and empty texts, and texts that B does not give back byte for byte (a
U+2581 in the text, which B writes as a space), have no tokens: zeros and an empty
groups column. Special tokens' strings are plain text. Repeated rows are each
aligned and each counted as a document; equal counts are all highest; a null id
stays null; a very long text is a block of its own and aligned by many lanes; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import pick, ship_package, written
from ferrylake.llm.packing import text_runs
from ferrylake.llm.partids import Numbers, PartIds, byte_letters, laid
from ferrylake.llm.words import mix

BLOCK_CHARS = 3_000_000
LANE_BYTES = 512            # a longer document is merged by several lanes
RANGE_KEYS = 3_000_000      # (block, pair) counts that one hash range adds up
PAIR_SLICE = 2_000_000      # pairs held at once while groups are multiplied out
CACHE_WORDS = 150_000       # words a generation of a worker's store holds

# Fixed value: the pattern by which byte-level vocabularies of this kind part text.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                      r"|\s+(?!\S)|\s+")

_BLOCKS = ("block long, doc_ids array<long>, n_a array<long>, n_b array<long>, "
           "n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
           "n_pairs array<int>, distinct long, pairs binary, docs binary, places binary, "
           "times binary")
_ASKED = "part long, block long, pairs binary, docs binary"
_TOLD = "block long, part long, counts binary, a_ids array<int>, a_best array<long>"
_FIGURES = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
            "count_sum long, groups_sha256 string")
_ALIGNED = ("doc_id long, a_ids array<int>, b_ids array<int>, "
            "groups array<struct<a_end: int, b_end: int, byte_end: int>>")


# --- the two tokenizers ------------------------------------------------------

class ByteLevel:
    """Ids and bytes of a byte-level BPE file, special tokens left out."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        for k, m in enumerate(model["merges"]):
            if vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] != 256 + k:
                raise ValueError(f"{path}: ids are not in the order of the merges")
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.bytes = [b""] * len(vocab)
        for entry, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in entry)
        self.encoding = tiktoken.Encoding(
            "byte_level", pat_str=BYTE_LEVEL_PATTERN, special_tokens={},
            mergeable_ranks={b: i for i, b in enumerate(self.bytes)})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Ids and bytes of a SentencePiece file, which adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else
                      p.replace("▁", " ").encode("utf-8")
                      for i, p in ((i, self.model.id_to_piece(i))
                                   for i in range(self.model.get_piece_size()))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, and their ids of blank-parted words.

    Neither joins characters over the border before a blank that a non-blank follows
    (A's pattern ends every match there; no piece of B has its blank sign behind another
    character, which is checked). So a text's ids are those of its words with the blank
    before each, unless a word is empty or starts with white space: such texts are
    encoded whole."""

    WHOLE, BROKEN = 1, 2         # kinds of words: text needs the tokenizers, has no tokens

    def __init__(self, a_path: str, b_path: str, cache: int = CACHE_WORDS):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.words = PartIds(self._learn, 3, cache)
        self.by_word = not any(" " in p.decode("utf-8", "replace").lstrip(" ")
                               for p in self.b.bytes)
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, s.bytes), np.int64, len(s.bytes))
                                      for s in (self.a, self.b))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides and whether both give back space+text."""
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        same = [_joined(self.a.bytes, x) == raw == _joined(self.b.bytes, y)
                for x, y, raw in zip(ids_a, ids_b,
                                     (b" " + t.encode("utf-8", "surrogatepass") for t in texts))]
        return ids_a, ids_b, same

    def _learn(self, words: list[str]) -> tuple[Numbers, ...]:
        """Ids of the words and their kinds. Plain words are encoded as texts of a few
        hundred, which are cut at their ends."""
        kinds = np.fromiter((self.WHOLE if not w or w[0].isspace() else
                             self.BROKEN if "▁" in w else 0 for w in words), np.int32, len(words))
        plain = [w for w, k in zip(words, kinds.tolist()) if not k]
        n_a, n_b = np.zeros((2, len(words)), np.int64)
        flat_a = flat_b = np.zeros(0, np.int32)
        if plain:
            runs = [" ".join(plain[k:k + 300]) for k in range(0, len(plain), 300)]
            ids_a, ids_b, same = self.encode(runs)
            if all(same):
                flat_a, flat_b = laid(ids_a)[1], laid(ids_b)[1]
                ends = np.cumsum(np.fromiter(
                    (len(w.encode("utf-8", "surrogatepass")) + 1 for w in plain),
                    np.int64, len(plain)))
                n_a[kinds == 0], n_b[kinds == 0] = (
                    np.diff(np.searchsorted(np.cumsum(sizes[flat]), ends) + 1, prepend=0)
                    for sizes, flat in ((self.a_sizes, flat_a), (self.b_sizes, flat_b)))
            else:                                  # a character that B does not give back
                ids_a, ids_b, same = self.encode(plain)
                (n_a[kinds == 0], flat_a), (n_b[kinds == 0], flat_b) = laid(ids_a), laid(ids_b)
                kinds[np.flatnonzero(kinds == 0)[~np.array(same)]] = self.BROKEN
        return (n_a, flat_a), (n_b, flat_b), (np.ones(len(words), np.int64), kinds)


def _joined(entries: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(entries.__getitem__, ids))


_LOADED: dict[tuple[str, str], Pair] = {}


def _tokenizers(a_path: str, b_path: str) -> Pair:
    """Loaded once per Python worker."""
    if (a_path, b_path) not in _LOADED:
        _LOADED.clear()
        _LOADED[a_path, b_path] = Pair(a_path, b_path)
    return _LOADED[a_path, b_path]


# --- the merge ---------------------------------------------------------------

@dataclass
class Tokens:
    """Tokens of a run of documents, laid end to end."""
    ids: np.ndarray             # of all documents
    ends: np.ndarray            # byte at which each ends, in the run
    first: np.ndarray           # per document and one more: place of its first token

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _tokens(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Tokens:
    return Tokens(ids, np.cumsum(sizes[ids]), np.concatenate([[0], np.cumsum(counts)]))


def tokenise(texts: list[str], pair: Pair) -> tuple[Tokens, Tokens]:
    """Tokens of both sides; none where the bytes of a side differ from space+text."""
    store = pair.words
    store.turn()
    words = [t.split(" ") if t and pair.by_word else [] for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    rows = store.rows(itertools.chain.from_iterable(words), int(n.sum()))
    del words
    store.learn()
    doc = np.repeat(np.arange(len(texts)), n)
    kinds = store.ids(rows, 2)[1]
    whole = np.zeros(len(texts), bool) if pair.by_word else np.fromiter(
        map(bool, texts), bool, len(texts))
    whole[doc[kinds == pair.WHOLE]] = True
    dropped = whole.copy()
    dropped[doc[kinds == pair.BROKEN]] = True
    kept = rows[~dropped[doc]]
    doc = doc[~dropped[doc]]
    again = np.flatnonzero(whole)
    *others, same = pair.encode([texts[k] for k in again.tolist()])
    sides = []
    for side, sizes in enumerate((pair.a_sizes, pair.b_sizes)):
        lengths, ids = store.ids(kept, side)
        counts = np.bincount(doc, weights=lengths, minlength=len(texts)).astype(np.int64)
        if len(again):
            of = np.repeat(doc, lengths)
            extra = [x if ok else [] for x, ok in zip(others[side], same)]
            counts[again], more = laid(extra)
            of = np.concatenate([of, np.repeat(again, counts[again])])
            ids = np.concatenate([ids, more])
            ids = ids[np.argsort(of, kind="stable")]
        sides.append(_tokens(ids, counts, sizes))
    return sides[0], sides[1]


def _meet(pa: np.ndarray, pb: np.ndarray, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """From each pair of places on, the first tokens that end together."""
    pa, pb = pa.copy(), pb.copy()
    live = np.arange(len(pa))
    while len(live):
        ea, eb = a.ends[pa[live]], b.ends[pb[live]]
        pa[live] += ea < eb
        pb[live] += eb < ea
        live = live[ea != eb]
    return pa, pb


def _lanes(a: Tokens, b: Tokens, lane_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where lanes start: each document's first tokens, and after the first
    common end behind every ``lane_bytes`` bytes of a document."""
    full = np.flatnonzero(a.counts)
    starts = np.concatenate([[0], a.ends])[a.first[full]]
    sizes = a.ends[a.first[full + 1] - 1] - starts
    more = (sizes - 1) // lane_bytes
    k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    at = np.repeat(starts, more) + k * lane_bytes
    pa, pb = _meet(np.searchsorted(a.ends, at), np.searchsorted(b.ends, at), a, b)
    # a meeting place at a document's end starts the next document's lane, or none
    firsts = np.concatenate([a.first[full], pa + 1])
    places = np.concatenate([b.first[full], pb + 1])
    firsts, keep = np.unique(firsts, return_index=True)
    places = places[keep]
    inside = firsts < len(a.ids)
    return firsts[inside], places[inside]


def merge(a: Tokens, b: Tokens, lane_bytes: int = LANE_BYTES
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A place, B place, cut) of every pair of overlapping tokens, in text order;
    ``cut`` says that the two end together."""
    pa, pb = _lanes(a, b, lane_bytes)
    stop = np.append(pa[1:], len(a.ids))
    link_a = np.full(len(a.ids) + len(b.ids), -1, np.int32)
    link_b = np.zeros(len(link_a), np.int32)
    cut = np.zeros(len(link_a), bool)
    while len(pa):
        ea, eb = a.ends[pa], b.ends[pb]
        both = ea == eb
        step = pa + pb                       # grows along a lane and from lane to lane
        link_a[step], link_b[step], cut[step] = pa, pb, both
        pa = pa + (ea <= eb)
        pb = pb + (eb <= ea)
        live = pa < stop
        if not live.all():
            pa, pb, stop = pa[live], pb[live], stop[live]
    seen = link_a >= 0
    return link_a[seen], link_b[seen], cut[seen]


@dataclass
class Groups:
    """Groups of a run in text order: places after their last tokens, and documents."""
    a_end: np.ndarray
    b_end: np.ndarray
    doc: np.ndarray

    @property
    def a_start(self) -> np.ndarray:
        return np.concatenate([[0], self.a_end])[:-1]

    @property
    def b_start(self) -> np.ndarray:
        return np.concatenate([[0], self.b_end])[:-1]


def _groups(a: Tokens, links: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Groups:
    la, lb, cut = links
    ends = la[cut].astype(np.int64)
    return Groups(ends + 1, lb[cut].astype(np.int64) + 1,
                  np.searchsorted(a.first, ends, "right") - 1)


def _products(sizes_a: np.ndarray, sizes_b: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of groups with at most ``most`` pairs together, or one group alone."""
    total = np.cumsum(sizes_a * sizes_b)
    at = 0
    while at < len(total):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        yield slice(at, to)
        at = to


def _tally(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how often each occurs."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    if times is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(times, at) if len(at) else times


def document_pairs(a: Tokens, b: Tokens, links: tuple[np.ndarray, np.ndarray, np.ndarray],
                   g: Groups, b_size: int, most: int = PAIR_SLICE
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair, times) of all links of the run; a pair is A id * b_size + B id.

    Where a group has one token on a side, its links are the overlaps of the merge;
    the tokens of the other groups are multiplied out, a slice of groups at a time, a
    group beyond ``most`` pairs by its distinct ids."""
    na, nb = g.a_end - g.a_start, g.b_end - g.b_start
    single = (na == 1) | (nb == 1)
    la, lb, cut = links
    group_of = np.cumsum(cut) - cut
    own = single[group_of]
    pair = a.ids[la[own]].astype(np.int64) * b_size + b.ids[lb[own]]
    bits = int(len(a.counts)).bit_length()
    if (int(a.ids.max(initial=0)) * b_size + b_size).bit_length() + bits > 63:
        raise ValueError("vocabularies too large for one number a (document, pair)")
    shift = 63 - bits
    parts = [_tally((g.doc[group_of[own]] << shift) + pair)]
    many = np.flatnonzero(~single)
    for s in _products(na[many], nb[many], most):
        for keys, times in _multiplied(a, b, g, many[s], b_size, shift, most):
            parts.append(_tally(keys, times))
    if len(parts) > 1:
        parts = [_tally(np.concatenate([k for k, _ in parts]),
                        np.concatenate([t for _, t in parts]))]
    keys, times = parts[0]
    return keys >> shift, keys & ((1 << shift) - 1), times


def _multiplied(a: Tokens, b: Tokens, g: Groups, chosen: np.ndarray, b_size: int, shift: int,
                most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    na, nb = (g.a_end - g.a_start)[chosen], (g.b_end - g.b_start)[chosen]
    if len(chosen) == 1 and na[0] * nb[0] > most:
        k = chosen[0]
        ua, ca = np.unique(a.ids[g.a_start[k]:g.a_end[k]], return_counts=True)
        ub, cb = np.unique(b.ids[g.b_start[k]:g.b_end[k]], return_counts=True)
        rows = max(1, most // len(ub))
        for at in range(0, len(ua), rows):
            code = ua[at:at + rows, None].astype(np.int64) * b_size + ub[None, :]
            yield ((g.doc[k] << shift) + code.ravel(),
                   (ca[at:at + rows, None] * cb[None, :]).ravel())
        return
    n = na * nb
    which = np.repeat(np.arange(len(chosen)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    ids_a = a.ids[g.a_start[chosen][which] + k // nb[which]].astype(np.int64)
    ids_b = b.ids[g.b_start[chosen][which] + k % nb[which]]
    yield (g.doc[chosen][which] << shift) + ids_a * b_size + ids_b, np.ones(len(which), np.int64)


@cache
def _decimals(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of digits and the digits, with room for a sign, of all numbers of ``bits``."""
    names = np.array([str(i) for i in range(1 << bits)])
    digits = np.char.str_len(names)
    cells = names.astype(f"S{names.dtype.itemsize // 4 + 1}")
    return digits, cells.view(np.uint8).reshape(len(names), -1)


def group_texts(a: Tokens, b: Tokens, g: Groups) -> Iterator[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document: decimal ids in order."""
    ga = np.repeat(np.arange(len(g.a_end)), g.a_end - g.a_start)
    gb = np.repeat(np.arange(len(g.b_end)), g.b_end - g.b_start)
    at_a = np.arange(len(a.ids)) + g.b_start[ga]
    at_b = np.arange(len(b.ids)) + g.a_end[gb]
    ids = np.empty(len(a.ids) + len(b.ids), np.int64)
    ids[at_a], ids[at_b] = a.ids, b.ids
    sign = np.full(len(ids), ord(","), np.uint8)
    sign[at_a[g.a_end - 1]] = ord("|")
    sign[at_b[g.b_end - 1]] = ord(";")
    digits, cells = _decimals(int(ids.max(initial=0)).bit_length())
    digits = digits[ids]
    cells = cells[ids]
    cells[np.arange(len(ids)), digits] = sign
    text = cells[np.arange(cells.shape[1]) <= digits[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(digits + 1)])
    first = a.first + b.first
    for start, stop in zip(ends[first[:-1]], ends[first[1:]]):
        yield text[start:max(start, stop - 1)]


# --- blocks ------------------------------------------------------------------

def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _expand(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _rises(x: np.ndarray) -> bytes:
    """Sorted numbers as their differences, which squeeze better."""
    return _squeeze(np.diff(x, prepend=0))


def _documents(docs: DataFrame, id: str, text: str) -> DataFrame:
    d = pick(docs, doc_id=id, text=text)
    return d.withColumn("doc_id", F.col("doc_id").cast("long"))


def _id_list(ids: pd.Series) -> list[int | None]:
    return [None if pd.isna(i) else int(i) for i in ids]


def aligned(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id",
            text: str = "text", block_chars: int = BLOCK_CHARS,
            lane_bytes: int = LANE_BYTES) -> DataFrame:
    """Per document its A and B ids and its groups: the numbers of A tokens, B tokens
    and bytes of space+text up to the end of each."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _tokenizers(a_path, b_path)
        for batch in batches:
            ids = _id_list(batch["doc_id"].astype("Int64"))
            for at, texts in text_runs(batch["text"], block_chars):
                a, b = tokenise(texts, pair)
                g = _groups(a, merge(a, b, lane_bytes))
                of = np.searchsorted(g.doc, np.arange(len(texts) + 1))
                rows = []
                for k in range(len(texts)):
                    s, e = slice(a.first[k], a.first[k + 1]), slice(b.first[k], b.first[k + 1])
                    ends = g.a_end[of[k]:of[k + 1]]
                    base = a.ends[s.start - 1] if s.start else 0
                    rows.append((ids[at + k], a.ids[s], b.ids[e], [
                        {"a_end": int(x - s.start), "b_end": int(y - e.start), "byte_end": int(z)}
                        for x, y, z in zip(ends, g.b_end[of[k]:of[k + 1]],
                                           a.ends[ends - 1] - base)]))
                frame = pd.DataFrame(rows, columns=["doc_id", "a_ids", "b_ids", "groups"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return _documents(docs, id, text).mapInPandas(run, _ALIGNED)


def blocks(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text",
           block_chars: int = BLOCK_CHARS, lane_bytes: int = LANE_BYTES) -> DataFrame:
    """One row per run of about ``block_chars`` characters, its block number still 0."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _tokenizers(a_path, b_path)
        for batch in batches:
            ids = _id_list(batch["doc_id"].astype("Int64"))
            for at, texts in text_runs(batch["text"], block_chars):
                row = _block(texts, pair, lane_bytes)
                row["doc_ids"] = ids[at:at + len(texts)]
                yield pd.DataFrame({k: [v] for k, v in row.items()})[
                    [c.split(" ")[0] for c in _BLOCKS.split(", ")]]

    return _documents(docs, id, text).mapInPandas(run, _BLOCKS).withColumn(
        "block", F.monotonically_increasing_id())


def _block(texts: list[str], both: Pair, lane_bytes: int) -> dict:
    a, b = tokenise(texts, both)
    links = merge(a, b, lane_bytes)
    g = _groups(a, links)
    doc, pair, times = document_pairs(a, b, links, g, len(both.b.bytes))
    del links
    pairs, docs = _tally(pair)
    return {
        "block": 0, "n_a": a.counts, "n_b": b.counts,
        "n_groups": np.bincount(g.doc, minlength=len(texts)),
        "n_links": _sums(doc, times, len(texts)),
        "groups_sha256": [hashlib.sha256(t).hexdigest() if t else ""
                          for t in group_texts(a, b, g)],
        "n_pairs": np.bincount(doc, minlength=len(texts)).astype(np.int32),
        "distinct": len(pairs), "pairs": _rises(pairs), "docs": _squeeze(docs.astype(np.int32)),
        "places": _squeeze(np.searchsorted(pairs, pair).astype(np.int32)),
        "times": _squeeze(times.astype(np.int32))}


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of ``values`` by their (sorted) place."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    edge = np.searchsorted(at, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


# --- counts over all documents -----------------------------------------------

def _part_of(pairs: np.ndarray, parts: int) -> np.ndarray:
    return (mix(pairs.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def pair_counts(written_blocks: DataFrame, b_size: int, range_keys: int = RANGE_KEYS
                ) -> tuple[DataFrame, int]:
    """Each block's pairs with the number of documents that hold them, and each
    range's highest count of an A id (rows without a block); the number of ranges."""
    total = written_blocks.agg(F.sum("distinct")).first()[0] or 0
    parts = max(1, -(-total // range_keys))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                pairs, docs = np.cumsum(_expand(r.pairs, np.int64)), _expand(r.docs, np.int32)
                part = _part_of(pairs, parts)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(p, r.block, _rises(pairs[order[s:e]]), _squeeze(docs[order[s:e]]))
                        for p, (s, e) in enumerate(zip(edge[:-1], edge[1:])) if s < e]
                yield pd.DataFrame(rows, columns=["part", "block", "pairs", "docs"])

    def tell(asked: pd.DataFrame) -> pd.DataFrame:
        slices = [np.cumsum(_expand(p, np.int64)) for p in asked["pairs"]]
        keys, place = np.unique(np.concatenate(slices), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, place, np.concatenate([_expand(d, np.int32) for d in asked["docs"]]))
        edge = np.concatenate([[0], np.cumsum([len(s) for s in slices])])
        part = int(asked["part"].iat[0])
        rows = [(int(block), part, _squeeze(counts[place[s:e]]), None, None)
                for block, s, e in zip(asked["block"], edge[:-1], edge[1:])]
        a_ids = keys // b_size                                    # sorted, as keys are
        at = np.flatnonzero(np.concatenate([[True], a_ids[1:] != a_ids[:-1]]))
        rows.append((None, part, None, a_ids[at].astype(np.int32),
                     np.maximum.reduceat(counts, at)))
        out = pd.DataFrame(rows, columns=["block", "part", "counts", "a_ids", "a_best"])
        return out.astype({"block": "Int64"})

    asked = written_blocks.select("block", "pairs", "docs").mapInPandas(ask, _ASKED)
    return asked.groupBy("part").applyInPandas(tell, _TOLD), parts


def report(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text",
           block_chars: int = BLOCK_CHARS, lane_bytes: int = LANE_BYTES,
           range_keys: int = RANGE_KEYS) -> DataFrame:
    """Per document its tokens, groups and links; ``n_best``: links whose count is the
    highest of their A id over all documents; ``count_sum``: the counts of all links."""
    made = written(blocks(docs, a_path, b_path, id, text, block_chars, lane_bytes), "aligned")
    both = _tokenizers(a_path, b_path)
    b_size = len(both.b.bytes)
    told, parts = pair_counts(made, b_size, range_keys)
    told = written(told, "pair-counts")
    best = np.zeros(len(both.a.bytes), np.int64)
    highest = told.filter("block is null").select(
        F.explode(F.arrays_zip("a_ids", "a_best")).alias("x")).groupBy("x.a_ids").agg(
        F.max("x.a_best").alias("n"))
    for r in highest.toLocalIterator():      # at most one row an entry of A's vocabulary
        best[r.a_ids] = r.n

    def figures(block: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        r = block.iloc[0]
        pairs = np.cumsum(_expand(r.pairs, np.int64))
        counts = np.zeros(len(pairs), np.int64)
        if len(counted):
            counted = counted.sort_values("part")
            counts[np.argsort(_part_of(pairs, parts), kind="stable")] = np.concatenate(
                [_expand(c, np.int64) for c in counted["counts"]])
        places, times = _expand(r.places, np.int32), _expand(r.times, np.int32)
        n = len(r.n_pairs)
        doc = np.repeat(np.arange(n), r.n_pairs)
        is_best = (counts == best[pairs // b_size])[places]
        out = pd.DataFrame({c: np.asarray(r[c]) for c in
                            ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")})
        out.insert(0, "doc_id", pd.array(_id_list(pd.Series(r.doc_ids, dtype="Int64")), "Int64"))
        out["n_best"] = _sums(doc, times * is_best, n)
        out["count_sum"] = _sums(doc, times * counts[places], n)
        return out[[c.split(" ")[0] for c in _FIGURES.split(", ")]]

    replies = told.filter("block is not null").select("block", "part", "counts")
    return made.drop("docs").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        figures, _FIGURES)
