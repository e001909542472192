"""Token ids of parts of texts, kept while they are in use.

Tokenisers treat the parts of a text (words, signs) independently, parts repeat, and
a Python worker sees many texts: each part is encoded once while the store holds it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np

Numbers = tuple[np.ndarray, np.ndarray]          # lengths of lists, the lists end to end
Encode = Callable[[list[str]], tuple[Numbers, ...]]


def laid(lists: list[list[int]]) -> Numbers:
    """Lists end to end."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return n, np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(n.sum()))


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class _Numbers(dict):
    """part -> row, given on first sight."""

    def __missing__(self, part: str) -> int:
        row = self[part] = len(self)
        return row


class _Lists:
    """Lists of numbers, one a row, laid end to end."""

    def __init__(self) -> None:
        self.flat = np.zeros(0, np.int32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def add(self, lengths: np.ndarray, flat: np.ndarray) -> None:
        first = len(self.flat) + np.cumsum(lengths) - lengths
        self.starts = np.concatenate([self.starts, first])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32, copy=False)])

    def take(self, rows: np.ndarray) -> Numbers:
        """(lengths, numbers) of the rows."""
        n = self.lengths[rows]
        begin = np.repeat(self.starts[rows] - (np.cumsum(n) - n), n)
        return n, self.flat[begin + np.arange(len(begin))]


class PartIds:
    """A store of two generations: when the young one holds ``limit`` parts it becomes
    the old one, and a part met again moves from there, so parts in use stay and the
    store never holds more than two generations and one run of texts. ``encode`` gives
    ``sides`` times the ids of each part of a list. Rows are good until ``turn``."""

    def __init__(self, encode: Encode, sides: int, limit: int):
        self.encode, self.sides, self.limit = encode, sides, limit
        self.young, self.old = _Numbers(), _Numbers()
        self.lists = [_Lists() for _ in range(sides)]
        self.old_lists = [_Lists() for _ in range(sides)]

    def turn(self) -> None:
        """Before a run of texts: start a new generation if this one is full."""
        if len(self.young) >= self.limit:
            self.old, self.old_lists = self.young, self.lists
            self.young, self.lists = _Numbers(), [_Lists() for _ in range(self.sides)]

    def rows(self, parts: Iterable[str], n: int = -1) -> np.ndarray:
        return np.fromiter(map(self.young.__getitem__, parts), np.int64, n)

    def learn(self) -> None:
        """Ids of the parts that ``rows`` saw for the first time."""
        have = len(self.lists[0].lengths)
        new = list(itertools.islice(self.young, have, None))
        if not new:
            return
        was = np.fromiter((self.old.get(p, -1) for p in new), np.int64, len(new))
        known = was >= 0
        fresh = self.encode([p for p, k in zip(new, known.tolist()) if not k])
        for side, lists in enumerate(self.lists):
            n = np.zeros(len(new), np.int64)
            n[~known], made = fresh[side]
            n[known], moved = self.old_lists[side].take(was[known])
            flat = np.empty(int(n.sum()), np.int32)
            from_old = np.repeat(known, n)
            flat[from_old], flat[~from_old] = moved, made
            lists.add(n, flat)

    def ids(self, rows: np.ndarray, side: int = 0) -> Numbers:
        """(ids of each row, the ids end to end)."""
        return self.lists[side].take(rows)
