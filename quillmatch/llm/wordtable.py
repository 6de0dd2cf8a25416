"""Words to rows of a feature table, filled as words turn up; one per Python worker and model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MOST = 300_000  #: Words held before the table starts anew (a bound on a worker's memory, not on the words scored).


class WordTable(dict):
    """``features(words)`` gives one row a word; rows are computed once for each distinct word held."""

    def __init__(self, features: Callable[[list[str]], np.ndarray], width: int):
        super().__init__()
        self.features, self.width = features, width
        self.pending: list[str] = []
        self.rows = np.zeros((1024, width), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.pending.append(word)
        return at

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the words of all texts in a row, and where each text ends."""
        if len(self) > MOST:
            self.clear()
        get = self.__getitem__
        words: list[int] = []
        ends = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words.extend(map(get, text.split()))
            ends[i] = len(words)
        if self.pending:
            have = len(self) - len(self.pending)
            if len(self) > len(self.rows):
                more = np.zeros((max(2 * len(self.rows), len(self)), self.width), np.float32)
                more[:have] = self.rows[:have]
                self.rows = more
            for at in range(0, len(self.pending), 20_000):
                some = self.pending[at : at + 20_000]
                self.rows[have + at : have + at + len(some)] = self.features(some)
            self.pending = []
        return np.array(words, np.int64), ends


def gram_buckets(words: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets (from 1) of all character n-grams of words, ends marked, word after word; and how many each word has.

    An empty word has the one bucket 0.
    """
    chars = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    room = end[owner] - np.arange(len(chars))
    some = (size > 2)[owner]
    flat, owners = [], []
    for n in orders:
        at = np.flatnonzero(some & (room >= n))
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ chars[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        flat.append((h >> np.uint64(32)) % np.uint64(buckets - 1) + np.uint64(1))
        owners.append(owner[at])
    empty = np.flatnonzero(size == 2)
    flat.append(np.zeros(len(empty), np.uint64))
    owners.append(empty)
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return np.concatenate(flat)[order].astype(np.int64), np.bincount(who, minlength=len(words))


def row_sums(index: np.ndarray, values: np.ndarray, n: int, order: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows of ``values`` by ``index``, for 0 to ``n - 1``; ``order`` is what sorts ``index``, if it is known."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(index):
        order = np.argsort(index, kind="stable") if order is None else order
        own = index[order]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def batches_of(texts: list, most_chars: int = 4_000_000):
    """Slices of a list of texts with about ``most_chars`` characters each (a longer text is one alone)."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
