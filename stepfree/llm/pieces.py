"""Substrings of words looked up in a fixed piece vocabulary, many words of one length at a time."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def codes(words: list[str], n: int) -> np.ndarray:
    """Code points of words that all have n characters, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)


def by_length(words, most: int = 4_000) -> Iterator[tuple[int, list[str]]]:
    """Words of equal length in blocks whose number of characters is bounded."""
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for n, group in groups.items():
        step = max(1, min(most, 40 * most // max(n, 1)))
        for i in range(0, len(group), step):
            yield n, group[i : i + step]


class PieceTable:
    """Sorted hashes of the pieces of each length; ``probe`` finds every piece that starts at every place of every word."""

    def __init__(self, pieces: list[str]):
        by = defaultdict(list)
        for i, p in enumerate(pieces):
            if p:
                by[len(p)].append((p, i))
        self.longest = max(by, default=0)
        self.tables = {}
        for n, own in by.items():
            keys = self._prefix(codes([p for p, _ in own], n))[:, -1]
            order = np.argsort(keys, kind="stable")
            self.tables[n] = keys[order], np.array([i for _, i in own], np.int64)[order]
        self.powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.longest):
                self.powers[i + 1] = self.powers[i] * _BASE

    @staticmethod
    def _prefix(chars: np.ndarray) -> np.ndarray:
        out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(chars.shape[1]):
                out[:, i + 1] = out[:, i] * _BASE + chars[:, i] + np.uint64(1)
        return out

    def probe(self, chars: np.ndarray) -> dict[int, np.ndarray]:
        """By piece length: the id of the piece at each start (row: word), or -1."""
        prefix, found = self._prefix(chars), {}
        for n, (keys, ids) in self.tables.items():
            if n > chars.shape[1]:
                continue
            with np.errstate(over="ignore"):
                sub = prefix[:, n:] - prefix[:, :-n] * self.powers[n]
            at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
            hit = keys[at] == sub
            if hit.any():
                found[n] = np.where(hit, ids[at], -1)
        return found
