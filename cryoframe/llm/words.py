"""Words of many texts at once, as numbers: hashing by columns instead of word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are handled in groups of about so many bytes; a longer text is a group of its own.
GROUP = 1 << 20
#: Bytes of words: 0-9, a-z, and all of characters beyond ASCII. Fixed by the task.
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(texts: list[bytes], most: int = GROUP) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts): neighbours, about ``most`` bytes together."""
    first, some, load = 0, [], 0
    for k, t in enumerate(texts):
        if some and load + len(t) > most:
            yield first, some
            first, some, load = k, [], 0
        some.append(t)
        load += len(t)
    if some:
        yield first, some


class Words:
    """Words of some texts: ``doc``, ``start``, ``end`` (places in ``data``) and ``hash`` of each."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\0".join(texts).lower()  # bytes: A-Z only
        self.n_docs = len(texts)
        raw = np.frombuffer(self.data, np.uint8)
        edge = np.diff(np.concatenate([[False], IN_WORD[raw], [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc = np.searchsorted(begins, self.start, "right") - 1
        power, inverse = _power_tables(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * power[: len(raw)])])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, hash) of each k neighbouring words of one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.hash[i : i + n])
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, h[at]

    def text(self, first: int, last: int) -> str:
        """The words from ``first`` to ``last``, by single spaces."""
        return b" ".join(self.data[self.start[i] : self.end[i]] for i in range(first, last + 1)).decode()
