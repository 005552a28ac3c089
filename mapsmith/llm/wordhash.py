"""Words of many texts at once, as numpy arrays: positions in one buffer of bytes, and 64-bit hashes.

A word is a run of bytes other than U+0020 and U+0009 to U+000D. The hash of a word is a polynomial over a random
table of its bytes, mixed; the hash of a window of words is a polynomial over theirs, mixed. Equal words have equal
hashes in every task. Different ones may collide: callers that must be exact compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are held at once (a longer text is held alone).
AT_ONCE = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(max(n, AT_ONCE + 1024), base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Words:
    """``data``: bytes of all texts, a space after each; ``start``, ``end``: of each word; ``at``: the first word of
    each text, and at last their number."""

    def __init__(self, texts: list[str | None], *, lower: bool = False):
        raw = [(t or "").encode() for t in texts]
        self.data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.at = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * up[: len(self.data)], dtype=np.uint64)])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, first: int, stop: int) -> bytes:
        """Words from ``first`` up to ``stop``, joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[first:stop].tolist(), self.end[first:stop].tolist(), strict=True))


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``n`` hashes from each position on that has so many."""
    many = len(hashes) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(many, (seed * 2 + 1) * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + hashes[k : k + many]
    return mix(total)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, stop) runs of texts of AT_ONCE bytes or so."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= AT_ONCE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
