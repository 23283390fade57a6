"""Hashes of words and of runs of words, by numpy on the bytes of a text."""

from __future__ import annotations

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_ONE = np.uint64(1)


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.append(_ONE, np.full(size - 1, b, np.uint64))) for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


_BYTES, *_RUNS = [Powers(b) for b in _ODD]


def mixed(x: np.ndarray) -> np.ndarray:
    """All bits of the result depend on all bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word; words are parted by ASCII white space."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _BYTES.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _ONE) * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def run_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` words; two independent ones by ``which``."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    up, down = _RUNS[which].upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[: len(words) - length + 1])


def minimizers(runs: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost smallest run in each ``window`` neighbours, each once; all of fewer count as one window."""
    if not len(runs):
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, min(window, len(runs)))
    return np.unique(np.arange(len(view)) + view.argmin(axis=1))
