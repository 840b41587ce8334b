"""Words, shingles and their hashes of whole Arrow batches with numpy; the small helper of the Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20  # texts are worked on about this much at a time; a longer text alone

_random = np.random.default_rng(20240229)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes after A-Z are lower-cased: 0-9, a-z and all of multi-byte characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Word bytes: all but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2**64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * BASE)])
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins and ends; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]] if len(bounds) else whole, bounds - bounds[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of texts of about `size` bytes."""
    if not len(column):
        return
    data, bounds = flat(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


class Words:
    """The words of a run of texts: where they start and end, whose they are, and their 64-bit hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: np.ndarray = ALNUM) -> None:
        self.low = LOWER[data]
        inside = kind[self.low]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = bounds[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Words of text i are first[i] .. first[i + 1].
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        length = self.end - self.start
        self.hash = np.empty(0, np.uint64)
        if len(length):
            at = np.cumsum(length) - length
            within = np.arange(int(length.sum())) - np.repeat(at, length)
            value = BYTE_VALUE[self.low[inside]] * powers(int(length.max()))[within]
            self.hash = mixed(np.add.reduceat(value, at) ^ length.astype(np.uint64))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and owner of every run of n words; a text of fewer, but not none, gives one run of all of them."""
        out, whose = [], []
        if len(self.hash) >= n:
            value = np.zeros(len(self.hash) - n + 1, np.uint64)
            for k in range(n):
                value = value * BASE + self.hash[k : k + len(value)]
            owner = self.owner()
            whole = owner[: len(value)] == owner[n - 1 :]
            out.append(mixed(value[whole]))
            whose.append(owner[: len(value)][whole])
        for i in np.flatnonzero((self.count > 0) & (self.count < n)):
            value = np.uint64(0)
            for h in self.hash[self.first[i] : self.first[i + 1]]:
                value = np.uint64((int(value) * int(BASE) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([value ^ np.uint64(self.count[i])])))
            whose.append(np.array([i]))
        if not out:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        value, owner = np.concatenate(out), np.concatenate(whose)
        order = np.argsort(owner, kind="stable")
        return value[order], owner[order]
