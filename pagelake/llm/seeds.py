"""Seeds of fixed-length windows.

A document is a sequence of symbols (bytes or hashes of words). Of the k-grams
in a window of `window` symbols the one with the smallest hash, the last among
equals, is the window's seed. Equal windows have equal seeds at equal offsets,
wherever they stand, so only windows whose seed occurs twice need a closer
look. The rolling hash only chooses seeds; what is compared is hashed with
XXH64.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Windows whose seeds are found at a time.
SEGMENT = 1 << 16
_PLACE = U(0xFFFFFF)
digest = xxhash.xxh64_intdigest


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, U)
    steps[0] = 1
    return np.cumprod(steps, dtype=U)


_UP = _powers(BASE, 2 * SEGMENT)
_DOWN = _powers(pow(BASE, -1, 1 << 64), 2 * SEGMENT)


@dataclass(frozen=True)
class Shape:
    """window symbols, seeds of k; a window starts 0 .. reach symbols before its seed."""

    window: int
    k: int
    part: int = 1

    @property
    def reach(self) -> int:
        return self.window - self.k

    @property
    def hull(self) -> int:
        """Length of all that windows of one seed can cover, from `reach` before the seed on."""
        return self.reach + self.window

    @property
    def half(self) -> int:
        """Windows that start at least so far before their seed share so much with it on the left; the others share right_half on the right."""
        return (self.reach + 1) // 2

    @property
    def right_half(self) -> int:
        return self.window - self.half + 1


@dataclass
class View:
    """A document: its length, symbols for the rolling hash, and the bytes that stand for a stretch of symbols."""

    n: int
    symbols: Callable[[int, int], np.ndarray]
    piece: Callable[[int, int], bytes]


def byte_view(raw: bytes) -> View:
    values = np.frombuffer(raw, np.uint8)
    return View(len(raw), lambda a, b: BYTE[values[a:b]], lambda a, b: raw[a:b])


def word_view(raw: bytes) -> View:
    """Words are runs of bytes other than blanks, tabs and line ends, which is what bytes.split cuts at."""
    words = raw.split()
    symbols = np.fromiter(map(digest, words), U, len(words))
    flat = symbols.tobytes()
    return View(len(words), lambda a, b: symbols[a:b], lambda a, b: flat[8 * a : 8 * b])


@dataclass
class Seeds:
    """For each seed of a document: where it is, and the smallest and largest distance from a window's start to it."""

    at: np.ndarray
    near: np.ndarray
    far: np.ndarray


def _segment(symbols: np.ndarray, shape: Shape) -> np.ndarray:
    """Positions of the seeds of all windows of a short stretch."""
    sums = np.zeros(len(symbols) + 1, U)
    np.multiply(symbols, _UP[: len(symbols)], out=sums[1:])
    np.cumsum(sums, out=sums)
    keys = (sums[shape.k :] - sums[: -shape.k]) * _DOWN[: len(symbols) - shape.k + 1]
    keys &= ~_PLACE
    keys |= _PLACE - np.arange(len(keys), dtype=U)
    wide, windows = 1, len(symbols) - shape.window + 1
    while 2 * wide <= shape.reach + 1:  # minima of stretches of 1, 2, 4, ... keys
        keys = np.minimum(keys[:-wide], keys[wide:])
        wide *= 2
    rest = shape.reach + 1 - wide
    keys = np.minimum(keys[:windows], keys[rest : rest + windows])
    return (_PLACE - (keys & _PLACE)).astype(np.int64)


def find_seeds(view: View, shape: Shape) -> Seeds:
    windows = view.n - shape.window + 1
    if windows < 1:
        return Seeds(*(np.zeros(0, np.int64),) * 3)
    own = [lo + _segment(view.symbols(lo, min(windows, lo + SEGMENT) + shape.window - 1), shape) for lo in range(0, windows, SEGMENT)]
    own = np.concatenate(own)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    at = own[first]
    return Seeds(at, at - np.concatenate((first[1:] - 1, [windows - 1])), at - first)
