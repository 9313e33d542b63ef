"""Words as 64-bit names, and hashes of word windows, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64


class WordNames(dict):
    """Word bytes -> XXH64; forgets everything when it holds a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


NAMES = WordNames()


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters."""
    return (text or "").encode().split()


def names_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(NAMES.__getitem__, words), _U, len(words))


def mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of two arrays, element by element."""
    more = b * _U(0xC2B2AE3D27D4EB4F) if isinstance(b, np.ndarray) else _U(b * 0xC2B2AE3D27D4EB4F % (1 << 64))
    x = a * _U(0x9E3779B97F4A7C15) + more + _U(0x165667B19E3779F9)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Windows:
    """Polynomial hashes of any window of an array of names, modulo 2**64, with an odd base."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, names: np.ndarray, base: int):
        n, inverse = len(names) + 1, pow(base, -1, 1 << 64)
        held = self._powers.get(base)
        if held is None or len(held[0]) < n:
            size = max(n, 1 << 16)
            one = np.ones(size, _U)
            up, down = one.copy(), one.copy()
            up[1:], down[1:] = _U(base), _U(inverse)
            held = self._powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.down = held[1]
        self.sums = np.zeros(n, _U)
        np.cumsum(names * held[0][: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start], (end - start).astype(_U))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
