"""Words and five-word shingles of texts: hashed for signatures, whole for verification."""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
_RANDOM = np.random.Generator(np.random.PCG64(20240611))
_BYTES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def normal(text: bytes | None) -> bytes:
    """The words of a UTF-8 text, A-Z lower-cased, joined by single spaces.

    ``bytes.split`` cuts at exactly space and 0x09 to 0x0D.
    """
    return b" ".join(text.lower().split()) if text else b""


def digest(norm: bytes) -> bytes:
    return hashlib.blake2b(norm, digest_size=16).digest()


class Hasher:
    """Hashes words and shingles of normal texts; keeps powers of the base between texts."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, length: int) -> None:
        size = max(length + 1, 1 << 16)
        back = pow(_BASE, -1, 2**64)
        for name, base in (("powers", _BASE), ("inverse", back)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def words(self, norm: bytes) -> np.ndarray:
        """One number per word: differences of running polynomial sums, shifted back to the word's start."""
        if not norm:
            return np.empty(0, np.uint64)
        signs = np.frombuffer(norm, np.uint8)
        if len(self.powers) <= len(signs):
            self._grow(len(signs))
        sums = np.zeros(len(signs) + 1, np.uint64)
        np.cumsum(_BYTES[signs] * self.powers[: len(signs)], out=sums[1:])
        ends = np.append(np.flatnonzero(signs == 32), len(signs))
        starts = np.concatenate(([0], ends[:-1] + 1))
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Shingle numbers in order; a shorter text is one shingle of all its words."""
        n = len(words)
        if not n:
            return words
        wide = min(n, WIDTH)
        sums = np.full(n - wide + 1, wide, np.uint64)
        for i in range(wide):
            sums += words[i : n - wide + 1 + i] * _PLACES[i]
        return mix(sums)


def shingle_set(norm: bytes) -> set:
    """The distinct shingles themselves."""
    words = norm.split(b" ") if norm else []
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WIDTH))))
