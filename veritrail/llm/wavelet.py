"""A wavelet matrix over a sequence of small classes, with vectorised rank and select."""

from __future__ import annotations

import numpy as np

_WORD = 64


class BitVector:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.size // _WORD + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at // _WORD
        below = (np.uint64(1) << (at % _WORD).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, bit: int, nth: np.ndarray) -> np.ndarray:
        """Position of the nth (from 0) set or clear bit, by bisection on the words' counts and inside one word."""
        before = self.before if bit else np.arange(len(self.before)) * _WORD - self.before
        word = np.searchsorted(before, nth, side="right") - 1
        value = self.words[word] if bit else ~self.words[word]
        left, at = nth - before[word], np.zeros(len(nth), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((value >> at.astype(np.uint64)) & np.uint64((1 << width) - 1))
            past = left >= low
            left, at = np.where(past, left - low, left), np.where(past, at + width, at)
        return word * _WORD + at


class WaveletMatrix:
    """Classes 0 .. 2**bits - 1; one bit vector a bit, highest first, each level with its zeros before its ones."""

    def __init__(self, classes: np.ndarray, bits: int):
        self.size, self.levels = len(classes), []
        for shift in reversed(range(bits)):
            bit = (classes >> shift) & 1
            one = bit.astype(bool)
            self.levels.append((shift, len(classes) - int(one.sum()), BitVector(bit)))
            classes = np.concatenate([classes[~one], classes[one]])

    def _down(self, klass: int, at: np.ndarray) -> np.ndarray:
        for shift, zeros, bits in self.levels:
            ones = bits.rank1(at)
            at = zeros + ones if klass >> shift & 1 else at - ones
        return at

    def rank(self, klass: int, at: np.ndarray) -> np.ndarray:
        """How many of the class stand before each position."""
        ends = self._down(klass, np.append(at, 0))
        return ends[:-1] - ends[-1]

    def select(self, klass: int, nth: np.ndarray) -> np.ndarray:
        """Position of the nth (from 0) of the class; there must be so many."""
        at = self._down(klass, np.zeros(1, np.int64)) + nth
        for shift, zeros, bits in reversed(self.levels):
            at = bits.select(1, at - zeros) if klass >> shift & 1 else bits.select(0, at)
        return at
