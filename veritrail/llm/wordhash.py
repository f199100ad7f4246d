"""Words of a batch of texts as 64-bit hashes, in whole-array steps.

The hash of a word is a polynomial in its bytes modulo 2^64: sums of byte values times powers are running sums over
the batch, so a word's is a difference of two, divided by the power of its place (an odd number has an inverse).
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, 5 modulo 8
_MASK = (1 << 64) - 1
#: Bytes that are hashed together; longer only for a single longer word.
PIECE = 1 << 18
#: Words are also known by the hash of their last three bytes.
ENDINGS = 1024


def _mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.array([_mixed(i + 1) for i in range(256)], np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of its ending, words of each text): runs without ASCII white space, A-Z lower-cased."""
    encoded = [t.encode() for t in texts]
    body = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    body = _LOWER[body]
    space = _SPACE[body]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.r_[0, edge]  # the last byte is a space, so words have both edges
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    per_text = np.diff(np.r_[0, np.searchsorted(starts, bounds)])
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        first = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, first + PIECE, side="right")))
        size = int(ends[end - 1] - first)
        up, down = _powers(max(size + 1, PIECE))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUES[body[first:first + size]] * up[:size], out=sums[1:])
        a, b = starts[at:end] - first, ends[at:end] - first
        hashes[at:end] = (sums[b] - sums[a]) * down[a]
        at = end
    last = [np.where(ends - starts >= i, body[ends - i], 0).astype(np.uint64) for i in (1, 2, 3)]
    endings = mix(last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)) % np.uint64(ENDINGS)
    return mix(hashes), endings.astype(np.int32), per_text
