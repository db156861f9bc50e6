"""Content-defined anchors: every string of `match` bytes gets one, and equal strings get the same.

The anchor of a string is the leftmost of its `gram`-byte grams with the smallest
hash. Neighbouring strings mostly share it, so a text has about one anchor in half
a string's length.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 20  # starts handled at a time, so memory doesn't follow the longest text


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the bytes data[i : i + gram] for every i, from prefix sums of a polynomial mod 2^64."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    if len(_tables.get("up", ())) < n + 1:
        size = max(1 << 16, 2 * n) if n < SEGMENT else n + 4096
        _tables["up"], _tables["down"] = _powers(size, _MULTIPLIER), _powers(size, _INVERSE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _tables["up"][:n], out=sums[1:])
    h = sums[gram:] - sums[: n - gram + 1]
    h *= _tables["down"][: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of key[i : i + width] for every i: doubling, then two overlapping halves."""
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def anchors(text: bytes, match: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of a text: its position, the first start it serves, and its gram's hash.

    It serves the starts from that one to just before the next anchor's first, or the last
    start, len(text) - match.
    """
    starts = len(text) - match + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    where, first, name = [], [], []
    last = -1
    for at in range(0, starts, SEGMENT):
        many = min(SEGMENT, starts - at)
        h = gram_hashes(data[at : at + many + match - 1], gram)
        # high half of the hash, then the position: the smallest key is the leftmost smallest
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        chosen = (_window_min(key, match - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[chosen[0] + at != last, chosen[1:] != chosen[:-1]])
        where.append(chosen[new] + at)
        first.append(new + at)
        # chosen hashes are small; mixed once more they are spread evenly
        name.append((h[chosen[new]] * np.uint64(0x9FB21C651E98DF25) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64))
        last = int(chosen[-1]) + at
    return np.concatenate(where), np.concatenate(first), np.concatenate(name)
