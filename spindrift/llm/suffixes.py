"""Front-coded sorted runs and their merge with a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known to agree."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:  # agree up to low, differ before high
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_code(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of a sorted list: each key's common prefix with the one before it, and what follows."""
    shared, tails, last = [], [], b""
    for k in keys:
        n = common_prefix(last, k)
        shared.append(n)
        tails.append(k[n:])
        last = k
    return shared, tails


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """Merge front-coded runs: (key, common prefix with the key given before, run, place in the run).

    Every contender keeps its common prefix with the last winner it met. The longer prefix
    wins unseen; only equal ones are compared, from the first byte that isn't known.
    """
    n = len(runs)
    if not n:
        return
    size = 1
    while size < n:
        size *= 2
    key: list[bytes] = [b""] * size
    known = [-1] * size  # -1: the run is at its end
    place = [-1] * size

    def advance(r: int) -> None:
        place[r] += 1
        shared, tails = runs[r]
        if place[r] < len(tails):
            known[r] = shared[place[r]]
            key[r] = key[r][: known[r]] + tails[place[r]]
        else:
            known[r], key[r] = -1, b""

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then the one with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = key[a], key[b]
        p = common_prefix(x, y, known[a])
        if x[p : p + 1] < y[p : p + 1] or (p == len(x) == len(y) and a < b):
            known[b] = p
            return a, b
        known[a] = p
        return b, a

    for r in range(n):
        advance(r)
        known[r] = 0 if known[r] >= 0 else -1
    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while known[best] >= 0:
        yield key[best], known[best], best, place[best]
        advance(best)
        node = (best + size) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
