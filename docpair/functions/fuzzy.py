"""Likeness of short strings, from 0 to 100: by longest common subsequences, of token sets, and of the best part."""

from __future__ import annotations

from functools import lru_cache


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: bits of a number stand for the letters of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def likeness(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 100 for two empty strings."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_part(a: str, b: str) -> float:
    """The greatest likeness of the shorter string to a stretch of the longer one of its length, or to what of such a stretch lies inside."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    best = max(likeness(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))
    if len(a) == len(b):
        best = max(best, *(likeness(long, short[max(0, i) : i + n]) for i in range(1 - n, n)))
    return best


def token_sets(a: str, b: str) -> float:
    """Likeness of the common words with and without those of either side; 100 if one side has only common words."""
    left, right = set(a.split()), set(b.split())
    both, rest_a, rest_b = left & right, " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if not left or not right:
        return 0.0
    if both and not (rest_a and rest_b):
        return 100.0
    base = len(" ".join(sorted(both)))
    gap = 1 if both else 0
    size_a, size_b = base + gap + len(rest_a), base + gap + len(rest_b)
    apart = len(rest_a) + len(rest_b) - 2 * common(rest_a, rest_b)
    out = 100.0 - 100.0 * apart / (size_a + size_b)
    if both:
        out = max(out, 100.0 - 100.0 * (gap + len(rest_a)) / (base + size_a), 100.0 - 100.0 * (gap + len(rest_b)) / (base + size_b))
    return out


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> float:
    return max(token_sets(a, b), best_part(a, b))
