"""Words and n-grams of many texts at once, on the UTF-8 buffer of an Arrow array.

Hashes are polynomials mod 2**64 and differ for nearly all different strings; where a result
depends on equality, the caller compares the strings as well."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 20


def byte_set(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes outside space and \x09-\x0D.
NOT_SPACE = ~byte_set([(0x09, 0x0D), (0x20, 0x20)])
#: Bytes of words of letters and digits, all of a non-ASCII character included.
ALNUM = byte_set([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for base in (BASE, inverse):
            p = np.full(2 * BLOCK, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def word_spans(raw: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes within a text, and for each text (and the end) its first word."""
    inside = member[raw]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(raw):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = at[(at > 0) & (at < len(raw))]
        before[edges] = False
        after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP
    return h ^ (h >> np.uint64(29))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (sorted, not overlapping); works in blocks of about a MB."""
    power, inverse = _power_tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a > len(power):  # one span of over two MB
            out[i] = _long_hash(raw[a:b])
        else:
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def _long_hash(raw: np.ndarray) -> np.uint64:
    power, total, shift = _power_tables()[0], np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(0, len(raw), BLOCK):
            part = raw[i : i + BLOCK].astype(np.uint64) + np.uint64(1)
            total += shift * (part * power[: len(part)]).sum(dtype=np.uint64)
            shift *= power[BLOCK]
    return total


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n neighbours (texts' borders are the caller's affair)."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * BASE + h[j : j + m]
    return mix(out)


def room(first: np.ndarray, n: int) -> np.ndarray:
    """For each word whether n words from it on belong to its text."""
    counts = np.diff(first)
    end = np.repeat(first[1:], counts)
    return np.arange(len(end)) + n <= end
