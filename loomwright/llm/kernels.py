"""Array kernels over the bytes of a block: words, fingerprints, rolling windows."""

from __future__ import annotations

import numpy as np

#: \x20 and \x09 to \x0D separate words, as bytes.split() has it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, _CHUNK) + 1, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * _CHUNK:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def prefix_codes(a: np.ndarray) -> np.ndarray:
    """Sums of code[a[i]] * base ** i before each place; spans() turns them into fingerprints."""
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_CODES[a] * _power(_BASE, len(a))[: len(a)], out=out[1:])
    return out


def spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte strings [start, end): equal strings have equal ones wherever they stand."""
    return mix((codes[ends] - codes[starts]) * _power(_INVERSE, len(codes))[starts] + (ends - starts).astype(np.uint64))


def words(a: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses a cut (ends of documents, ascending)."""
    space = SPACE[a]
    edge = np.ones(len(a) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[cuts] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = ~space[starts]
    return starts[keep], ends[keep]


def word_names(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word, chunk by chunk."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK)))
        base = starts[i]
        out[i:j] = spans(prefix_codes(a[base : ends[j - 1]]), starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def rolling(names: np.ndarray, width: int) -> np.ndarray:
    """A name of each run of width names, built from runs of powers of two; empty if there are fewer."""
    n = len(names) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor, size, power = 0xD1342543DE82EF95, 1, names
    out, done = None, 0
    while True:
        if width & size:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(factor, size, 1 << 64)) + part
            done += size
        if 2 * size > width:
            return mix(out + np.uint64(width))
        power = power[:-size] * np.uint64(pow(factor, size, 1 << 64)) + power[size:]
        size *= 2


def covered(flagged: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places a window [start, start + width) covers; the flagged starts are distinct and their windows lie within n."""
    step = np.zeros(n + 1, np.int32)
    step[flagged] += 1
    step[flagged + width] -= 1
    return np.cumsum(step[:-1]) > 0
