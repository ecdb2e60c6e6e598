"""Words and shingles of many texts at once, as 64-bit hashes of their bytes, with numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    if len(_cache.get("p", ())) < n:
        m = max(n, 1 << 20) + 1024
        _cache["p"] = _powers(_BASE, m)
        _cache["q"] = _powers(pow(_BASE, -1, 1 << 64), m)
    return _cache["p"][:n], _cache["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Cumulative polynomial hash with a leading 0, so that a slice's hash is a difference."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * p[: len(data)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, q = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64) * _U(0x9FB21C651E98DF25))


def word_table(separators: bytes) -> np.ndarray:
    """256 booleans: whether a byte belongs to a word."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of the texts data[offsets[i]:offsets[i + 1]]."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    here, before = inside[1:], inside[:-1]
    return np.flatnonzero(here & (~before | first)), np.flatnonzero(before & (~here | first))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts data[offsets[i]:offsets[i + 1]], lower-cased in A-Z, and
    n + 1 offsets into the words. Words never cross texts."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    start, end = word_bounds(low, offsets, table)
    h = slice_hash(prefix_hash(low), start, end)
    return h, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of `width` words within a text, a shorter text's whole sequence as one
    (none for a text without words), and n + 1 offsets. Repeats are kept."""
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    total = int(out[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[:-1] - out[:-1], made)
    left = np.repeat(offsets[1:], made) - at
    acc = np.zeros(total, np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for j in range(width):
        odd = _U((0xD6E8FEB86659FD93 * (2 * j + 1) + (j << 33)) & (2**64 - 1) | 1)
        term = padded[at + j] * odd
        term = np.bitwise_xor(term, term >> _U(29))
        acc += np.where(left > j, term, _U(0)) if j else term
    short = np.minimum(left, width).astype(np.uint64)
    return mix(acc + short * _U(0xA24BAED4963EE407)), out
