"""Prefix codes of many streams at once: each row of a table is the alphabet of one stream.

Codes are optimal, canonical and read from the lowest bit on, as lossless WebP has them. Building codes,
writing and reading them and the fields between them take a step per symbol for all streams together.
"""

from __future__ import annotations

import functools

import numpy as np

#: Order in which the lengths of the code length code stand.
CODE_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
LONGEST = 15
_U = np.uint64
_FAR = 1 << 40
#: Extra bits and smallest count of the code length symbols.
_MORE = np.array([0] * 16 + [2, 3, 7])
_LEAST = np.array([1] * 16 + [3, 3, 11])


@functools.cache
def reversed_bits() -> np.ndarray:
    """Each number of 15 bits with its bits the other way round."""
    x, out = np.arange(1 << LONGEST), np.zeros(1 << LONGEST, np.int64)
    for k in range(LONGEST):
        out |= (x >> k & 1) << (LONGEST - 1 - k)
    return out


def _optimal(weights: np.ndarray) -> np.ndarray:
    """Code lengths by two queues in each row: symbols by weight, and sums in the order they are made."""
    rows, alphabet = weights.shape
    key = np.sort(np.where(weights > 0, weights, _FAR) << 9 | np.arange(alphabet), axis=1)
    used = (weights > 0).sum(axis=1)
    rank = np.argsort(-used, kind="stable")
    key, used = key[rank], used[rank]
    n = int(used[0])
    wide = 2 * n + 2  # symbols and one that is never taken, then sums
    weight = np.full((rows, wide), _FAR << 9)
    weight[:, :n] = key[:, :n] >> 9
    weight[:, n] = _FAR
    weight, parent = weight.ravel(), np.zeros(rows * wide, np.int64)
    base = np.arange(rows) * wide
    one, two = base.copy(), base + n + 1
    active = np.searchsorted(-used, -np.arange(n + 2), "right")  # rows with that many symbols
    for s in range(n - 1):
        k = active[s + 2]
        x, y, total = one[:k], two[:k], 0
        for _ in range(2):
            a, b = weight[x], weight[y]
            symbol = a <= b
            parent[np.where(symbol, x, y)] = s
            total = total + np.minimum(a, b)
            x += symbol
            y += ~symbol
        weight[base[:k] + n + 1 + s] = total
    depth = np.zeros((rows, n), np.int64)
    for s in range(n - 3, -1, -1):
        k = active[s + 3]
        depth[:k, s] = depth[np.arange(k), parent[base[:k] + n + 1 + s]] + 1
    row, column = np.nonzero(np.arange(n) < used[:, None])
    out = np.zeros((rows, alphabet), np.int64)
    out[rank[row], key[row, column] & 511] = depth[row, parent[base[row] + column]] + 1
    return out


def code_lengths(weights: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code for each row of weights (0: no word), flatter where one would
    be over `most`. A row with fewer than two symbols gets others, so that each has a word."""
    weights = weights.astype(np.int64)
    for symbol in (0, 1):
        few = (weights > 0).sum(axis=1) < 2
        weights[few, symbol] = np.maximum(weights[few, symbol], 1)
    out, todo = np.zeros(weights.shape, np.int64), np.arange(len(weights))
    while len(todo):
        got = _optimal(weights)
        good = got.max(axis=1) <= most
        out[todo[good]] = got[good]
        todo, weights = todo[~good], (weights[~good] + 1) // 2
    return out


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, symbol and length of all words by row, length and symbol, and the words from the left."""
    row, symbol = np.nonzero(lengths)
    key = np.sort(row << 13 | lengths[row, symbol] << 9 | symbol)
    row, n, symbol = key >> 13, key >> 9 & 15, key & 511
    size = 1 << (LONGEST - n)
    before = np.cumsum(size) - size
    return row, symbol, n, before - before[np.searchsorted(row, row)]


def words(lengths: np.ndarray) -> np.ndarray:
    """The canonical words of each row, lowest bit first (0 where there is none)."""
    row, symbol, _, left = _canonical(lengths)
    out = np.zeros(lengths.shape, np.int64)
    out[row, symbol] = reversed_bits()[left]
    return out


def tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For reading: entries length << 16 | symbol, each row's first entry, and how far the next 15 bits, turned
    round, are shifted to give the place after it. One symbol alone takes no bits."""
    lengths = lengths.copy()
    lengths[lengths.max(axis=1) == 0, 0] = 1
    row, symbol, n, _ = _canonical(lengths)
    longest = lengths.max(axis=1)
    alone = np.bincount(row, minlength=len(lengths)) == 1
    longest[alone], n = 0, np.where(alone[row], 0, n)
    size = 1 << (longest[row] - n)
    if (np.bincount(row, size, len(lengths)) != 1 << longest).any():
        raise ValueError("a prefix code is not complete")
    return np.repeat((n << 16 | symbol).astype(np.int32), size), np.cumsum(1 << longest) - (1 << longest), LONGEST - longest


Fields = tuple[np.ndarray, np.ndarray, np.ndarray]


def code_fields(lengths: np.ndarray, alphabet: np.ndarray) -> Fields:
    """The fields (stream, value, bits) that write the code of each row, of so many symbols, zeros in runs."""
    rows = len(lengths)
    flat = lengths[np.arange(lengths.shape[1]) < alphabet[:, None]]
    row = np.repeat(np.arange(rows), alphabet)
    new = (flat > 0) | (np.diff(flat, prepend=1) != 0) | (np.diff(row, prepend=-1) != 0)
    first = np.flatnonzero(new)
    n, value, row = np.diff(np.append(first, len(flat))), flat[first], row[first]
    full, rest = np.where(value > 0, 0, n // 138), np.where(value > 0, 1, n % 138)
    count = full + np.where(rest >= 3, 1, rest)
    of = np.repeat(np.arange(len(first)), count)
    j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    value, rest, row = value[of], rest[of], row[of]
    rest = np.where(j < full[of], 138, np.where(rest >= 3, rest, 1))
    symbol = np.where(value > 0, value, np.where(rest >= 11, 18, np.where(rest >= 3, 17, 0)))
    extra = np.where(symbol > 16, rest - _LEAST[symbol], 0)
    own = code_lengths(np.bincount(row * 19 + symbol, minlength=rows * 19).reshape(rows, 19), 7)
    word = words(own)
    table = (own[:, CODE_ORDER] << 3 * np.arange(19)).sum(axis=1)  # and a bit 0: lengths for all symbols
    all_rows = np.arange(rows)
    taken = own[row, symbol]
    return np.concatenate([all_rows, all_rows, row]), np.concatenate([np.full(rows, 30), table, word[row, symbol] | extra << taken]), np.concatenate([np.full(rows, 5), np.full(rows, 58), taken + _MORE[symbol]])


def packed(sections: list[Fields], streams: int) -> list[bytes]:
    """The bytes of each stream: its fields of each section, in order. A field has less than 64 bits."""
    row, value, n = (np.concatenate(x) for x in zip(*sections, strict=True))
    order = np.argsort(row.astype(np.uint16), kind="stable")
    row, value, n = row[order], value[order].astype(_U), n[order]
    ends = np.cumsum(n)
    last = np.append(0, ends)[np.searchsorted(row, np.arange(streams + 1))]
    total = np.diff(last)
    base = np.append(0, np.cumsum(-(-total // 64)))
    at = ends - n - last[row] + base[row] * 64
    word, shift = at >> 6, (at & 63).astype(_U)
    high = np.where(shift > 0, value >> (_U(64) - np.maximum(shift, _U(1))), _U(0))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(base[-1] + 2, _U)
    out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(high, first)
    data = out.tobytes()
    return [data[8 * b : 8 * b + (t + 7) // 8] for b, t in zip(base[:-1].tolist(), total.tolist(), strict=True)]


class Windows:
    """The 57 bits and more that follow each bit of some bytes."""

    def __init__(self, data: bytes):
        data = np.frombuffer(data + b"\0" * 64, np.uint8)
        self.at = np.ascontiguousarray(np.ndarray((len(data) - 8,), "<i8", data, 0, (1,)))

    def __call__(self, pos: np.ndarray) -> np.ndarray:
        """As signed numbers: the bits above the 57th are not to be used."""
        return self.at.take(pos >> 3) >> (pos & 7)


def read_codes(bits: Windows, pos: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reads a code that is not a simple one at each bit: lengths by row, and the bits after it."""
    rows = len(pos)
    count = 4 + (bits(pos) >> 1 & 15)
    own = np.zeros((rows, 19), np.int64)
    own[:, CODE_ORDER] = np.where(np.arange(19) < count[:, None], bits(pos + 5)[:, None] >> 3 * np.arange(19) & 7, 0)
    pos = pos + 5 + 3 * count
    limited = bits(pos) & 1
    size = 2 + 2 * (bits(pos + 1) & 7)
    left = np.where(limited, 2 + (bits(pos + 4) & ((1 << size) - 1)), alphabet)
    pos = pos + np.where(limited, 4 + size, 1)
    table, base, shift = tables(own)
    turn, filled, who = reversed_bits(), np.zeros(rows, np.int64), np.arange(rows)
    taken = []
    while len(who := who[(filled[who] < alphabet[who]) & (left[who] > 0)]):
        x = bits(pos[who])
        got = table[base[who] + (turn[x & 32767] >> shift[who])]
        n, s = got >> 16, got & 0xFFFF
        times = _LEAST[s] + (x >> n & ((1 << _MORE[s]) - 1))
        pos[who] += n + _MORE[s]
        filled[who] += times
        left[who] -= 1
        taken.append((who, s, times))
    if (filled > alphabet).any():
        raise ValueError("too many code lengths")
    row, s, times = (np.concatenate(x) for x in zip(*taken, strict=True))
    order = np.argsort(row.astype(np.uint16), kind="stable")
    row, s, times = row[order], s[order], times[order]
    known = np.maximum.accumulate(np.where((s > 0) & (s < 16), np.arange(len(s)), -1))  # the last length that is not 0
    before = np.where((known >= 0) & (row[known] == row), s[known], 8)
    value = np.repeat(np.where(s < 16, s, np.where(s == 16, before, 0)), times)
    out = np.zeros((rows, int(alphabet.max())), np.int64)
    out[np.arange(out.shape[1]) < filled[:, None]] = value
    return out, pos
