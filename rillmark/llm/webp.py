"""Lossless WebP: a decoder of the whole format, and an encoder and a decoder for many byte rows at once.

`decode` reads prefix codes, meta prefix images, back-references and the colour cache, and inverts
the predictor, cross-colour, subtract-green and palette transforms; it gives a height x width x 4
array (red, green, blue, alpha). `encode_rows` writes bytes as grey images of 64 samples a row. Each
image gets the transforms that suit it (a palette for 16 different bytes or fewer; cross-colour and a
predictor, or subtract-green, whichever leaves the lower entropy), back-references, a colour cache where
it takes fewer bits, and prefix codes of its own. `decode_rows` reads the codes of many images from
their streams, then a symbol of each at a time; images that are not grey, or have groups of codes, go to `decode`.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

from rillmark.llm import prefixes
from rillmark.llm.prefixes import CODE_ORDER

ROW = 64
#: Rows of one image; more rows are several images one after another.
IMAGE_ROWS = 256
#: Near distances of the format as (x, y).
NEAR = """0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2
0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5
5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6
6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6
6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7
8,6 8,7"""
_NEAR = [tuple(map(int, p.split(","))) for p in NEAR.split()]


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        byte, shift = self.at >> 3, self.at & 7
        self.at += n
        if self.at > self.size + 32:
            raise ValueError("the image ends too early")
        return int.from_bytes(self.data[byte : byte + 8], "little") >> shift & ((1 << n) - 1)

    def symbol(self, code: dict) -> int:
        if (only := code.get("only")) is not None:
            return only
        window = self.read(15)
        self.at -= 15
        got = code["table"][window & code["mask"]]
        self.at += got >> 16
        return got & 0xFFFF


def canonical(lengths: list[int]) -> list[int]:
    """The bit-reversed canonical code word of each symbol (0 where it has none)."""
    code, out = 0, [0] * len(lengths)
    for n in range(1, 16):
        code <<= 1
        for s, x in enumerate(lengths):
            if x == n:
                out[s] = int(format(code, f"0{n}b")[::-1], 2)
                code += 1
    return out


def _lookup(lengths: list[int]) -> dict:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1:
        return {"only": used[0] if used else 0}
    longest = max(lengths)
    table = np.zeros(1 << longest, np.int64)
    if sum(1 << (longest - n) for n in lengths if n) != 1 << longest:
        raise ValueError("a prefix code is not complete")
    for s, word in enumerate(canonical(lengths)):
        if n := lengths[s]:
            table[word :: 1 << n] = n << 16 | s
    return {"table": table.tolist(), "mask": (1 << longest) - 1}


def _read_code(bits: Bits, alphabet: int) -> dict:
    if bits.read(1):
        count = bits.read(1) + 1
        first = bits.read(8 if bits.read(1) else 1)
        lengths = [0] * max(alphabet, 256)
        lengths[first] = 1
        if count == 2:
            lengths[bits.read(8)] = 1
        return _lookup(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[CODE_ORDER[k]] = bits.read(3)
    code = _lookup(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, before = [], 8
    while len(lengths) < alphabet and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths.append(s)
            before = s or before
        else:
            lengths += [before if s == 16 else 0] * (bits.read((2, 3, 7)[s - 16]) + (3, 3, 11)[s - 16])
    if len(lengths) > alphabet:
        raise ValueError("too many code lengths")
    return _lookup(lengths + [0] * (alphabet - len(lengths)))


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, main: bool, seen: set | None = None) -> list[int]:
    """Entropy-coded pixels as numbers 0xAARRGGBB. `seen` takes the names of the tools that are met."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, groups, block = 0, 1, [0]
    across = 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        block = [p >> 8 & 0xFFFF for p in _pixels(bits, across, -(-height >> shift), False)]
        groups = max(block) + 1
    sizes = (280 + len(cache), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    out: list[int] = []
    total, x, y = width * height, 0, 0
    group = codes[block[0]]
    while len(out) < total:
        if shift:
            x, y = len(out) % width, len(out) // width
            group = codes[block[(y >> shift) * across + (x >> shift)]]
        s = bits.symbol(group[0])
        if s < 256:
            red, blue, alpha = bits.symbol(group[1]), bits.symbol(group[2]), bits.symbol(group[3])
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _value(bits, s - 256)
            code = _value(bits, bits.symbol(group[4]))
            back = code - 120
            if code <= 120:
                dx, dy = _NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > len(out) or len(out) + length > total:
                raise ValueError("a back-reference leaves the image")
            new = [out[-back + k] if k < back else None for k in range(length)]
            for k in range(back, length):
                new[k] = new[k - back]
        else:
            new = [cache[s - 280]]
        if seen is not None and s >= 256:
            seen.add("back-reference" if s < 280 else "colour cache")
        out += new
        if cache_bits:
            for p in new:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


def _channels(pixels: list[int], width: int) -> np.ndarray:
    p = np.array(pixels, np.int64).reshape(-1, width)
    return np.stack([p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24], axis=2)


def _predict(kind: int, left, top, corner, right):  # noqa: ANN001
    mean = lambda a, b: (a + b) >> 1
    if kind in (1, 2, 3, 4):
        return (left, top, right, corner)[kind - 1]
    if kind == 11:
        near = np.abs(top - corner).sum() < np.abs(left - corner).sum()
        return left if near else top
    return {
        5: lambda: mean(mean(left, right), top),
        6: lambda: mean(left, corner),
        7: lambda: mean(left, top),
        8: lambda: mean(corner, top),
        9: lambda: mean(top, right),
        10: lambda: mean(mean(left, corner), mean(top, right)),
        12: lambda: np.clip(left + top - corner, 0, 255),
        13: lambda: np.clip(mean(left, top) + ((mean(left, top) - corner) / 2).astype(np.int64), 0, 255),
    }.get(kind, lambda: np.array([0, 0, 0, 255]))()


def _undo_predictor(image: np.ndarray, size: int, modes: np.ndarray) -> np.ndarray:
    height, width, _ = image.shape
    if (modes & 15 == 2).all():  # each sample from the one above
        image[0, 0, 3] += 255
        image[0] = np.cumsum(image[0], axis=0)
        return np.cumsum(image, axis=0) & 255
    for y in range(height):
        for x in range(width):
            if not x and not y:
                guess = np.array([0, 0, 0, 255])
            elif not y:
                guess = image[y, x - 1]
            elif not x:
                guess = image[y - 1, x]
            else:
                right = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
                guess = _predict(int(modes[y >> size, x >> size]) & 15, image[y, x - 1], image[y - 1, x], image[y - 1, x - 1], right)
            image[y, x] = (image[y, x] + guess) & 255
    return image


def _signed(a: np.ndarray) -> np.ndarray:
    return (a + 128) % 256 - 128


def _undo_cross_colour(image: np.ndarray, size: int, table: np.ndarray) -> np.ndarray:
    t = table.repeat(1 << size, axis=0).repeat(1 << size, axis=1)[: image.shape[0], : image.shape[1]]
    shifted = lambda a, b: _signed(a) * _signed(b) >> 5
    green = image[..., 1]
    red = (image[..., 0] + shifted(t[..., 2], green)) & 255
    image[..., 2] = (image[..., 2] + shifted(t[..., 1], green) + shifted(t[..., 0], red)) & 255
    image[..., 0] = red
    return image


def _opened(data: bytes, seen: set | None = None) -> tuple[Bits, int, int, list]:
    """A file's bits from its pixels on, their width and height, and the transforms to undo."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1) // 2 * 2
    bits = Bits(data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if seen is not None:
            seen.add(("predictor", "cross-colour", "subtract-green", "palette")[kind])
        if kind in (0, 1):
            size = bits.read(3) + 2
            sub = -(-coded >> size)
            table = _channels(_pixels(bits, sub, -(-height >> size), False), sub)
            undo.append((kind, size, table))
        elif kind == 2:
            undo.append((2, 0, None))
        else:
            n = bits.read(8) + 1
            palette = np.cumsum(_channels(_pixels(bits, n, 1, False), n)[0], axis=0) & 255
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((3, (packed, coded), palette))
            coded = -(-coded >> packed)
    return bits, coded, height, undo


def _undone(image: np.ndarray, undo: list) -> np.ndarray:
    for kind, size, table in reversed(undo):
        if kind == 0:
            image = _undo_predictor(image, size, table[..., 1])
        elif kind == 1:
            image = _undo_cross_colour(image, size, table)
        elif kind == 2:
            image[..., [0, 2]] = (image[..., [0, 2]] + image[..., 1:2]) & 255
        else:
            packed, full = size
            each = 8 >> packed
            index = image[..., 1]
            if packed:
                x = np.arange(full)
                index = index[:, x >> packed] >> (each * (x & ((1 << packed) - 1))) & ((1 << each) - 1)
            known = np.zeros((256, 4), np.int64)
            known[: len(table)] = table
            image = known[index]
    return image.astype(np.uint8)


def decode(data: bytes, seen: set | None = None) -> np.ndarray:
    """The pixel array of one lossless WebP file; `seen` takes the names of the tools that it uses."""
    bits, width, height, undo = _opened(data, seen)
    return _undone(_channels(_pixels(bits, width, height, True, seen), width), undo)


def code_lengths(weights: list[float], most: int) -> list[int]:
    """Lengths of an optimal prefix code, made flatter until none is over `most`."""
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weights) if w > 0]
        lengths = [0] * len(weights)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        heapq.heapify(heap)
        tie = len(weights)
        while len(heap) > 1:
            (a, _, p), (b, _, q) = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*p, *q):
                lengths[s] += 1
            heapq.heappush(heap, (a + b, tie, (*p, *q)))
            tie += 1
        if max(lengths) <= most:
            return lengths
        weights = [w and w**0.8 for w in weights]


class Writer:
    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> k & 1 for k in range(n)]

    def code(self, lengths: list[int]) -> None:
        """Writes the lengths of a prefix code with two symbols or more, runs shortened."""
        tokens, i = [], 0
        while i < len(lengths):
            j = i
            while j < len(lengths) and lengths[j] == lengths[i]:
                j += 1
            n = j - i
            if lengths[i] == 0:
                while n >= 3:
                    k = min(n, 138)
                    tokens.append((17, k - 3, 3) if k < 11 else (18, k - 11, 7))
                    n -= k
            else:
                tokens.append((lengths[i], 0, 0))
                n -= 1
                while n >= 3:
                    k = min(n, 6)
                    tokens.append((16, k - 3, 2))
                    n -= k
            tokens += [(lengths[i], 0, 0)] * n
            i = j
        own = code_lengths([float(sum(t[0] == s for t in tokens)) for s in range(19)], 7)
        words = canonical(own)
        single = sum(map(bool, own)) == 1
        self.put(0, 1)
        self.put(15, 4)
        for s in CODE_ORDER:
            self.put(own[s], 3)
        self.put(0, 1)
        for s, extra, n in tokens:
            if not single:
                self.put(words[s], own[s])
            self.put(extra, n)

    def one(self, symbol: int) -> None:
        """A code of one symbol, which takes no bits."""
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)


#: Bits of the colour cache (more never saved any on grey texts, README), and the fewest samples that a
#: back-reference copies.
CACHE_BITS, SHORTEST = 2, 4
#: Samples that are written and read together, and images of either: a step costs little more for many.
WRITTEN, READ, IMAGES = 1 << 21, 1 << 22, 1 << 14
#: The longest word of a code that is written, so that tables to read it are small.
WORD_BITS = 11
_AT = 22  # bits of a sample's place among those that are written together
#: Bits that each used symbol takes in the table of a code, about.
_SYMBOL_BITS = 5
_HASH = 0x1E35A7BD


def _prefixed(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance code."""
    x = value - 1
    if x < 4:
        return x, 0, 0
    high = x.bit_length() - 1
    return 2 * high + (x >> (high - 1) & 1), x & ((1 << (high - 1)) - 1), high - 1


@functools.cache
def _prefix_table() -> np.ndarray:
    """Those three of every length and distance code that an image can have."""
    return np.array([(0, 0, 0), *(_prefixed(v) for v in range(1, ROW * IMAGE_ROWS + 121))]).T


@functools.cache
def _near_codes() -> np.ndarray:
    """By the power of two that a palette narrows rows by: the code of each small distance, or 0."""
    out = np.zeros((4, 1024), np.int64)
    for packed in range(4):
        for k, (dx, dy) in reversed(list(enumerate(_NEAR))):
            if (back := dx + dy * (ROW >> packed)) > 0:
                out[packed, back] = k + 1
    return out


#: Smallest value and extra bits of each prefix symbol of a length or distance code.
_LEAST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(40)])
_EXTRA = np.array([0 if p < 4 else (p - 2) >> 1 for p in range(40)])
_BACK = np.array([(dx, dy) for dx, dy in _NEAR])


def _counted(w: Writer, symbols: list[int], alphabet: int) -> tuple[list[int], list[int]]:
    """Writes the prefix code of some symbols and gives its words and lengths."""
    weights = [0.0] * alphabet
    for x in symbols:
        weights[x] += 1
    if sum(map(bool, weights)) < 2:
        w.one(max(symbols))
        return [0] * alphabet, [0] * alphabet
    lengths = code_lengths(weights, 15)
    w.code(lengths)
    return canonical(lengths), lengths


def _constant(w: Writer, *channels: int) -> None:
    """An image of one pixel: green, red, blue, alpha."""
    w.put(0, 1)
    for x in (*channels, 0):
        w.one(x)


@functools.lru_cache(4096)
def _transforms(kind: int, colours: bytes = b"") -> list[tuple[int, int]]:
    """Values and bits of what stands between size and pixels: 0 subtract-green, 1 cross-colour and
    the predictor of the sample above, 2 a palette."""
    w = Writer()
    if kind == 0:
        w.put(1, 1), w.put(2, 2)
    elif kind == 1:
        w.put(1, 1), w.put(1, 2), w.put(7, 3), _constant(w, 32, 0, 32, 255)  # green goes to red and blue
        w.put(1, 1), w.put(0, 2), w.put(7, 3), _constant(w, 2, 0, 0, 255)
    else:
        w.put(1, 1), w.put(3, 2), w.put(len(colours) - 1, 8), w.put(0, 1)
        steps = [b - a & 255 for a, b in zip(b"\0" + colours, colours, strict=False)]
        codes = [_counted(w, steps, 280), _counted(w, steps, 256), _counted(w, steps, 256), _counted(w, [255, *[0] * (len(steps) - 1)], 256)]
        w.one(0)
        for k, x in enumerate(steps):
            for (words, lengths), y in zip(codes, (x, x, x, 0 if k else 255), strict=True):
                w.put(words[y], lengths[y])
    w.put(0, 1)
    return [(sum(b << k for k, b in enumerate(w.bits[i : i + 48])), len(w.bits[i : i + 48])) for i in range(0, len(w.bits), 48)]


def _bits_needed(counts: np.ndarray) -> np.ndarray:
    """The bits of each row's symbols by their entropy."""
    total = counts.sum(axis=1, keepdims=True)
    return (counts * np.log2(total / np.maximum(counts, 1))).sum(axis=1)


def _histogram(image: np.ndarray, symbols: np.ndarray, images: int, alphabet: int) -> np.ndarray:
    return np.bincount(image.astype(np.int32) * np.int32(alphabet) + symbols.astype(np.int32), minlength=images * alphabet).reshape(images, alphabet)


def _copies(data: np.ndarray, ends: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references of all images: first samples, lengths, distances. A sample refers to the nearest
    earlier place of the next four samples in its image, as long as those after it lie as far from
    theirs; of references that overlap, the first stays."""
    n, begins = len(data), np.append(0, ends[:-1])
    key = np.ndarray((n,), "<u4", np.append(data, np.zeros(SHORTEST - 1, np.uint8)), 0, (1,)).astype(np.uint64)
    key <<= np.uint64(_AT)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    at = (key & np.uint64((1 << _AT) - 1)).astype(np.int32)
    key >>= np.uint64(_AT)
    of = image.take(at)
    same = np.flatnonzero((key[1:] == key[:-1]) & (of[1:] == of[:-1]))
    del key, of
    here = at[same + 1]
    far = np.zeros(n + 1, np.int32)
    far[here] = here - at[same]
    for k in range(1, SHORTEST):
        far[ends - k] = 0  # fewer than four samples are left
    run = np.flatnonzero(np.diff(far, prepend=-1))
    size = np.diff(np.append(run, n + 1))
    length = np.minimum(np.repeat((run + size + SHORTEST - 1).astype(np.int32), size) - np.arange(n + 1, dtype=np.int32), 4096)
    where = np.flatnonzero(far)
    following = np.repeat(np.append(where, n).astype(np.int32), np.diff(np.concatenate([[-1], where, [n]])))  # the reference at a sample or after it
    taken, at, stop = [np.zeros(0, np.int64)], begins, ends
    while True:
        at = following.take(at)
        inside = at < stop
        if not inside.all():
            at, stop = at[inside], stop[inside]
            if not len(at):
                break
        taken.append(at)
        at = at + length.take(at)
    first = np.sort(np.concatenate(taken))
    return first, length[first].astype(np.int64), far[first].astype(np.int64)


def _cached(data: np.ndarray, image: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each sample in its image's colour cache, and whether the sample is there."""
    slots = np.array([[(_HASH * (a << 24 | g << 8) & 0xFFFFFFFF) >> (32 - CACHE_BITS) for g in range(256)] for a in (0, 255)], np.uint8)
    slot = slots.ravel().take(((alpha > 0).astype(np.uint16) * 256)[image] + data)
    key = slot.astype(np.uint32) << np.uint32(_AT) | np.arange(len(data), dtype=np.uint32)
    key.sort()
    at = key & np.uint32((1 << _AT) - 1)
    key >>= np.uint32(_AT)
    value, of = data.take(at), image.take(at)
    hit = np.zeros(len(data), bool)
    hit[at[1:]] = (value[1:] == value[:-1]) & (of[1:] == of[:-1]) & (key[1:] == key[:-1])
    return slot, hit


def _encode(parts: list[np.ndarray]) -> list[bytes]:
    """One WebP file of each part, of at most 64 * IMAGE_ROWS samples."""
    m, counts = len(parts), np.array([len(p) for p in parts])
    samples = np.concatenate(parts)
    image, ends = np.repeat(np.arange(m, dtype=np.uint16), counts), np.cumsum(counts)
    rows = samples.reshape(-1, ROW)
    above = np.diff(rows, axis=0, prepend=np.zeros((1, ROW), np.uint8))
    top = (ends - counts) // ROW
    above[top] = np.diff(rows[top], axis=1, prepend=np.zeros((len(top), 1), np.uint8))
    plain = _histogram(image, samples, m, 256)
    few = (plain > 0).sum(axis=1) <= 16
    kind = np.where(few, 2, _bits_needed(_histogram(image, above.ravel(), m, 256)) < _bits_needed(plain))
    alpha = np.where(kind == 1, 0, 255)
    data, narrow = np.where((kind == 1)[image], above.ravel(), samples), np.zeros(m, np.int64)
    colours = {int(i): np.flatnonzero(plain[i]) for i in np.flatnonzero(few)}
    if colours:
        all_parts = np.split(data, ends[:-1])
        for i, c in colours.items():
            narrow[i] = 3 if len(c) <= 2 else 2 if len(c) <= 4 else 1
            index = np.searchsorted(c, all_parts[i]).reshape(-1, 1 << narrow[i])
            all_parts[i] = (index << (np.arange(1 << narrow[i]) * (8 >> narrow[i]))).sum(axis=1).astype(np.uint8)
        data = np.concatenate(all_parts)
        image, ends = np.repeat(np.arange(m, dtype=np.uint16), counts >> narrow), np.cumsum(counts >> narrow)

    first, length, far = _copies(data, ends, image)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[first] += 1
    edge[first + length] -= 1
    literal = np.cumsum(edge[:-1], dtype=np.int8) == 0
    start = literal.copy()
    start[first] = True
    token = np.flatnonzero(start)
    of = image[token].astype(np.int64)
    copy = np.flatnonzero(~literal[token])
    symbols, extras, sizes = _prefix_table()
    near = _near_codes()[narrow[image[first]], np.minimum(far, 1023)]
    code = np.where((far < 1024) & (near > 0), near, far + 120)
    green = data[token].astype(np.int64)
    green[copy] = 256 + symbols[length]
    slot, hit = _cached(data, image, alpha)
    hit = hit[token]
    hit[copy] = False
    with_cache = np.where(hit, slot[token].astype(np.int64) + 280, green)
    size = 280 + (1 << CACHE_BITS)
    without, within = _histogram(of, green, m, size), _histogram(of, with_cache, m, size)
    cache = _bits_needed(within) + _SYMBOL_BITS * (within > 0).sum(axis=1) < _bits_needed(without) + _SYMBOL_BITS * (without > 0).sum(axis=1)
    green = np.where(cache[of], with_cache, green)
    lengths = prefixes.code_lengths(np.where(cache[:, None], within, without), WORD_BITS)
    words = prefixes.words(lengths)
    value, bits = words[of, green], lengths[of, green]
    referring = np.unique(of[copy])
    distances = np.zeros(m, bool)
    distances[referring] = True
    value[copy] |= extras[length] << bits[copy]
    bits[copy] += sizes[length]
    far_fields = (np.zeros(0, np.int64),) * 3
    if len(copy):
        row = np.searchsorted(referring, of[copy])
        far_lengths = prefixes.code_lengths(_histogram(row, symbols[code], len(referring), 40), WORD_BITS)
        far_words = prefixes.words(far_lengths)
        value[copy] |= (far_words[row, symbols[code]] | extras[code] << far_lengths[row, symbols[code]]) << bits[copy]
        bits[copy] += far_lengths[row, symbols[code]] + sizes[code]
        row, *rest = prefixes.code_fields(far_lengths, np.full(len(referring), 40))
        far_fields = (referring[row], *rest)
    every, ones = np.arange(m), np.ones(m, np.int64)
    heads = [(i, v, n) for i, k in enumerate(kind.tolist()) for v, n in _transforms(k, bytes(colours[i].tolist()) if k == 2 else b"")]
    sections = [
        (every, 0x2F | (ROW - 1) << 8 | (counts // ROW - 1) << 22, 40 * ones),
        tuple(np.array(x) for x in zip(*heads, strict=True)),
        (every, np.where(cache, 1 | CACHE_BITS << 1, 0), np.where(cache, 6, 2)),  # and one group of codes
        prefixes.code_fields(lengths, np.where(cache, size, 280)),
        (every, 5 | 5 << 11 | (5 | alpha << 3) << 22, 33 * ones),  # red, blue and alpha have one symbol each
        (every[~distances], 5 * ones[~distances], 11 * ones[~distances]),
        far_fields,
        (of, value, bits),
    ]
    return [_file(x) for x in prefixes.packed(sections, m)]


def _file(chunk: bytes) -> bytes:
    pad = b"\0" * (len(chunk) % 2)
    return b"".join([b"RIFF", struct.pack("<I", 12 + len(chunk) + len(pad)), b"WEBPVP8L", struct.pack("<I", len(chunk)), chunk, pad])


def encode_rows(payloads: list[np.ndarray]) -> list[bytes]:
    """Each payload (uint8, its length a positive multiple of 64) as one or more WebP files in a row."""
    out: list[list[bytes]] = [[] for _ in payloads]
    held, samples = [], 0

    def done() -> None:
        for (i, _), f in zip(held, _encode([p for _, p in held]), strict=True):
            out[i].append(f)

    for i, p in enumerate(payloads):
        for a in range(0, len(p), ROW * IMAGE_ROWS):
            held.append((i, p[a : a + ROW * IMAGE_ROWS]))
            samples += len(held[-1][1])
            if samples >= WRITTEN or len(held) >= IMAGES:
                done()
                held, samples = [], 0
    if held:
        done()
    return [b"".join(x) for x in out]


def encode_with_tools(payload: np.ndarray) -> bytes:
    """One WebP file of a payload of at most 64 * IMAGE_ROWS samples."""
    return encode_rows([payload])[0]


def files_in(media: bytes) -> list[bytes]:
    """The WebP files that stand one after another."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + n])
        at += n
    return out


def _simple(bits: prefixes.Windows, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a simple code of one symbol stands at each bit, that symbol, and the bit after it."""
    x = bits(pos)
    wide = x >> 2 & 1
    return x & 3 == 1, x >> 3 & np.where(wide, 255, 1), pos + np.where(wide, 11, 4)


def _expanded(image: np.ndarray, symbol: np.ndarray, length: np.ndarray, code: np.ndarray, widths: np.ndarray, totals: np.ndarray, cache_bits: np.ndarray, pixel: np.ndarray) -> np.ndarray:
    """The samples of all images one after another, from their tokens (image, symbol, length, distance code)."""
    order = np.argsort(image.astype(np.uint16), kind="stable")
    image, symbol, length, code = image[order], symbol[order], length[order], code[order]
    if (np.bincount(image, length, len(totals)) != totals).any():
        raise ValueError("a back-reference leaves the image")
    slow = np.unique(image[symbol >= 280])
    copy = np.flatnonzero(code)
    near = _BACK[np.minimum(code[copy], 120) - 1]
    back = np.zeros(len(code), np.int32)
    back[copy] = np.where(code[copy] > 120, code[copy] - 120, np.maximum(1, near[:, 0] + near[:, 1] * widths[image[copy]]))
    begins = np.cumsum(totals) - totals
    if (np.cumsum(length) - length - back < begins[image]).any():
        raise ValueError("a back-reference leaves the image")
    back, symbol = np.repeat(back, length), np.repeat(symbol.astype(np.uint16), length)
    del image, order, code
    source = np.arange(len(back), dtype=np.int32)
    source -= back
    out = symbol.astype(np.uint8)
    # images that refer to their colour cache need each sample before the next
    if len(slow):
        slow = slow[np.argsort(-totals[slow], kind="stable")]
        size = totals[slow]
        slots = ((_HASH * (pixel[slow][:, None] | np.arange(256) << 8) & 0xFFFFFFFF) >> (32 - cache_bits[slow])[:, None]).ravel()
        room = 1 << int(cache_bits[slow].max())
        cache, at, own = np.zeros(len(slow) * room, np.int64), np.arange(len(slow)) * room, np.arange(len(slow)) * 256
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # images with more samples than the step
        for t in range(int(size[0])):
            k = active[t]
            i = begins[slow[:k]] + t
            v = np.where(back[i] > 0, out[source[i]], symbol[i]).astype(np.int64)
            v = np.where(v >= 280, cache[at[:k] + np.maximum(v, 280) - 280], v)
            out[i] = v
            cache[at[:k] + slots[own[:k] + v]] = v
        finished = np.zeros(len(totals), bool)
        finished[slow] = True
        finished = np.flatnonzero(np.repeat(finished, totals))
        source[finished] = finished
        back[finished] = 0
    copied = np.flatnonzero(back)
    one = source[copied]
    waiting = np.arange(len(copied))
    while len(waiting):
        two = source[one[waiting]]
        moved = two != one[waiting]
        waiting, two = waiting[moved], two[moved]
        one[waiting] = two
        source[copied[waiting]] = two
    out[copied] = out[one]
    return out


def _decode(images: list[tuple[Bits, int, int, list]]) -> list[np.ndarray | None]:
    """The samples of opened files; none of those that are not grey or have groups of codes."""
    out: list[np.ndarray | None] = [None] * len(images)
    starts = np.cumsum([0, *(len(b.data) for b, *_ in images)])
    bits = prefixes.Windows(b"".join(b.data for b, *_ in images))
    which, stop = np.arange(len(images)), starts[1:] * 8
    pos = starts[:-1] * 8 + np.array([b.at for b, *_ in images])
    x = bits(pos)
    cache_bits = np.where(x & 1, x >> 1 & 15, 0)
    pos = pos + np.where(x & 1, 5, 1)
    good = (bits(pos) & 3 == 0) & (cache_bits <= 11) & (cache_bits >= (x & 1))  # one group, and a code that is not simple
    which, pos, cache_bits = which[good], pos[good] + 1, cache_bits[good]
    if not len(which):
        return out
    lengths, pos = prefixes.read_codes(bits, pos, 280 + np.where(cache_bits > 0, 1 << cache_bits, 0))
    good, pixel = np.ones(len(which), bool), np.zeros(len(which), np.int64)
    for shift in (16, 0, 24):
        simple, symbol, pos = _simple(bits, pos)
        good &= simple
        pixel |= symbol << shift
    simple, only, after = _simple(bits, pos)
    good &= simple | (bits(pos) & 1 == 0)
    which, pos, cache_bits, lengths, pixel, simple, only, after = (v[good] for v in (which, pos, cache_bits, lengths, pixel, simple, only, after))
    if not len(which):
        return out
    far = np.zeros((len(which), 40), np.int64)
    far[simple, np.minimum(only[simple], 39)] = 1
    pos = np.where(simple, after, pos)
    if not simple.all():
        far[~simple], pos[~simple] = prefixes.read_codes(bits, pos[~simple], np.full(int((~simple).sum()), 40))
    greens, base, shift = prefixes.tables(lengths)
    fars, far_base, far_shift = prefixes.tables(far)
    turn = prefixes.reversed_bits()
    widths, totals = (np.array([f(images[i]) for i in which]) for f in (lambda h: h[1], lambda h: h[1] * h[2]))
    who, left, stop = np.arange(len(which), dtype=np.int32), totals.copy(), stop[which]
    tokens, copies, n_tokens = [], [], 0
    while True:
        x = bits(pos)
        got = greens.take(base + (turn.take(x & 32767) >> shift))
        pos += got >> 16
        got &= 0xFFFF
        copy = ((got - 256).view(np.uint32) < 24).nonzero()[0]
        left -= 1
        tokens.append((who, got))
        if len(copy):
            prefix = got.take(copy) - 256
            at = pos.take(copy)
            x, n = bits(at), _EXTRA.take(prefix)
            length = _LEAST.take(prefix) + (x & ((1 << n) - 1))
            x >>= n
            word = fars.take(far_base.take(copy) + (turn.take(x & 32767) >> far_shift.take(copy)))
            n += word >> 16
            x >>= word >> 16
            more = _EXTRA.take(word & 0xFFFF)
            copies.append((copy + n_tokens, length, _LEAST.take(word & 0xFFFF) + (x & ((1 << more) - 1))))
            pos[copy] = at + n + more
            left[copy] -= length - 1
        n_tokens += len(who)
        if left.min() <= 0:
            if (pos > stop).any():
                raise ValueError("the image ends too early")
            more = left > 0
            who, left, pos, stop, base, shift, far_base, far_shift = (v[more] for v in (who, left, pos, stop, base, shift, far_base, far_shift))
            if not len(who):
                break
    image, symbol = (np.concatenate(x) for x in zip(*tokens, strict=True))
    length, code = np.ones(n_tokens, np.int32), np.zeros(n_tokens, np.int32)
    if copies:
        at, size, far_code = (np.concatenate(x) for x in zip(*copies, strict=True))
        length[at], code[at] = size, far_code
    del tokens, copies
    data = _expanded(image, symbol, length, code, widths, totals, cache_bits, pixel)
    for i, n, end, p in zip(which.tolist(), totals.tolist(), np.cumsum(totals).tolist(), pixel.tolist(), strict=True):
        _, width, _, undo = images[i]
        green = data[end - n : end]
        if any(kind != 2 for kind, *_ in undo):
            square = np.empty((n // width, width, 4), np.int64)
            square[...] = (p >> 16 & 255, 0, p & 255, p >> 24)
            square[..., 1] = green.reshape(-1, width)
            green = _undone(square, undo)[..., 1].ravel()
        out[i] = green
    return out


def decode_rows(media: list[bytes]) -> list[np.ndarray]:
    """The samples (green, in reading order) of each run of WebP files."""
    files = [files_in(m) for m in media]
    every = [f for x in files for f in x]
    done: list[np.ndarray] = []
    held, samples = [], 0
    for k, f in enumerate(every):
        held.append(_opened(f))
        samples += held[-1][1] * held[-1][2]
        if samples >= READ or len(held) >= IMAGES or k == len(every) - 1:
            try:
                found = _decode(held)
            except IndexError:
                raise ValueError("the image ends too early") from None
            done += [decode(every[len(done) + j])[..., 1].ravel() if x is None else x for j, x in enumerate(found)]
            held, samples = [], 0
    rest = iter(done)
    return [np.concatenate([next(rest) for _ in x]) for x in files]
