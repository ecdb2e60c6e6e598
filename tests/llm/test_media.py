import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from rillmark.llm import media, prefixes, webp
from tests.llm.fixtures import corpus, documents


def file_of(w):
    body = np.packbits(np.array(w.bits, np.uint8), bitorder="little").tobytes()
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def start(width, height):
    w = webp.Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    return w


FLAT = [8] * 256


def flat_codes(w, extra=0, cache=0, distance=0):
    """Literal codes of 8 bits each (9 where the green alphabet also has other symbols)."""
    green = FLAT + [0] * 24 if not extra and not cache else [9] * 256 + [5] * 16 + [0] * 8
    if cache:
        green = [9] * 256 + [0] * 24 + [2] * 2
    w.code(green)
    for _ in range(3):
        w.code(FLAT)
    w.one(0) if not distance else w.code([5] * 32 + [0] * 8)
    return webp.canonical(green), green


def put_pixel(w, words, lengths, p):
    r, g, b, a = (int(x) for x in p)
    w.put(words[g], lengths[g])
    flat = webp.canonical(FLAT)
    for x in (r, b, a):
        w.put(flat[x], 8)


def plain(w, pixels):
    w.put(0, 1), w.put(0, 1)
    words, lengths = flat_codes(w)
    for p in pixels:
        put_pixel(w, words, lengths, p)
    return w


def sub_image(w, pixels):
    w.put(0, 1)
    words, lengths = flat_codes(w)
    for p in pixels:
        put_pixel(w, words, lengths, p)


RNG = np.random.default_rng(4)
IMAGE = RNG.integers(0, 256, (7, 9, 4)).astype(np.int64)


def test_literals():
    w = start(9, 7)
    w.put(0, 1)
    assert (webp.decode(file_of(plain(w, IMAGE.reshape(-1, 4)))) == IMAGE).all()


def test_predictor_modes():
    height, width = IMAGE.shape[:2]
    for mode in range(14):
        residual = IMAGE.copy()
        for y in range(height):
            for x in range(width):
                if not x and not y:
                    guess = np.array([0, 0, 0, 255])
                elif not y:
                    guess = IMAGE[y, x - 1]
                elif not x:
                    guess = IMAGE[y - 1, x]
                else:
                    a, b, c = IMAGE[y, x - 1], IMAGE[y - 1, x], IMAGE[y - 1, x - 1]
                    d = IMAGE[y - 1, x + 1] if x + 1 < width else IMAGE[y, 0]
                    half = (a + b) // 2
                    guess = [np.array([0, 0, 0, 255]), a, b, d, c, ((a + d) // 2 + b) // 2, (a + c) // 2, half, (c + b) // 2, (b + d) // 2, ((a + c) // 2 + (b + d) // 2) // 2, a if sum(abs(b - c)) < sum(abs(a - c)) else b, np.clip(a + b - c, 0, 255), np.clip(half + np.array([int((h - k) / 2) for h, k in zip(half, c, strict=True)]), 0, 255)][mode]
                residual[y, x] = (IMAGE[y, x] - guess) % 256
        w = start(width, height)
        w.put(1, 1), w.put(0, 2), w.put(2, 3)
        sub_image(w, [(0, mode, 0, 0)])
        w.put(0, 1)
        assert (webp.decode(file_of(plain(w, residual.reshape(-1, 4)))) == IMAGE).all(), mode


def test_cross_colour_and_subtract_green():
    g2r, g2b, r2b = 40, 200, 131
    s = lambda v: (v + 128) % 256 - 128
    coded = IMAGE.copy()
    coded[..., 0] = (IMAGE[..., 0] - (s(g2r) * s(IMAGE[..., 1]) >> 5)) % 256
    coded[..., 2] = (IMAGE[..., 2] - (s(g2b) * s(IMAGE[..., 1]) >> 5) - (s(r2b) * s(IMAGE[..., 0]) >> 5)) % 256
    coded[..., 0] = (coded[..., 0] - coded[..., 1]) % 256
    coded[..., 2] = (coded[..., 2] - coded[..., 1]) % 256
    w = start(9, 7)
    w.put(1, 1), w.put(1, 2), w.put(2, 3)
    sub_image(w, [(r2b, g2b, g2r, 255)])
    w.put(1, 1), w.put(2, 2), w.put(0, 1)
    assert (webp.decode(file_of(plain(w, coded.reshape(-1, 4)))) == IMAGE).all()


@pytest.mark.parametrize("colours", [2, 4, 16, 40])
def test_palette(colours):
    palette = RNG.integers(0, 256, (colours, 4)).astype(np.int64)
    index = RNG.integers(0, colours, (5, 11))
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each, wide = 8 >> packed, -(-11 >> packed)
    coded = np.zeros((5, wide, 4), np.int64)
    for y in range(5):
        for x in range(11):
            coded[y, x >> packed, 1] |= int(index[y, x]) << (each * (x & ((1 << packed) - 1)))
    w = start(11, 5)
    w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
    sub_image(w, np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.int64)) % 256)
    w.put(0, 1)
    assert (webp.decode(file_of(plain(w, coded.reshape(-1, 4)))) == palette[index]).all()


def test_back_references_near_and_far_and_overlapping():
    a, b, c = IMAGE[0, 0], IMAGE[0, 1], IMAGE[0, 2]
    w = start(40, 5)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    words, lengths = flat_codes(w, extra=1, distance=1)
    dist = webp.canonical([5] * 32)
    for p in (a, b, c):
        put_pixel(w, words, lengths, p)
    # length 37 = 33 + 4 (prefix 10, four bits), code 2 is (1, 0): one pixel back, repeated
    w.put(words[256 + 10], 5), w.put(4, 4), w.put(dist[1], 5)
    # 40 pixels (prefix 10, 7) from the row above: code 1 is (0, 1)
    w.put(words[256 + 10], 5), w.put(7, 4), w.put(dist[0], 5)
    # 120 pixels (97 + 23: prefix 13, five bits) from 80 back: code 200 = 193 + 7 (prefix 15, six bits)
    w.put(words[256 + 13], 5), w.put(23, 5), w.put(dist[15], 5), w.put(7, 6)
    row = np.array([a, b] + [c] * 38)
    assert (webp.decode(file_of(w)) == np.stack([row] * 5)).all()


def test_colour_cache_and_groups_of_codes():
    a, b = IMAGE[0, 0], IMAGE[0, 1]
    key = lambda p: (0x1E35A7BD * (int(p[3]) << 24 | int(p[0]) << 16 | int(p[1]) << 8 | int(p[2])) & 0xFFFFFFFF) >> 31
    w = start(4, 1)
    w.put(0, 1), w.put(1, 1), w.put(1, 4), w.put(0, 1)
    words, lengths = flat_codes(w, cache=1)
    put_pixel(w, words, lengths, a), put_pixel(w, words, lengths, b)
    slots = {key(a): a} | {key(b): b}
    want = [a, b]
    for p in (b, b):
        w.put(words[280 + key(p)], lengths[280 + key(p)])
        want.append(slots[key(p)])
    assert (webp.decode(file_of(w)) == np.array([want])).all()
    w = start(8, 4)
    w.put(0, 1), w.put(0, 1), w.put(1, 1), w.put(0, 3)
    sub_image(w, [(0, 0, 0, 0), (0, 1, 0, 0)])
    flat_codes(w)
    for s in (1, 2, 3, 4, 0):
        w.one(s)
    words = webp.canonical(FLAT)
    for y in range(4):
        for x in range(4):
            put_pixel(w, words, FLAT, IMAGE[y, x])
    out = webp.decode(file_of(w))
    assert (out[:, 4:] == [2, 1, 3, 4]).all() and (out[:, :4] == IMAGE[:4, :4]).all()


def test_rows_round_trip_in_step_and_one_by_one():
    payloads = [RNG.integers(0, 256, 64 * n).astype(np.uint8) for n in (1, 3, 256, 257, 700)]
    stored = webp.encode_rows(payloads)
    assert [x.tobytes() for x in webp.decode_rows(stored)] == [p.tobytes() for p in payloads]
    grey = webp.decode(stored[1])
    assert (grey[..., 0].ravel() == payloads[1]).all() and (grey[..., 2] == grey[..., 1]).all() and (grey[..., 3] == 255).all()
    w = start(9, 7)
    w.put(0, 1)
    other = file_of(plain(w, IMAGE.reshape(-1, 4)))
    assert (webp.decode_rows([other, stored[0]])[0] == IMAGE[..., 1].ravel()).all()


def test_damaged_files():
    for bad in (b"RIFF\0\0\0\0WAVE", webp.encode_rows([np.zeros(64, np.uint8)])[0][:30]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_documents(spark):
    rows = corpus()
    out = media.describe(media.store(documents(spark, rows))).collect()
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == sorted(want)
    assert len({(r.media_sha256, r.feature) for r in out}) == len({r.payload_sha256 for r in out})
    assert media.describe(media.store(documents(spark, []))).count() == 0


def padded(b):
    x = np.zeros(max(64, -(-len(b) // 64) * 64), np.uint8)
    x[: len(b)] = np.frombuffer(b, np.uint8)
    return x


def test_stored_images_use_and_survive_every_tool():
    r = np.random.default_rng(2)
    texts = [b"", b"a", b"abab" * 700, b"one line of a list\n" * 2000, bytes(range(256)) * 70, b"".join(b"%-64d" % k for k in range(300))]
    texts += [r.integers(0, 256, 20_000).astype(np.uint8).tobytes(), r.integers(40, 45, 9_000).astype(np.uint8).tobytes(), b"The quick brown fox, which no one had seen, jumped. " * 3]
    texts += [bytes(r.integers(0, k, n).astype(np.uint8)) for k in (1, 2, 3, 5, 16, 17, 200) for n in (1, 63, 64, 65, 700)]
    payloads = [padded(t) for t in texts]
    stored = webp.encode_rows(payloads)
    assert stored == webp.encode_rows(payloads)
    assert all((a == b).all() for a, b in zip(webp.decode_rows(stored), payloads, strict=True))
    used = Counter()
    for media in stored:
        for f in webp.files_in(media):
            seen = set()
            image = webp.decode(f, seen)
            assert (image[..., 0] == image[..., 1]).all() and (image[..., 2] == image[..., 1]).all() and (image[..., 3] == 255).all()
            used.update(seen)
    for tool in ("palette", "predictor", "cross-colour", "subtract-green", "back-reference", "colour cache"):
        assert used[tool] > 0, tool


def test_tools_survive_random_samples():
    r = np.random.default_rng(4)
    for k in (1, 2, 4, 9, 16, 30, 256):
        for n in (64, 640, 64 * 256):
            p = np.repeat(r.integers(0, k, n // 4), 4).astype(np.uint8) if n % 3 else r.integers(0, k, n).astype(np.uint8)
            assert (webp.decode(webp.encode_with_tools(p))[..., 1].ravel() == p).all()


def prose(seed, n):
    r = np.random.default_rng(seed)
    words = ["".join(map(chr, r.integers(97 + seed % 7, 123, r.integers(2, 9)))) for _ in range(150)]
    return padded(" ".join(r.choice(words, n)).encode())


def test_prose_has_back_references_and_codes_of_its_own():
    payloads = [prose(k, 60 + 70 * k) for k in range(9)]
    heads = set()
    for p, stored in zip(payloads, webp.encode_rows(payloads), strict=True):
        seen = set()
        assert (webp.decode(stored, seen)[..., 1].ravel() == p).all()
        assert {"subtract-green", "back-reference"} <= seen
        heads.add(stored[26:40])  # what follows size and transform: the code's table
        entropy = -sum(n / len(p) * np.log2(n / len(p)) for n in Counter(p.tolist()).values())
        assert len(stored) < len(p) * entropy / 8 + 110
    assert len(heads) == len(payloads)


def test_all_stored_images_are_read_in_step(monkeypatch):
    payloads = [prose(k, 100) for k in range(4)] + [padded(t) for t in (b"", b"abab" * 700, b"".join(b"%-64d" % k for k in range(300)), b"The quick brown fox, which no one had seen, jumped. " * 3, bytes(range(256)) * 70)]
    payloads.append(np.concatenate([prose(11, 9000), prose(12, 2000)]))
    stored = webp.encode_rows(payloads)
    used = set()
    for m in stored:
        for f in webp.files_in(m):
            webp.decode(f, used)
    assert used == {"palette", "predictor", "cross-colour", "subtract-green", "back-reference", "colour cache"}
    monkeypatch.setattr(webp, "decode", None)
    assert all((a == b).all() for a, b in zip(webp.decode_rows(stored), payloads, strict=True))
    for few in ({"WRITTEN": 1000, "READ": 1000}, {"IMAGES": 2}):
        for name, value in few.items():
            monkeypatch.setattr(webp, name, value)
        assert webp.encode_rows(payloads) == stored
        assert all((a == b).all() for a, b in zip(webp.decode_rows(stored), payloads, strict=True))


def test_step_decoder_reads_what_others_write():
    """Repeated code lengths, a cache of another size, and codes of a single symbol."""
    cache = lambda v, bits: (0x1E35A7BD * (255 << 24 | v << 8) & 0xFFFFFFFF) >> (32 - bits)
    samples = [5, 5, 77, 5, 77, 77, 200, 5]
    files = []
    for bits in (0, 1, 5):
        w = start(8, 1)
        w.put(0, 1)
        w.put(1, 1) if bits else w.put(0, 1)
        if bits:
            w.put(bits, 4)
        w.put(0, 1)
        lengths = FLAT + [0] * 24 if not bits else [9] * 256 + [0] * 24 + [bits + 1] * (1 << bits)
        w.code(lengths)
        w.one(0), w.one(0), w.one(255), w.one(0)
        words, slots = webp.canonical(lengths), {}
        for v in samples:
            s = 280 + cache(v, bits) if bits and slots.get(cache(v, bits)) == v else v
            w.put(words[s], lengths[s])
            slots[cache(v, bits)] = v
        files.append(file_of(w))
    w = start(64, 3)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    for x in (7, 0, 0, 255, 0):
        w.one(x)
    files.append(file_of(w))
    got = webp.decode_rows(files)
    assert [g.tolist() for g in got] == [samples] * 3 + [[7] * 192]
    assert all((webp.decode(f)[..., 1].ravel() == g).all() for f, g in zip(files, got, strict=True))


def test_step_decoder_and_damaged_files():
    whole = webp.encode_rows([prose(3, 300)])[0]
    size = len(whole) // 2 // 2 * 2
    short = whole[:4] + struct.pack("<I", size - 8) + whole[8:16] + struct.pack("<I", size - 20) + whole[20:size]
    with pytest.raises(ValueError):
        webp.decode_rows([short])
    with pytest.raises(ValueError):
        webp.decode_rows([whole, short, whole])


def test_codes_of_many_rows_are_optimal_and_canonical():
    r = np.random.default_rng(8)
    weights = r.integers(0, 50, (40, 30)) ** r.integers(1, 4, (40, 1)) * (r.random((40, 30)) < r.random((40, 1)))
    weights[0] = 0
    weights[1, 3:] = 0
    lengths = prefixes.code_lengths(weights, 15)
    for w, n, words in zip(weights.tolist(), lengths, prefixes.words(lengths), strict=True):
        assert sum(0.5 ** int(x) for x in n if x) == 1
        assert words.tolist() == webp.canonical(n.tolist())
        if sum(x > 0 for x in w) > 1:
            assert sum(a * b for a, b in zip(w, n.tolist(), strict=True)) == sum(a * b for a, b in zip(w, webp.code_lengths([float(x) for x in w], 99), strict=True))
    steep = np.array([[2**k for k in range(25)]])
    assert prefixes.code_lengths(steep, 7).max() == 7 and (0.5 ** prefixes.code_lengths(steep, 7).astype(float)).sum() == 1


def test_batches_are_written_and_read_together(spark, monkeypatch):
    rows = corpus()
    want = {r.doc_id: (r.payload_sha256, r.media_sha256) for r in media.describe(media.store(documents(spark, rows))).collect()}
    monkeypatch.setattr(media, "TEXTS", 1)
    monkeypatch.setattr(media, "MEDIA", 1)
    assert {r.doc_id: (r.payload_sha256, r.media_sha256) for r in media.describe(media.store(documents(spark, rows))).collect()} == want
