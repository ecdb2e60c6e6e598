import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rillmark.llm import packing
from rillmark.llm.queries import TOKENIZER
from tests.llm.fixtures import corpus, documents


def fill(counts, capacity):
    """Sequences of a plan, checked: places lie gapless and no more than the capacity is used."""
    used = {}
    left = list(counts)
    for s, lo, hi, q, seq, at in packing.plan(counts, capacity):
        left[s] -= hi - lo
        for r in range(hi - lo):
            used.setdefault(seq + r // q, []).append((at + r % q * s, s))
    assert not any(left)
    for parts in used.values():
        end = 0
        for at, s in sorted(parts):
            assert at == end
            end += s
        assert end <= capacity
    return len(used)


def fewest(items, capacity):
    """By trying all placements."""
    best = [len(items)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in sorted({r: i for i, r in enumerate(rooms) if r >= items[k]}.values()):
            put(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - items[k]])

    put(0, [])
    return best[0]


def test_plans_fill_sequences_and_are_near_the_fewest():
    r = random.Random(2)
    over = 0
    for _ in range(60):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 11))), reverse=True)
        counts = [items.count(s) for s in range(21)]
        over += fill(counts, 20) - fewest(items, 20)
    assert 0 <= over <= 2
    many = [0] + [r.randint(0, 400 if s < 30 else 9) for s in range(64)]
    total = sum(s * n for s, n in enumerate(many))
    assert fill(many, 64) <= 1.01 * total / 64 + 1


def test_dominating_sets_never_cost_a_sequence():
    r = random.Random(3)
    for _ in range(60):
        items = sorted((r.randint(3, 20) for _ in range(r.randint(1, 9))), reverse=True)
        counts = [items.count(s) for s in range(21)]
        fixed = packing.dominating_sets(counts, 20)
        rest = [s for s in range(20, 0, -1) for _ in range(counts[s])]
        assert sum(n for n, _ in fixed) + (fewest(rest, 20) if rest else 0) == fewest(items, 20)


def test_documents(spark):
    rows = corpus() + [(90, "<|endoftext|> a <|", None, None, None)]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(documents(spark, rows), capacity=64, keep_ids=True, **TOKENIZER).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 64 or 64
        cuts = [(0, first), *((s, 64) for s in range(first, len(ids), 64))]
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    places = {}
    for r in out:
        assert len(r.ids) == r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [a for a, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 64
    assert packing.pack(documents(spark, []), **TOKENIZER).count() == 0


def test_both_encoders_give_the_same_ids():
    fast = packing.Encoder(TOKENIZER["tokenizer"], TOKENIZER["ranks"], TOKENIZER["pattern"])
    slow = packing.Encoder(TOKENIZER["tokenizer"], None, None)
    r = random.Random(9)
    texts = ["", " ", "a\n\n b", "don't  stop", "x\r\n\t y ", "ünï\U0001f600 \x00", "१२३ 12 a1"] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x3000), 10, 32, 32])) for _ in range(300)) for _ in range(60)]
    anywhere = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]  # but for halves of surrogate pairs
    texts += ["".join(chr(r.choice([r.choice(anywhere), r.randrange(32, 127), 32])) for _ in range(300)) for _ in range(200)]
    for t in texts:
        assert fast(t).tolist() == slow(t).tolist(), repr(t)
