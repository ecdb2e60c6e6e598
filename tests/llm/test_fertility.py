import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rillmark.llm import fertility, queries
from tests.llm.fixtures import SCHEMA, corpus, documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def measures(text):
    """The same numbers word by word."""
    import base64

    import sentencepiece
    import tiktoken

    v, u = queries.VOCABULARIES
    sp = sentencepiece.SentencePieceProcessor(model_file=v["path"])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(u["path"], "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    w, out = WORD.findall(text or ""), []
    whole = lambda b: b.decode("utf-8", "ignore").encode() == b
    for ids, part in (([i for x in w for i in sp.encode(x)], sp.is_byte), ([i for x in w for i in bpe.encode_ordinary(" " + x)], lambda i: not whole(bpe.decode_single_token_bytes(i)))):
        n = len(ids)
        h = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        out += [sum(map(len, w)) / max(n, 1), sum(map(part, ids)) / max(n, 1), h / math.log2(n) if n > 1 else float(n)]
    return out


def long_rows():
    rows = corpus(90)
    rows += [(500 + i, " ".join(f"w{i}x{j % 40}" for j in range(60)), "xx", "s", 1) for i in range(5)]
    rows += [(None, "x y z " * 40, None, None, None), (None, "a\nb b\na\n\n \na\nb b", None, None, None), (601, "слово и ещё " * 30, None, "s", 1), (602, "y" * 1_100_000, "en", "s", 1), (603, "ab cd " * 200_000, "en", "s", 1)]
    rows += [(604, "\xa0 a\xa0 \xa0b \x85 　  x \x1c", "en", "s", 1), (605, "###|<>&%$* #", "en", "s", 1)]
    return rows + [rows[0], rows[0]]


def test_counts_and_measures_equal_brute_force(spark):
    rows = long_rows()
    out = fertility.judge(documents(spark, rows).withColumn("group", F.lit("x")).withColumn("kept", F.lit(5)).repartition(3), queries.VOCABULARIES)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t, *_ in rows), key=str)
    text = {i: t for i, t, *_ in rows if i is not None}
    for r in out.collect():
        assert not (r.kept and r.base_failed)
        if r.doc_id in text and len(text[r.doc_id] or "") < 20_000:
            assert r.measures == pytest.approx(measures(text[r.doc_id]), abs=1e-9)


def test_bands_equal_brute_force(spark):
    r = np.random.default_rng(3)
    plain = ["the cat and a dog of this house", "when we were there they said that", "some water from our river over land"]
    text = lambda i: " ".join(plain[int(k)] for k in r.integers(0, 3, 4)) + " " + " ".join(f"n{x}" for x in r.integers(0, 10**6, 60 + i % 30))
    rows = [(i, text(i), "en" if i % 4 else None, "s", 1) for i in range(120)] + [(200 + i, " ".join(f"w###{x}&&&$$$" for x in r.integers(0, 10**6, 70)), "en", "s", 1) for i in range(3)]
    out = fertility.judge(spark.createDataFrame(rows, SCHEMA), queries.VOCABULARIES, least=50).collect()
    by = {x.doc_id: x for x in out}
    good = [x for x in out if not x.base_failed]
    lang = {i: g for i, _, g, *_ in rows}
    for x in out:
        peers = [y for y in good if lang[x.doc_id] is None or lang[y.doc_id] == "en"]
        outside = []
        for k in range(6):
            own = sorted(round(y.measures[k] * 1000) for y in peers)
            a, b = own[math.ceil(len(own) * 0.1) - 1] / 1000, own[math.ceil(len(own) * 0.9) - 1] / 1000
            w = max(b - a, 0.03) * 1.5
            if not a - w <= x.measures[k] <= b + w:
                outside.append(k)
        assert x.outside == outside and x.kept == (not x.base_failed and not outside)
        assert x.group == ("lang:en" if lang[x.doc_id] else "script:Latin")
    assert not any(by[200 + i].kept for i in range(3)) and sum(x.kept for x in out) >= 0.9 * len(good)


def test_empty_table_and_scripts(spark):
    assert fertility.judge(documents(spark, []), queries.VOCABULARIES).count() == 0
    texts = ["abc дом дома", "дом", "漢字かな漢", "", "12 .", "été", "ab дг", "สวัสดี", "한국어 a"]
    data, ends = "".join(texts).encode(), np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert fertility.script_of(np.frombuffer(data, np.uint8), ends) == ["Cyrillic", "Cyrillic", "Han", None, None, "Latin", "Cyrillic", "Thai", "Hangul"]
