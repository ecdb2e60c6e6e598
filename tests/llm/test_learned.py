import math
import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from rillmark.llm import langid, toxicity
from tests.llm.fixtures import SCHEMA, corpus, documents


def made(lang, n, seed):
    r = random.Random(seed)
    parts = {"aa": ["the", "ing", "er", "th", "on"], "bb": ["eau", "ré", "tion", "le", "ou"], "cc": ["sch", "ung", "ein", "ä", "der"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy_and_awkward_texts(spark):
    rows = [(i, made(lang, 5 + i % 60, i), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = documents(spark, rows)
    held = langid.held_out("doc_id", 5, 0)
    names, table = langid.prototypes(docs.where(~held))
    assert names == ["aa", "bb", "cc"]
    out = langid.identify(docs, names, table).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    odd = langid.identify(documents(spark), names, table).collect()
    assert len(odd) == len(corpus())
    assert {r.lang_pred for r in odd if not any(c.isalpha() for c in r.text or "")} == {"und"}
    assert langid.identify(documents(spark, []), names, table).count() == 0
    names, table = langid.prototypes(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.identify(docs.limit(3), names, table).collect()} == {"und"}


def test_language_text_vectors_do_not_depend_on_the_batch(spark):
    texts = [(t or "").encode() for _, t, *_ in corpus()]
    whole, has = langid.text_vectors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for k in (0, 5, len(texts) - 1):
        one, own = langid.text_vectors(np.frombuffer(texts[k], np.uint8), np.array([0, len(texts[k])]))
        assert own[0] == has[k] and np.abs(one[0] - whole[k]).max() < 1e-5


def toxic_rows(n=400):
    r = random.Random(7)
    out = []
    for i in range(n):
        words = made("aa", 60, 1000 + i).split()
        y = i % 5 == 0
        if y:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["blaggard", "vermin", "nitwit"]))
        out.append((i, " ".join(words), "en", "s", 0, int(y)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows] + [(9999, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    held = langid.held_out("doc_id", 4, 2)
    model = toxicity.train(docs, labels.where(~held))
    out = toxicity.score_texts(docs, model, keep=[F.col("doc_id"), held.alias("held_out")]).collect()
    truth = {r[0]: r[5] for r in rows}
    judged = [r for r in out if r.held_out]
    assert len(judged) > 50 and sum(r.predicted == truth[r.doc_id] for r in judged) >= 0.9 * len(judged)
    odd = toxicity.score_texts(documents(spark), model).collect()
    assert len(odd) == len(corpus()) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.train(docs.where("doc_id < 0"), labels)
    assert toxicity.score_texts(docs.limit(5), none).where("predicted = 0").count() == 5


def test_windows_cover_the_text():
    for text in (b"", b"a", b"x" * 300, b"ab cd " * 50, b" " * 130):
        assert b"".join(toxicity.windows(text, 32)) == text and all(1 <= len(w) <= 32 for w in toxicity.windows(text, 32))


def test_language_scores_equal_a_naive_computation(spark):
    rows = [(i, made(lang, 5 + i % 20, i), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 8)]
    odd = ["Été, ẞtraße 12 x", "a", "İI ıi", " a-b  c", "漢字 und Kana", "x" * 40, "ab" * 30, made("bb", 9, 99), made("cc", 3, 5), "\x00z\x00"]

    def vector(text):
        stream, inside = [0], False
        for c in text:
            if c.isalpha():
                stream.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
                inside = True
            elif inside:
                stream.append(0)
                inside = False
        stream += [0] if inside else []
        v = lambda cp: np.ones(1024, int) if cp == 0 else langid._vector(cp, 1024).astype(int)
        total = np.zeros(1024)
        for x, y, z in zip(stream, stream[1:], stream[2:], strict=False):
            total += np.roll(v(x), 2) * np.roll(v(y), 1) * v(z)
        return total / max(np.linalg.norm(total), 1e-9)

    docs = documents(spark, rows)
    names, table = langid.prototypes(docs)
    own = np.array([sum(vector(t) for _, t, lang, *_ in rows if lang == name) for name in names])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    assert np.abs(own - table).max() < 1e-5
    mean = own.mean(axis=0)
    centred = (own - mean) / np.linalg.norm(own - mean, axis=1, keepdims=True)
    got = {r.doc_id: r for r in langid.identify(documents(spark, [(i, t, None, None, 0) for i, t in enumerate(odd)]), names, table).collect()}
    for i, t in enumerate(odd):
        x = vector(t) - mean
        cosine = centred @ x / np.linalg.norm(x)
        odds = np.exp(12 * cosine)
        assert got[i].lang_pred == names[int(cosine.argmax())] and abs(got[i].score - odds.max() / odds.sum()) < 1e-4


def test_toxicity_scores_equal_a_naive_computation(spark):
    rows = [(t.encode(), y) for *_, t, _, _, _, y in [(r[0], r[1], *r[2:]) for r in toxic_rows(120)]]
    model = toxicity.fit(rows, 0.2, most_runs=50, repeats=10, common_windows=500, ordinary_windows=200)
    texts = ["", "a", "You blaggard of the vermin", "X" * 200, "ab cd " * 40, " ", "é " * 70, made("aa", 80, 3), "nitwit", "\n\t ordinary the on"]
    dictionary = lambda d: zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda d, w: len(zstandard.ZstdCompressor(level=1, dict_data=dictionary(d), write_content_size=False, write_dict_id=False, write_checksum=False).compress(w))
    got = {r.doc_id: r for r in toxicity.score_texts(documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        rest, differences = b" " + t.encode().lower() + b" ", []
        text = rest
        while text:
            w = text[:64]
            if len(text) > 64 and b" " in w[33:]:
                w = w[: w.rindex(b" ")]
            differences.append(size(model.ordinary, w) - size(model.toxic, w))
            text = text[len(w) :]
        n = len(differences)
        x = [max(differences), sum(sorted(differences)[-3:]) / len(sorted(differences)[-3:]), sum(differences) / n, *(sum(d >= k for d in differences) / n for k in (2, 3, 4, 5)), math.log1p(sum(d >= 4 for d in differences)), math.log(n)]
        z = sum(w * (a - c) / s for w, a, c, s in zip(model.weights, x, model.centre, model.scale, strict=False)) + model.weights[-1]
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)
