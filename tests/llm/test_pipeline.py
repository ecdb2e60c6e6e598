import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rillmark.llm.queries import TOKENIZER
from tests.llm.fixtures import SCHEMA, corpus, documents
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_suffix import brute_words

BENCHMARK = "item_id long, text string"


def prose(k, n=40):
    return " ".join(f"wort{k}x{i}" for i in range(n))


def awkward():
    rows = [(i, prose(i), "en" if i % 2 else "de", "hot", 1) for i in range(12)]
    rows += [(20, prose(1) + " end", None, "s", 1), (21, prose(1), "en", None, None), (21, prose(1), "en", None, None), (None, prose(2) + " x", None, None, 3)]
    rows += [(30, None, "en", "s", 0), (31, "", None, "s", 0), (32, " \t ", None, None, 2), (33, "12 34 !", "de", "s", 7), (34, "ja", None, "s", 2)]
    return rows


def bench(spark, texts=()):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], BENCHMARK)


@pytest.fixture
def sf_dir(spark, tmp_path):
    item = " ".join(f"wort5x{i}" for i in range(3, 25))
    bench(spark, [item, None, ""]).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(awkward(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_languages_are_found_and_texts_without_letters_go(spark):
    docs = documents(spark, awkward())
    out = corpus_pipeline.identify_languages(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, t, *_ in awkward() if t and re.search("[a-z]", t))
    assert {r.lang for r in rows} <= {"en", "de"} and all(r.lang == lang for r in rows for i, t, lang, *_ in awkward() if (i, t) == (r.doc_id, r.text) and lang)


def test_one_document_of_each_group_stays(spark):
    rows = [r for r in corpus() if r[1]]
    docs = documents(spark, rows)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    unique = list({r[:2]: r for r in rows}.values())
    want = sorted(i for i, _, _, kept in brute_groups(unique, width=5) if kept)
    assert sorted(r.doc_id for r in out.collect()) == want


def test_repeats_go_as_brute_force_says(spark):
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in corpus()]
    docs = documents(spark, rows)
    out = corpus_pipeline.remove_repeats(spark, docs, "")
    assert out.columns == docs.columns
    want = [(i, kept.decode()) for i, kept in brute_words(rows, 50)]
    untouched = Counter((r[0], r[1] or "") for r in rows)
    want = [w for w in want if untouched[w] or w[1].strip()]
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_documents_with_benchmark_windows_go(spark, sf_dir):
    docs = documents(spark, awkward())
    out = corpus_pipeline.decontaminate(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert Counter(str(r.doc_id) for r in out.collect()) == Counter(str(i) for i, *_ in awkward() if i != 5)


def ids_of(text):
    tokenizer = Tokenizer.from_file(TOKENIZER["tokenizer"])
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1


def test_packing_holds_every_token_once(spark):
    rows = [*awkward(), (50, prose(9, 3000), "en", "s", 0)]
    out = corpus_pipeline.pack(spark, documents(spark, rows), "").collect()
    assert Counter(r.length for r in out).total() and sum(r.length for r in out) == sum(ids_of(t) for _, t, *_ in rows)
    ids = {}
    for r in sorted(out, key=lambda r: (str(r.doc_id), r.piece)):
        assert len(r.ids) == r.length
        ids.setdefault(r.doc_id, []).extend(r.ids)
    tokenizer = Tokenizer.from_file(TOKENIZER["tokenizer"])
    assert ids[50] == [*tokenizer.encode(prose(9, 3000), add_special_tokens=False).ids, 0]
    fill = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf_dir, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, sf_dir).count() == 0


def test_run_keeps_what_no_stage_drops(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    # 20 and both 21 are near copies of 1, the row without id one of 2; 5 is in the benchmark; 30 to 33 have no letters
    want = [i for i in range(12) if i != 5] + [34]
    assert sorted({r.doc_id for r in out}) == want
    texts = {i: t for i, t, *_ in awkward()}
    size = np.array([ids_of(texts[i]) for i in want])
    assert sum(r.length for r in out) == size.sum()


def test_repeated_rows_go_through_the_first_stages(spark):
    rows = [(None, prose(3), "en", "s", 1)] * 200 + [(7, prose(3), "en", "s", 1)] * 200 + [(8, prose(4, 60), "de", "s", 1)] * 5
    docs = corpus_pipeline.identify_languages(spark, documents(spark, rows), "")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [7, 8]
    again = corpus_pipeline.remove_repeats(spark, documents(spark, rows[-5:]), "")
    assert again.count() == 0  # copies of a passage of over 50 words have nothing else
