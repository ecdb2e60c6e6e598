"""Quality rules: plain word and line counts, and how well public vocabularies read a text.

Every word (a run between ASCII white space) is read on its own by each vocabulary. Three measures
follow for a text: characters per token, the share of tokens that are bytes of a character which the
vocabulary lacks, and the entropy of the tokens as a share of what that many different tokens have.

Texts are compared with their own language (or, where that is unknown or has few texts, with their
script). Each measure is rounded to a grid, counted over all texts that pass the plain rules, and the
counts give the 10th and 90th percentiles exactly. The band reaches `widen` times their difference
beyond each. A text outside a band of its group is rejected. Groups of texts with a script that no
band knows are kept.

Words repeat, so a batch reads its different words once.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm._base import as_bytes, cut, flat, pieces, small_batches
from rillmark.llm.textbytes import mix, prefix_hash, shingles, slice_hash, word_bounds, word_table

WORD = word_table(b" \t\n\v\f\r")
SYMBOLS = b"#*$%&|<>"
#: Rules of the base: least words, and the most per cent of them that stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Grid of the measures, the percentiles of a band, and how many times their distance it adds beyond them.
#: So bands hold while less than a tenth of a language's texts lies at one end.
GRID, LOW, HIGH, WIDEN = 1000, 0.1, 0.9, 1.5
#: Texts that a language needs for bands of its own, and the least width between percentiles.
LEAST_TEXTS, LEAST_WIDTH = 200, 0.03
#: First code points of blocks, and the script from there on ("" is none).
SCRIPTS = [
    (0x0000, ""), (0x0041, "Latin"), (0x005B, ""), (0x0061, "Latin"), (0x007B, ""), (0x00C0, "Latin"), (0x0250, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, ""), (0x0E00, "Thai"), (0x0E80, ""),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""),
]
_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_KINDS = np.array([_NAMES.index(name) for _, name in SCRIPTS])


@functools.cache
def _pieces_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


@functools.cache
def _ranks_model(path: str, pattern: str):
    """The encoding; of each id its bytes' number and whether they are only a part of a character."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    model = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    size, part = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, bool)
    for token, rank in ranks.items():
        size[rank] = len(token)
        try:
            token.decode("utf-8")
        except UnicodeDecodeError:
            part[rank] = True
    return model, size, part


#: White space beyond ASCII, which a pattern could join with the blank between two words.
_WIDE_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def read_words(words: list[str], vocabulary: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all words one after another, how many each word has, and for every id whether it is
    only a byte or a part of a character. Each word is read as if it followed a blank."""
    if vocabulary["kind"] == "pieces":
        model, part = _pieces_model(vocabulary["path"])
        ids = model.encode(words, num_threads=1)
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(many.sum())), many, part
    model, size, part = _ranks_model(vocabulary["path"], vocabulary["pattern"])
    alone = {i: model.encode_ordinary(" " + w) for i, w in enumerate(words) if _WIDE_BLANK.search(w)}
    # no token reaches from one word into the next, so one call reads them all; a word's tokens begin in it
    texts = [" " + ("x" if i in alone else w) for i, w in enumerate(words)]
    joined = "".join(texts)
    first = np.cumsum([0, *(len(t.encode("utf-8")) for t in texts)]) if not joined.isascii() else np.cumsum([0, *map(len, texts)])
    ids = np.array(model.encode_ordinary(joined), np.int64)
    at = np.cumsum(size[ids]) - size[ids]
    word = np.searchsorted(first, at, "right") - 1
    many = np.bincount(word, minlength=len(words)) if len(ids) else np.zeros(len(words), np.int64)
    if alone:
        split = np.split(ids, np.cumsum(many)[:-1])
        for i, own in alone.items():
            split[i], many[i] = np.array(own, np.int64), len(own)
        ids = np.concatenate(split)
    return ids, many, part


def text_measures(tokens: np.ndarray, doc: np.ndarray, docs: int, chars: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Rows of characters per token, share of bytes and relative entropy, for ids of all texts. A text
    without tokens has 0 everywhere; one with a single token has entropy 1."""
    n = np.bincount(doc, minlength=docs)
    some = np.maximum(n, 1)
    share = np.bincount(doc, weights=part[tokens], minlength=docs) / some
    key, times = np.unique(doc * np.int64(len(part)) + tokens, return_counts=True)
    own = key // len(part)
    p = times / some[own]
    entropy = np.bincount(own, weights=-p * np.log2(p), minlength=docs)
    relative = np.where(n > 1, entropy / np.log2(np.maximum(n, 2)), (n > 0).astype(float))
    return np.stack([chars / some, share, relative], axis=1)


def script_of(data: np.ndarray, offsets: np.ndarray) -> list[str | None]:
    """The script that most letters of each text belong to (ties: by name), None without letters."""
    docs, wide = len(offsets) - 1, len(_NAMES)
    ascii_letters = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    at = np.flatnonzero(data >= 0xC0)
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    lead, b1, b2, b3 = b[at], b[at + 1] & 63, b[at + 2] & 63, b[at + 3] & 63
    points = np.select([lead < 0xE0, lead < 0xF0], [(lead & 31) << 6 | b1, (lead & 15) << 12 | b1 << 6 | b2], (lead & 7) << 18 | b1 << 12 | b2 << 6 | b3)
    kind = _KINDS[np.searchsorted(_STARTS, points, "right") - 1]
    table = np.bincount((np.searchsorted(offsets, at, "right") - 1) * wide + kind, minlength=docs * wide).reshape(docs, wide)
    table[:, _NAMES.index("Latin")] += np.diff(ascii_letters[offsets])
    table[:, 0] = 0  # "" sorts first
    return [_NAMES[i] if n else None for i, n in zip(table.argmax(axis=1), table.max(axis=1), strict=True)]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text: words, code points in words, symbols, lines equal to an earlier line, words in
    repeated windows; and the words' first bytes, ends, hashes and offsets."""
    docs = len(offsets) - 1
    start, end = word_bounds(data, offsets, WORD)
    prefix = prefix_hash(data)
    h = slice_hash(prefix, start, end)
    at = np.searchsorted(start, offsets)
    n_words = np.diff(at)
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    inside = WORD[data]
    chars = count(inside & ((data & 0xC0) != 0x80))
    symbols = count(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    # lines: between line feeds and the texts' ends
    feed = np.flatnonzero(data == 10)
    first = np.concatenate([offsets[:-1], feed + 1])
    last = np.concatenate([feed, offsets[1:]])
    first.sort(), last.sort()
    held = np.concatenate([[0], np.cumsum(inside)])
    full = held[last] > held[first]
    first, last = first[full], last[full]
    doc = np.searchsorted(offsets, first, "right") - 1
    key = mix(slice_hash(prefix, first, last) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    once = np.unique(key, return_index=True)[1]
    lines = np.bincount(doc, minlength=docs) - np.bincount(doc[once], minlength=docs)
    # windows of three words
    windows, to = shingles(h, at, 3)
    doc = np.repeat(np.arange(docs), np.diff(to))
    inverse, times = np.unique(mix(windows + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)[1:]
    again = np.flatnonzero(times[inverse] > 1)
    place = at[doc[again]] + again - to[doc[again]]
    step = np.zeros(len(h) + 4, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + 3, -1)
    repeated = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(step)[: len(h)] > 0)])[at])
    return n_words, chars, symbols, lines, repeated, start, end, h, at


def _measured(df: DataFrame, vocabularies: list[dict]) -> DataFrame:
    """(_id, lang, _text) to _id, lang, script, the five counts and measures (three a vocabulary)."""
    schema = T.StructType([df.schema["_id"], *[T.StructField(x, T.StringType()) for x in ("lang", "script")], *[T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], T.StructField("measures", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("_text"))
            for i, j in pieces(offsets):
                own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                *counts, start, end, h, at = base_counts(own, ends)
                first, inverse = np.unique(h, return_index=True, return_inverse=True)[1:]
                raw = own.tobytes()
                different = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                doc = np.repeat(np.arange(j - i), np.diff(at))
                out = []
                for v in vocabularies:
                    ids, size, part = read_words(different, v)
                    begin = np.cumsum(size) - size
                    many = size[inverse]
                    stop = np.cumsum(many)
                    tokens = ids[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - many - begin[inverse], many)]
                    out.append(text_measures(tokens, np.repeat(doc, many), j - i, counts[1], part))
                rows = batch.slice(i, j - i)
                measures = pa.array(list(np.concatenate(out, axis=1)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("lang"), pa.array(script_of(own, ends), pa.string()), *[pa.array(x, pa.int64()) for x in counts], measures], names=schema.names)

    return df.mapInArrow(work, schema)


def _bands(measured: DataFrame, widen: float, least: int) -> DataFrame:
    """(_group, _bands): for each measure of a group the lowest and the highest value that is kept."""
    groups = F.array_compact(F.array(F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("script:"), F.col("script"))))
    cells = measured.where("not base_failed").select(F.explode(groups).alias("g"), F.posexplode(F.transform("measures", lambda x: F.rint(x * GRID).cast("long"))).alias("k", "x"))
    counts = cells.groupBy("g", "k", "x").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("g", "k")
    ranked = counts.select("g", "k", "x", F.sum("n").over(own.orderBy("x")).alias("upto"), F.sum("n").over(own).alias("all"))
    quantile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("x"))) / GRID
    edges = ranked.groupBy("g", "k").agg(quantile(LOW).alias("a"), quantile(HIGH).alias("b"), F.max("all").alias("all")).where((F.col("all") >= least) | F.col("g").startswith("script:"))
    wide = F.greatest(F.col("b") - F.col("a"), F.lit(LEAST_WIDTH)) * widen
    edges = edges.select("g", "k", (F.col("a") - wide).alias("low"), (F.col("b") + wide).alias("high"))
    listed = edges.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("bands"))
    return listed


def judge(docs: DataFrame, vocabularies: list[dict], *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", widen: float = WIDEN, least: int = LEAST_TEXTS) -> DataFrame:
    """One row per document row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, then the group whose bands judged it, `measures` and `outside` (places of the
    measures that lie outside their bands).

    A vocabulary is {"kind": "pieces", "path": ...} (with byte tokens) or {"kind": "ranks", "path": ...,
    "pattern": ...}. Null texts have no words; texts of under 50 words, or with over half of them in
    windows of three that occur twice or more, fail the base and are not kept. A text without a
    language goes by its script, one without letters or bands is kept if the base is. Repeated rows
    count each. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), as_bytes(text_col).alias("_text"))
    failed: Column = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = cut(_measured(rows, vocabularies).withColumn("base_failed", failed))
    bands = cut(_bands(measured, widen, least))
    # one row for each language or script, which is joined twice: first by language, then by script
    of_lang = bands.where("startswith(g, 'lang:')").select(F.substring("g", 6, 1 << 20).alias("_l"), F.col("bands").alias("_own"))
    of_script = bands.where("startswith(g, 'script:')").select(F.substring("g", 8, 1 << 20).alias("_s"), F.col("bands").alias("_all"))
    out = measured.join(of_lang, F.col("lang") == F.col("_l"), "left").join(of_script, F.col("script") == F.col("_s"), "left")
    group = F.when(F.col("_own").isNotNull(), F.concat(F.lit("lang:"), "lang")).when(F.col("_all").isNotNull(), F.concat(F.lit("script:"), "script"))
    wrong = F.expr("transform(filter(coalesce(_own, _all, array()), b -> measures[b.k] < b.low or measures[b.k] > b.high), b -> b.k)")
    out = out.withColumn("group", group).withColumn("outside", wrong)
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"), "group", "measures", "outside")
