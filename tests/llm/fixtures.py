"""Small document tables with the awkward cases, and brute-force helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = sentence(120)
    out = []
    for i in range(n):
        kind = i % 6
        text = sentence(r.randint(1, 150))
        if kind == 1 and out:
            words = (out[r.randrange(len(out))][1] or "").split(" ")
            if len(words) > 3:
                words[r.randrange(len(words))] = "Changed"
            text = " ".join(words)
        elif kind == 2:
            text = sentence(20) + " " + shared + " " + sentence(10)
        elif kind == 3 and out:
            text = out[r.randrange(len(out))][1] or ""
        out.append((i, text, r.choice(["en", "fr", None]), "hot" if i % 3 else f"s{i % 5}", len(text)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "", 0), (n + 2, " \t\n ", "fr", "hot", 4), (n + 3, "one", None, "hot", 3), (n + 4, sentence(4000), "en", "hot", 1)]
    out += [(n + 3, "one", None, "hot", 3), (n + 5, "\x00\x01 Ünï \U0001f600 a", "en", "s1", 5)]
    return out


def documents(spark, rows=None):
    """With extra columns whose names may clash with those an operator makes."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    return df.select("*", F.lit(1).alias("size"), F.lit("x").alias("shard"), F.lit(2).alias("n"), F.lit(None).cast("string").alias("items"), F.lit(3).alias("_at"))
