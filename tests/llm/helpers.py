"""Small fixtures and plain-Python versions to hold operators against."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def lower_az(text):
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or "")


def documents(spark, rows, extra=False):
    """rows of (doc_id, text); extra adds columns whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, schema)
    if extra:
        from pyspark.sql import functions as F

        for name in ("fp", "row", "chunk", "h", "words", "p", "seed", "toxicity", "n", "score", "item_id", "unit", "node"):
            df = df.withColumn(name, F.lit(7))
    return df


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "only words here"), (4, "same text twice over"), (4, "same text twice over"), (5, "x"), (None, None), (6, "Ünï çode 字 text wide")]


def union_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
