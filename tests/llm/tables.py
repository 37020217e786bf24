"""Small tables with what the operators must bear: nulls, empty and long texts, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns that carry names the operators use inside
CLASHES = ["text_hash", "size", "h", "holder", "score", "predicted", "root", "fp", "taken", "epochs", "words", "key", "shard", "blob", "spans", "rank", "label"]


def documents(spark, rows, clash=True):
    """Rows (doc_id, text[, source]) as documents with extra columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def words(seed, n, vocabulary=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def prose(seed, n):
    """Words with line ends and stops."""
    draw = random.Random(seed * 7 + 1)
    return "".join(w + draw.choice([" ", " ", " ", ", ", ".\n", "  ", " \n"]) for w in words(seed, n))


def odd_rows():
    long = prose(99, 30_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "no id here at all, only text", "b"), (None, None, None),
        (4, prose(4, 60), "b"), (4, prose(4, 60), "b"), (4, prose(5, 60), "b"), (6, long, "c"), (7, prose(4, 60), None),
        (8, "ÄÖÜ ß é 漢字 \U0001f600 end", "c"), (9, "one", "a"), (-5, "minus five has a text too", "a"),
    ]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
