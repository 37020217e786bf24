import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kalendarium.llm import bit_importance, catalog
from tests.llm.tables import documents, odd_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs=1):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def brute(docs, targets, buckets=10_000, percent=10, least=20, runs=1):
    """(doc_id, n_features, weight, score, rank) by the definition, one feature after the other."""
    number = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(number(f) for _, d in docs for f in features(d, runs)[1]), Counter(number(f) for d in targets for f in features(d, runs)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (n_s + buckets)) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for doc_id, text in docs:
        words, runs_of = features(text, runs)
        weight = sum(gain(number(f)) for f in runs_of)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(runs_of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    ranked = sorted((r for r in out if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(ranked[: len(ranked) * percent // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("runs,percent", [(1, 10), (2, 40)])
def test_equals_the_definition(spark, runs, percent):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + i, prose(i, 10 + i % 60)) for i in range(150)] + [(900 + i, prose(3, 50)) for i in range(40)]
    targets = [prose(7, 300), None, "", "ÄÖ ß 12 w3 W3"]
    df = bit_importance.resample(documents(spark, rows), documents(spark, [(i, t) for i, t in enumerate(targets)]), max_run=runs, percent=percent)
    assert got(df) == brute(rows, targets, runs=runs, percent=percent)


def test_planes_give_exact_sums():
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 1000):
        values = rng.integers(-20_000, 20_000, n)
        planes = bit_importance.GainPlanes(values)
        counts = rng.integers(0, 3, (50, n)) * rng.integers(1, 70_000, (50, n))
        row, bucket = np.nonzero(counts)
        assert (planes.weights(row, bucket, counts[row, bucket], 50) == counts @ values).all()
    assert (bit_importance.GainPlanes(np.zeros(5, dtype=np.int64)).weights(np.array([0]), np.array([2]), np.array([9]), 2) == 0).all()


def test_empty_tables_and_ties(spark):
    none = documents(spark, [])
    assert bit_importance.resample(none, none).collect() == []
    same = [(5, prose(1, 30))] * 30
    ranks = sorted(r["rank"] for r in bit_importance.resample(documents(spark, same), none).collect() if r["rank"])
    assert ranks == [1, 2, 3]
    short = bit_importance.resample(documents(spark, [(i, "too short") for i in range(30)]), none)
    assert {r["rank"] for r in short.collect()} == {None}


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    targets = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got(catalog.QUERIES["op11_bit_importance"](spark, folder)) == brute(rows, targets)
