import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kalendarium.llm import catalog, norm_buckets
from tests.llm.tables import documents, odd_rows, prose, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    weight = lambda w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            m = 25 + 75 * c.total() * n_docs // total if total else 0
            score = sum(weight(w) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if score > 0:
                scored.append((-score, math.inf if doc_id is None else doc_id))
        out += [(item_id, rank, None if d == math.inf else d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, score int")


def corpus(seed, n=400):
    draw = random.Random(seed)
    zipf = lambda: f"t{int(draw.paretovariate(0.7)) % 3000}"
    docs = [(i, " ".join(zipf() for _ in range(draw.choice([1, 5, 30, 200])))) for i in range(n)]
    asked = [(i, " ".join(zipf() for _ in range(draw.choice([1, 3, 20, 60])))) for i in range(25)]
    docs += [(n + i, t) for i, (_, t) in enumerate(asked[:5])] * 2 + [(None, asked[6][1])]
    return docs, asked + [(99, None), (99, ""), (98, "never seen words"), (None, asked[2][1]), (7, asked[7][1])]


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_definition(spark, monkeypatch, seed):
    docs, asked = corpus(seed)
    docs += [(10_000 + (r[0] or 0), r[1]) for r in odd_rows()]
    wanted = brute(docs, asked)
    assert got(norm_buckets.search(documents(spark, docs), items(spark, asked))) == wanted
    # several item blocks, many chunks
    assert got(norm_buckets.search(documents(spark, docs), items(spark, asked), item_block=7, chunk=500)) == wanted


@pytest.mark.parametrize("seed", range(6))
def test_bounds_lose_nothing_and_prune(seed):
    rng = np.random.default_rng(seed)
    n, vocabulary = 3000, 400
    sizes = rng.integers(1, 30, n)
    rows = [np.sort(rng.choice(vocabulary, s, replace=False, p=(p := 1 / np.arange(1, vocabulary + 1)) / p.sum())) for s in sizes]
    flat, counts = np.concatenate(rows).astype(np.int32), rng.integers(1, 5, int(sizes.sum())).astype(np.int32)
    length = rng.integers(1, 400, n)
    buckets = norm_buckets.buckets_of(np.arange(n), length, sizes, flat, counts, n, int(length.sum()), bucket=256)
    dense = np.zeros((n, vocabulary), dtype=np.int64)
    m = 25 + 75 * length * n // int(length.sum())
    tf = counts.astype(np.int64)
    dense[np.repeat(np.arange(n), sizes), flat] = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
    asked = [norm_buckets.Item(i, i, np.sort(rng.choice(vocabulary, 12, replace=False)), rng.integers(1, 9000, 12)) for i in range(40)]
    asked += [norm_buckets.Item(40 + i, i, rows[i].astype(np.int64), rng.integers(1000, 9000, sizes[i])) for i in range(40)]
    best = [norm_buckets.Best(10, 0.0) for _ in asked]
    norm_buckets.search_chunk(buckets, asked, best, np.zeros(vocabulary, dtype=np.int64))
    looked_at = 0
    for item, found in zip(asked, best):
        scores = dense[:, item.terms] @ item.weights
        order = [i for i in np.lexsort((np.arange(n), -scores))[:10] if scores[i] > 0]
        assert found.ids.tolist() == order and found.scores.tolist() == scores[order].tolist()
        for bucket in buckets:
            kept = bucket.candidates(item, found.least) if item.length * bucket.longest >= found.least else []
            looked_at += len(kept)
            assert set(np.flatnonzero(scores[bucket.ids] >= found.least)) <= set(kept)
    assert looked_at < 0.1 * n * len(asked)


def test_empty_tables(spark):
    none, no_items = documents(spark, []), items(spark, [])
    assert norm_buckets.search(none, items(spark, [(1, "a b")])).collect() == []
    assert norm_buckets.search(documents(spark, [(1, "a b")]), no_items).collect() == []
    assert got(norm_buckets.search(documents(spark, [(1, "a b"), (2, None)]), items(spark, [(1, "A")]))) == brute([(1, "a b"), (2, None)], [(1, "A")])
    assert words(1, 1) and prose(1, 1)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    asked = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got(catalog.QUERIES["op13_norm_buckets"](spark, folder)) == brute(docs, asked)
