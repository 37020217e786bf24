import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kalendarium.llm import toxic_neighbours
from tests.llm.tables import documents, odd_rows, words

LABELS = "doc_id long, quality int, toxic int, text string"
BAD = ["blorx", "snarf", "quib", "zort"]


def corpus(n=1200, seed=2):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        tokens = words(i, draw.randrange(5, 200))
        toxic = i % 8 == 0
        for _ in range(draw.randrange(2, 6) if toxic else 0):
            tokens.insert(draw.randrange(len(tokens)), draw.choice(BAD).upper() + draw.choice(["", ",", "!"]))
        docs.append((i, " ".join(tokens)))
        if i % 5:
            labels.append((i, 1, int(toxic) if i % 41 else 1 - int(toxic), "clash"))
    return docs, labels


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = corpus()
    df = toxic_neighbours.score_documents(documents(spark, docs), spark.createDataFrame(labels + [(3, 1, None, "x"), (None, 1, 1, "x")], LABELS))
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [i for i, r in got.items() if r["held_out"]]
    right = sum(got[i]["predicted"] == (i % 8 == 0) for i in held)
    assert right >= 0.98 * len(held)
    known = {d for d, *_ in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    assert all(e["doc_id"] in known for r in got.values() for e in r["evidence"])


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(400)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t, x) for d, q, t, x in labels]
    scores = lambda rows: sorted((r["doc_id"], r["score"]) for r in toxic_neighbours.score_documents(documents(spark, docs), spark.createDataFrame(rows, LABELS)).collect())
    assert scores(labels) == scores(turned)


@pytest.mark.parametrize("seed", range(8))
def test_block_max_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(900):
        at = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.random(len(at)) + 0.1
        vectors.append((at, w / np.sqrt((w**2).sum()) if len(at) else w))
    vectors += vectors[:200]  # ties
    index = toxic_neighbours.BlockMaxIndex(vectors, 40)
    dense = np.zeros((len(vectors), 40))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for q in range(0, 200, 9):
        cosines = dense @ dense[q]
        order = np.lexsort((np.arange(len(vectors)), -cosines.round(12)))
        order = [i for i in order if cosines[i] > 0 and i != q][:15]
        got = index.nearest(*vectors[q], 15, but=q)
        assert [round(s, 9) for s, _ in got] == [round(cosines[i], 9) for i in order]


def test_odd_rows_and_no_labels(spark):
    given = odd_rows()
    none = spark.createDataFrame([], LABELS)
    df = toxic_neighbours.score_documents(documents(spark, given), none)
    assert {(r["score"], r["predicted"]) for r in df.collect()} == {(0.5, 0)} and df.count() == len(given)
    some = spark.createDataFrame([(4, 1, 1, ""), (6, 1, 0, ""), (999, 1, 1, "")], LABELS)
    assert toxic_neighbours.score_documents(documents(spark, given), some).count() == len(given)
    assert toxic_neighbours.score_documents(documents(spark, []), some).collect() == []


def test_clean_rows_stay_as_they_are(spark):
    docs, labels = corpus(600)
    table = documents(spark, docs + [(None, None), (5000, "")])
    kept = toxic_neighbours.keep_clean(table, spark.createDataFrame(labels, LABELS))
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i, _ in docs if i % 8} <= ids and len([i for i in ids if i is not None and i < 600 and i % 8 == 0]) <= 5 and {None, 5000} <= ids


def test_copies_of_examples_with_rare_words_find_them(spark):
    docs, labels = corpus(400)
    learned = [d for d, *_ in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    # words that stand in one example only; a copy, a near copy, and other words
    text = " ".join(f"only{i}" for i in range(40))
    bad, clean = learned[0], learned[1]
    docs = [(i, text if i == bad else text.replace("only", "fine") if i == clean else t) for i, t in docs]
    labels = [(i, q, 1 if i == bad else 0 if i == clean else y, x) for i, q, y, x in labels]
    docs += [(9001, text), (9002, text.replace("only7 ", "")), (9003, text.replace("only", "fine")), (9004, "none of these")]
    got = {r["doc_id"]: r for r in toxic_neighbours.score_documents(documents(spark, docs), spark.createDataFrame(labels, LABELS)).collect()}
    nearest = {i: got[i]["evidence"][0] for i in (9001, 9002, 9003)}
    assert [(e["doc_id"], e["toxic"]) for e in nearest.values()] == [(bad, 1), (bad, 1), (clean, 0)]
    assert nearest[9001]["cosine"] == pytest.approx(1) and nearest[9003]["cosine"] == pytest.approx(1) and 0.9 < nearest[9002]["cosine"] < 1
    assert got[9001]["score"] > got[9003]["score"] and not got[9004]["evidence"]


@pytest.mark.parametrize("seed", range(3))
def test_search_is_exact_with_a_real_vocabulary(seed):
    rng = np.random.default_rng(seed)
    n, n_terms = 700, 6000
    draw = lambda size: np.unique(np.minimum(rng.zipf(1.3, size), n_terms) - 1)  # noqa: E731  some terms in nearly all, most in one or two
    vectors = []
    for i in range(n):
        at = draw(rng.integers(0, 400)) if i % 9 else (vectors[i - 1][0] if i else draw(50))
        w = (1 + np.log(rng.integers(1, 6, len(at)))) * (1 + np.log1p(at))
        vectors.append((at, w / np.sqrt((w**2).sum()) if len(at) else w))
    index = toxic_neighbours.BlockMaxIndex(vectors, n_terms)
    assert (index.column < 0).sum() > 5000 and len(index.maxima) > 1000  # lists and block maxima are really used
    dense = np.zeros((n, n_terms))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for q in range(0, n, 13):
        cosines = dense @ dense[q]
        order = [i for i in np.lexsort((np.arange(n), -cosines.round(12))) if cosines[i] > 0 and i != q][:15]
        got = index.nearest(*vectors[q], 15, but=q)
        assert [round(s, 9) for s, _ in got] == [round(cosines[i], 9) for i in order]
        assert sorted(i for _, i in got) == sorted(order) or len({round(s, 9) for s, _ in got}) < 15


def test_blocks_below_the_bound_are_not_visited(monkeypatch):
    rng = np.random.default_rng(3)
    groups = [rng.choice(np.arange(g * 200, g * 200 + 200), 30, replace=False) for g in range(30) for _ in range(64)]
    vectors = [(np.sort(at), np.full(30, 30 ** -0.5)) for at in groups]
    index = toxic_neighbours.BlockMaxIndex(vectors, 6000, frequent=0)
    visited = []
    ragged = toxic_neighbours._ragged
    monkeypatch.setattr(toxic_neighbours, "_ragged", lambda a, b: visited.append(len(a)) or ragged(a, b))
    index.nearest(*vectors[70], 5)
    assert sum(visited[1::2]) <= toxic_neighbours.FIRST_BLOCKS


def test_visits_end_where_the_bound_does(monkeypatch):
    rng = np.random.default_rng(3)
    groups = [rng.choice(np.arange(g * 200, g * 200 + 200), 30, replace=False) for g in range(30) for _ in range(64)]
    vectors = [(np.sort(at), np.full(30, 30 ** -0.5)) for at in groups]
    read, ranges = [], toxic_neighbours._ranges
    monkeypatch.setattr(toxic_neighbours, "_ranges", lambda a, n: read.append(int(n.sum())) or ranges(a, n))
    index = toxic_neighbours.BlockMaxIndex(vectors, 6000, frequent=0)
    index.nearest(*vectors[70], 5)
    # list entries, then the postings of the text's own block
    assert len(read) == 2 and read[1] <= 64 * 30


@pytest.mark.parametrize("texts", [[], ["  "], ["", "a  B b\n", "x y\u2014z\x85w", "\u0130stanbul \u1e9e STRASSE", "a_b-c'd 12\u00b2 \u0663", "\x1cA\x1fb", "\u65e5\u672c\u8a9e text\u3002ok", " \u00c9T\u00c9\u00a0\u03a3\u0391\u03a3 ", "a\u200bb a"]])
def test_terms_of_many_texts_are_listed_once(texts):
    row, place, counts, terms = toxic_neighbours.term_table(texts)
    assert len(set(terms)) == len(terms)
    for i, text in enumerate(texts):
        assert {terms[p]: int(n) for r, p, n in zip(row, place, counts) if r == i} == Counter(re.findall(r"\w+", text.lower()))
    known = [t for t in terms if t][::2]
    vectors = toxic_neighbours.Space(known, np.arange(1.0, len(known) + 1), 0.5).vectors(texts)
    for text, (at, weights) in zip(texts, vectors):
        held = Counter(re.findall(r"\w+", text.lower()))
        raw = {t: (1 + np.log(n)) * (1.0 + known.index(t) if t in known else 0.5) for t, n in held.items()}
        norm = sum(w**2 for w in raw.values()) ** 0.5
        assert at.tolist() == sorted(known.index(t) for t in held if t in known)
        assert np.allclose(weights, [raw[known[i]] / norm for i in at])


def test_calibration_is_monotone_and_weighed():
    rates, empty = toxic_neighbours.calibrated({(0, 0): 900, (0, 1): 10, (10, 0): 5, (10, 1): 50, (19, 1): 30, (5, 1): 4, (6, 0): 40, (-1, 0): 9}, 0.1)
    assert list(rates) == sorted(rates) and rates[0] < 0.02 and rates[19] > 0.9 and empty == pytest.approx(0.01)
