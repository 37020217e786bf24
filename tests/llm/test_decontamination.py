import re
from collections import Counter

import pytest

from kalendarium.llm import decontamination
from tests.llm.tables import documents, odd_rows, prose, words

ITEMS = "item_id long, text string, source string"


def shingles(tokens):
    return Counter(tuple(tokens[i:i + 5]) for i in range(len(tokens) - 4))


def normal(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, least=0.8):
    out = {}
    for doc_id, text, *_ in docs:
        own = normal(text)
        for item_id, item in items:
            known = shingles(normal(item))
            n = len(normal(item))
            for s in range(max(1, len(own) - n + 1)) if known else []:
                window = shingles(own[s:s + n])
                alike = sum((window & known).values()) / max(1, sum((window | known).values()))
                if alike >= least:
                    out[doc_id, item_id] = max(alike, out.get((doc_id, item_id), 0))
    return out


def planted():
    items = [(i, " ".join(words(1000 + i, 14 + i % 45))) for i in range(60)] + [(90, "too short"), (91, None), (92, ""), (93, "a a a a a a a a"), (94, items_twice := " ".join(words(7, 20))), (95, items_twice)]
    docs = odd_rows()
    for i in range(60):
        passage = items[i][1].split()
        edited = list(passage)
        if i % 4 == 1:
            edited[0] = "changed"
        if i % 4 == 2:
            edited[len(edited) // 2] = "changed"
        if i % 4 == 3:
            edited = [w.upper() + "," for w in edited]
        around = words(2000 + i, 400 if i % 5 else 0)
        cut = len(around) // 2
        docs.append((100 + i, " ".join(around[:cut] + edited + around[cut:]), "s"))
    docs += [(300, " ".join(words(5, 30) + words(1001, 12)), "s"), (301, "a " * 40, "s"), (302, " ".join(words(7, 20) * 3), "s"), (302, " ".join(words(7, 20) * 3), "s")]
    return docs, items


@pytest.mark.parametrize("max_broadcast", [1_000_000, 0])
def test_like_brute_force(spark, max_broadcast):
    docs, items = planted()
    df = decontamination.find_leaks(documents(spark, docs), spark.createDataFrame([(*i, "x") for i in items], ITEMS), max_broadcast=max_broadcast)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in df.collect()}
    expected = brute(docs, items)
    assert len(expected) > 40
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_plan_stays_native(spark):
    docs, items = planted()
    df = decontamination.find_leaks(documents(spark, docs), spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_blocks_meet_within_the_radius(spark):
    df = spark.createDataFrame([(5,), (-1,), (1 << 62,), (-(1 << 63),)], "fp long").select("fp", decontamination.blocks("fp", 20).alias("b"))
    for r in df.groupBy("fp").agg({"b": "count"}).collect():
        assert r[1] == 21
    bits = {}
    for r in df.collect():
        bits[r["fp"]] = bits.get(r["fp"], 0) + bin(r["b"]["value"]).count("1")
    assert bits == {5: 2, -1: 64, 1 << 62: 1, -(1 << 63): 1}


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, prose(1, 30), "x")], ITEMS)
    assert decontamination.find_leaks(documents(spark, []), items).collect() == []
    assert decontamination.find_leaks(documents(spark, odd_rows()), items.limit(0)).collect() == []
