import random
import re

import numpy as np
import pytest
import xxhash

from kalendarium.llm import simhash_groups
from kalendarium.llm.common import run_folder
from kalendarium.llm.components import components
from tests.llm.tables import documents, odd_rows, prose, words


def plain_fingerprint(text, size=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(tokens[i:i + size]) for i in range(len(tokens) - size + 1)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=4):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                root[find(b)] = find(a)
    return {p: find(p) for p in ordered}


@pytest.mark.parametrize("text", [None, "", "One", "one two THREE four", "Ä ä one two three four five", prose(1, 500), " a b c d e f g\x1fh i\x85j"])
def test_fingerprint(text):
    assert simhash_groups.fingerprint(text or "") % (1 << 64) == plain_fingerprint(text)


def test_groups_like_brute_force(spark):
    given = odd_rows() + [(11, " "), (12, None), (13, "\n")]
    for i in range(40):
        own = words(i, 120)
        given += [(100 + i, " ".join(own)), (200 + i, " ".join(own).upper())]
        for j in range(4):
            near = list(own)
            for _ in range(1 + j % 2):
                near[random.Random(i * 9 + j).randrange(len(near))] = f"edit{i}{j}"
            given.append((1000 - 7 * i - j, " ".join(near)))
    prints = {(d[0], d[1]): plain_fingerprint(d[1]) for d in given}
    roots = plain_groups(set(prints.values()))
    least = {}
    for (doc_id, _), p in prints.items():
        if doc_id is not None:
            least[roots[p]] = min(doc_id, least.get(roots[p], doc_id))
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_groups.simhash_groups(documents(spark, given)).collect()]
    assert sorted(got, key=repr) == sorted(((d[0], prints[d[0], d[1]], least.get(roots[prints[d[0], d[1]]])) for d in given), key=repr)


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
@pytest.mark.parametrize("pivots", [(), (3,)])
def test_chains_and_dense_groups_of_fingerprints(spark, radius, pivots):
    draw = random.Random(radius)
    prints = {draw.getrandbits(64) for _ in range(150)}
    for _ in range(6):  # chains whose ends are far apart, and balls around one fingerprint
        p = draw.getrandbits(64)
        for _ in range(20):
            p ^= sum(1 << b for b in draw.sample(range(64), draw.choice([1, 2, 4, 5])))
            prints.add(p)
        prints |= {p ^ sum(1 << b for b in draw.sample(range(12), 3)) for _ in range(20)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r["fp"] % (1 << 64): r["root"] for r in simhash_groups.link_groups(df, run_folder(spark, "t8"), radius, pivots).collect()}
    expected = plain_groups(prints, radius)
    together = lambda groups: {frozenset(p for p in groups if groups[p] == g) for g in set(groups.values())}
    assert together(found) == together(expected)


def test_thresholds_keep_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    prints[:900] &= np.uint64(0xFFFF)  # one dense part
    for m in (2, 3, 4, 5):
        plan = simhash_groups.Plan(prints, len(prints), m, 4)
        assert sorted(b for part in plan.parts for b in part) == list(range(64))
        chosen, _ = plan.thresholds(prints)
        assert (chosen.sum(axis=1) == 4 - m + 1).all() and (chosen >= -1).all()


def test_components(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 260)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)] + [(7, 7), (0, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), run_folder(spark, "cc")).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for node in sorted(near):
        todo = [node] if node not in expected else []
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = node
                todo += near[x]
    assert got == expected


def test_empty_table(spark):
    assert simhash_groups.simhash_groups(documents(spark, [])).collect() == []
