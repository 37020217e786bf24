import random

import numpy as np
import pytest

from kalendarium.llm import mixing
from tests.llm.tables import documents, odd_rows, prose, rows


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left = {}, set(sizes)
    while left:
        rest, total = sum(sizes.values()) - sum(out.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > 3 * sizes[s]]
        out |= {s: 3.0 * sizes[s] for s in over} if over else {s: rest * weight[s] / total for s in left}
        left -= set(over) if over else left
    return out


def check(df, tolerance):
    by_source = {}
    for r in df.collect():
        s = by_source.setdefault(r["source"], {"size": 0, "taken": 0, "r": r})
        s["size"] += r["size"]
        s["taken"] += r["taken"]
        assert r["taken"] == r["epochs"] * r["size"] and 0 <= r["epochs"] <= 3
    want = targets({s: v["size"] for s, v in by_source.items()})
    for s, v in by_source.items():
        assert v["r"]["source_size"] == v["size"] and v["r"]["target"] == pytest.approx(want[s])
        assert abs(v["taken"] - want[s]) <= tolerance(s, v)


def test_targets_are_met(spark):
    draw = random.Random(1)
    given = [(i, " ".join(["w"] * draw.randrange(1, 300)), "hot" if i % 3 == 0 else draw.choice([None, "b", "c", "Z"])) for i in range(1500)]
    df = mixing.mix(documents(spark, given))
    check(df, lambda s, v: 1)
    again = mixing.mix(documents(spark, given[::-1]).repartition(7))
    assert rows(df, "doc_id", "epochs") == rows(again, "doc_id", "epochs")


def test_one_length_in_a_hot_source(spark):
    given = [(i, "a b c d", "hot") for i in range(2000)] + [(5000 + i, "x " * 9, "small") for i in range(20)]
    check(mixing.mix(documents(spark, given)), lambda s, v: 4 if s == "hot" else 9)


def test_odd_rows(spark):
    df = mixing.mix(documents(spark, odd_rows() + [(50, prose(7, 90), "d"), (51, None, "empty source")]))
    assert df.count() == len(odd_rows()) + 2
    assert sorted(r["size"] for r in df.collect()) == sorted(len((r[1] or "").split(None)) for r in odd_rows() + [(0, prose(7, 90)), (0, "")])
    assert all(r["taken"] == 0 for r in df.filter("size = 0").collect())


@pytest.mark.parametrize("seed", range(30))
def test_budget_is_fitted_as_well_as_can_be(seed):
    draw = random.Random(seed)
    lengths = np.array(sorted(draw.sample(range(1, 40), draw.randrange(1, 6))))
    counts = np.array([draw.randrange(1, 4) for _ in lengths])
    sums = {0}
    for n, c in zip(lengths.tolist(), counts.tolist()):
        sums = {s + k * n for s in sums for k in range(c + 1)}
    budget = draw.randrange(int((lengths * counts).sum()) + 1)
    # no equal share taken beforehand: the dynamic programme alone is exact
    taken = mixing._knapsack(lengths, counts, budget, np.arange(len(lengths))) if budget else np.zeros(len(lengths), int)
    assert (taken <= counts).all() and abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
    whole = mixing.fit_budget(lengths, counts, budget, np.random.default_rng(seed))
    assert (whole <= counts).all() and abs(int((whole * lengths).sum()) - budget) <= int(lengths.max())


def test_large_budgets_come_near():
    rng = np.random.default_rng(3)
    lengths, counts = np.arange(1, 20_001, 7), rng.integers(1, 50, 2858)
    budget = int((lengths * counts).sum() * 0.37)
    taken = mixing.fit_budget(lengths, counts, budget, rng)
    assert (taken <= counts).all() and int((taken * lengths).sum()) == budget
    huge = mixing.fit_budget(np.array([3, 10**9]), np.array([5, 4]), 2 * 10**9 + 7, rng)
    assert abs(int((huge * np.array([3, 10**9])).sum()) - 2 * 10**9 - 7) <= 2


@pytest.mark.parametrize("lengths, counts, budget, words", [
    ([200_000], [1], 150_000, 200_000), ([200_000], [1], 90_000, 0), ([100, 200_000], [3, 1], 190_000, 200_000), ([100, 200_000], [3, 1], 199_900, 200_000),
    ([100, 200_000], [3, 1], 100_050, 300), ([100, 200_000], [3, 1], 100_200, 200_000), ([7, 150_000, 400_000], [2, 1, 1], 500_000, 550_000),
])
def test_one_long_document_more_where_that_is_nearer(lengths, counts, budget, words):
    lengths, counts = np.array(lengths), np.array(counts)
    taken = mixing.fit_budget(lengths, counts, budget, np.random.default_rng(0))
    sums = [0]
    for n, c in zip(lengths.tolist(), counts.tolist()):
        sums = [s + k * n for s in sums for k in range(c + 1)]
    assert (0 <= taken).all() and (taken <= counts).all()
    assert abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
    assert int((taken * lengths).sum()) == words


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
