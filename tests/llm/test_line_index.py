import numpy as np
import pytest

from kalendarium.llm import line_index
from tests.llm.tables import documents, odd_rows, prose, rows


def brute(given):
    holders = {}
    key = lambda line: line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    last = (1 << 63) - 1
    for doc_id, text, *_ in given:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(last if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in given:
        lines = (text or "").split("\n")
        gone = [len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != (last if doc_id is None else doc_id) for x in lines]
        out.append((doc_id, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


SHARED = ["A line that many documents hold", "  a LINE that many documents hold\t", "short", "Änderung bleibt Änderung", "ändeRung bleibt ändeRung", "nine char"]


@pytest.mark.parametrize("hot_share", [1, 5, 4096])
@pytest.mark.parametrize("keys_per_shard", [3, 1 << 17])
def test_like_brute_force(spark, hot_share, keys_per_shard):
    made = [(i, "\n".join([prose(i % 7, 20), SHARED[i % len(SHARED)], SHARED[0], f"own line of {i}", SHARED[0]]), "s") for i in range(40)]
    given = made + odd_rows()
    df = line_index.dedup_lines(documents(spark, given), keys_per_shard=keys_per_shard, hot_share=hot_share)
    assert rows(df, "doc_id", "n_lines", "n_dropped", "kept") == brute(given)


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(5)
    h1, h2 = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2))
    h1[:500] = h1[0]  # one half of the hash may repeat
    hashes = line_index.PerfectHash.of(h1, h2)
    assert sorted(hashes.numbers(h1, h2).tolist()) == list(range(20_000))
    counts, first = rng.integers(1, 400, 20_000), rng.integers(0, 99, 20_000)
    shard = line_index.LineShard.from_bytes(line_index.LineShard.of(h1, h2, counts, first).to_bytes())
    assert shard.dropped(h1, h2, np.full(20_000, 50)).tolist() == ((counts > 1) & (first < 50)).tolist()
    foreign = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert not shard.dropped(foreign, foreign, np.full(5000, 1 << 40)).any()


def test_empty_table(spark):
    assert line_index.dedup_lines(documents(spark, [])).collect() == []
