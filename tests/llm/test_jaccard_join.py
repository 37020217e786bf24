import random

import numpy as np
import pyarrow as pa
import pytest

from kalendarium.llm import catalog, jaccard_join
from tests.llm.tables import documents, odd_rows, prose, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    parts = [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    return {tuple(parts)} if 0 < len(parts) < n else {tuple(parts[i:i + n]) for i in range(len(parts) - n + 1)}


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def changed(text, seed, n):
    draw = random.Random(seed)
    parts = text.split(" ")
    for _ in range(n):
        parts[draw.randrange(len(parts))] = f"x{draw.randrange(10**6)}"
    return " ".join(parts)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(20, "Three small words"), (21, "three SMALL\twords"), (22, "one"), (23, "w1 w2 w3 w4"), (24, "three small words more")]
    assert got(jaccard_join.jaccard_groups(documents(spark, rows))) == brute(rows)
    assert jaccard_join.jaccard_groups(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    draw = random.Random(seed)
    passage = " ".join(words(1000 + seed, 60))
    rows, base = [], [" ".join(words(50 * seed + i, draw.choice([5, 6, 7, 8, 20, 60, 200]))) for i in range(25)]
    for i in range(260):
        text = base[min(draw.randrange(25), draw.randrange(25))]  # a few texts have most of the copies
        text = changed(text, i, draw.randrange(0, 1 + len(text.split(" ")) // 30)) if draw.random() < 0.8 else text
        if draw.random() < 0.3:
            text = f"{text} {passage}"
        rows.append((i, text))
    df = jaccard_join.jaccard_groups(documents(spark, rows))
    assert got(df) == brute(rows)


def test_links_right_at_the_bound(spark):
    tokens = words(5, 103, 10**6)  # 100 shingles
    drop = lambda n: " ".join(tokens[: len(tokens) - n])
    rows = [(1, drop(0)), (2, drop(15)), (3, drop(16)), (4, drop(29))]  # 85, 84, 71 of 100
    assert got(jaccard_join.jaccard_groups(documents(spark, rows))) == brute(rows)
    pairs = [(1, drop(0)), (2, drop(16))]
    assert [c for _, _, c in got(jaccard_join.jaccard_groups(documents(spark, pairs)))] == [1, 2]


def test_rows_of_a_dense_group_meet_their_leader_only(spark):
    text = " ".join(words(3, 150, 10**6))
    rows = [(i, changed(text, i, 1)) for i in range(120)]
    folder = jaccard_join.run_folder(spark, "dense")
    matrix = jaccard_join.Matrix(documents(spark, rows), folder)
    panel = matrix.panel()
    leaders = jaccard_join._leader_cells(panel, 85)
    assert 0 < leaders.count() <= panel.count() < 120 * 119 // 2
    groups = jaccard_join.components(matrix.links(leaders, f"{folder}/l"), f"{folder}/c").selectExpr("node as set_id", "root")
    assert jaccard_join._group_cells(jaccard_join._open_panel(panel, groups), 85).count() < 120


@pytest.mark.parametrize("tile", [7, 256])
def test_near_copies_just_below_the_bound_meet_by_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    text = " ".join(words(4, 150, 10**6))
    rows = [(i, changed(text, 1000 + i, 2 + i % 4)) for i in range(150)]
    folder = jaccard_join.run_folder(spark, "tiles")
    panel = jaccard_join.Matrix(documents(spark, rows), folder).panel()
    alone = spark.createDataFrame([], "set_id long, root long")
    cells = jaccard_join._group_cells(jaccard_join._open_panel(panel, alone), 85).collect()
    tiles = {t for r in cells for t in (r["tile_a"], r["tile_b"])}
    assert len(cells) <= len(tiles) * (len(tiles) + 1) // 2
    assert 2 * len(cells) < sum(len(r["cells"]) for r in cells) // 16
    assert got(jaccard_join.jaccard_groups(documents(spark, rows))) == brute(rows)


def test_product_of_tiles():
    rng = np.random.default_rng(2)
    for panel in (3, 4096):
        a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 30)).astype(np.uint64)) for _ in range(n)] for n in (9, 5))
        flat = lambda rows: (np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
        assert jaccard_join.product(flat(a), flat(b), (9, 5), panel).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert jaccard_join._forest([1, 2, 1, 4], [2, 3, 3, 1]) == [True, True, False, True]


def test_columns_of_one_row_go_over_batch_ends():
    column = [1, 1, 2, 3, 3, 3, 4, 5, 5, 6, 7, 7]
    row = [1, 1, 5, 2, 2, 9, 1, 1, 2, 3, 4, 4]
    wanted = [(3, 2), (3, 9), (5, 1), (5, 2)]
    for cut in (1, 2, 3, 5, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array(column[i:i + cut]), pa.array(row[i:i + cut])], ["column", "set_id"]) for i in range(0, 12, cut)]
        out = [(r["column"], r["set_id"]) for b in jaccard_join._shared(iter(batches)) for r in b.to_pylist()]
        assert out == wanted


def test_overlap_by_panels():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        whole = len(np.intersect1d(a, b))
        assert jaccard_join.overlap(a, b, 0, panel=7) == whole
        assert (jaccard_join.overlap(a, b, 20, panel=7) >= 20) == (whole >= 20)


@pytest.mark.parametrize("n", range(1, 400))
def test_linked_rows_lie_in_neighbouring_blocks(n):
    most = 100 * n // 85
    assert jaccard_join.size_block(most) - jaccard_join.size_block(n) <= 1
    assert n - jaccard_join.leading(n) + 1 == -(-85 * n // 100)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(catalog.QUERIES["op12_jaccard_join"](spark, folder)) == brute(rows)
    assert prose(1, 5)
