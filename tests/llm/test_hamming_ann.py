import numpy as np

from kalendarium.llm import hamming_ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=5, every=50):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    lengths = np.sqrt((x**2).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = (x * x[q]).sum(axis=1) / (lengths * lengths[q])
        scores[q] = -np.inf
        best = np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in best]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 32))
    vectors = {i: (centres[i % 6] + rng.standard_normal(32)).tolist() for i in range(3000)}
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA)
    got, exact = answers(hamming_ann.nearest_neighbours(df, shard_rows=700, query_rows=16)), brute(vectors)
    assert got.keys() == exact.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert hits >= 0.9 * 5 * len(exact)
    scores = {(q, i): s for q, near in brute(vectors, k=2999).items() for i, s in near}
    assert all(abs(scores[q, i] - s) < 1e-12 for q, near in got.items() for i, s in near)


def test_doubles_are_scored_as_doubles(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.standard_normal(16).tolist() for i in range(200)}
    vectors[1] = [x * (1 + 1e-9 * i) for i, x in enumerate(vectors[0])]  # one vector as floats, two as doubles
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    for q, near in answers(hamming_ann.nearest_neighbours(df)).items():
        a = np.array(vectors[q])
        for i, score in near:
            b = np.array(vectors[i])
            assert abs(score - (a @ b) / np.sqrt((a @ a) * (b @ b))) < 1e-14


def test_radius_does_not_follow_the_first_rows():
    rng = np.random.default_rng(6)
    tight, wide = rng.standard_normal(16) + 1e-3 * rng.standard_normal((600, 16)), rng.standard_normal((3000, 16))
    codes = hamming_ann.Codes.fit(np.concatenate([tight, wide]))
    assert hamming_ann.learned_radius(codes, np.concatenate([tight, wide]), 5) > 2 * hamming_ann.learned_radius(codes, tight, 5)


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((900, 32)).astype(np.float32)
    codes = hamming_ann.Codes.fit(vectors)
    packed = codes.encode(vectors)
    shard = hamming_ann.Shard(np.arange(900), packed, vectors)
    for radius in (0, 3, 7, 25, 40, 57, codes.bits):
        for q in range(0, 900, 97):
            assert shard.within(packed[q], radius).tolist() == np.flatnonzero(hamming_ann.distances(packed, packed[q]) <= radius).tolist()


def test_ties_copies_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.standard_normal(8).astype(np.float32).tolist() for i in range(120)}
    for i in range(30, 60):
        vectors[i] = vectors[0]
    left_out = [(500, None, 0), (550, [0.0] * 8, 0), (551, [float("nan")] + [1.0] * 7, 0), (552, [None] + [1.0] * 7, 0), (553, [float("inf")] * 8, 0), (554, [1.0] * 7, 0), (555, [], 0), (None, [1.0] * 8, 0)]
    repeated = [(i, vectors[i], 1) for i in (0, 7)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()] + left_out + repeated, SCHEMA)
    got, exact = answers(hamming_ann.nearest_neighbours(df)), brute(vectors)
    assert got.keys() == exact.keys()
    assert [i for i, _ in got[0]] == [30, 31, 32, 33, 34] and [i for i, _ in got[50]] == [0, 30, 31, 32, 33]


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, -1.0], 0), (2, [-1.0, 0.0], 0)], SCHEMA)
    assert [i for i, _ in answers(hamming_ann.nearest_neighbours(df))[0]] == [1, 2]
    assert answers(hamming_ann.nearest_neighbours(df.filter("vec_id = 0"))) == {}
    assert answers(hamming_ann.nearest_neighbours(df.limit(0))) == {}


def test_query_blocks_are_not_repeated_per_shard_before_they_meet(spark, tmp_path):
    codes = np.zeros((4, 4), dtype="<u8").tobytes()
    rows = [(i, np.arange(4, dtype="<i8").tobytes(), codes, np.ones((4, 2), dtype="<f4").tobytes()) for i in range(50)]
    table = lambda key, n: hamming_ann.stored(spark.createDataFrame(rows[:n], f"{key} long, ids binary, codes binary, vectors binary"), f"{tmp_path}/{key}")
    plan = hamming_ann._visits(table("shard", 50), table("block", 3), 2, 5, 256, "<f4")._jdf.queryExecution()
    assert "Generate" not in plan.optimizedPlan().toString() and "hashpartitioning" not in plan.executedPlan().toString()
