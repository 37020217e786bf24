"""Nearest neighbours by multi-index hashing of learned binary codes (operator 3).

Codes: vectors are scaled to length one and rotated; several rotations are learned by iterative
quantisation (alternating signs and orthogonal Procrustes) on a sample of at most about SAMPLE vectors,
each giving as many bits as the vector has components. The search radius is learned on the same sample:
the RECALL quantile of the code distances between 512 of its vectors, drawn at random, and their nearest
neighbours there (in a larger corpus neighbours only come nearer).

Index: every vector is in it. Rows are dealt by hash into shards of about SHARD_ROWS; a shard is one row
of a table with its codes, their substrings in sorted order, and the original vectors. A block of queries
visits every shard. There each substring is probed by the pigeonhole principle: for radius r and m
substrings, a code within r bits lies within r // m bits of the query in one of the first r % m + 1
substrings or within r // m - 1 bits in another. Values of a substring that occur within that distance
are looked up, candidates are verified on the whole code and reranked by exact cosines in double
precision. Queries that find fewer than k within the radius search again with all codes in reach, so
nobody gets fewer than there are.

The query set (every 50th row) against all rows grows as the square of the table by its definition; work
is dealt over (shard, query block), results are k rows per query and shard. Nothing depends on labels or
on how similar rows are, so copies of one vector are spread over the shards.

Rows: vectors that are null, zero, of another dimension than most, or hold null or non-finite components
take no part; equal scores go to the smaller vec_id; of rows that share a vec_id the smallest vector stays; a row without
vec_id is neither query nor candidate. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kalendarium.llm.common import run_folder, small_batches, stored

SAMPLE = 8_192
ROTATIONS = 4
SUBSTRING = 16
RECALL = 0.995
SHARD_ROWS = 8_192
QUERY_ROWS = 256
QUERY_EVERY = 50
SEED = 11


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


class Codes:
    """Learned rotations; ``encode`` gives rows of packed bits."""

    def __init__(self, centre: np.ndarray, rotations: np.ndarray):
        self.centre, self.rotations = centre, rotations
        self.bits = rotations.shape[1]

    @classmethod
    def fit(cls, vectors: np.ndarray, n_rotations: int = ROTATIONS, rounds: int = 20, seed: int = SEED) -> Codes:
        rng = np.random.default_rng(seed)
        x = unit(vectors)
        centre = x.mean(axis=0)
        x = x - centre
        _, axes = np.linalg.eigh(x.T @ x)
        x = x @ axes
        found = []
        for _ in range(n_rotations):
            r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
                r = (u @ v).T
            found.append(axes @ r)
        return cls(centre, np.concatenate(found, axis=1))

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        bits = (unit(vectors) - self.centre) @ self.rotations > 0
        width = -(-self.bits // 64) * 64
        padded = np.zeros((len(bits), width), dtype=np.uint8)
        padded[:, : self.bits] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def learned_radius(codes: Codes, vectors: np.ndarray, k: int, recall: float = RECALL, queries: int = 512, seed: int = SEED) -> int:
    """The code distance within which ``recall`` of the k nearest lie, asked for ``queries`` drawn vectors."""
    if len(vectors) <= k:
        return codes.bits
    x, packed, seen = unit(vectors), codes.encode(vectors), []
    for i in np.random.default_rng(seed).permutation(len(vectors))[:queries]:
        cosines = x @ x[i]
        cosines[i] = -2
        near = np.argpartition(-cosines, k - 1)[:k]
        seen.append(distances(packed[near], packed[i]))
    return int(np.quantile(np.concatenate(seen), recall, method="higher"))


class Shard:
    """One shard's multi-index: for each substring its occurring values, sorted, and the rows behind them."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray):
        self.ids, self.codes, self.vectors = ids, codes, vectors
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        parts = codes.view("<u2")
        self.tables = []
        for j in range(parts.shape[1]):
            rows = np.argsort(parts[:, j], kind="stable")
            values, starts = np.unique(parts[rows, j], return_index=True)
            self.tables.append((values, np.append(starts, len(rows)), rows))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits; all of them."""
        m = len(self.tables)
        hit = np.zeros(len(self.ids), dtype=bool)
        for j, (values, starts, rows) in enumerate(self.tables):
            reach = radius // m - (j > radius % m)
            if reach >= 0:
                flips = np.bitwise_count(values ^ code.view("<u2")[j]) <= reach
                # rows of a value are neighbours in ``rows``: spread the verdict over its run
                hit[rows[np.repeat(flips, np.diff(starts))]] = True
        found = np.flatnonzero(hit)
        return found[distances(self.codes[found], code) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, code: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact cosines of the k nearest codes within the radius, reranked."""
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != query_id]
        v = vector.astype(np.float64)
        # one sum per row, in the same order everywhere: equal vectors get equal scores
        scores = (self.vectors[rows].astype(np.float64) * v).sum(axis=1) / (self.lengths[rows] * np.sqrt((v**2).sum()))
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def _pack(codes: Codes, key: str, kind: str):
    """The rows of a group as one row of byte strings."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = np.array(table.column("v").combine_chunks().flatten(), dtype=kind).reshape(len(ids), -1)[order]
        packed = codes.encode(vectors)
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({key: table.column(key)[:1].combine_chunks(), "ids": blob(ids[order].astype("<i8")), "codes": blob(packed), "vectors": blob(vectors)})

    return run


def _search(dim: int, k: int, radius: int, kind: str):
    def run(batches):
        kept = (None, None)
        for batch in batches:
            for row in batch.to_pylist():
                if kept[0] != row["shard"]:
                    ids = np.frombuffer(row["ids"], "<i8")
                    kept = (row["shard"], Shard(ids, np.frombuffer(row["codes"], "<u8").reshape(len(ids), -1), np.frombuffer(row["vectors"], kind).reshape(len(ids), dim)))
                query_ids = np.frombuffer(row["q_ids"], "<i8")
                codes = np.frombuffer(row["q_codes"], "<u8").reshape(len(query_ids), -1)
                vectors = np.frombuffer(row["q_vectors"], kind).reshape(len(query_ids), dim)
                out: list[tuple] = []
                for q, code, vector in zip(query_ids.tolist(), codes, vectors):
                    found, scores = kept[1].nearest(q, vector, code, k, radius)
                    out += zip([q] * len(found), found.tolist(), scores.tolist())
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _visits(shards: DataFrame, queries: DataFrame, dim: int, k: int, radius: int, kind: str) -> DataFrame:
    # every block meets every shard: blocks repeated per shard would be shuffled, or broadcast by the size of the unrepeated ones
    blocks = queries.select(F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"), F.col("vectors").alias("q_vectors"))
    return shards.crossJoin(blocks).mapInArrow(_search(dim, k, radius, kind), "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_neighbours(table: DataFrame, k: int = 5, every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for each query row."""
    spark = table.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # rows here are whole shards
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    folder = run_folder(spark, "ann")
    # components stay as exact as they are given
    given = table.schema["embedding"].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)
    rows = rows.filter(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.filter(F.size("v") == dim)
    share = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.filter(share < min(1.0, SAMPLE / total)).orderBy("vec_id").select("v").toArrow()
    some = drawn if drawn.num_rows else rows.limit(1).select("v").toArrow()
    sample = np.array(some.column("v").combine_chunks().flatten(), dtype=kind).reshape(-1, dim)
    codes = Codes.fit(sample)
    radius = learned_radius(codes, sample, k)
    n_shards = max(1, -(-total // shard_rows))
    layout = "ids binary, codes binary, vectors binary"
    salted = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)))
    shards = stored(salted.groupBy("shard").applyInArrow(_pack(codes, "shard", kind), f"shard long, {layout}"), f"{folder}/shards")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-asked.count() // query_rows))
    pack_queries = lambda df: df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).groupBy("block").applyInArrow(_pack(codes, "block", kind), f"block long, {layout}")
    found = _top(_visits(shards, stored(pack_queries(asked), f"{folder}/queries"), dim, k, radius, kind), k)
    found = stored(found.select("query_id", "rank", "vec_id", "score"), f"{folder}/found")
    full = found.groupBy("query_id").count().filter(F.col("count") >= k)
    short = asked.join(full, asked["vec_id"] == full["query_id"], "left_anti")
    again = _top(_visits(shards, stored(pack_queries(short), f"{folder}/short"), dim, k, codes.bits, kind), k)
    return found.join(full, "query_id", "left_semi").unionByName(again.select(*found.columns)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
