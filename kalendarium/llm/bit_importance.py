"""Importance resampling towards a target distribution by bit-sliced aggregation (operator 11).

Words are runs of digits, ASCII letters (lower-cased) and code points beyond ASCII; features are runs of 1
to MAX_RUN words, repeats counted, and a feature's bucket is its crc32 modulo BUCKETS. A bucket's gain is
the floored log ratio of its smoothed shares in the target and in the corpus, in thousandths.

Weights are exact sums of gains without a multiplication per feature: a document's bucket counts become
bit planes (plane j holds the buckets whose count has bit j), the gains become planes in two's complement
(the last one counts negative), and each pair of planes adds popcount(AND) times a power of two. Documents
keep their buckets and counts as sparse arrays in the run folder, so texts are read once.

The draw is Gumbel top-k: weight plus a noise that only the seed and doc_id decide. Ranks come from one
shuffle by ranges of the order; a task's rows are numbered in place and offset by the rows of the ranges
before it, of which there is one count per task. The driver holds BUCKETS gains and those counts.

Rows: null and empty texts have no feature and weight 0; a missing doc_id counts as empty text in the noise
and comes last among ties; repeated rows each count and each get a rank; order among equal rows doesn't
show. Without target or corpus texts the smoothed shares remain. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalendarium.llm.common import Memo, per_worker, plain_words, run_folder, small_batches, stored, text_bytes

BUCKETS = 10_000
MAX_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: documents whose planes are held at once
BLOCK = 128
_ORDINAL = (1 << 33) - 1


def _features(words: list[bytes], max_run: int) -> list[bytes]:
    """All runs of 1 to ``max_run`` words, joined by one blank."""
    out = list(words)
    for n in range(2, max_run + 1):
        out += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return out


def _bucket_counts(buckets: int, max_run: int):
    def run(batches):
        numbers = per_worker(f"buckets:{buckets}", lambda: Memo(lambda feature: zlib.crc32(feature) % buckets))
        for batch in batches:
            n_words, n_features, held, counts = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = plain_words(text)
                features = words if max_run == 1 else _features(words, max_run)
                at, n = np.unique(np.fromiter(map(numbers.__getitem__, features), np.int64, len(features)), return_counts=True)
                n_words.append(len(words))
                n_features.append(len(features))
                held.append(at.astype("<u4").tobytes())
                counts.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(held, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "text_hash", "n_words", "n_features", "buckets", "counts"])

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """doc_id, text_hash, n_words, n_features and the buckets with their counts, one row per row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_bytes().alias("text")).withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
    return rows.mapInArrow(_bucket_counts(buckets, max_run), "doc_id long, text_hash long, n_words long, n_features long, buckets binary, counts binary")


def _flat(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4")


def _totals(buckets: int):
    def run(batches):
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            np.add.at(sums, _flat(batch.column("buckets")), _flat(batch.column("counts")).astype(np.int64))
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(sums[held], pa.int64())], ["bucket", "n"])

    return run


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; a task sends at most one row per bucket."""
    rows = counted.select("buckets", "counts").mapInArrow(_totals(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(buckets, dtype=np.int64)
    for row in rows:
        sums[row["bucket"]] = row["n"]
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda t, s: float((t + 1) * (all_corpus + n)) / float((s + 1) * (all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(int(t), int(s)))) for t, s in zip(target, corpus)], dtype=np.int64)


class GainPlanes:
    """Signed integers as bit planes over the buckets, in two's complement."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.words = -(-self.n // 64)
        largest = int(np.abs(values).max(initial=0))
        self.bits = largest.bit_length() + 1  # the last plane counts negative
        padded = np.zeros(self.words * 64, dtype=np.int64)
        padded[: self.n] = values
        self.planes = [np.packbits((padded >> k & 1).astype(np.uint8), bitorder="little").view("<u8") for k in range(self.bits)]

    def weights(self, rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray, n_rows: int) -> np.ndarray:
        """Exact sums of count * value per row, from planes, popcounts and powers of two."""
        out = np.zeros(n_rows, dtype=np.int64)
        width = self.words * 64
        for j in range(int(counts.max(initial=0)).bit_length()):
            with_bit = (counts >> j & 1).astype(bool)
            held, row = np.unique(rows[with_bit], return_inverse=True)  # most documents have few planes
            bits = np.zeros(len(held) * width, dtype=np.uint8)
            bits[row * width + buckets[with_bit]] = 1
            plane = np.packbits(bits, bitorder="little").view("<u8").reshape(len(held), self.words)
            for k, gain in enumerate(self.planes):
                hits = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
                out[held] += (-hits if k == self.bits - 1 else hits) << (j + k)
        return out


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, from the seed and the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(planes: GainPlanes, seed: int):
    def run(batches):
        for batch in batches:
            held, counts = batch.column("buckets").to_pylist(), batch.column("counts").to_pylist()
            weights = np.zeros(len(held), dtype=np.int64)
            for at in range(0, len(held), BLOCK):
                some = held[at:at + BLOCK]
                rows = np.repeat(np.arange(len(some)), [len(b) // 4 for b in some])
                flat = lambda parts: np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
                weights[at:at + len(some)] = planes.weights(rows, flat(some), flat(counts[at:at + BLOCK]), len(some))
            extra = [noise(i, seed) for i in batch.column("doc_id").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "text_hash", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weights), pa.array(weights + np.array(extra, dtype=np.int64))], ["doc_id", "text_hash", "n_words", "n_features", "weight", "score"])

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score and rank (of the drawn documents, else null)."""
    folder = run_folder(docs.sparkSession, "importance")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    counted = stored(bucket_counts(rows, buckets, max_run), f"{folder}/counts")
    aims = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, max_run)
    planes = GainPlanes(gains(bucket_totals(counted, buckets), bucket_totals(aims, buckets)))
    scored = stored(
        counted.mapInArrow(_scores(planes, seed), "doc_id long, text_hash long, n_words long, n_features long, weight long, score long"), f"{folder}/scored")
    # the last key spreads repeated rows over the ranges
    row = scored.withColumn("in", F.col("n_words") >= least_words).withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("in"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("text_hash"), F.asc("row")]
    ranged = row.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("place", F.monotonically_increasing_id()).drop("row"), f"{folder}/placed")
    ranges = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.count_if("in").alias("n_in"))
    # one row per range, as many as the shuffle has tasks
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(ranges.select("range", before.alias("before"), "n_in"), f"{folder}/ranges")
    drawn = (offsets.agg(F.sum("n_in")).first()[0] or 0) * percent // 100
    place = F.col("before") + F.col("place").bitwiseAND(F.lit(_ORDINAL)) + 1
    ranked = placed.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(offsets), "range")
    return ranked.select("doc_id", "text_hash", "n_words", "n_features", "weight", "score", F.when(place <= F.lit(drawn), place).alias("rank"))
