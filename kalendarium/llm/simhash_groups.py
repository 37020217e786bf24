"""SimHash near-duplicate groups by the generalised pigeonhole principle (operator 8).

Fingerprints are 64-bit SimHashes over word shingles; two within RADIUS differing bits are linked, and a
group is what links reach. The 64 bits are dealt into partitions, correlated bits together. For parts
p_1..p_m and thresholds with sum RADIUS - m + 1 (a threshold of -1 leaves a part out), any two linked
fingerprints lie within a threshold of each other in some part. The number of parts and, for every
fingerprint on its own, the thresholds come from a dynamic programme over estimated candidate counts:
histograms of the part's leading bits say how full the neighbourhood is. A fingerprint probes each part
for all values within its threshold; what shares the value is verified on all 64 bits.

Only different fingerprints are compared. A first round probes a hashed share of the fingerprints
(pivots), which joins nearly all of a large group with a small share of its links; the last round probes
all and reports only links between different groups of the rounds before. So no group lists its pairs.

Rows: a null or empty text has no words and fingerprint zero; fewer words than a shingle make one
shingle of all words; rows without doc_id take part and get the smallest id of their group, or null.
An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendarium.llm.common import forget_others, run_folder, small_batches, stored, text_of
from kalendarium.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: rows of fingerprints that train the bit partition and the histograms' resolution, both bounded
SAMPLE = 20_000
HISTOGRAM_BITS = 12
#: what a probe (a shuffled row) costs against a candidate (a comparison in the join)
PROBE_COST = 30.0
#: rounds against one in so many fingerprints before the round against all
PIVOTS = (64,)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in more than half of the shingles' XXH64; signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() touch exactly A-Z and the six white-space characters
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        hashes = [xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1:])]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        block = np.array(hashes[at:at + 8192], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        forget_others()
        for batch in batches:
            prints = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.int64())], ["doc_id", "text_hash", "fp"])

    return run


# --------------------------------------------------------------- parts, thresholds, probes (workers)


def correlated_parts(prints: np.ndarray, m: int) -> list[list[int]]:
    """Deal 64 bits into m parts of near equal width: a part starts with the most skewed open bit and
    takes the open bits that correlate most with what it holds, so the others stay as independent as can be."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    related = np.abs(centred.T @ centred) / scale[:, None] / scale[None, :]
    skew = np.abs(bits.mean(axis=0) - 0.5)
    left, parts = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        part = [max(sorted(left), key=lambda b: skew[b])]
        left.discard(part[0])
        while len(part) < width:
            part.append(max(sorted(left), key=lambda b: related[b, part].sum()))
            left.discard(part[-1])
        parts.append(part)
    return parts


def part_values(prints: np.ndarray, part: list[int]) -> np.ndarray:
    prints = prints.astype(np.uint64)
    out = np.zeros(len(prints), dtype=np.uint64)
    for to, bit in enumerate(part):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
    return out


def masks(width: int, most: int) -> list[np.ndarray]:
    """The masks of 0, 1, .. ``most`` set bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), k)], dtype=np.uint64) for k in range(most + 1)]


def histogram(values: np.ndarray, width: int) -> np.ndarray:
    """Share of fingerprints by a part's leading bits."""
    bits = min(width, HISTOGRAM_BITS)
    return np.bincount((values >> np.uint64(width - bits)).astype(np.int64), minlength=1 << bits) / max(len(values), 1)


def costs(values: np.ndarray, width: int, shares: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Estimated cost of thresholds -1..radius per fingerprint: probes, and candidates if the rest of the
    part is spread evenly behind its leading bits (and, beyond two flips, over these)."""
    bits = min(width, HISTOGRAM_BITS)
    lead = (values >> np.uint64(width - bits)).astype(np.int64)
    rest = width - bits
    ball = [sum(shares[lead ^ int(m)] for m in ms) if len(ms) else np.zeros(len(values)) for ms in masks(bits, min(2, bits, radius))]
    out = np.zeros((len(values), radius + 2))
    for t in range(radius + 1):
        candidates = np.zeros(len(values))
        for flips in range(min(t, bits) + 1):  # flips among the leading bits, the rest behind them
            share = ball[flips] if flips < len(ball) else comb(bits, flips) / (1 << bits)
            candidates += share * sum(comb(rest, k) for k in range(t - flips + 1)) / (1 << rest)
        out[:, t + 1] = sum(comb(width, k) for k in range(t + 1)) * PROBE_COST + n * candidates
    return out


def allocate(per_part: list[np.ndarray], radius: int) -> np.ndarray:
    """Thresholds per fingerprint and part, at least -1 each, with sum radius - m + 1 and the smallest
    estimated cost; counted as t + 1 >= 0 with sum radius + 1."""
    n, budget = len(per_part[0]), radius + 1
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    choice = []
    for cost in per_part:
        nxt, took = np.full_like(best, np.inf), np.zeros((n, budget + 1), dtype=np.int64)
        for total in range(budget + 1):
            for t in range(total + 1):
                c = best[:, total - t] + cost[:, t]
                better = c < nxt[:, total]
                nxt[better, total], took[better, total] = c[better], t
        best = nxt
        choice.append(took)
    out, total = np.zeros((n, len(per_part)), dtype=np.int64), np.full(n, budget)
    for i in range(len(per_part) - 1, -1, -1):
        out[:, i] = choice[i][np.arange(n), total]
        total = total - out[:, i]
    return out - 1


class Plan:
    """Parts, and the shares that the per-fingerprint allocation reads."""

    def __init__(self, sample: np.ndarray, n: int, m: int, radius: int):
        self.parts, self.n, self.radius = correlated_parts(sample, m), n, radius
        self.shares = [histogram(part_values(sample, p), len(p)) for p in self.parts]

    def thresholds(self, prints: np.ndarray) -> tuple[np.ndarray, float]:
        per_part = [costs(part_values(prints, p), len(p), s, self.n, self.radius) for p, s in zip(self.parts, self.shares)]
        chosen = allocate(per_part, self.radius)
        cost = sum(c[np.arange(len(prints)), chosen[:, i] + 1].sum() for i, c in enumerate(per_part))
        return chosen, float(cost)

    @classmethod
    def of(cls, sample: np.ndarray, n: int, radius: int) -> Plan:
        sample = sample if len(sample) else np.zeros(1, dtype=np.uint64)
        plans = [cls(sample, n, m, radius) for m in range(1, radius + 2)]
        return min(plans, key=lambda p: p.thresholds(sample)[1])


def _index_rows(plan: Plan):
    def run(batches):
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            for i, part in enumerate(plan.parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(prints), i, np.int32)), pa.array(part_values(prints, part).astype(np.int64)), batch.column("fp"), batch.column("g")], ["part", "value", "x", "gx"])

    return run


def _probe_rows(plan: Plan):
    def run(batches):
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            chosen, _ = plan.thresholds(prints)
            for i, part in enumerate(plan.parts):
                values = part_values(prints, part)
                for distance, flips in enumerate(masks(len(part), int(chosen[:, i].max(initial=-1)))):
                    rows = np.flatnonzero(chosen[:, i] >= distance)
                    step = max(1, 200_000 // len(flips))
                    for at in range(0, len(rows), step):
                        some = rows[at:at + step]
                        probes = (values[some][:, None] ^ flips[None, :]).ravel().astype(np.int64)
                        take = pa.array(np.repeat(some, len(flips)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(probes), i, np.int32)), pa.array(probes), batch.column("fp").take(take), batch.column("g").take(take)], ["part", "value", "q", "gq"])

    return run


# ------------------------------------------------------------------------------------ Spark jobs


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, text_hash long, fp long")


def link_groups(prints: DataFrame, folder: str, radius: int = RADIUS, pivots: tuple[int, ...] = PIVOTS) -> DataFrame:
    """(fp, root): groups of the distinct ``fp`` that links of ``radius`` bits connect. A fingerprint
    without links is its own root."""
    total = prints.count()
    unit = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = np.array([r["fp"] for r in prints.filter(unit < min(1.0, SAMPLE / max(total, 1))).select("fp").orderBy("fp").collect()], dtype=np.int64).view(np.uint64)
    plan = Plan.of(sample, total, radius)
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("x"))) <= radius
    groups = prints.select("fp", F.col("fp").alias("g"))
    for turn, rate in enumerate((*pivots, 1)):
        # probes carry every fingerprint's own thresholds; only links between different groups come out
        probes = groups.mapInArrow(_probe_rows(plan), "part int, value long, q long, gq long")
        resident = groups.filter(F.pmod(F.xxhash64("fp"), F.lit(rate)) == 0).mapInArrow(_index_rows(plan), "part int, value long, x long, gx long")
        once = F.col("q") < F.col("x") if rate == 1 else F.lit(True)  # each end of a link finds the other
        between = probes.join(resident, ["part", "value"]).filter((F.col("gq") != F.col("gx")) & once & near)
        roots = components(between.select(F.col("gq").alias("a"), F.col("gx").alias("b")).distinct(), f"{folder}/links-{turn}")
        joined = groups.join(roots, groups["g"] == roots["node"], "left").select("fp", F.coalesce("root", "g").alias("g"))
        groups = stored(joined, f"{folder}/groups-{turn}")
    return groups.withColumnRenamed("g", "root")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint, one per group), component_id (the group's smallest doc_id)."""
    folder = run_folder(docs.sparkSession, "simhash")
    rows = stored(fingerprints(docs, shingle), f"{folder}/rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/prints")
    linked = link_groups(distinct, folder, radius)
    by_print = linked.join(distinct.select("fp", "least"), "fp")
    smallest = by_print.groupBy("root").agg(F.min("least").alias("component_id"))
    resolved = by_print.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(resolved, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")
