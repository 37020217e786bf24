"""Exact line dedup through a sharded minimal perfect hash (operator 2).

Keys (trimmed, ASCII lower-cased lines) of at least ``min_chars`` code points are identified by 128 hash
bits. Distinct keys are dealt to shards by hash; each shard is one row of an index table: a minimal
perfect hash over its keys, a fingerprint and a count array, and the first holder of repeated keys.
Documents send only hashes: probes meet the array of their shard, line texts are never joined. Keys held
by more than 1 / HOT_SHARE of all line keys (so fewer than HOT_SHARE of them) are looked up in a
broadcast table instead, which bounds a shard's probes and that table alike.

Rows: a null or empty text is one empty line; rows of one doc_id are one document; rows without doc_id
are one document that comes after all others; repeated rows are treated alike. An empty table gives an
empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendarium.llm.common import run_folder, small_batches, stored, text_of

MIN_CHARS = 10
KEYS_PER_SHARD = 1 << 17
HOT_SHARE = 4096
#: stands for a missing doc_id, after all others
NO_ID = (1 << 63) - 1
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


# ---------------------------------------------------------------- minimal perfect hash of one shard


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 0xBF58476D1CE4E5B9) & (1 << 64) - 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bit arrays: a key sits at the first level where no other key shares its slot; its
    number is the rank of that bit."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, load: float = 1.5) -> PerfectHash:
        sizes, parts = [], []
        while len(h1):
            size = max(8, int(load * len(h1)))
            slots = _slot(h1, h2, len(sizes), size)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = ~alone[slots]
            h1, h2 = h1[left], h2[left]
        return cls(sizes, np.concatenate(parts).astype(np.uint8) if parts else np.zeros(0, np.uint8))

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for some that aren't in the set (others get any number)."""
        out, todo, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            slots = _slot(h1[todo], h2[todo], level, size) + base
            here = self.bits[slots] == 1
            out[todo[here]] = self.rank[slots[here]]
            todo, base = todo[~here], base + size
        return out


class LineShard:
    """Perfect hash, 32-bit fingerprints, counts (255: more), and first holders of keys of several."""

    def __init__(self, hashes: PerfectHash, prints: np.ndarray, counts: np.ndarray, first: np.ndarray):
        self.hashes, self.prints, self.counts, self.first = hashes, prints, counts, first
        self.repeated = np.cumsum(counts > 1) - 1

    @classmethod
    def of(cls, h1, h2, counts, first) -> LineShard:
        hashes = PerfectHash.of(h1, h2)
        order = np.argsort(hashes.numbers(h1, h2))
        counts = np.minimum(counts[order], 255).astype(np.uint8)
        return cls(hashes, (h2[order] >> np.uint64(32)).astype(np.uint32), counts, first[order][counts > 1])

    def to_bytes(self) -> bytes:
        sizes = np.array(self.hashes.sizes, dtype="<i8")
        head = struct.pack("<III", len(sizes), len(self.counts), len(self.first))
        return head + sizes.tobytes() + np.packbits(self.hashes.bits).tobytes() + self.prints.astype("<u4").tobytes() + self.counts.tobytes() + self.first.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> LineShard:
        levels, n, many = struct.unpack_from("<III", data)
        at = 12
        sizes = np.frombuffer(data, "<i8", levels, at).tolist()
        at += 8 * levels
        width = (sum(sizes) + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=sum(sizes))
        at += width
        prints, counts = np.frombuffer(data, "<u4", n, at), np.frombuffer(data, np.uint8, n, at + 4 * n)
        return cls(PerfectHash(sizes, bits), prints, counts, np.frombuffer(data, "<i8", many, at + 5 * n))

    def dropped(self, h1: np.ndarray, h2: np.ndarray, holder: np.ndarray) -> np.ndarray:
        """Whether the holder's lines with this key go: the key has several holders, an earlier one first."""
        at = self.hashes.numbers(h1, h2)
        known = at >= 0
        known[known] = self.prints[at[known]] == (h2[known] >> np.uint64(32)).astype(np.uint32)
        known[known] = self.counts[at[known]] > 1
        known[known] = self.first[self.repeated[at[known]]] < holder[known]
        return known


# ------------------------------------------------------------------------------------ Spark jobs


def _keys(text: str) -> list[bytes]:
    return [line.strip(_SPACES).lower() for line in text.encode("utf-8", "surrogatepass").split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least


def _line_hashes(least: int):
    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows, numbers, hashes = [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                for number, key in enumerate(dict.fromkeys(_keys(text))):
                    if _long_enough(key, least):
                        rows.append(at)
                        numbers.append(number)
                        hashes.append(xxh3_128_digest(key))
            both = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("holder").take(take), batch.column("text_hash").take(take), pa.array(numbers, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                ["holder", "text_hash", "number", "h1", "h2"],
            )

    return run


def _build(table: pa.Table) -> pa.Table:
    column = lambda name: table.column(name).to_numpy()
    shard = LineShard.of(column("h1").view(np.uint64), column("h2").view(np.uint64), column("n"), column("first"))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "arrays": pa.array([shard.to_bytes()], pa.binary())})


def _probe(batches):
    arrays = None
    for batch in batches:
        blobs = batch.column("arrays")
        marks = np.flatnonzero(~np.asarray(blobs.is_null()))
        cuts = [0, *marks.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a in marks:
                arrays = LineShard.from_bytes(blobs[a].as_py())
                a += 1
            if b > a:
                part = batch.slice(a, b - a)
                column = lambda name: part.column(name).to_numpy(zero_copy_only=False)  # noqa: E731,B023
                gone = arrays.dropped(column("h1").view(np.uint64), column("h2").view(np.uint64), column("holder"))
                yield part.select(["holder", "text_hash", "number"]).filter(pa.array(gone))


def _without(batches):
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist()):
            lines = text.split("\n")
            n_lines.append(len(lines))
            if drops:
                keys = _keys(text)
                distinct = list(dict.fromkeys(keys))
                gone = {distinct[d] for d in drops}
                left = [line for line, key in zip(lines, keys) if key not in gone]
                n_dropped.append(len(lines) - len(left))
                kept.append("\n".join(left))
            else:
                n_dropped.append(0)
                kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD, hot_share: int = HOT_SHARE) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: lines whose key two documents hold stay in the smallest doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = run_folder(spark, "lines")
    holder = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), holder.alias("holder"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    hashed = rows.select("holder", "text_hash", "text").mapInArrow(_line_hashes(min_chars), "holder long, text_hash long, number int, h1 long, h2 long")
    lines = stored(hashed, f"{folder}/hashes")
    total = lines.count()
    # as many holders as counts: one if all rows of the key belong to one document
    one = F.min("holder") == F.max("holder")
    counted = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows"), F.when(one, 1).otherwise(F.greatest(F.lit(2), F.count(F.lit(1)))).alias("n"), F.min("holder").alias("first"))
    keys = stored(counted, f"{folder}/keys")
    hot = keys.filter(F.col("rows") > total / hot_share).select("h1", "h2", "n", "first", F.lit(True).alias("is_hot"))
    shards = max(1, -(-total // keys_per_shard))
    shard = F.pmod("h1", F.lit(shards)).alias("shard")
    index = keys.select(shard, "h1", "h2", "n", "first").groupBy("shard").applyInArrow(_build, "shard long, arrays binary")
    looked_up = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    probes = looked_up.filter(F.col("is_hot").isNull()).select(shard, "h1", "h2", "holder", "text_hash", "number", F.lit(None).cast("binary").alias("arrays"))
    zero = F.lit(0).cast("long")
    arrays = index.select("shard", zero.alias("h1"), zero.alias("h2"), zero.alias("holder"), zero.alias("text_hash"), F.lit(-1).alias("number"), "arrays")
    # the arrays of a shard (number -1) stand before its probes
    met = arrays.unionByName(probes).repartition("shard").sortWithinPartitions("shard", F.col("arrays").isNull())
    found = met.mapInArrow(_probe, "holder long, text_hash long, number int")
    found_hot = looked_up.filter(F.col("is_hot") & (F.col("n") > 1) & (F.col("first") < F.col("holder"))).select("holder", "text_hash", "number")
    # at most one entry per line of the document
    drops = stored(found.unionByName(found_hot).groupBy("holder", "text_hash").agg(F.collect_set("number").alias("drops")), f"{folder}/drops")
    matched = rows.join(drops, ["holder", "text_hash"], "left").select("doc_id", "text", "drops")
    return matched.mapInArrow(_without, "doc_id long, n_lines long, n_dropped long, kept string")
