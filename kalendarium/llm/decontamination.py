"""Benchmark decontamination by SimHash of item-sized windows (operator 5), in DataFrame functions only.

Words are runs of letters and digits in lower case, shingles five of them. A window of a document is as
long as a benchmark item (in words). Windows are anchored where a shingle of the item stands: a window
that is similar to an item shares shingles with it, and each shared shingle says where the item would
begin. Windows and items get 64-bit SimHashes weighted by how often a shingle occurs; with RADIUS + 1
blocks of bits, two fingerprints within RADIUS bits agree in a block, so a join on (length, block, value)
meets every pair within the radius. Pairs are verified by the exact weighted similarity of their shingles
(sum of smaller counts over sum of larger counts).

RADIUS: shingle sets of similarity 0.8 have a cosine of 0.89 or more, 9.7 of 64 bits differ on average at
that bound (standard deviation 2.9); 20 bits are 3.5 deviations more, equal windows differ in none.

The benchmark's shingles are broadcast only below MAX_BROADCAST of them (counted first); above that the
join shuffles by shingle. A passage in a third of all documents gives each of them a few windows, joined
to some twenty blocks of the items of that length.

Rows: null and empty texts match nothing; items below five words are too short to show a leak and are
never reported; repeated rows of a document count once; a missing doc_id stays missing. A document
without match gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium.llm.common import run_folder, stored, text_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
MAX_BROADCAST = 1_000_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; empty for a text without any."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def shingle_hashes(words: str, size: int = SHINGLE) -> Column:
    """One hash per shingle position; empty below ``size`` words."""
    at = lambda i, k: F.get(F.col(words), i + k)
    positions = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: F.xxhash64(*[at(i, k) for k in range(size)]))


def simhash(hashes: str) -> Column:
    """64 bits: bit b is set if it is set in more than half of the shingles, repeats counted."""
    majority = f"""aggregate(sequence(0, 63), 0L, (sum, b) -> sum | if(
        2 * aggregate({hashes}, 0, (n, h) -> n + cast(bit_get(h, b) as int)) > size({hashes}), shiftleft(1L, b), 0L))"""
    return F.expr(majority)


def blocks(fp: str, radius: int = RADIUS) -> Column:
    """(block, value) of radius + 1 blocks of bits, as equal in width as can be."""
    n, out, start = radius + 1, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        value = F.shiftrightunsigned(F.col(fp), start).bitwiseAND(F.lit((1 << width) - 1))
        out.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
        start += width
    return F.explode(F.array(*out))


def _counts(hashes: str) -> Column:
    """Sorted distinct hashes with their counts."""
    return F.expr(f"transform(array_sort(array_distinct({hashes})), d -> struct(d as h, size(filter({hashes}, x -> x = d)) as n))")


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two count lists of shingles that hold sum_a and sum_b shingles in all."""
    shared = f"aggregate({a}, 0, (s, x) -> s + coalesce(aggregate({b}, 0, (t, y) -> t + if(x.h = y.h, least(x.n, y.n), 0)), 0))"
    total = f"(aggregate({a}, 0, (s, x) -> s + x.n) + aggregate({b}, 0, (s, x) -> s + x.n))"
    return F.expr(f"cast({shared} as double) / ({total} - {shared})")


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, first_word, n_words, bits: the best window per document and item."""
    folder = run_folder(docs.sparkSession, "leaks")
    worded = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(text_of()).alias("words")).filter(F.size("words") >= SHINGLE)
    hashed = worded.select("item_id", F.size("words").alias("n_words"), shingle_hashes("words").alias("hashes"))
    items = stored(hashed.select("*", simhash("hashes").alias("fp"), _counts("hashes").alias("counts")), f"{folder}/items")
    places = stored(items.select("n_words", F.posexplode("hashes").alias("offset", "h")).distinct(), f"{folder}/places")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    document = texts.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    positions = document.select("doc_id", "text_hash", F.size("words").alias("size"), F.posexplode(shingle_hashes("words")).alias("at", "h"))
    small = places.count() <= max_broadcast
    hits = positions.join(F.broadcast(places) if small else places, "h")
    # an item that reaches over an end of the document is compared with the part that lies in it
    first = F.greatest(F.col("at") - F.col("offset"), F.lit(0))
    last = F.least(F.col("at") - F.col("offset") + F.col("n_words"), "size")
    starts = hits.select("doc_id", "text_hash", "n_words", first.alias("first"), last.alias("last")).distinct()
    by_document = starts.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("n_words", "first", "last")).alias("windows"))
    found = stored(by_document, f"{folder}/starts")
    same = document["doc_id"].eqNullSafe(found["doc_id"]) & (document["text_hash"] == found["text_hash"])
    once = document.join(found, same).select(document["doc_id"], document["text_hash"], shingle_hashes("words").alias("all"), "windows")
    spans = once.select("doc_id", "text_hash", "all", F.explode("windows").alias("w"))
    cut = spans.select("doc_id", "text_hash", "w.*", F.expr(f"slice(all, w.first + 1, greatest(w.last - w.first - {SHINGLE - 1}, 0))").alias("hashes")).filter(F.size("hashes") > 0)
    # few bytes, much work: the windows are dealt to a fixed number of tasks
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(tasks, "doc_id", "text_hash", "n_words", "first")
    windows = stored(dealt.select("*", simhash("hashes").alias("fp")), f"{folder}/windows")
    of_windows = windows.select("doc_id", "text_hash", "n_words", "first", "last", "hashes", "fp", blocks("fp", radius).alias("b")).select("*", "b.*").drop("b")
    of_items = items.select("item_id", "n_words", F.col("fp").alias("item_fp"), "counts", blocks("fp", radius).alias("b")).select("*", "b.*").drop("b")
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    met = of_windows.join(of_items, ["n_words", "block", "value"]).withColumn("bits", bits).filter(F.col("bits") <= radius)
    # a pair may agree in several blocks; the first of them reports it
    agreeing = F.lit(0)
    n, start = radius + 1, 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        mask = ((1 << width) - 1) << start
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        equal = F.col("fp").bitwiseXOR(F.col("item_fp")).bitwiseAND(F.lit(mask)) == 0
        agreeing = agreeing + F.when((F.col("block") > i) & equal, 1).otherwise(0)
        start += width
    verified = met.filter(agreeing == 0).withColumn("own", _counts("hashes")).withColumn("similarity", similarity("own", "counts")).filter(F.col("similarity") >= least)
    best = F.max_by(F.struct("similarity", F.col("first").alias("first_word"), (F.col("last") - F.col("first")).alias("n_words"), "bits"), F.struct("similarity", -F.col("first")))
    return verified.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select("doc_id", "text_hash", "item_id", "best.*")
