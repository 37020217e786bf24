"""Mixing sources to target weights by subset-sum budget fitting (operator 4).

Sizes are words. Sources in code-point order (a missing source last) weigh WEIGHTS in turn and share all
words; a target stops at MAX_EPOCHS times its source's size and the excess is shared again by weight.
A source is taken whole as often as its target allows; the rest of its budget is fitted on counts of
documents by exact length: an equal share of every length, then a bounded-knapsack dynamic programme for
what is left. Of each length the documents with the smallest seeded hashes are taken.

Only histograms meet in one task: a source has at most sqrt(2 * words) distinct lengths. Documents of a
hot (source, length) are cut by the hash bucket in which the wanted number falls, so only that bucket is
ranked.

Rows: a null text has size 0 and is never taken; a missing source is a source; ids may repeat or be
missing, rows are told apart by (doc_id, text). An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalendarium.llm.common import forget_others, run_folder, small_batches, stored, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 17
#: budgets up to about this many words are fitted exactly
DP_WORDS = 1 << 16
HASH_BUCKETS = 4096


def _sizes(batches):
    forget_others()
    for batch in batches:
        # bytes.split() cuts at exactly the six white-space characters of the word rule
        sizes = [len(t.encode("utf-8", "surrogatepass").split()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64()), batch.column("h")], ["doc_id", "source", "size", "h"])


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, rng: np.random.Generator, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length (ascending) to take so that their words come near the budget.

    An equal share of every length, then the programme for the rest. If words are still missing, one document
    longer than what is missing is tried, with documents of about the excess put back; the nearer choice stays.
    The programme is exact for rests up to ``dp_words``; beyond, documents are first taken from the longest on."""
    total = int((lengths * counts).sum())
    budget = min(budget, total)
    # integer arithmetic, rounded down
    taken = np.array([int(c) * budget // total if total else 0 for c in counts.tolist()], dtype=np.int64)
    order = rng.permutation(len(lengths))
    taken += _fill(lengths, counts - taken, budget - int((taken * lengths).sum()), order, dp_words)
    missing = budget - int((taken * lengths).sum())
    longer = np.flatnonzero((taken < counts) & (lengths > missing))
    if missing > 0 and len(longer):
        other = taken.copy()
        other[longer[0]] += 1
        other -= _fill(lengths, other, int(lengths[longer[0]]) - missing, order, dp_words)
        if abs(budget - int((other * lengths).sum())) < missing:
            return other
    return taken


def _fill(lengths: np.ndarray, counts: np.ndarray, rest: int, order: np.ndarray, dp_words: int) -> np.ndarray:
    """Documents of about ``rest`` words: down to a rest for the programme, which does the remainder."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    # long documents from the longest on, then the others in a seeded order
    long = lengths > dp_words // 4
    for i in [*np.flatnonzero(long)[::-1], *order[~long[order]]]:
        if taken[i] < counts[i] and rest - int(lengths[i]) >= (0 if long[i] else dp_words // 2):
            taken[i] += 1
            rest -= int(lengths[i])
    while rest > dp_words:  # only lengths near the rest are left
        fits = np.flatnonzero((taken < counts) & (lengths <= rest) & (lengths > 0))
        if not len(fits):
            break
        i = fits[np.argmax(lengths[fits])]
        taken[i] += 1
        rest -= int(lengths[i])
    if rest > dp_words or rest <= 0:
        return taken
    return taken + _knapsack(lengths, counts - taken, rest, order)


def _knapsack(lengths: np.ndarray, left: np.ndarray, rest: int, order: np.ndarray) -> np.ndarray:
    """Bounded subset sum: counts in powers of two, one pass per power, the first way to each sum kept."""
    reach = np.zeros(2 * rest + 1, dtype=bool)
    reach[0] = True
    via = np.full(2 * rest + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i in order:
        n, part = min(int(left[i]), 2 * rest // max(int(lengths[i]), 1)), 1
        while n > 0 and lengths[i] > 0 and not reach[rest]:
            part = min(part, n)
            step = part * int(lengths[i])
            new = np.zeros_like(reach)
            new[step:] = reach[:-step]
            new &= ~reach
            via[new] = len(items)
            items.append((int(i), part))
            reach |= new
            n, part = n - part, part * 2
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    out = np.zeros(len(lengths), dtype=np.int64)
    while at:
        i, part = items[via[at]]
        out[i] += part
        at -= part * int(lengths[i])
    return out


def _fit_source(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        key = rows["source_key"].iloc[0]
        rng = np.random.default_rng([seed, zlib.crc32(key.encode("utf-8", "surrogatepass"))])
        taken = fit_budget(lengths, counts, int(rows["budget"].iloc[0]), rng)
        return pd.DataFrame({"source_key": key, "size": lengths, "n": counts, "k": taken})

    return run


def _key(source: str = "source") -> Column:
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source_key, source_size, target of one row per source (source, source_size).

    Filled up like water: sources in the order of cap / weight reach their caps one after the other;
    the first that doesn't gives the level for itself and the rest."""
    numbered = sizes.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("at", F.lit(len(weights))) + 1)
    capped = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "at").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0.0))
    levels = capped.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - before("cap")) / (F.sum("weight").over(whole) - before("weight")))
    open_level = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), "at", "level"))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * open_level, F.col("cap")))
    return levels.select(_key().alias("source_key"), "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of documents: doc_id, text_hash, source, size, source_size, target, epochs (how
    often the mix takes it) and taken (words)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = run_folder(spark, "mix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    counted = rows.select("doc_id", "source", "h", "text").mapInArrow(_sizes, "doc_id long, source string, size long, h long")
    sized = stored(counted.withColumn("source_key", _key()), f"{folder}/sizes")
    histogram = stored(sized.groupBy("source", "source_key", "size").agg(F.count(F.lit(1)).alias("n")), f"{folder}/lengths")
    by_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    targets = stored(source_targets(by_source, weights, max_epochs).withColumn("whole", whole.cast("long")), f"{folder}/targets")
    budgets = targets.select("source_key", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("budget"))
    lengths = histogram.filter("size > 0").join(budgets, "source_key").select("source_key", "size", "n", "budget")
    picks = stored(lengths.groupBy("source_key").applyInPandas(_fit_source(seed), "source_key string, size long, n long, k long").filter("k > 0"), f"{folder}/picks")
    # the hash bucket of a (source, length) in which its k-th document lies
    order = F.xxhash64(F.lit(seed), "doc_id", "h")
    wanted = sized.join(picks, ["source_key", "size"]).withColumn("order", order).withColumn("bucket", F.pmod(order, F.lit(HASH_BUCKETS)))
    cell = ["source_key", "size"]
    filled = wanted.groupBy(*cell, "bucket").agg(F.count(F.lit(1)).alias("here"), F.first("k").alias("k"))
    filled = filled.withColumn("upto", F.sum("here").over(W.partitionBy(*cell).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    cuts = filled.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("here") < F.col("k"))).select(
        *cell, F.col("bucket").alias("cut"), (F.col("k") - F.col("upto") + F.col("here")).alias("of_cut"))
    at_cut = sized.join(cuts, cell, "left").withColumn("order", order).withColumn("bucket", F.pmod(order, F.lit(HASH_BUCKETS)))
    columns = ["doc_id", "h", "source", "source_key", "size"]
    ranked = at_cut.filter(F.col("bucket") == F.col("cut")).withColumn("rank", F.row_number().over(W.partitionBy(*cell).orderBy("order", "doc_id")))
    sure = at_cut.filter(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).select(*columns, (F.col("cut").isNotNull() & (F.col("bucket") < F.col("cut"))).alias("more"))
    chosen = sure.unionByName(ranked.select(*columns, (F.col("rank") <= F.col("of_cut")).alias("more")))
    epochs = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.col("more").cast("long"))
    return chosen.join(targets, "source_key").select(
        "doc_id", F.col("h").alias("text_hash"), "source", "size", "source_size", "target", epochs.cast("long").alias("epochs"), (epochs * F.col("size")).cast("long").alias("taken"))
