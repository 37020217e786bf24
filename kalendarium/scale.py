"""Building blocks that keep a hot key from landing in one task.

A title, source, day or key may hold a third of all rows. The helpers below therefore reduce groups
with mergeable aggregates (map-side combine), or split them on a salt, a time slot or an id block, and
they never drop or cap rows to do so.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ids per block when rows of one instant are numbered
ID_BLOCK = 65_536
SPLITS = 32


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], largest: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) under ``order``. Partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread_on: str, rank: str = "rank", bucket: Column | None = None
) -> DataFrame:
    """The first ``k`` rows per key with their rank. Each of the SPLITS slices of a group is cut to
    ``k`` rows first, so the task that ranks the group sees at most ``SPLITS * k`` rows. With a large
    ``k``, give a ``bucket`` that ascends with the order (a day): buckets that begin after the k-th row
    are dropped by their counts before anything is ranked."""
    if bucket is not None:
        marked = df.withColumn("_bucket", bucket)
        counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        # one row per key and bucket
        needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(_before(keys, ["_bucket"])), F.lit(0))).filter(F.col("_before") < k)
        df = marked.join(needed.select(*keys, "_bucket"), [*keys, "_bucket"], "left_semi").select(*df.columns)
    slice_no = F.pmod(F.xxhash64(F.col(spread_on)), F.lit(SPLITS))
    sliced = (
        df.withColumn("_slice", slice_no)
        .withColumn(rank, F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)))
        .filter(F.col(rank) <= k)
        .drop("_slice")
    )
    return sliced.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def number_rows(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, out: str = "rank") -> DataFrame:
    """``row_number`` per key in (ts, id) order without sorting a whole group in one task.

    Rows are counted per (key, instant, id block); running totals over days and, inside a day, over
    blocks give each block its offset; only rows of one block are numbered together.
    """
    day, block = F.to_date(ts), F.floor(F.col(row_id) / ID_BLOCK)
    marked = df.withColumn("_day", day).withColumn("_block", block)
    slots = marked.groupBy(*keys, "_day", ts, "_block").agg(F.count(F.lit(1)).alias("_n"))
    days = (
        slots.groupBy(*keys, "_day")
        .agg(F.sum("_n").alias("_day_n"))
        .withColumn("_day_base", F.coalesce(F.sum("_day_n").over(_before(keys, ["_day"])), F.lit(0)))
        .drop("_day_n")
    )
    offsets = (
        slots.withColumn("_slot_base", F.coalesce(F.sum("_n").over(_before([*keys, "_day"], [ts, "_block"])), F.lit(0)))
        .join(days, [*keys, "_day"])
        .select(*keys, ts, "_block", (F.col("_day_base") + F.col("_slot_base")).alias("_base"))
    )
    within = W.partitionBy(*keys, ts, "_block").orderBy(row_id)
    return (
        marked.join(offsets, [*keys, ts, "_block"], "left")
        .withColumn(out, F.col("_base") + F.row_number().over(within))
        .select(*df.columns, out)
    )


def _before(keys: Sequence[str], order: Sequence[str]):
    """All rows of the key strictly before the current one."""
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def number_keys(df: DataFrame, key: Column, out: str = "rank", buckets: int = 4096) -> DataFrame:
    """Dense 1-based numbers for distinct rows, ordered by (digest prefix, key): the per-bucket counts
    (at most ``buckets`` rows) give the offsets, each bucket is numbered on its own."""
    width = len(f"{buckets - 1:x}")
    marked = df.withColumn("_k", key).withColumn("_b", F.substring(F.md5(F.col("_k")), 1, width))
    counts = marked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_b",
        F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    return (
        marked.join(offsets, "_b", "left")
        .withColumn(out, F.col("_base") + F.row_number().over(W.partitionBy("_b").orderBy("_k")))
        .select(*df.columns, out)
    )


def join_back(df: DataFrame, groups: DataFrame, keys: Sequence[str], spread_on: str) -> DataFrame:
    """Left-join per-group values onto the rows of each group. Rows without a key are spread over the
    shuffle; the rows of a huge group meet one group row in a sort-merge join, whose skewed partitions
    adaptive execution splits (``session.prepare`` makes it do so even before an aggregation). No side
    is broadcast by a hint, and groups of every size take the same way."""
    values = [c for c in groups.columns if c not in keys]
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # always 0 here, but written so that the optimizer keeps it as a join key (a literal would be folded
    # into a residual condition and the salt would no longer take part in the shuffle)
    never = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    once = groups.withColumn("_salt", never.cast("long"))
    spread = df.withColumn("_salt", F.when(no_key, F.xxhash64(spread_on)).otherwise(F.lit(0).cast("long")))
    return spread.join(once, [*keys, "_salt"], "left").select(*df.columns, *values)


def previous_value(df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str) -> DataFrame:
    """``lag(value)`` per key in position order. Positions are cut into blocks of ID_BLOCK; a block's
    first row takes the last value of the block before it, so no task orders a whole group. Give a plain column as
    ``value``: an expression would be moved beside the columns it is made of."""
    marked = df.withColumn("_block", F.floor(F.col(position) / ID_BLOCK))
    block = W.partitionBy(*keys, "_block").orderBy(position)
    whole = block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # both branches ask the same columns of one shuffle; only first rows of a block go through a second one
    within = marked.withColumns({"_own": F.lag(value).over(block), "_later": F.lag(F.lit(True)).over(block), "_last": F.last(value).over(whole)})
    later = within.filter(F.col("_later")).withColumn(out, F.col("_own"))
    firsts = within.filter(F.col("_later").isNull()).withColumn(out, F.lag("_last").over(W.partitionBy(*keys).orderBy("_block")))
    return later.select(*df.columns, out).unionByName(firsts.select(*df.columns, out))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose expressions are not repeated in later filters. The optimizer moves a filter
    on a derived column below the projection by copying the expression; it cannot move one below a
    generator, so costly parses are packed into a one-element explode."""
    packed = df.withColumn("_packed", F.struct(*[c.alias(n) for n, c in columns.items()]))
    return packed.withColumn("_once", F.explode(F.array("_packed"))).select(*[c for c in df.columns if c not in columns], "_once.*")
