"""Streaming visit counters. Counts follow event time: visits later than the watermark no longer reach
the state. ``views_with_late`` keeps them in a side table, so that counts plus late visits are all visits;
the plain counters drop them (the batch counters in ``operators.visits`` have no such bound).

Results are written per micro-batch as an update log (key, value, batch); the current state of a
key is its newest entry, so a replayed batch after a lost executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kalendarium.operators import visits as V

WATERMARK = "1 day"


def event_time(prepared: DataFrame) -> DataFrame:
    """Watermarked rows: watermarks need a zoned timestamp, results keep the zone-less day."""
    return prepared.withColumn("at", F.col("ts").cast("timestamp_ltz")).withWatermark("at", WATERMARK)


def stream_views(prepared: DataFrame) -> DataFrame:
    """Views per (region, Berlin day, route)."""
    return _counted(prepared, "region_id", "route")


def stream_event_views(prepared: DataFrame) -> DataFrame:
    rows = prepared.filter((F.col("route") == V.DETAIL_ROUTE) & (F.col("event_id") > 0))
    return _counted(rows, "event_id")


def stream_visitors(prepared: DataFrame) -> DataFrame:
    """First sight of each (region, day, token); tokens leave the state once the watermark has passed
    them, so it holds about two days of tokens."""
    seen = event_time(prepared).dropDuplicatesWithinWatermark(["region_id", "day", "token"])
    return seen.select("region_id", "day", "token")


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    # the hour window carries the watermark, so finished hours leave the state; days are summed from hours
    hourly = event_time(rows).groupBy(F.window("at", "1 hour"), "day", *keys).agg(F.count(F.lit(1)).alias("views"))
    return hourly.select(F.col("window.start").alias("hour"), "day", *keys, "views")


def views_with_late(prepared: DataFrame, *keys: str) -> DataFrame:
    """Hourly counts (``visit`` false) together with the visits they were counted from (``visit`` true),
    for ``late_log``: both arrive in the same micro-batch."""
    counts = _counted(prepared, *keys).withColumn("visit", F.lit(False))
    seen = event_time(prepared).select(F.window("at", "1 hour")["start"].alias("hour"), "day", *keys, F.lit(1).cast("long").alias("views"), F.lit(True).alias("visit"))
    return counts.unionByName(seen)


def late_log(stream: DataFrame, folder: str, *keys: str) -> StreamingQuery:
    """Run ``views_with_late`` over what is available. In update mode each (hour, key) whose visits the
    state took comes out of the batch that took them; visits of a batch without such a row were late. They
    go to ``late``, the counts to ``log``. A replayed batch overwrites its own folders."""
    group = ["hour", "day", *keys]

    def write(batch: DataFrame, number: int) -> None:
        # the batch is computed once: it holds the state's output
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/batches/batch={number}")
        counts = rows.filter(~F.col("visit")).drop("visit")
        counts.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        visits = rows.filter("visit").groupBy(*group).agg(F.sum("views").alias("views"))
        taken = [visits[c].eqNullSafe(counts[c]) for c in group]
        visits.join(counts, taken, "left_anti").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def late_views(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """The side table: late views per (day, key)."""
    late = spark.read.option("basePath", f"{folder}/late").parquet(f"{folder}/late")
    return late.groupBy("day", *keys).agg(F.sum("views").alias("views"))


def all_views(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Counted and late views per (day, key)."""
    log = spark.read.option("basePath", f"{folder}/log").parquet(f"{folder}/log")
    both = current(log, list(keys)).unionByName(late_views(spark, folder, *keys))
    return both.groupBy("day", *keys).agg(F.sum("views").alias("views"))


def stored_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The hours the counter's state still holds, read from the state store itself."""
    return spark.read.format("statestore").load(checkpoint).select("key.*")


def update_log(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Append each micro-batch's changed rows with its number; a replay overwrites its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(log: DataFrame, keys: list[str]) -> DataFrame:
    """Newest entry per (hour, key), summed to days."""
    newest = log.groupBy("hour", "day", *keys).agg(F.max_by("views", "batch").alias("views"))
    return newest.groupBy("day", *keys).agg(F.sum("views").alias("views"))


def drain(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over everything available and return its log."""
    update_log(stream, f"{folder}/log", f"{folder}/checkpoint", mode).awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{folder}/log").parquet(f"{folder}/log")

