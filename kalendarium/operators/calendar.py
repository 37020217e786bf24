"""Calendar shapes: day buckets, week view, month grid. Rows stay long (one per cell and event): a
busy day is never collected into one value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendarium.functions.times import as_ntz, day_start, display_end
from kalendarium.operators.listing import in_range, month_bounds


def group_by_day(df: DataFrame, floor: str | None = None) -> DataFrame:
    """Each event under its start day; earlier starts under the floor day."""
    day = F.to_date("starts_at")
    if floor is not None:
        day = F.greatest(day, F.to_date(as_ntz(floor)))
    return df.withColumn("day", day)


def day_counts(df: DataFrame, floor: str | None = None) -> DataFrame:
    return group_by_day(df, floor).groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.min("starts_at").alias("first_start"))


def _days(spark, first: dt.date, n: int) -> DataFrame:
    return spark.range(n).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))


def week_view(df: DataFrame, year: int, week: int) -> DataFrame:
    """Seven days of the ISO week, empty ones with a null event."""
    monday = dt.date.fromisocalendar(year, week, 1)
    following = monday + dt.timedelta(days=7)
    rows = group_by_day(in_range(df, monday.isoformat(), following.isoformat()), monday.isoformat())
    return _days(df.sparkSession, monday, 7).join(rows.select("day", "id", "title", "starts_at"), "day", "left")


def month_grid(df: DataFrame, year: int, month: int) -> DataFrame:
    """Monday-first cells; an event appears in every cell it covers."""
    start, end = month_bounds(year, month)
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end) - dt.timedelta(days=1)
    monday = first - dt.timedelta(days=first.isoweekday() - 1)
    weeks = ((last - monday).days // 7) + 1
    low, high = first - dt.timedelta(days=6), last + dt.timedelta(days=6)
    until = F.to_date(F.coalesce(display_end(day_start(F.col("starts_at")), F.col("ends_at"), F.col("all_day")), F.col("starts_at")))
    span_from = F.greatest(F.to_date("starts_at"), F.lit(low))
    span_to = F.least(until, F.lit(high))  # the window bounds a span below 44 days
    cells = (
        in_range(df, start, end)
        .withColumn("_from", span_from).withColumn("_to", span_to).filter("_from <= _to")
        .select("id", "title", F.explode(F.sequence("_from", "_to")).alias("day"))
    )
    grid = _days(df.sparkSession, monday, 7 * weeks)
    return grid.join(cells, "day", "left").select(
        (F.floor(F.datediff("day", F.lit(monday)) / 7) + 1).cast("int").alias("week_no"), "day",
        (F.month("day") == month).alias("in_month"), "id", "title",
    )


def today(df: DataFrame, now: str) -> DataFrame:
    """Everything overlapping the calendar day of ``now``."""
    day = dt.datetime.fromisoformat(now).date()
    return in_range(df, day.isoformat(), (day + dt.timedelta(days=1)).isoformat())
