"""Wall-clock time columns (Europe/Berlin, zone-less) and the listing predicates on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BERLIN = "Europe/Berlin"


def ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def as_ntz(value: str | Column) -> Column:
    return ts(value) if isinstance(value, str) else value


def day_start(c: Column) -> Column:
    return F.to_date(c).cast("timestamp_ntz")


def berlin_wall(c: Column, zone: str | Column) -> Column:
    """Wall clock in ``zone`` to wall clock in Berlin."""
    source = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(source, F.lit(BERLIN), c)


def utc_wall(c: Column) -> Column:
    return F.convert_timezone(F.lit(BERLIN), F.lit("UTC"), c)


def iso_berlin(c: Column) -> Column:
    """``2026-06-20T20:00:00+02:00``; the offset is the wall clock minus UTC."""
    hours = F.timestamp_diff("HOUR", utc_wall(c), c)
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.format_string("+%02d:00", hours))


def still_relevant(floor: str | Column, starts_at: Column | None = None, ends_at: Column | None = None, all_day: Column | None = None) -> Column:
    """A timed event with an end is over exactly then; any other counts through its last day."""
    at = as_ntz(floor)
    starts_at = F.col("starts_at") if starts_at is None else starts_at
    ends_at = F.col("ends_at") if ends_at is None else ends_at
    all_day = F.col("all_day") if all_day is None else all_day
    # plain comparisons, no CASE or coalesce, so that all of it can be pushed to the scan
    day = day_start(at)
    return (~all_day & (ends_at > at)) | (all_day & (ends_at >= day)) | (ends_at.isNull() & (starts_at >= day))


def display_end(starts_at: Column, ends_at: Column, all_day: Column) -> Column:
    """A timed end at midnight after the start shows as the day before."""
    midnight = ~all_day & (ends_at == day_start(ends_at)) & (ends_at > starts_at)
    return F.when(midnight, ends_at - F.expr("INTERVAL 1 DAY")).otherwise(ends_at)
