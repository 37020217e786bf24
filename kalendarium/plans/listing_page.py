"""The listing page as one plan: filter, window, collapse, categories, series labels, day buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendarium.operators import calendar, listing


def listing_page(
    events: DataFrame, venues: DataFrame, sources: DataFrame, event_categories: DataFrame, categories: DataFrame,
    flt: listing.Filter, now: str, region: int | None = None, limit: int = listing.PAGE_SIZE, offset: int = 0,
) -> DataFrame:
    """One page of rows with category slugs, series label and the day they are shown under. The page
    is cut first, so venues, labels and categories join a bounded number of rows."""
    rows = listing.visible_events(events, venues, sources, flt, region, event_categories, categories)
    page = listing.find_upcoming(rows, flt, now, limit, offset)
    if "venue_name" not in page.columns:
        page = listing.with_venue(page, venues)
    named = listing.with_categories(page, event_categories.join(page.select(F.col("id").alias("event_id")), "event_id", "left_semi"), categories)
    labels = listing.series_labels(rows, flt, now).select("title", F.col("venue_id").alias("_v"), "occurrences", "last_at", "daily")
    joined = named.join(labels, (named["title"] == labels["title"]) & named["venue_id"].eqNullSafe(F.col("_v")), "left").drop(labels["title"]).drop("_v")
    return calendar.group_by_day(joined, flt.from_ or now).orderBy("effective_start", "starts_at", "id")
