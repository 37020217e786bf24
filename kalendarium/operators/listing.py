"""Listing queries: visibility, relevance, windows, search, series collapse, pages, neighbours, feeds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.functions.times import as_ntz, day_start, still_relevant

PAGE_SIZE = 40
FEED_LIMIT = 2000
SITEMAP_LIMIT = 20_000


@dataclass(frozen=True)
class Filter:
    """What a listing is narrowed to. ``from_``/``to`` are ISO dates or timestamps."""

    q: str | None = None
    category_slugs: tuple[str, ...] = ()
    city: str | None = None
    course: str = "all"
    from_: str | None = None
    to: str | None = None
    only_saved: bool = False
    saved_ids: tuple[int, ...] = ()

    def with_period(self, period: str, now: str) -> Filter:
        """A named period; an explicit from/to wins."""
        if self.from_ or self.to:
            return self
        first, last = period_bounds(now)[period]
        return replace(self, from_=first.isoformat(), to=last.isoformat())


def period_bounds(now: str) -> dict[str, tuple[dt.date, dt.date]]:
    """First and last day of each named period, from the calendar day of ``now``."""
    today = dt.datetime.fromisoformat(now).date()
    shift = lambda n: today + dt.timedelta(days=n)
    iso = today.isoweekday()
    sunday = 7 - iso
    return {
        "heute": (today, today),
        "morgen": (shift(1), shift(1)),
        "wochenende": (shift(max(0, 6 - iso)), shift(sunday)),
        "woche": (today, shift(sunday)),
        "7tage": (today, shift(6)),
    }


def with_source(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with their source. No broadcast hint: the planner broadcasts a dimension whose size it
    knows to be small and shuffles (with skew splitting) one that is not."""
    source = sources.select(
        F.col("id").alias("source_id"), F.col("key").alias("source_key"), F.col("name").alias("source_name"),
        F.col("type").alias("source_type"), F.col("url").alias("source_home"), F.col("importer").alias("source_importer"),
        F.col("enabled").alias("source_enabled"), F.col("facts_only").alias("source_facts_only"),
        F.col("approved_at").alias("source_approved_at"),
    )
    return events.join(source, "source_id")


def with_venue(rows: DataFrame, venues: DataFrame) -> DataFrame:
    """Venue columns (left). Needed for search, city and display only; cut the rows first where possible."""
    venue = venues.select(
        F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), F.col("city").alias("venue_city"),
        F.col("street").alias("venue_street"), F.col("postal_code").alias("venue_postal_code"),
    )
    return rows.join(venue, "venue_id", "left")


def enrich(events: DataFrame, venues: DataFrame, sources: DataFrame) -> DataFrame:
    return with_venue(with_source(events, sources), venues)


def visible_events(events: DataFrame, venues: DataFrame, sources: DataFrame, flt: Filter = Filter(), region: int | None = None,
                   event_categories: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """``visible`` over the bare tables; the venue table is only joined when the filter looks at it."""
    rows = with_source(events, sources)
    if flt.q is not None or flt.city is not None:
        rows = with_venue(rows, venues)
    return visible(rows, flt, region, event_categories, categories)


def matches(q: str) -> Column:
    """Case-insensitive LIKE over five columns; ``%`` and ``_`` in the needle stay wildcards."""
    needle = f"%{q.lower()}%"
    hit = F.lit(False)
    for name in ("title", "description", "venue_name", "venue_city", "source_name"):
        hit = hit | F.lower(F.col(name)).like(needle)
    return hit


def search(enriched: DataFrame, q: str) -> DataFrame:
    return enriched.filter(matches(q))


def in_categories(df: DataFrame, slugs, event_categories: DataFrame, categories: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows having any of the slugs; a semi join, so rows never multiply."""
    wanted = (
        event_categories.join(categories.filter(F.col("slug").isin(*slugs)).select(F.col("id").alias("category_id")), "category_id", "left_semi")
        .select(F.col("event_id").alias(id_col))
    )
    return df.join(wanted, id_col, "left_semi")


def of_course_kind(df: DataFrame, course: str) -> DataFrame:
    if course == "only":
        return df.filter(F.col("is_course"))
    if course == "hide":
        return df.filter(~F.col("is_course"))
    return df


def saved_only(df: DataFrame, saved_ids) -> DataFrame:
    """The user's picks; nothing picked means nothing shown."""
    return df.filter(F.col("id").isin(*saved_ids)) if saved_ids else df.filter(F.lit(False))


def visible(enriched: DataFrame, flt: Filter = Filter(), region: int | None = None,
            event_categories: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """Published events of enabled sources under the non-temporal filters."""
    df = enriched.filter((F.col("status") == "published") & F.col("source_enabled"))
    if region is not None:
        df = df.filter(F.col("region_id") == region)
    if flt.q is not None:
        df = search(df, flt.q)
    if flt.city is not None:
        df = df.filter(F.col("venue_city") == flt.city)
    df = of_course_kind(df, flt.course)
    if flt.category_slugs:
        df = in_categories(df, flt.category_slugs, event_categories, categories)
    if flt.only_saved:
        df = saved_only(df, flt.saved_ids)
    return df


def _floor(flt: Filter, now: str) -> str | None:
    return flt.from_ or (None if flt.only_saved else now)


def _before_end(df: DataFrame, flt: Filter) -> DataFrame:
    if flt.to is None:
        return df
    return df.filter(F.col("starts_at") < day_start(as_ntz(flt.to)) + F.expr("INTERVAL 1 DAY"))


def upcoming(df: DataFrame, flt: Filter, now: str) -> DataFrame:
    """Lower bound on the end of the event, upper bound on its start."""
    floor = _floor(flt, now)
    if floor is not None:
        df = df.filter(still_relevant(floor))
    return _before_end(df, flt)


def collapse_series(df: DataFrame) -> DataFrame:
    """One row per (title, venue or none, region): the soonest, ties on id."""
    return scale.pick_one(df, ["title", "venue_id", "region_id"], [F.col("starts_at"), F.col("id")])


def collapsed(df: DataFrame, flt: Filter, now: str) -> DataFrame:
    """The listing relation. The representative is picked before the upper bound applies."""
    if flt.only_saved:
        return upcoming(df, flt, now)
    return _before_end(collapse_series(df.filter(still_relevant(flt.from_ or now))), flt)


def find_upcoming(df: DataFrame, flt: Filter, now: str, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """A page: running events sort as if they started today."""
    effective = F.greatest(F.col("starts_at"), day_start(as_ntz(now)))
    page = collapsed(df, flt, now).withColumn("effective_start", effective)
    return page.orderBy("effective_start", "starts_at", "id").offset(offset).limit(limit)


def count_upcoming(df: DataFrame, flt: Filter, now: str) -> DataFrame:
    return collapsed(df, flt, now).agg(F.count(F.lit(1)).alias("n"))


def series_labels(df: DataFrame, flt: Filter, now: str) -> DataFrame:
    """Per (title, venue) with several dates: count, last end and whether they cover the run daily."""
    rows = _before_end(df.filter(still_relevant(flt.from_ or now)), flt)
    grouped = rows.groupBy("title", "venue_id").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.max(F.coalesce("ends_at", "starts_at")).alias("last_at"),
        F.min("starts_at").alias("first_at"),
    )
    days = F.abs(F.timestamp_diff("DAY", F.col("first_at"), F.col("last_at"))) + 1
    return grouped.filter(F.col("occurrences") > 1).select(
        "title", "venue_id", "occurrences", "last_at", (F.col("occurrences") * 10 >= days * 8).alias("daily")
    )


def in_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Events overlapping the half-open range."""
    return df.filter((F.col("starts_at") < as_ntz(end)) & still_relevant(start))


def month_bounds(year: int, month: int) -> tuple[str, str]:
    first = dt.date(year, month, 1)
    following = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return first.isoformat(), following.isoformat()


def for_month(df: DataFrame, year: int, month: int) -> DataFrame:
    return in_range(df, *month_bounds(year, month))


def count_by_period(df: DataFrame, now: str) -> DataFrame:
    """Events per named period in one scan: a conditional count per window, then one row each."""
    windows = period_bounds(now)
    counts = []
    for name, (first, last) in windows.items():
        flt = Filter(from_=first.isoformat(), to=last.isoformat())
        upper = F.col("starts_at") < day_start(as_ntz(flt.to)) + F.expr("INTERVAL 1 DAY")
        counts.append(F.count_if(still_relevant(flt.from_) & upper).alias(name))
    rows = F.array(*[
        F.struct(F.lit(n).alias("period"), F.lit(a).alias("first_day"), F.lit(b).alias("last_day"), F.col(n).alias("n"))
        for n, (a, b) in windows.items()
    ])
    return df.agg(*counts).select(F.inline(rows))


def around(df: DataFrame, flt: Filter, now: str, event_id: int, k: int = 8) -> DataFrame:
    """The ``k`` list rows before and after one event in (start, id) order."""
    rows = collapsed(df, flt, now)
    start = df.filter(F.col("id") == event_id).agg(F.max("starts_at")).scalar()
    here, there = F.struct("starts_at", "id"), F.struct(start.alias("starts_at"), F.lit(event_id).cast("long").alias("id"))
    rows = rows.filter(start.isNotNull())  # an anchor outside the listing has no neighbours
    after = rows.filter(here > there).orderBy("starts_at", "id").limit(k)
    before = rows.filter(here < there).orderBy(F.desc("starts_at"), F.desc("id")).limit(k)
    return before.withColumn("side", F.lit("before")).unionByName(after.withColumn("side", F.lit("after")))


def neighbours(df: DataFrame, flt: Filter, now: str) -> DataFrame:
    """Previous and next list row of every row, per region, by distributed row numbers."""
    ranked = scale.number_rows(collapsed(df, flt, now).select("region_id", "starts_at", "id"), ["region_id"], "starts_at", "id")
    by_rank = lambda name, shift: ranked.select(
        "region_id", (F.col("rank") + shift).alias("rank"), F.col("id").alias(name)
    )
    keys = ["region_id", "rank"]
    return ranked.join(by_rank("previous_id", 1), keys, "left").join(by_rank("next_id", -1), keys, "left")


def find_for_feed(df: DataFrame, now: str, limit: int = FEED_LIMIT) -> DataFrame:
    """Soonest ``limit`` rows of the coming year per region."""
    year_on = as_ntz(now) + F.expr("INTERVAL 1 YEAR")
    rows = df.filter(still_relevant(now) & (F.col("starts_at") < year_on))
    return scale.top_per_group(rows, ["region_id"], [F.col("starts_at"), F.col("id")], limit, "id", bucket=F.to_date("starts_at")).drop("rank")


def find_for_sitemap(df: DataFrame, now: str, limit: int = SITEMAP_LIMIT) -> DataFrame:
    """Soonest ``limit`` rows per region."""
    rows = df.filter(still_relevant(now)).select("region_id", "id", "slug", "last_seen_at", "starts_at")
    return scale.top_per_group(rows, ["region_id"], [F.col("starts_at"), F.col("id")], limit, "id", bucket=F.to_date("starts_at"))


def find_visible(df: DataFrame, event_id: int) -> DataFrame:
    return df.filter(F.col("id") == event_id)


def shard(df: DataFrame, shards: int, index: int) -> DataFrame:
    """Disjoint work sets by id."""
    return df.filter(F.pmod(F.col("id"), F.lit(shards)) == index)


def needs_summary(df: DataFrame, now: str) -> DataFrame:
    text = F.coalesce("description", F.lit("")) != ""
    return df.filter(still_relevant(now) & F.col("summary").isNull() & text & ~F.col("source_facts_only"))


def unchecked(df: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    seen = decisions.select(F.col("event_id").alias("id"))
    return df.filter(still_relevant(now)).join(seen, "id", "left_anti")


def summarized(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    rows = df.filter((F.coalesce("summary", F.lit("")) != "") & ~F.col("source_facts_only"))
    return rows.orderBy("starts_at", "id").offset(offset).limit(limit)


def used_cities(df: DataFrame, regions: DataFrame, now: str) -> DataFrame:
    """Cities with relevant events, per region, without the region's own default."""
    default = regions.select(F.col("id").alias("region_id"), "default_city")
    return (
        df.filter(still_relevant(now) & (F.coalesce("venue_city", F.lit("")) != ""))
        .select("region_id", F.col("venue_city").alias("city")).distinct()
        .join(default, "region_id").filter(F.col("city") != F.col("default_city")).select("region_id", "city")
    )


def with_categories(df: DataFrame, event_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """Category slugs of each event as one ordered array (at most the catalogue's length)."""
    named = event_categories.join(categories.select(F.col("id").alias("category_id"), "slug", "sort_order"), "category_id")
    slugs = named.groupBy(F.col("event_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("sort_order", "slug"))), lambda s: s["slug"]).alias("category_slugs")
    )
    return df.join(slugs, "id", "left")


def ordered(dim: DataFrame, kind: str) -> DataFrame:
    """Catalogue order: categories by sort order, other dimensions by name."""
    return dim.orderBy("sort_order", "name") if kind == "categories" else dim.orderBy("name", "id")


def source_directory(sources: DataFrame, region: int) -> DataFrame:
    rows = sources.filter((F.col("region_id") == region) & (F.col("key") != "demo"))
    return rows.orderBy("name", "id")
