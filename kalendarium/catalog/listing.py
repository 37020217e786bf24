"""Listing queries on the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalendarium.catalog.sql import T_NOW, relevant, with_tables
from kalendarium.catalog.tables import NOW, Tables
from kalendarium.operators import listing as L

SHOW = ["id", "title", "starts_at", "ends_at", "venue_id", "region_id"]
_S = ", ".join(SHOW)


def _enriched(t: Tables):
    return L.enrich(t.events, t.venues, t.sources)


def _visible(t: Tables, flt=L.Filter(), region=None):
    return L.visible_events(t.events, t.venues, t.sources, flt, region, t.event_categories, t.categories)


def _shown(t: Tables):
    """Visible events with their venue, for display columns."""
    return L.visible(_enriched(t))


def _q(fn):
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


COLLAPSED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, venue_id, region_id ORDER BY starts_at, id) AS rn
  FROM vi WHERE {relevant(T_NOW)}) WHERE rn = 1"""
_DAY = f"date_trunc('day', {T_NOW})"
WEEKEND = L.Filter().with_period("wochenende", NOW)
SEARCH = L.Filter(q="bolt%frei", category_slugs=("musik", "kunst"), course="hide")
SAVED = L.Filter(only_saved=True, saved_ids=tuple(range(3, 3000, 10)))
_BIG = 100_000

QUERIES = {
    "visibility_filter": _q(lambda t: _shown(t).select(*SHOW, "source_key", "venue_name")),
    "relevance_predicate": _q(lambda t: t.events.filter(L.still_relevant(NOW)).select("id", "starts_at", "ends_at", "all_day")),
    "upcoming_window": _q(lambda t: L.upcoming(_visible(t), WEEKEND, NOW).select(*SHOW)),
    "upcoming_saved": _q(lambda t: L.upcoming(_visible(t, SAVED), SAVED, NOW).select(*SHOW)),
    "search_substring": _q(lambda t: L.search(_shown(t), "Nation_1%").select(*SHOW, "source_name")),
    "category_filter": _q(lambda t: _visible(t, L.Filter(category_slugs=("musik", "kunst"))).select(*SHOW)),
    "city_filter": _q(lambda t: _visible(t, L.Filter(city="NATION_6"), 1).select(*SHOW)),
    "course_filter": _q(lambda t: _visible(t, L.Filter(course="only")).select("id", "is_course")),
    "saved_filter": _q(lambda t: L.saved_only(_visible(t), SAVED.saved_ids).select(*SHOW)),
    "period_counts": _q(lambda t: L.count_by_period(_visible(t), NOW)),
    "range_overlap": _q(lambda t: L.for_month(_visible(t), 1998, 7).select(*SHOW)),
    "work_shard": _q(lambda t: L.shard(_visible(t), 4, 1).select(*SHOW)),
    "needs_summary": _q(lambda t: L.needs_summary(_visible(t), NOW).select(*SHOW)),
    "unchecked_worklist": _q(lambda t: L.unchecked(_visible(t), t.category_decisions, NOW).select(*SHOW)),
    "visible_point_lookup": _q(lambda t: L.find_visible(_visible(t), 324).select(*SHOW)),
    "series_collapse": _q(lambda t: L.collapsed(_visible(t), L.Filter(), NOW).select(*SHOW)),
    "series_collapse_filtered": _q(lambda t: L.collapsed(_visible(t, SEARCH), SEARCH, NOW).select(*SHOW)),
    "series_anti_join": _q(lambda t: series_by_anti_join(t)),
    "series_labels": _q(lambda t: L.series_labels(_visible(t), L.Filter(), NOW)),
    "find_upcoming": _q(lambda t: L.find_upcoming(_visible(t), L.Filter(), NOW, limit=40, offset=10).select(*SHOW, "effective_start")),
    "count_upcoming": _q(lambda t: L.count_upcoming(_visible(t), L.Filter(), NOW)),
    "neighbours_of_event": _q(lambda t: L.around(_visible(t), L.Filter(), NOW, 324, 8).select("side", *SHOW)),
    "neighbours_bulk": _q(lambda t: L.neighbours(_visible(t), L.Filter(), NOW)),
    "calendar_feed": _q(lambda t: L.find_for_feed(_visible(t), NOW).select(*SHOW)),
    "sitemap": _q(lambda t: L.find_for_sitemap(_visible(t), NOW)),
    "teaser_review": _q(lambda t: L.summarized(_visible(t), 500, 20).select(*SHOW, "summary")),
    "used_cities": _q(lambda t: L.used_cities(_shown(t), t.regions, NOW)),
    "with_categories": _q(lambda t: L.with_categories(_visible(t), t.event_categories, t.categories).select("id", F.array_join("category_slugs", ",").alias("slugs"))),
    "dimension_order": _q(lambda t: L.ordered(t.venues, "venues").select("id", "name", "city")),
    "source_directory": _q(lambda t: L.source_directory(t.sources, 3).select("id", "name", "url")),
}


def series_by_anti_join(t: Tables):
    """The collapse without an ordering window: no earlier row of the same series (a cross-check)."""
    rows = _visible(t).filter(L.still_relevant(NOW)).select(*SHOW)
    first = rows.groupBy("title", "venue_id", "region_id").agg(F.min("starts_at").alias("first_at"))
    tied = rows.join(first, (rows["title"] == first["title"]) & rows["venue_id"].eqNullSafe(first["venue_id"]) & (rows["region_id"] == first["region_id"]) & (rows["starts_at"] > first["first_at"]), "left_anti")
    lowest = tied.groupBy("title", "venue_id", "region_id").agg(F.min("id").alias("id")).select("id")
    return tied.join(lowest, "id", "left_semi").select(*SHOW)


def _period_sql() -> str:
    parts = []
    for name, (a, b) in L.period_bounds(NOW).items():
        floor = f"TIMESTAMP '{a} 00:00:00'"
        parts.append(
            f"SELECT '{name}' AS period, DATE '{a}' AS first_day, DATE '{b}' AS last_day, count(*) AS n FROM vi "
            f"WHERE {relevant(floor)} AND starts_at < TIMESTAMP '{b} 00:00:00' + INTERVAL 1 DAY"
        )
    return " UNION ALL ".join(parts)


_LIKE = "(lower(title) LIKE '%{q}%' OR lower(description) LIKE '%{q}%' OR lower(venue_name) LIKE '%{q}%' OR lower(venue_city) LIKE '%{q}%' OR lower(source_name) LIKE '%{q}%')"
_HASCAT = "id IN (SELECT event_id FROM evcat JOIN cat ON cat.id = category_id WHERE slug IN ('musik', 'kunst'))"
_SAVED_IDS = "id BETWEEN 3 AND 2999 AND id % 10 = 3"

ORACLE = {
    "visibility_filter": with_tables("vi", f"SELECT {_S}, source_key, venue_name FROM vi"),
    "relevance_predicate": with_tables("ev", f"SELECT id, starts_at, ends_at, all_day FROM ev WHERE {relevant(T_NOW)}"),
    "upcoming_window": with_tables("vi", f"SELECT {_S} FROM vi WHERE {relevant(f'TIMESTAMP {chr(39)}{WEEKEND.from_}{chr(39)}')} AND starts_at < TIMESTAMP '{WEEKEND.to}' + INTERVAL 1 DAY"),
    "upcoming_saved": with_tables("vi", f"SELECT {_S} FROM vi WHERE {_SAVED_IDS}"),
    "search_substring": with_tables("vi", f"SELECT {_S}, source_name FROM vi WHERE {_LIKE.format(q='nation_1%')}"),
    "category_filter": with_tables("vi evcat", f"SELECT {_S} FROM vi WHERE {_HASCAT}"),
    "city_filter": with_tables("vi", f"SELECT {_S} FROM vi WHERE venue_city = 'NATION_6' AND region_id = 1"),
    "course_filter": with_tables("vi", "SELECT id, is_course FROM vi WHERE is_course"),
    "saved_filter": with_tables("vi", f"SELECT {_S} FROM vi WHERE {_SAVED_IDS}"),
    "period_counts": with_tables("vi", _period_sql()),
    "range_overlap": with_tables("vi", f"""SELECT {_S} FROM vi WHERE starts_at < TIMESTAMP '1998-08-01' AND {relevant("TIMESTAMP '1998-07-01'")}"""),
    "work_shard": with_tables("vi", f"SELECT {_S} FROM vi WHERE id % 4 = 1"),
    "needs_summary": with_tables("vi", f"SELECT {_S} FROM vi WHERE {relevant(T_NOW)} AND summary IS NULL AND description IS NOT NULL AND description <> '' AND NOT facts_only"),
    "unchecked_worklist": with_tables("vi cdec", f"SELECT {_S} FROM vi WHERE {relevant(T_NOW)} AND id NOT IN (SELECT event_id FROM cdec)"),
    "visible_point_lookup": with_tables("vi", f"SELECT {_S} FROM vi WHERE id = 324"),
    "series_collapse": with_tables("vi", f"SELECT {_S} FROM ({COLLAPSED})"),
    "series_collapse_filtered": with_tables("vi evcat", f"""SELECT {_S} FROM (SELECT *, row_number() OVER (PARTITION BY title, venue_id, region_id ORDER BY starts_at, id) AS rn
      FROM vi WHERE {relevant(T_NOW)} AND NOT is_course AND {_HASCAT} AND {_LIKE.format(q='bolt%frei')}) WHERE rn = 1"""),
    "series_anti_join": with_tables("vi", f"""SELECT {', '.join('e.' + c for c in SHOW)} FROM (SELECT * FROM vi WHERE {relevant(T_NOW)}) e
      WHERE NOT EXISTS (SELECT 1 FROM vi x WHERE x.title = e.title AND x.venue_id IS NOT DISTINCT FROM e.venue_id AND x.region_id = e.region_id
      AND {relevant(T_NOW, 'x')} AND (x.starts_at < e.starts_at OR (x.starts_at = e.starts_at AND x.id < e.id)))"""),
    "series_labels": with_tables("vi", f"""SELECT title, venue_id, count(*) AS occurrences, max(coalesce(ends_at, starts_at)) AS last_at,
      count(*) >= 0.8 * (date_sub('day', min(starts_at), max(coalesce(ends_at, starts_at))) + 1) AS daily
      FROM vi WHERE {relevant(T_NOW)} GROUP BY title, venue_id HAVING count(*) > 1"""),
    "find_upcoming": with_tables("vi", f"SELECT {_S}, greatest(starts_at, {_DAY}) AS effective_start FROM ({COLLAPSED}) ORDER BY effective_start, starts_at, id LIMIT 40 OFFSET 10"),
    "count_upcoming": with_tables("vi", f"SELECT count(*) AS n FROM ({COLLAPSED})"),
    "neighbours_of_event": with_tables("vi", f"""(SELECT 'after' AS side, {_S} FROM ({COLLAPSED}) WHERE (starts_at, id) > (SELECT (starts_at, id) FROM vi WHERE id = 324) ORDER BY starts_at, id LIMIT 8)
      UNION ALL (SELECT 'before' AS side, {_S} FROM ({COLLAPSED}) WHERE (starts_at, id) < (SELECT (starts_at, id) FROM vi WHERE id = 324) ORDER BY starts_at DESC, id DESC LIMIT 8)"""),
    "neighbours_bulk": with_tables("vi", f"""SELECT region_id, starts_at, id, row_number() OVER w AS rank, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id
      FROM ({COLLAPSED}) WINDOW w AS (PARTITION BY region_id ORDER BY starts_at, id)"""),
    "calendar_feed": with_tables("vi", f"""SELECT {_S} FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY starts_at, id) AS place FROM vi
      WHERE {relevant(T_NOW)} AND starts_at < {T_NOW} + INTERVAL 1 YEAR) WHERE place <= 2000"""),
    "sitemap": with_tables("vi", f"""SELECT * FROM (SELECT region_id, id, slug, last_seen_at, starts_at, row_number() OVER (PARTITION BY region_id ORDER BY starts_at, id) AS rank
      FROM vi WHERE {relevant(T_NOW)}) WHERE rank <= 20000"""),
    "teaser_review": with_tables("vi", f"SELECT {_S}, summary FROM vi WHERE coalesce(summary, '') <> '' AND NOT facts_only ORDER BY starts_at, id LIMIT 500 OFFSET 20"),
    "used_cities": with_tables("vi reg", f"SELECT DISTINCT region_id, venue_city AS city FROM vi JOIN reg ON reg.id = region_id WHERE {relevant(T_NOW)} AND venue_city <> '' AND venue_city <> default_city"),
    "with_categories": with_tables("vi evcat", "SELECT vi.id, string_agg(cat.slug, ',' ORDER BY sort_order) AS slugs FROM vi LEFT JOIN evcat ON event_id = vi.id LEFT JOIN cat ON cat.id = category_id GROUP BY vi.id"),
    "dimension_order": with_tables("ven", "SELECT id, name, city FROM ven"),
    "source_directory": with_tables("src", "SELECT id, name, url FROM src WHERE region_id = 3"),
}
