"""Snapshot merge, identity and dimension queries with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kalendarium.catalog.listing import _q
from kalendarium.catalog.sql import T_NOW, canonical_city, content_hash, dedup_key, norm, norm_title, strip, utc, with_tables
from kalendarium.catalog.tables import NOW, Tables, every
from kalendarium.functions.times import ts
from kalendarium.operators import merge as M
from kalendarium.operators import places as P
from kalendarium.session import checkpoint_dir, cut_lineage
from kalendarium.sources import regional


def merged(t: Tables) -> M.Merged:
    return M.upsert(t.stored_events, t.event_categories, t.incoming, t.sources, t.regions, t.venues, t.categories, t.category_decisions, NOW)


def _prepared(t: Tables):
    return M.prepare_incoming(t.incoming.filter("title <> ''"), t.sources, t.regions)


def _regional(t: Tables) -> regional.Regional:
    """The stored events laid out by region in a folder of their own."""
    store = regional.Regional(t.spark, f"{checkpoint_dir(t.spark)}/regional-{uuid.uuid4().hex}", buckets=8)
    store.start(t.stored_events, t.event_categories, t.venues)
    return store


def _regional_merged(t: Tables) -> regional.Regional:
    store = _regional(t)
    store.merge("first", t.incoming, t.sources, t.regions, t.categories, t.category_decisions, NOW)
    return store


def _regional_merge(t: Tables):
    return _regional_merged(t).events().select(*_EV)


def _regional_keys(t: Tables):
    """The own keys as the merge left them."""
    return _regional_merged(t).keys().own.select("source_id", "run_key", "id", "content_hash")


def _long_ids(t: Tables):
    """Overlong, partly shared ids per source."""
    tail = F.when(F.col("id") % 3 == 0, (F.col("id") % 5).cast("string")).otherwise(F.col("id").cast("string"))
    url = F.concat(F.lit("https://x.example/"), F.when(every(4), F.repeat(F.lit("a"), 200)).otherwise(""), tail)
    return t.occurrences.select("source_id", F.col("id").alias("position"), "starts_at", url.alias("external_id"))


def _edits(t: Tables):
    i = F.col("id")
    return t.events.filter(every(5)).select(
        "id", F.when(every(10), "  ").otherwise(F.concat(F.lit(" Neu "), "title")).alias("title"), F.when(every(15), "").otherwise(F.lit("Verein")).alias("organizer"),
        F.when(every(20), F.col("description")).otherwise(F.lit("Text ")).alias("description"), F.lit("").alias("image_url"),
        F.when(every(25), ts("1999-01-01 10:00:00")).alias("starts_at"), F.lit(None).cast("timestamp_ntz").alias("ends_at"), F.lit(True).alias("all_day"),
        F.array(F.lit("title"), F.concat(F.lit("f"), (i % 3).cast("string"))).alias("locked_fields"),
    )


def _stale_keys(t: Tables):
    """Events with keys of the earlier rule, built from city, venue name or something unknown."""
    place = F.when(every(3), F.col("venue_city")).when(every(3, 1), F.col("venue_name_")).otherwise(F.lit("anderswo"))
    v = t.venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name_"), F.col("city").alias("venue_city"))
    from kalendarium.functions import keys as K

    old = F.concat_ws("|", K.strip_to_ascii(K.undecorated_title(F.col("title"))), F.date_format("starts_at", "yyyy-MM-dd"), K.strip_to_ascii(F.coalesce(place, F.lit(""))))
    return t.events.join(v, "venue_id", "left").withColumn("dedup_key", old).select(*t.events.columns)


def _manual(t: Tables):
    i = F.col("id")
    s = F.col("starts_at")
    return t.occurrences.select(
        F.col("source_id"), i.alias("position"), "title", F.when(every(2), F.date_format(s, "yyyy-MM-dd")).when(every(7, 1), F.lit("31.06.2026")).otherwise(F.date_format(s, "dd.MM.yyyy")).alias("date"),
        F.when(every(4), "").when(every(9, 1), F.lit("25:00")).otherwise(F.date_format(s, "H:mm")).alias("time"),
        F.when(every(3, 1), F.date_format(F.col("ends_at"), "yyyy-MM-dd")).otherwise("").alias("end_date"), F.when(every(6, 1), "23:30").alias("end_time"),
        F.col("venue_name").alias("location"), "description", "city", F.lit("kunst").alias("category"), F.col("source_url").alias("url"), "price", "organizer",
    )


_EV = ["id", "title", "slug", "description", "summary", "starts_at", "ends_at", "all_day", "location_text", "region_id", "source_id", "external_id",
       "content_hash", "dedup_key", "status", "pruned_at", "first_seen_at", "last_seen_at", "duplicate_of", "organizer", "image_url"]

QUERIES = {
    "dedupe_batch": _q(lambda t: M.dedupe_batch(_prepared(t)).select("source_id", "run_key", "position", "title")),
    "disambiguate_ids": _q(lambda t: M.disambiguate_ids(_long_ids(t))),
    "match_existing": _q(lambda t: M.match_existing(_prepared(t), M.key_rows(t.stored_events)).select("source_id", "run_key", "matched_id")),
    "change_actions": _q(lambda t: M.resolve_actions(cut_lineage(_prepared(t)), M.key_rows(t.stored_events)).select("source_id", "position", "matched_id", "action")),
    "match_bucketed": _q(lambda t: _regional(t).match(_prepared(t)).select("source_id", "run_key", "matched_id")),
    "regional_merge": _q(_regional_merge),
    "regional_keys": _q(_regional_keys),
    "upsert_actions": _q(lambda t: merged(t).actions),
    "upsert_events": _q(lambda t: merged(t).events.select(*_EV)),
    "upsert_venues": _q(lambda t: merged(t).venues.select("id", "region_id", "name", "city", "dedup_key")),
    "upsert_event_venue": _q(lambda t: merged(t).events.select("id", "venue_id")),
    "upsert_categories": _q(lambda t: merged(t).event_categories),
    "city_normalization": _q(lambda t: P.normalize_city(t.incoming.join(t.sources.select(F.col("id").alias("source_id"), "region_id"), "source_id"), t.regions).select("source_id", "position", "city")),
    "corrections_overlay": _q(lambda t: M.apply_corrections(t.events, _edits(t)).select(
        "id", "title", "organizer", "description", "image_url", "summary", "starts_at", "ends_at", "all_day", F.array_join("locked_fields", ",").alias("locks"))),
    "backfill_keys": _q(lambda t: M.backfill_keys(_stale_keys(t), t.venues)),
    "manual_rows": _q(lambda t: M.manual_incoming(_manual(t)).select("position", "title", "starts_at", "ends_at", "all_day", "venue_name", "external_id")),
}

_RK = "CASE WHEN coalesce(external_id, '') <> '' THEN 'id:' || external_id ELSE 'key:' || dedup_key END"
_LOCK = "list_contains(e.locked_fields, '{}')"


def _pick(col: str, new: str, lock: str | None = None) -> str:
    guard = f"h.position IS NOT NULL AND NOT {_LOCK.format(lock)}" if lock else "h.position IS NOT NULL"
    return f"CASE WHEN {guard} THEN {new} ELSE e.{col} END AS {col}"


_UPD = ", ".join([
    "e.id", _pick("title", "h.title", "title"), _pick("slug", "h.slug", "title"), _pick("description", "h.description", "description"),
    f"CASE WHEN h.position IS NOT NULL AND h.cleared AND NOT {_LOCK.format('description')} THEN NULL ELSE e.summary END AS summary",
    _pick("starts_at", "h.starts_at", "datum"), _pick("ends_at", "h.ends_at", "datum"), _pick("all_day", "h.all_day", "datum"), _pick("location_text", "h.location_text"),
    _pick("region_id", "h.region_id"), "e.source_id", _pick("external_id", "h.external_id"), _pick("content_hash", "h.content_hash"),
    "coalesce(h.dedup_key, u.dedup_key, e.dedup_key) AS dedup_key",
    "CASE WHEN (h.position IS NOT NULL OR u.position IS NOT NULL) AND e.pruned_at IS NOT NULL AND e.status = 'hidden' THEN 'published' ELSE e.status END AS status",
    "CASE WHEN h.position IS NOT NULL OR u.position IS NOT NULL THEN NULL ELSE e.pruned_at END AS pruned_at", "e.first_seen_at",
    f"CASE WHEN h.position IS NOT NULL OR u.position IS NOT NULL THEN {T_NOW} ELSE e.last_seen_at END AS last_seen_at", "e.duplicate_of",
    _pick("organizer", "h.organizer", "organizer"), _pick("image_url", "h.image_url", "imageUrl"),
])
_SLUG = "left(strftime(starts_at, '%Y-%m-%d') || '-' || trim(regexp_replace(lower(left(title, 80)), '[^a-z0-9]+', '-', 'g'), '-'), 300) AS slug"

ORACLE = {
    "dedupe_batch": with_tables("incn", f"""SELECT source_id, run_key, position, title FROM (SELECT *, {_RK} AS run_key,
      row_number() OVER (PARTITION BY source_id, {_RK} ORDER BY position) AS rn FROM incn) WHERE rn = 1"""),
    "disambiguate_ids": with_tables("occ", """SELECT source_id, position, starts_at, CASE WHEN n > 1 THEN left(short, 191 - 16) || '#' || strftime(starts_at, '%Y-%m-%d-%H%M') ELSE url END AS external_id
      FROM (SELECT *, left(url, 191) AS short, count(*) OVER (PARTITION BY source_id, left(url, 191)) AS n FROM (SELECT source_id, id AS position, starts_at,
      'https://x.example/' || CASE WHEN id % 4 = 0 THEN repeat('a', 200) ELSE '' END || CASE WHEN id % 3 = 0 THEN id % 5 ELSE id END AS url FROM occ))"""),
    "match_existing": with_tables("steps", "SELECT DISTINCT source_id, run_key, matched_id FROM steps"),
    "match_bucketed": with_tables("steps", "SELECT DISTINCT source_id, run_key, matched_id FROM steps"),
    "change_actions": with_tables("acted", "SELECT source_id, position, matched_id, action FROM acted"),
    "upsert_actions": with_tables("acted created", """SELECT source_id, position, action FROM acted WHERE action <> 'created'
      UNION ALL SELECT source_id, position, CASE WHEN canonical_id IS NULL THEN 'created' ELSE 'duplicate' END FROM created"""),
    "upsert_events": with_tables("heads created", _MERGED_EVENTS := f"""SELECT {_UPD} FROM ev e LEFT JOIN (SELECT *, {_SLUG} FROM heads WHERE matched_id IS NOT NULL AND changed) h ON h.matched_id = e.id
      LEFT JOIN (SELECT * FROM heads WHERE matched_id IS NOT NULL AND NOT changed) u ON u.matched_id = e.id
      UNION ALL SELECT id, title, {_SLUG}, description, NULL, starts_at, ends_at, all_day, location_text, region_id, source_id, external_id, content_hash, dedup_key,
        CASE WHEN canonical_id IS NULL THEN 'published' ELSE 'duplicate' END, NULL, {T_NOW}, {T_NOW}, canonical_id, organizer, image_url FROM created"""),
    "regional_merge": with_tables("heads created", _MERGED_EVENTS),
    "regional_keys": with_tables("heads created", f"""SELECT source_id, run_key, min(id) AS id, min_by(content_hash, id) AS content_hash FROM (
      SELECT *, unnest(CASE WHEN coalesce(external_id, '') <> '' THEN ['id:' || external_id, 'key:' || dedup_key] ELSE ['key:' || dedup_key] END) AS run_key
      FROM ({_MERGED_EVENTS})) GROUP BY region_id, source_id, run_key"""),
    "upsert_venues": with_tables("ven2", "SELECT id, region_id, name, city, dedup_key FROM ven2"),
    "upsert_event_venue": with_tables("ven2 created", f"""SELECT id, venue_id FROM (
      SELECT e.id, CASE WHEN h.position IS NULL THEN e.venue_id ELSE v.id END AS venue_id FROM ev e LEFT JOIN (SELECT h.*, {strip('venue_name')} || '|' || {strip('coalesce(city, default_city)')} AS vk
        FROM heads h JOIN reg ON reg.id = h.region_id WHERE matched_id IS NOT NULL AND changed) h ON h.matched_id = e.id LEFT JOIN ven2 v ON v.region_id = h.region_id AND v.dedup_key = h.vk
      UNION ALL SELECT c.id, v.id FROM (SELECT c.*, {strip('venue_name')} || '|' || {strip('coalesce(city, default_city)')} AS vk FROM created c JOIN reg ON reg.id = c.region_id) c
        LEFT JOIN ven2 v ON v.region_id = c.region_id AND v.dedup_key = c.vk)"""),
    "upsert_categories": with_tables("evcat cdec heads created", """SELECT * FROM evcat WHERE event_id NOT IN (SELECT matched_id FROM op) UNION ALL
      SELECT x.id, cat.id FROM (SELECT matched_id AS id, unnest(category_slugs) AS slug FROM op UNION ALL SELECT id, unnest(category_slugs) FROM created) x JOIN cat USING (slug)""",
      op="SELECT h.* FROM heads h JOIN ev ON ev.id = h.matched_id WHERE changed AND NOT list_contains(ev.locked_fields, 'categories') AND h.matched_id NOT IN (SELECT event_id FROM cdec WHERE status = 'applied')"),
    "city_normalization": with_tables("inc src towns", f"SELECT source_id, position, {canonical_city('inc.city', 's.region_id')} AS city FROM inc JOIN src s ON s.id = inc.source_id"),
    "corrections_overlay": with_tables("ev", f"""SELECT id, CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN 'Neu ' || title ELSE title END AS title,
      CASE WHEN id % 15 = 0 THEN NULL WHEN id % 5 = 0 THEN 'Verein' ELSE organizer END AS organizer,
      CASE WHEN id % 20 = 0 THEN CASE WHEN description <> '' THEN description END WHEN id % 5 = 0 THEN 'Text' ELSE description END AS description,
      CASE WHEN id % 5 <> 0 THEN image_url END AS image_url,
      CASE WHEN id % 20 = 0 AND (CASE WHEN description <> '' THEN description END) IS NOT DISTINCT FROM description THEN summary
        WHEN id % 5 = 0 AND id % 20 <> 0 AND description IS NOT DISTINCT FROM 'Text' THEN summary WHEN id % 5 = 0 THEN NULL ELSE summary END AS summary,
      CASE WHEN id % 25 = 0 THEN TIMESTAMP '1999-01-01 10:00:00' ELSE starts_at END AS starts_at, CASE WHEN id % 25 <> 0 THEN ends_at END AS ends_at,
      CASE WHEN id % 25 = 0 THEN true ELSE all_day END AS all_day, CASE WHEN id % 5 = 0 THEN 'title,f' || (id % 3) ELSE array_to_string(locked_fields, ',') END AS locks FROM ev"""),
    "backfill_keys": with_tables("ev ven", f"""SELECT id, old AS dedup_key, new_key FROM (SELECT *, {dedup_key('title', 'starts_at', 'all_day', 'place')} AS new_key FROM (
      SELECT *, CASE WHEN city IS NOT NULL AND old = head || {strip('city')} THEN city WHEN name IS NOT NULL AND old = head || {strip('name')} THEN name
        WHEN location_text IS NOT NULL AND old = head || {strip('location_text')} THEN location_text WHEN old = head THEN '' ELSE coalesce(city, location_text, '') END AS place FROM (
      SELECT *, head || {strip("coalesce(CASE id % 3 WHEN 0 THEN city WHEN 1 THEN name ELSE 'anderswo' END, '')")} AS old FROM (
      SELECT ev.id, title, starts_at, all_day, location_text, v.city, v.name, {norm_title('title')} || '|' || strftime(starts_at, '%Y-%m-%d') || '|' AS head FROM ev LEFT JOIN ven v ON v.id = venue_id))))
      WHERE new_key <> old"""),
    "manual_rows": with_tables("occ", f"""SELECT position, title, s AS starts_at, CASE WHEN e > s THEN e END AS ends_at, id % 4 = 0 AS all_day, venue_name,
      'manual:' || strftime(s, '%Y-%m-%d') || '-' || left(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 40) AS external_id FROM (
      SELECT id, id AS position, title, venue_name, CASE WHEN id % 4 = 0 THEN date_trunc('day', starts_at) ELSE starts_at END AS s,
        CASE WHEN id % 6 = 1 THEN date_trunc('day', coalesce(ends_at, starts_at)) + INTERVAL 1410 MINUTE WHEN id % 3 = 1 THEN date_trunc('day', ends_at) END AS e FROM occ WHERE NOT (id % 2 = 1 AND id % 7 = 1) AND (id % 4 = 0 OR id % 9 <> 1))"""),
}
