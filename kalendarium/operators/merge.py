"""Idempotent snapshot merge of imported rows into the event table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.functions import keys
from kalendarium.functions.dates import manual_moment
from kalendarium.functions.text import blank_to_null, trim_edges
from kalendarium.functions.times import as_ntz
from kalendarium.model import CAPS, EVENT_COLUMNS, INCOMING_COLUMNS, VENUE_CITY_CAP, VENUE_NAME_CAP
from kalendarium.operators.inventory import cross_source_match
from kalendarium.operators.places import normalize_city
from kalendarium.session import cut_lineage


@dataclass(frozen=True)
class StoredKeys:
    """What a merge asks of the stored events before it touches them. ``own``: source_id, run_key, id,
    content_hash, text (digest of the description); ``shared``: region_id, dedup_key, source_id, id,
    status; ``ids``: ids whose largest is the largest stored one. Either columns of the events
    themselves or the key tables kept beside them (``sources.regional``)."""

    own: DataFrame
    shared: DataFrame
    ids: DataFrame

    @staticmethod
    def of(events: DataFrame) -> StoredKeys:
        return StoredKeys(key_rows(events), events.select("region_id", "dedup_key", "source_id", "id", "status"), events.select("id"))


@dataclass(frozen=True)
class Merged:
    events: DataFrame
    event_categories: DataFrame
    venues: DataFrame
    actions: DataFrame


def cap(c: Column, name: str) -> Column:
    return F.left(c, F.lit(CAPS[name]))


def apply_caps(df: DataFrame) -> DataFrame:
    """Column widths of the stored table."""
    return df.withColumns({name: cap(F.col(name), name) for name in CAPS if name in df.columns})


def prepare_incoming(incoming: DataFrame, sources: DataFrame, regions: DataFrame) -> DataFrame:
    """Region from the source, canonical city, capped id, then cross-source key, hash and run key."""
    source = sources.select(
        F.col("id").alias("source_id"), "region_id", F.coalesce(F.lower(F.col("config")["isCourse"]) == "true", F.lit(False)).alias("source_is_course")
    )
    rows = normalize_city(incoming.join(source, "source_id"), regions).withColumns({
        "external_id": cap(F.col("external_id"), "external_id"), "category_slugs": keys.all_slugs(F.col("category_slugs")),
    })
    places = [F.col(c) for c in ("city", "venue_name", "location_text")]
    rows = rows.withColumns({
        "dedup_key": keys.dedup_key(F.col("title"), F.col("starts_at"), F.col("all_day"), *places),
        "content_hash": keys.content_hash({c: F.col(c) for c in INCOMING_COLUMNS}),
    })
    return rows.withColumn("run_key", keys.run_key(F.col("external_id"), F.col("dedup_key")))


def dedupe_batch(rows: DataFrame) -> DataFrame:
    """First row per (source, run key) in arrival order."""
    return scale.pick_one(rows, ["source_id", "run_key"], [F.col("position")])


def disambiguate_ids(incoming: DataFrame, external_id: str = "external_id") -> DataFrame:
    """Ids of one source that collide after truncation get the start moment; the base is shortened so
    the suffix survives the cap. The count is a partial aggregate joined back, safe for a hot id."""
    short = cap(F.col(external_id), "external_id")
    rows = incoming.withColumn("_short", short)
    counts = rows.filter(F.col("_short").isNotNull()).groupBy("source_id", "_short").agg(F.count(F.lit(1)).alias("_n"))
    counted = scale.join_back(rows, counts.withColumn("_copies", F.col("_n")), ["source_id", "_short"], "position")
    suffix = F.concat(F.lit("#"), F.date_format("starts_at", "yyyy-MM-dd-HHmm"))
    base = F.left(F.col("_short"), F.lit(CAPS["external_id"]) - F.length(suffix))
    fixed = F.when(F.col("_copies") > 1, F.concat(base, suffix)).otherwise(F.col(external_id))
    return counted.withColumn(external_id, fixed).select(*incoming.columns)


def text_digest(description: str = "description") -> Column:
    return F.sha2(F.col(description), 256)


def key_rows(events: DataFrame) -> DataFrame:
    """The run keys stored events answer to: by external id where they have one, and by cross-source key."""
    has_id = F.coalesce("external_id", F.lit("")) != ""
    stored = events.select("region_id", "source_id", "external_id", "dedup_key", "id", "content_hash", text_digest().alias("text"))
    by_key = F.concat(F.lit("key:"), "dedup_key")
    answers = F.when(has_id, F.array(F.concat(F.lit("id:"), "external_id"), by_key)).otherwise(F.array(by_key))
    # one pass: the digest is taken once for both keys
    return stored.withColumn("run_key", F.explode(answers)).drop("external_id", "dedup_key")


def match_existing(rows: DataFrame, own: DataFrame, buckets: int | None = None) -> DataFrame:
    """Stored event per (source, run key): by external id when the row has one, else by the
    cross-source key. Returns one row per key with its size and the stored hash and description digest.
    ``own`` are ``key_rows``; ``buckets`` deals the batch like a key table of so many buckets, whose
    rows then stay where they are."""
    keyed = rows if buckets is None else rows.repartition(buckets, "source_id", "run_key")
    asked = keyed.groupBy("source_id", "run_key").agg(F.count(F.lit(1)).alias("_n"))
    # only stored rows the batch asks for go on; a small batch is broadcast and the table not shuffled
    wanted = own.join(asked.select("source_id", "run_key"), ["source_id", "run_key"], "left_semi")
    stored = F.struct("id", "content_hash", "text", "region_id")
    known = wanted.groupBy("source_id", "run_key").agg(F.min_by(stored, "id").alias("_stored"))
    state = F.when(F.col("_stored").isNotNull(), F.struct("_stored.content_hash", "_stored.text"))
    found = asked.join(known, ["source_id", "run_key"], "left")
    return found.withColumns({"matched_id": F.col("_stored.id"), "stored_region": F.col("_stored.region_id"), "_stored": state})


#: identity of a prepared row within one merge: verdicts are taken on narrow rows and find the whole ones by it
ROW = "_row"


def numbered(prepared: DataFrame) -> DataFrame:
    """Adds ``ROW``; stage the result, since the numbers only hold for one reading."""
    return prepared.withColumn(ROW, F.monotonically_increasing_id())


def _digest(text: Column) -> Column:
    """Sixteen bytes that stand for a digest text where only equality is asked."""
    return F.unhex(F.md5(text))


def known_states(asked: DataFrame, own: DataFrame) -> DataFrame:
    """The lowest stored event per (source, run key) that ``asked`` holds, with digests of its state."""
    # only stored rows the batch asks for go on; a small batch is broadcast and the table not shuffled
    states = own.select("source_id", "run_key", "id", "region_id", _digest(F.col("content_hash")).alias("hash"), _digest(F.col("text")).alias("text"))
    wanted = states.join(asked.select("source_id", "run_key").distinct(), ["source_id", "run_key"], "left_semi")
    known = wanted.groupBy("source_id", "run_key").agg(F.min_by(F.struct("id", "hash", "text", "region_id"), "id").alias("_stored"))
    return known.select(
        "source_id", "run_key", F.col("_stored.id").alias("matched_id"), F.col("_stored.region_id").alias("stored_region"),
        F.col("_stored.hash").alias("_hash"), F.col("_stored.text").alias("_text"),
    )


def resolve_actions(rows: DataFrame, own: DataFrame, buckets: int | None = None) -> DataFrame:
    """The verdict on each row, without its content: source_id, position, region_id, ``matched_id``,
    ``stored_region``, ``entity``, the step action and, where the rows are ``numbered``, their number. Rows of one
    entity apply in arrival order, each compared with the state the one before it left. Read staged rows: they are
    asked twice."""
    # digest of the content, then that of the description where there is one
    state = F.concat(_digest(F.col("content_hash")), F.coalesce(_digest(text_digest()), F.lit(b"")))
    narrow = rows.select("source_id", "run_key", "position", "region_id", *[c for c in (ROW,) if c in rows.columns], state.alias("_state"))
    keyed = narrow if buckets is None else narrow.repartition(buckets, "source_id", "run_key")
    matched = keyed.join(known_states(keyed, own), ["source_id", "run_key"], "left")
    known = F.col("matched_id").isNotNull()
    entity = F.when(known, F.concat(F.lit("ev:"), F.col("matched_id").cast("string"))).otherwise(F.col("run_key"))
    content, text = lambda c: F.substring(c, 1, 16), lambda c: F.substring(c, 17, 16)
    # what the stored state says is settled here, so that its digests stay behind
    other = content("_state") != F.col("_hash")
    judged = matched.withColumns({"entity": entity, "_other": other, "_other_text": other & (text("_state") != F.coalesce("_text", F.lit(b"")))})
    stepped = scale.previous_value(judged.drop("run_key", "_hash", "_text"), ["source_id", "entity"], "position", F.col("_state"), "_before")
    again = F.col("_before").isNotNull()
    changed = F.when(again, content("_state") != content("_before")).otherwise(F.col("_other"))
    new_text = F.when(again, changed & (text("_state") != text("_before"))).otherwise(F.col("_other_text"))
    action = F.when(known & ~changed, "unchanged").when(known, "updated").when(~again, "created").otherwise("unchanged")
    return stepped.withColumn("action", action).withColumn("_new_text", known & new_text).drop("_state", "_before", "_other", "_other_text")


#: what venue, duplicate and new id of a row are found by
HEAD_KEYS = ("source_id", "position", "run_key", "region_id", "dedup_key", "venue_name", "city")


def resolve_heads(stepped: DataFrame, prepared: DataFrame) -> DataFrame:
    """One row per entity: the first for a new event, the last for a stored one, and what changed; its keys
    without its content, which later meets the row by its number."""
    at = F.coalesce("position", F.lit(-(1 << 62)))
    heads = stepped.groupBy("source_id", "entity").agg(
        F.max("matched_id").alias("matched_id"), F.min_by(ROW, at).alias("_first"), F.max_by(ROW, at).alias("_last"),
        F.max(F.col("action") == "updated").alias("changed"), F.max("_new_text").alias("new_text"),
    )
    chosen = F.when(F.col("matched_id").isNull(), F.col("_first")).otherwise(F.col("_last"))
    return heads.select(chosen.alias(ROW), "matched_id", "changed", "new_text").join(prepared.select(ROW, *HEAD_KEYS), ROW)


def resolve_venues(rows: DataFrame, venues: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Find or create venues. Returns ``rows`` with ``venue_id`` and the extended venue table."""
    default = regions.select(F.col("id").alias("region_id"), "default_city")
    name = blank_to_null(F.left(trim_edges("venue_name"), F.lit(VENUE_NAME_CAP)))
    city = F.left(trim_edges(F.coalesce(blank_to_null(F.col("city")), F.col("default_city"))), F.lit(VENUE_CITY_CAP))
    keyed = rows.join(default, "region_id", "left").withColumns({"_name": name, "_city": city})
    keyed = keyed.withColumn("_venue_key", F.when(F.col("_name").isNotNull(), keys.venue_key(F.col("_name"), F.col("_city"))))
    wanted = keyed.filter(F.col("_venue_key").isNotNull()).groupBy("region_id", F.col("_venue_key").alias("dedup_key")).agg(
        F.min_by(F.struct(F.col("_name").alias("name"), F.col("_city").alias("city")), F.struct("source_id", "position")).alias("_v"),
        F.count(F.lit(1)).alias("_n"),
    )
    stored = venues.groupBy("region_id", "dedup_key").agg(F.min("id").alias("venue_id"))
    looked_up = wanted.join(stored, ["region_id", "dedup_key"], "left")
    top = venues.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = scale.number_keys(
        looked_up.filter(F.col("venue_id").isNull()).drop("venue_id"), F.concat_ws("|", F.col("region_id").cast("string"), "dedup_key"), "_nr"
    )
    fresh = fresh.withColumn("venue_id", top.scalar() + F.col("_nr"))
    found = looked_up.filter(F.col("venue_id").isNotNull()).select("region_id", "dedup_key", "_n", "venue_id").unionByName(
        fresh.select("region_id", "dedup_key", "_n", "venue_id")
    )
    attached = scale.join_back(keyed, found.withColumnRenamed("dedup_key", "_venue_key"), ["region_id", "_venue_key"], "position")
    added = fresh.select(F.col("venue_id").alias("id"), "region_id", "_v.*", "dedup_key")
    return attached.select(*rows.columns, "venue_id"), venues.unionByName(added, allowMissingColumns=True)


def locked(name: str) -> Column:
    return F.array_contains("locked_fields", name)


def respect_locks(new: dict[str, Column]) -> dict[str, Column]:
    """Pinned fields keep their stored value; ``datum`` pins start, end and the all-day flag."""
    pins = {
        "title": "title", "description": "description", "image_url": "imageUrl", "organizer": "organizer",
        "starts_at": "datum", "ends_at": "datum", "all_day": "datum",
    }
    return {c: F.when(locked(pins[c]), F.col(c)).otherwise(v) if c in pins else v for c, v in new.items()}


def _content(row: Callable[[str], Column]) -> dict[str, Column]:
    """Stored columns an import writes, from a prepared incoming row."""
    plain = ["starts_at", "ends_at", "all_day", "description", "region_id", "external_id", "content_hash", "dedup_key", "booking_status", "raw", "venue_id"]
    capped = ["title", "location_text", "source_url", "image_url", "price", "organizer"]
    return {
        **{c: row(c) for c in plain}, **{c: cap(row(c), c) for c in capped},
        "is_course": row("is_course") | row("source_is_course"), "slug": keys.slug(row("starts_at"), row("title")),
    }


def upsert(
    events: DataFrame, event_categories: DataFrame, incoming: DataFrame, sources: DataFrame, regions: DataFrame, venues: DataFrame,
    categories: DataFrame, category_decisions: DataFrame, now: str, stage: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> Merged:
    """Merge one batch. ``stage`` materializes (by default: checkpoints) the keyed rows, the verdicts, one row
    per entity, its venue and the new ids, since each is read several times below."""
    known = StoredKeys.of(events)
    prepared = stage(numbered(prepare_incoming(incoming.filter(F.coalesce("title", F.lit("")) != ""), sources, regions)))
    stepped = stage(resolve_actions(prepared, known.own))
    return merge_stepped(events, event_categories, prepared, stepped, known, sources, regions, venues, categories, category_decisions, now, stage)


def merge_stepped(
    events: DataFrame, event_categories: DataFrame, prepared: DataFrame, stepped: DataFrame, known: StoredKeys, sources: DataFrame, regions: DataFrame,
    venues: DataFrame, categories: DataFrame, category_decisions: DataFrame, now: str, stage: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> Merged:
    """The verdicts on the ``prepared`` rows applied. ``events`` and ``event_categories`` need only hold the regions
    of the matched events and of the batch: rows outside them neither change nor answer."""
    # read by venues, updates and sightings: grouped once, not for each of them
    heads = stage(resolve_heads(stepped, prepared))
    touched = heads.filter(F.col("matched_id").isNull() | F.col("changed"))
    placed, all_venues = resolve_venues(touched, venues, regions)
    placed = stage(placed.drop("changed", "venue_name", "city"))

    fresh = cross_source_match(placed.filter(F.col("matched_id").isNull()).drop("matched_id", "new_text"), known.shared, sources)
    fresh = _with_new_ids(fresh.withColumnRenamed("matched_id", "duplicate_of"), known.ids)
    fresh = stage(fresh.select(ROW, "source_id", "position", "id", "duplicate_of", "venue_id"))
    # both sides ask the same columns of the whole rows, so these are moved once for the two
    content = prepared.drop("source_id", "position", "run_key", "venue_name", "city")
    created = fresh.drop("position").join(content, ROW)
    updates = placed.filter(F.col("matched_id").isNotNull()).select(ROW, "matched_id", "new_text", "venue_id").join(content, ROW)
    refreshed = heads.filter(F.col("matched_id").isNotNull() & ~F.col("changed")).select("matched_id", "dedup_key")

    merged = _apply(events, updates, refreshed, now)
    inserted = _insert(created, now)
    bridge = _rewrite_categories(events, event_categories, updates, created, categories, category_decisions)
    kept = stepped.filter(F.col("action") != "created").select("source_id", "position", "action")
    firsts = fresh.select("source_id", "position", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("created").alias("action"))
    return Merged(merged.unionByName(inserted), bridge, all_venues, kept.unionByName(firsts))


def _with_new_ids(created: DataFrame, ids: DataFrame) -> DataFrame:
    top = ids.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = scale.number_keys(created, F.concat_ws("|", F.col("source_id").cast("string"), "run_key"), "_nr")
    return numbered.withColumn("id", top.scalar() + F.col("_nr")).drop("_nr")


def _apply(events: DataFrame, updates: DataFrame, refreshed: DataFrame, now: str) -> DataFrame:
    """Stored events after updates (locks kept) and sightings (last seen, key); both lift a prune."""
    # plain columns, not one struct: those nobody asks for stay behind
    new = [F.col(c).alias(f"_new_{c}") for c in updates.columns if c not in ("matched_id", ROW, "category_slugs")]
    changes = updates.select(F.col("matched_id").alias("id"), F.lit(True).alias("_updated"), *new)
    seen = refreshed.select(F.col("matched_id").alias("id"), F.col("dedup_key").alias("_seen_key"))
    joined = events.join(changes, "id", "left").join(seen, "id", "left")
    updated = F.col("_updated").isNotNull()
    sighted = updated | F.col("_seen_key").isNotNull()
    content = respect_locks(_content(lambda c: F.col(f"_new_{c}")))
    content["slug"] = F.when(locked("title") & (F.coalesce("slug", F.lit("")) != ""), F.col("slug")).otherwise(content["slug"])
    content["summary"] = F.when(F.col("_new_new_text") & ~locked("description"), F.lit(None).cast("string")).otherwise(F.col("summary"))
    values = {c: F.when(updated, v).otherwise(F.col(c)) for c, v in content.items()}
    values["dedup_key"] = F.coalesce(F.col("_new_dedup_key"), F.col("_seen_key"), F.col("dedup_key"))
    values["last_seen_at"] = F.when(sighted, as_ntz(now)).otherwise(F.col("last_seen_at"))
    values["status"], values["pruned_at"] = republish(sighted)
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS])


def republish(sighted: Column) -> tuple[Column, Column]:
    """A row hidden by the prune pass returns when seen again; the marker is cleared either way."""
    lifted = sighted & F.col("pruned_at").isNotNull()
    status = F.when(lifted & (F.col("status") == "hidden"), "published").otherwise(F.col("status"))
    return status, F.when(lifted, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("pruned_at"))


def _insert(created: DataFrame, now: str) -> DataFrame:
    values = _content(F.col)
    values |= {
        "id": F.col("id"), "source_id": F.col("source_id"), "summary": F.lit(None).cast("string"), "duplicate_of": F.col("duplicate_of"),
        "status": F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("published"), "pruned_at": F.lit(None).cast("timestamp_ntz"),
        "locked_fields": F.array().cast("array<string>"), "first_seen_at": as_ntz(now), "last_seen_at": as_ntz(now),
    }
    return created.select(*[values[c].alias(c) for c in EVENT_COLUMNS])


def _rewrite_categories(events, event_categories, updates, created, categories, decisions) -> DataFrame:
    """Categories of created events, and of updated ones that are neither pinned nor already decided."""
    pinned = events.filter(locked("categories")).select(F.col("id").alias("matched_id"))
    applied = decisions.filter(F.col("status") == "applied").select(F.col("event_id").alias("matched_id"))
    open_rows = updates.join(pinned, "matched_id", "left_anti").join(applied, "matched_id", "left_anti")
    open_rows = open_rows.select(F.col("matched_id").alias("event_id"), "category_slugs")
    slugs = open_rows.unionByName(created.select(F.col("id").alias("event_id"), "category_slugs")).select("event_id", F.explode("category_slugs").alias("slug"))
    fresh = slugs.join(categories.select(F.col("id").alias("category_id"), "slug"), "slug").select("event_id", "category_id")
    return event_categories.join(open_rows.select("event_id"), "event_id", "left_anti").unionByName(fresh)


def manual_incoming(rows: DataFrame) -> DataFrame:
    """Hand-entered rows (text dates, ISO or German) in import shape; rows without a usable start drop out."""
    given = lambda c: blank_to_null(trim_edges(F.coalesce(F.col(c), F.lit(""))))
    start = manual_moment(F.col("date"), F.col("time"))
    has_end = given("end_date").isNotNull() | given("end_time").isNotNull()
    end = F.when(has_end, manual_moment(F.coalesce(given("end_date"), F.col("date")), F.col("end_time")))
    timed = rows.withColumns({"starts_at": start, "ends_at": end}).filter(F.col("starts_at").isNotNull() & (~has_end | F.col("ends_at").isNotNull()))
    tail = F.left(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", ""), F.lit(40))
    null = F.lit(None).cast("string")
    out = {
        "ends_at": F.when(F.col("ends_at") > F.col("starts_at"), F.col("ends_at")), "all_day": given("time").isNull(),
        "venue_name": given("location"), "location_text": given("location"), "category_slugs": F.array_compact(F.array(given("category"))),
        "source_url": given("url"), "image_url": null, "description": given("description"), "city": given("city"), "price": given("price"),
        "organizer": given("organizer"), "external_id": F.concat(F.lit("manual:"), F.date_format("starts_at", "yyyy-MM-dd"), F.lit("-"), tail),
        "raw": F.lit('{"manual":true}'), "is_course": F.lit(False), "booking_status": null,
    }
    return timed.select(*[out.get(c, F.col(c)).alias(c) for c in INCOMING_COLUMNS])


def apply_corrections(events: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited fields and pins over events. Blank title keeps the old one; other blanks clear; dates
    only where a start is given; a changed description clears the summary."""
    delta = edits.select("id", F.struct(*[c for c in edits.columns if c != "id"]).alias("_e"))
    e = lambda c: F.col("_e")[c]
    touched = F.col("_e").isNotNull()
    text = lambda c: blank_to_null(cap(trim_edges(F.coalesce(e(c), F.lit(""))), c) if c in CAPS else trim_edges(F.coalesce(e(c), F.lit(""))))
    dated = touched & e("starts_at").isNotNull()
    pick = lambda cond, new, old: F.when(cond, new).otherwise(F.col(old)).alias(old)
    values = {
        "title": pick(touched, F.coalesce(text("title"), F.col("title")), "title"),
        "organizer": pick(touched, text("organizer"), "organizer"), "description": pick(touched, text("description"), "description"),
        "image_url": pick(touched, text("image_url"), "image_url"),
        "summary": pick(touched & ~text("description").eqNullSafe(F.col("description")), F.lit(None).cast("string"), "summary"),
        "starts_at": pick(dated, e("starts_at"), "starts_at"), "ends_at": pick(dated, e("ends_at"), "ends_at"),
        "all_day": pick(dated, e("all_day"), "all_day"), "locked_fields": pick(touched, e("locked_fields"), "locked_fields"),
    }
    return events.join(delta, "id", "left").select(*[values.get(c, F.col(c)) for c in events.columns])


def backfill_keys(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Recomputed cross-source keys. The place is the first candidate that reproduces the stored key
    under the earlier rule (day only, no transliteration); only changed rows are returned."""
    venue = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("_name"), F.col("city").alias("_city"))
    rows = events.select("id", "title", "starts_at", "all_day", "dedup_key", "location_text", "venue_id").join(venue, "venue_id", "left")
    head = F.concat_ws("|", keys.strip_to_ascii(keys.undecorated_title(F.col("title"))), F.date_format("starts_at", "yyyy-MM-dd"))
    earlier = lambda place: F.left(F.concat_ws("|", head, keys.strip_to_ascii(place)), F.lit(CAPS["dedup_key"]))
    candidates = F.array_compact(F.array("_city", "_name", "location_text", F.lit("")))
    hit = F.get(F.filter(candidates, lambda p: earlier(p) == F.col("dedup_key")), F.lit(0))
    place = F.coalesce(hit, "_city", "location_text", F.lit(""))
    fresh = keys.dedup_key(F.col("title"), F.col("starts_at"), F.col("all_day"), place)
    return rows.withColumn("new_key", fresh).filter(F.col("new_key") != F.col("dedup_key")).select("id", "dedup_key", "new_key")
