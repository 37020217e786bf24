"""Table schemas as DDL strings, in the column order the operators emit."""

#: ``position``: place of a body among all bodies; rows of one body follow it, so leave room between two
BODIES = "source_id long, url string, fetched_at timestamp_ntz, position long, body string"

INCOMING = (
    "source_id long, position long, title string, starts_at timestamp_ntz, ends_at timestamp_ntz, "
    "all_day boolean, description string, venue_name string, city string, location_text string, "
    "category_slugs array<string>, source_url string, image_url string, price string, organizer string, "
    "external_id string, raw string, is_course boolean, booking_status string"
)
INCOMING_COLUMNS = [part.split()[0] for part in INCOMING.split(", ")]

EVENTS = (
    "id long, title string, slug string, description string, summary string, starts_at timestamp_ntz, "
    "ends_at timestamp_ntz, all_day boolean, venue_id long, location_text string, region_id long, "
    "source_id long, source_url string, image_url string, price string, organizer string, "
    "external_id string, content_hash string, dedup_key string, duplicate_of long, status string, "
    "pruned_at timestamp_ntz, is_course boolean, booking_status string, raw string, "
    "locked_fields array<string>, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
)
EVENT_COLUMNS = [part.split()[0] for part in EVENTS.split(", ")]

VENUES = (
    "id long, region_id long, name string, street string, postal_code string, city string, "
    "latitude double, longitude double, website string, dedup_key string"
)
SOURCES = (
    "id long, region_id long, key string, name string, type string, url string, importer string, "
    "enabled boolean, facts_only boolean, approved_at timestamp_ntz, config map<string,string>, "
    "last_run_at timestamp_ntz, last_status string"
)
REGIONS = (
    "id long, key string, site_name string, area_name string, canonical_host string, default_city string, "
    "host_aliases array<string>, cities array<string>, city_aliases map<string,string>, enabled boolean"
)
CATEGORIES = "id long, slug string, name string, sort_order int"
EVENT_CATEGORIES = "event_id long, category_id long"
IMPORT_RUNS = (
    "id long, source_id long, started_at timestamp_ntz, finished_at timestamp_ntz, duration_ms long, "
    "status string, seen long, created long, updated long, unchanged long, duplicates long, errors long, "
    "dry_run boolean, message string"
)
DEDUP_DECISIONS = (
    "id long, day date, duplicate_event_id long, canonical_event_id long, reason string, model string, "
    "active boolean, undone_by_admin_at timestamp_ntz, created_at timestamp_ntz"
)
DEDUP_DAYS = "region_id long, day date, fingerprint string, reviewed_at timestamp_ntz"
CATEGORY_DECISIONS = (
    "id long, event_id long, mode string, status string, previous_slugs array<string>, "
    "proposed_slugs array<string>, reason string, model string, created_at timestamp_ntz, reviewed_at timestamp_ntz"
)
CONTACT_MESSAGES = (
    "id long, name string, email string, message string, created_at timestamp_ntz, spam boolean, "
    "spam_reason string, seen boolean"
)
VISITS = (
    "ts timestamp_ntz, host string, route string, event_id long, method string, status int, "
    "content_type string, client_ip string, user_agent string"
)

#: stored tables by name
TABLES = {
    "events": EVENTS, "venues": VENUES, "sources": SOURCES, "regions": REGIONS, "categories": CATEGORIES, "event_categories": EVENT_CATEGORIES,
    "import_runs": IMPORT_RUNS, "dedup_decisions": DEDUP_DECISIONS, "dedup_days": DEDUP_DAYS, "category_decisions": CATEGORY_DECISIONS,
    "contact_messages": CONTACT_MESSAGES,
}

# Widths of the stored columns.
CAPS = {
    "title": 300, "location_text": 255, "source_url": 1024, "image_url": 1024, "price": 120,
    "organizer": 200, "external_id": 191, "dedup_key": 191, "slug": 300,
}
VENUE_NAME_CAP, VENUE_CITY_CAP, VENUE_KEY_CAP = 200, 120, 200

# The event category slugs, in listing order.
CATEGORY_SLUGS = ["musik", "party", "buehne", "kino", "kunst", "familie", "sport", "markt", "genuss", "bildung", "sonstiges"]
CATCH_ALL = "sonstiges"
