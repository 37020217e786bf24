"""Extraction, expression, dimension, export and streaming queries with their SQL twins. Feed bodies
are built from the given tables, so the expected rows follow from the same tables in SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from kalendarium.catalog.health import _VIS, DEFAULT_REGION, PV, SECRET
from kalendarium.catalog.listing import _enriched, _q, _shown, _visible
from kalendarium.catalog.sql import T_NOW, canonical_city, iso, norm, norm_title, relevant, utc, with_tables
from kalendarium.catalog.tables import NOW, Tables, every
from kalendarium.functions import classify as K
from kalendarium.functions import dates as D
from kalendarium.functions import keys
from kalendarium.functions.dates import MONTH_NAMES, WEEKDAY_NAMES
from kalendarium.functions.text import prompt_line
from kalendarium.functions.times import berlin_wall, display_end, ts, utc_wall
from kalendarium.operators import dims
from kalendarium.operators import listing as L
from kalendarium.operators import places as P
from kalendarium.operators import visits as V
from kalendarium.operators.review import display_location
from kalendarium.session import checkpoint_dir
from kalendarium.sinks import exports as X
from kalendarium.sources import feeds, ics, jsonld, pages, payloads
from kalendarium.sources.state import current
from kalendarium.sources.tables import read_table, write_snapshot
from kalendarium.streaming import imports
from kalendarium.streaming import visits as SV

#: sources that send something unreadable, and nothing, to the incremental import
FAILING, EMPTY = 25, 26

def _id():
    return F.col("id")


_s = lambda c: c.cast("string")
_LATER = "INTERVAL 20 YEAR"


# ---- bodies built from the tables --------------------------------------------------------------

def _ics_bodies(t: Tables):
    start, end, d = F.col("starts_at"), F.col("ends_at"), "yyyyMMdd"
    stamp = "yyyyMMdd'T'HHmmss"
    line = lambda name, value: F.concat(F.lit(name), value, F.lit("\r\n"))
    opt = lambda cond, text: F.when(cond, text).otherwise("")
    began = (
        F.when(F.col("all_day"), line("DTSTART;VALUE=DATE:", F.date_format(start, d)))
        .when(every(4, 1), line("DTSTART:", F.concat(F.date_format(utc_wall(start), stamp), F.lit("Z"))))
        .when(every(4, 2), line("DTSTART;TZID=America/New_York:", F.date_format(F.convert_timezone(F.lit("Europe/Berlin"), F.lit("America/New_York"), start), stamp)))
        .when(every(8, 3), line("DTSTART;TZID=UTC:", F.date_format(utc_wall(start), stamp)))
        .when(every(16, 7), line("DTSTART;TZID=Nirgendwo/Unbekannt:", F.date_format(start, stamp)))
        .otherwise(line("DTSTART:", F.date_format(start, stamp)))
    )
    ended = F.when(F.col("all_day"), line("DTEND:", F.date_format(end + F.expr("INTERVAL 1 DAY"), d))).otherwise(line("DTEND;TZID=Europe/Berlin:", F.date_format(end, stamp)))
    text = F.concat(
        F.lit("BEGIN:VEVENT\r\n"), line("UID:ext-", _s(_id())), line("SUMMARY:", F.col("title")), began, F.coalesce(ended, F.lit("")),
        opt(every(5), F.lit("BEGIN:VALARM\r\nDESCRIPTION:Alarm\r\nSUMMARY:Alarm\r\nEND:VALARM\r\n")),
        F.coalesce(line("DESCRIPTION:", F.concat(F.lit("Gruß\\, "), F.lit("\r\n "), F.col("description"))), F.lit("")), F.coalesce(line("LOCATION:", F.col("venue_name")), F.lit("")),
        opt(every(23), F.lit("STATUS:CANCELLED\r\n")), opt(every(6), F.lit("CATEGORIES:Musik\r\n")), F.lit("CLASS:PUBLIC\r\nEND:VEVENT\r\n"),
    )
    return t.bodies(text, "BEGIN:VCALENDAR\r\n", "END:VCALENDAR\r\n")


def _feed_bodies(t: Tables):
    at = F.col("starts_at") + F.expr(_LATER)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(at))
    labelled = F.concat(F.lit("Datum: "), F.date_format(at, "dd.MM.yy, HH:mm"), F.lit(" - "), F.date_format(at, "dd.MM.yyyy"), F.lit(", 23:30<br>Veranstaltungsort: Haus-"), _s(_id() % 7), F.lit(" | Stadt"))
    numeric = F.concat(F.lit("am "), F.date_format(at, "d.M.yyyy"), F.lit(" um "), F.date_format(at, "HH:mm"), F.lit(" Uhr"))
    spelled = F.concat(F.lit("am "), F.date_format(at, "d"), F.lit(". "), month, F.lit(" "), F.date_format(at, "yyyy"), F.lit(" ab "), F.date_format(at, "H"), F.lit(" Uhr"))
    text = F.when(every(4), labelled).when(every(4, 1), numeric).when(every(4, 2), spelled).otherwise("ohne Datum")
    item = F.concat(
        F.lit("<item><title>"), "title", F.when(every(4), " - 01.02.2026, 19:30").otherwise(""), F.lit("</title><link>"), F.coalesce("source_url", F.lit("")), F.lit("</link><category>Fest</category><description><![CDATA[<p>"), text,
        F.lit('</p><img src="../bild/'), _s(_id()), F.lit('.jpg">]]></description><pubDate>'), F.date_format(utc_wall(at), "dd"), F.lit(" "),
        F.element_at(F.array(*[F.lit(m) for m in feeds.MAIL_MONTHS]), F.month(utc_wall(at))), F.date_format(utc_wall(at), " yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"),
    )
    bodies = t.bodies(item, "<rss version=\"2.0\"><channel>", "</channel></rss>")
    return bodies.withColumn("body", F.when(F.col("chunk") % 7 == 3, "<html><body><p>Wartung</body></html>").otherwise(F.col("body")))


def _jsonld_bodies(t: Tables):
    when = lambda c: F.when(F.col("all_day"), F.date_format(c, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(utc_wall(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    address = F.struct(F.lit("Weg 1").alias("streetAddress"), F.lit("33330").alias("postalCode"), F.col("city").alias("addressLocality"))
    node = F.struct(
        F.when(every(3), F.lit("MusicEvent")).otherwise(F.lit("Event")).alias("@type"), F.concat("title", F.lit(" &amp; mehr")).alias("name"), when("starts_at").alias("startDate"), when("ends_at").alias("endDate"),
        F.struct(F.col("venue_name").alias("name"), address.alias("address")).alias("location"), F.col("source_url").alias("url"),
        F.array(F.struct(_s((_id() % 50) * 10).alias("price"), F.lit("EUR").alias("priceCurrency"))).alias("offers"), F.lit("/img/a.jpg").alias("image"),
        F.struct(F.col("organizer").alias("name")).alias("organizer"),
    )
    return t.bodies(F.to_json(node), '<html><script type="application/ld+json">{"@graph":[', ',{"@type":"Organization","name":"x"},]}</script></html>', ",")


def _plugin_bodies(t: Tables):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    node = F.struct(
        _s(_id()).alias("id"), F.concat("title", F.lit(" &#8211; live")).alias("title"), stamp("starts_at").alias("start_date"), stamp("ends_at").alias("end_date"), "all_day",
        F.concat(F.lit("<p>"), F.coalesce("description", F.lit("")), F.lit("</p>")).alias("description"), F.struct(F.col("venue_name").alias("venue"), "city").alias("venue"),
        F.transform("category_slugs", lambda c: F.struct(F.concat(F.lit("Große "), c).alias("name"), c.alias("slug"))).alias("categories"), F.col("source_url").alias("url"), F.col("price").alias("cost"),
    )
    return t.bodies(F.to_json(node), '{"events":[', "]}", ",")


def _item_bodies(t: Tables):
    stamp = lambda d: F.date_format(F.col("starts_at") + F.make_dt_interval(days=F.lit(d)), "yyyy-MM-dd'T'HH:mm:ss")
    node = F.struct(
        _s(_id()).alias("id"), F.concat("title", F.lit(" - ")).alias("title"), F.col("venue_name").alias("name"), F.when(every(8), F.lit("Tö? 44a")).otherwise(F.lit("Neustadt")).alias("city"),
        F.array(F.lit("Kino"), F.lit("Konzert")).alias("categories"),
        F.array(F.struct(F.lit("teaser").alias("rel"), F.lit("text/plain").alias("type"), F.lit("kurz").alias("value")), F.struct(F.lit("details").alias("rel"), F.lit("text/html").alias("type"), F.lit("<b>lang</b>").alias("value"))).alias("texts"),
        F.array(*[F.struct(stamp(d).alias("start")) for d in (0, 7, 7, 14)]).alias("timeIntervals"),
    )
    return t.bodies(F.to_json(node), '{"items":[', "]}", ",")


def _flat_bodies(t: Tables):
    node = F.struct(
        _s(_id()).alias("uid"), "title", F.lit("Die").alias("titlePrefix"), every(3).alias("showTitlePrefix"), F.date_format("starts_at", "d.M.yyyy").alias("date"), F.when(~F.col("all_day"), F.date_format("starts_at", "HH:mm")).alias("time"),
        F.date_format("ends_at", "dd.MM.yyyy").alias("enddate"), F.date_format("ends_at", "HH:mm").alias("endtime"), F.concat(F.lit("/d/"), _s(_id())).alias("detail"), (_id() % 3).alias("category_uid"),
    )
    return t.bodies(F.to_json(node), '{"categories":[{"uid":1,"title":"Konzert"},{"uid":2,"title":"Ball &amp; Tanz"}],"events":[', "]}", ",")


def _micro_bodies(t: Tables):
    text = F.concat(
        F.lit('<div class="row"><h3 itemprop="name">'), "title", F.lit('</h3><meta itemprop="startDate" content="'), F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm"), F.lit('">'),
        F.when(F.col("ends_at").isNotNull(), F.concat(F.lit('<meta content="'), F.date_format("ends_at", "yyyy-MM-dd'T'HH:mm"), F.lit('" itemprop="endDate">'))).otherwise(""),
        F.lit('<a itemprop="url" href="/e/'), _s(_id()), F.lit('">x</a></div>'),
    )
    return t.bodies(text, "<html>", "</html>")


def _marked_pages(t: Tables):
    """Pages with an image and a small dated table appended."""
    p = F.col("page_id")
    row = lambda n: F.concat(F.lit("<tr><td>0"), _s(p % 9 + 1), F.lit(f".0{n}.2026</td><td>"), F.when(p % 3 != n % 3, F.concat(F.lit('<a href="/t/'), _s(p), F.lit(f'-{n}">Abend &amp; <b>Fest</b></a>'))).otherwise(F.lit("Vorstand")), F.lit("</td></tr>"))
    image = F.when(p % 4 == 0, "//cdn.example/a.png").when(p % 4 == 1, "../b/./c.png").when(p % 4 == 2, "data:image/png;base64,x").otherwise("/d.png")
    return t.scan("pages").withColumn("html", F.concat(F.regexp_replace("html", r"(?is)<(img|tr|td)\b[^>]*>", ""), F.lit("<table><tr><th>Datum</th><th>Was</th></tr>"), row(1), row(2), row(3), F.lit('</table><img alt="x" src="'), image, F.lit('">')))


def _german_rows(t: Tables):
    """Order dates as people write them."""
    at = F.col("starts_at")
    year = F.when(every(3), F.date_format(at, "yy")).otherwise(F.date_format(at, "yyyy"))
    date = F.when(every(97), F.concat(F.lit("31.06."), year)).otherwise(F.concat(F.date_format(at, "dd.MM."), year))
    clock = F.when(every(4), "").when(every(4, 1), F.date_format(at, "', 'HH.mm 'Uhr'")).otherwise(F.date_format(at, "', 'HH:mm"))
    return t.occurrences.select("id", "starts_at", "ends_at", F.concat(F.lit("Mi. "), date, clock).alias("text"))


def _texts(t: Tables):
    return t.scan("documents").select("doc_id", F.col("text").alias("title"), "source", F.col("doc_id").alias("n"))


WORDS = [
    "Fast ausgebucht!", "ist AUSGEBUCHT", "Fällt aus: abgesagt", "Warteliste", "noch Plätze frei", "bereits beendet", "nur wenige Plätze", "entfällt", "siehe Text", "12,50 €",
    "Eintritt frei", "ab 7.5 EUR", "1.200 Euro", "Ehrenamtstag der AG", "Vorstand intern", "Seminar Gitarre", "Chor und Tanz", "Kinder kochen",
]


def _status_rows(t: Tables):
    return t.occurrences.select("id", F.element_at(F.array(*[F.lit(w) for w in WORDS]), (_id() % len(WORDS) + 1).cast("int")).alias("text"), "category_slugs")


def _folder(t: Tables) -> str:
    return f"{checkpoint_dir(t.spark)}/drained-{uuid.uuid4().hex}"


def _visit_stream(t: Tables):
    """The events table read as a stream, in visit shape."""
    stream = Tables(t.spark, t.sf_dir)
    schema = t.scan("events").schema
    scan = stream.scan
    stream.scan = lambda name: t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}.parquet*") if name == "events" else scan(name)
    return V.prepared(stream.visits, t.regions, DEFAULT_REGION, SECRET)


def _late_arrivals(t: Tables, folder: str) -> None:
    """The visits in three arrivals, counted after each: two thirds of them, a sixth, the rest. The later
    arrivals spread over all days, so most of what the third brings is beyond the watermark."""
    drop = f"{folder}/arrived"
    rows, turn = t.visits, F.pmod(F.xxhash64("ts", "client_ip"), F.lit(6))
    for share in (turn < 4, turn == 4, turn == 5):
        rows.filter(share).write.mode("append").parquet(drop)
        stream = t.spark.readStream.schema(rows.schema).parquet(drop)
        late = SV.views_with_late(V.prepared(stream, t.regions, DEFAULT_REGION, SECRET), "region_id", "route")
        SV.late_log(late, folder, "region_id", "route").awaitTermination()


def _views_with_late(t: Tables):
    folder = _folder(t)
    _late_arrivals(t, folder)
    return SV.all_views(t.spark, folder, "region_id", "route")


def _in(df, *cols):
    return df.select("source_id", *cols)


def _label_now():
    return ts("1998-06-03 12:00:00")


def _seed(t: Tables):
    """Definitions for every other source plus new ones, over the current sources."""
    n = F.col("id")
    defs = t.sources.filter(n % 2 == 0).select("region_id", "key", F.concat(F.lit("Neu "), "name").alias("name"), "type", "url", F.lit("rss").alias("importer"), F.lit(True).alias("enabled"), F.create_map(F.lit("city"), F.lit("X"), F.lit("neu"), F.lit("1")).alias("config"))
    fresh = t.sources.select("region_id", F.concat("key", F.lit("_b")).alias("key"), "name", "type", "url", "importer", F.lit(False).alias("enabled"), "config")
    return dims.seed_dimension(t.sources, defs.unionByName(fresh), ["region_id", "key"], keep=["enabled"], merge=["config"], forced={"facts_only": F.coalesce("facts_only", F.lit(False)) | (F.col("key") == "nation_6")})


def _patched(t: Tables):
    patches = t.sources.filter(F.col("id") % 3 == 0).select("id", F.concat(F.lit('{"city":"Y","max":"'), _s(F.col("id")), F.lit('"}')).alias("patch"))
    return dims.patch_config(t.sources, patches)


def _match_rows(t: Tables):
    i = F.col("position")
    rows = t.incoming.join(t.sources.select(F.col("id").alias("source_id"), "region_id"), "source_id")
    return rows.select("position", "region_id", "title", "venue_name", F.when(i % 5 == 0, F.concat(F.lit("bei "), "city")).otherwise("").alias("address"),
                       F.when(i % 5 < 3, "").otherwise(F.col("city")).alias("city"), F.when(i % 11 == 1, "33 330").otherwise("x").alias("zip"))


def _ics_rows(t: Tables):
    return ics.extract_ics(_ics_bodies(t), t.sources)


def _categories_named(t: Tables):
    rows = X.with_host(_shown(t), t.regions)
    return L.with_categories(rows, t.event_categories, t.categories).withColumn("category_names", F.coalesce("category_slugs", F.array().cast("array<string>")))


def _calendar_files(t: Tables):
    """All visible events as calendar files of a hundred entries, read back."""
    path = _folder(t)
    X.export_ics(_categories_named(t), path, 100)
    return X.read_ics(t.spark, path)


def _snapshot(t: Tables):
    root = _folder(t)
    write_snapshot(t.events, root, "events", 1)
    return read_table(t.spark, root, "events", 1)


def _incremental_import(t: Tables):
    """Bodies arrive as a stream in two batches: calendars of all sources, and of two sources more an empty calendar
    and a feed that can't be read; then every second calendar again and an event no table can hold. The run rows."""
    root, spark = _folder(t), t.spark
    importer = F.when(F.col("id") == FAILING, "rss").otherwise(F.col("importer"))
    more = t.sources.filter("id in (1, 2)").withColumns({"id": F.col("id") + 24, "key": F.concat(F.lit("mehr-"), "key")})
    start = {"sources": t.sources.unionByName(more).withColumn("importer", importer), "regions": t.regions, "categories": t.categories}
    current(spark, root).commit("start", start)
    calendars = _ics_bodies(t)
    odd = "source_id long, url string, fetched_at timestamp_ntz, position long, body string"
    at = dt.datetime.fromisoformat(NOW)
    rest = [(FAILING, "https://host.example/weg", at, 0, "<html>weg"), (EMPTY, "https://host.example/leer", at, 1, "BEGIN:VCALENDAR\r\nEND:VCALENDAR\r\n")]
    old = (EMPTY, "https://host.example/alt", at, 2, "BEGIN:VEVENT\nSUMMARY:Alt\nUID:alt\nDTSTART:09990101T100000\nEND:VEVENT")
    batches = [
        calendars.drop("chunk").unionByName(spark.createDataFrame(rest, odd)),
        calendars.filter("chunk % 2 = 0").drop("chunk").unionByName(spark.createDataFrame([old], odd)),
    ]
    for bodies in batches:
        bodies.write.mode("append").parquet(f"{root}/bodies")
        stream = spark.readStream.schema(batches[0].schema).parquet(f"{root}/bodies")
        imports.stream_import(stream, root, f"{root}/progress", NOW, ["ics", "rss"]).awaitTermination()
    step = F.floor(F.col("id") / imports.SOURCES_PER_STEP).alias("step")
    return current(spark, root).read("import_runs").select(step, "source_id", "status", "seen", "created", "updated", "unchanged", "duplicates", "errors")


QUERIES = {
    "snapshot_roundtrip": _q(lambda t: _snapshot(t).select("id", "region_id", "title", "starts_at", "status", F.array_join("locked_fields", ",").alias("locks"))),
    "incremental_import": _q(_incremental_import),
    "extract_ics": _q(lambda t: _in(_ics_rows(t), "external_id", "title", "starts_at", "ends_at", "all_day", "description", "venue_name", "city", F.array_join("category_slugs", ",").alias("slugs"), "booking_status")),
    "extract_feed": _q(lambda t: _in(feeds.extract_feed_items(_feed_bodies(t), t.sources)[0], "title", "starts_at", "ends_at", "venue_name", "image_url", "source_url", F.array_join("category_slugs", ",").alias("slugs"))),
    "extract_feed_errors": _q(lambda t: _in(feeds.extract_feed_items(_feed_bodies(t), t.sources)[1], "url")),
    "extract_jsonld": _q(lambda t: _in(jsonld.extract_jsonld(_jsonld_bodies(t), t.sources), "title", "starts_at", "ends_at", "all_day", "venue_name", "city", "location_text", "price", "image_url", "organizer", "source_url")),
    "extract_plugin": _q(lambda t: _in(payloads.extract_tribe(_plugin_bodies(t), t.sources), "external_id", "title", "starts_at", "ends_at", "all_day", "description", "venue_name", "city", "price", F.array_join("category_slugs", ",").alias("slugs"))),
    "extract_intervals": _q(lambda t: _in(payloads.extract_intervals(_item_bodies(t), t.sources, NOW), "external_id", "title", "starts_at", "all_day", "description", "city", "venue_name", F.array_join("category_slugs", ",").alias("slugs"))),
    "extract_flat_json": _q(lambda t: _in(payloads.extract_flat_json(_flat_bodies(t), t.sources), "external_id", "title", "starts_at", "ends_at", "all_day", "source_url", F.array_join("category_slugs", ",").alias("slugs"))),
    "extract_microdata": _q(lambda t: _in(pages.extract_microdata(_micro_bodies(t), t.sources, '<div class="row">'), "title", "starts_at", "ends_at", "source_url")),
    "table_rows": _q(lambda t: pages.extract_table_rows(_marked_pages(t)).select("page_id", "row_no", "link", F.array_join("cells", "|").alias("cells"))),
    "discover_links": _q(lambda t: pages.discover_links(t.scan("pages"), r"^/[a-z]")),
    "page_text": _q(lambda t: pages.page_text(t.scan("pages"))),
    "lead_image": _q(lambda t: pages.lead_images(_marked_pages(t))),
    "seed_dimension": _q(lambda t: _seed(t).select("region_id", "key", "name", "importer", "enabled", "facts_only", F.col("config")["city"].alias("config_city"), F.col("config")["category"].alias("config_category"), F.col("config")["neu"].alias("config_neu"))),
    "patch_config": _q(lambda t: _patched(t).select("id", F.col("config")["city"].alias("config_city"), F.col("config")["max"].alias("config_max"), F.col("config")["category"].alias("config_category"))),
    "calendar_export": _q(lambda t: X.calendar_entries(_categories_named(t)).select("id", "entry")),
    "calendar_files": _q(_calendar_files),
    "sitemap_export": _q(lambda t: X.sitemap_entries(_visible(t), t.regions, NOW)),
    "schema_org_export": _q(lambda t: X.schema_org(X.with_host(_shown(t), t.regions)).select("id", *[F.get_json_object("json", f"$.{p}").alias(a) for a, p in (
        ("name", "name"), ("start", "startDate"), ("finish", "endDate"), ("state", "eventStatus"), ("place", "location.name"), ("organizer", "organizer.name"), ("home", "organizer.url"),
        ("availability", "offers.availability"), ("price", "offers.price"), ("image", "image"), ("description", "description"))])),
    "region_match": _q(lambda t: P.region_match(_match_rows(t), t.regions, F.array(F.lit("333"))).select("position", "matched_city")),
    "drop_marked": _q(lambda t: K.drop_marked(_status_rows(t), "text").select("id", "text")),
    "drop_past": _q(lambda t: K.drop_past(t.occurrences, NOW, "end").select("id")),
    "mask_rights": _q(lambda t: dims.mask_rights(_enriched(t)).select("id", "description", "summary", "image_url")),
    "display_columns": _q(lambda t: _enriched(t).select("id", display_location().alias("place"), dims.full_address().alias("address"), display_end(F.col("starts_at"), F.col("ends_at"), F.col("all_day")).alias("shown_end"))),
    "booking_status": _q(lambda t: _status_rows(t).select("id", K.booking_status(F.col("text")).alias("state"))),
    "price_amount": _q(lambda t: _status_rows(t).select("id", K.price_amount(F.col("text")).alias("amount"))),
    "keyword_category": _q(lambda t: _status_rows(t).select("id", K.first_group(F.col("text"), K.COURSE_CATEGORIES, F.lit("bildung")).alias("slug"))),
    "course_flag": _q(lambda t: _status_rows(t).select("id", K.is_course(F.col("text"), F.col("category_slugs")).alias("course"))),
    "normalize_text": _q(lambda t: _texts(t).select("doc_id", keys.normalize(F.col("title")).alias("plain"), keys.normalize_title(F.col("title")).alias("title_key"), keys.strip_to_ascii(F.col("title")).alias("venue_form"))),
    "content_hash": _q(lambda t: t.events.select("id", "content_hash", "slug", "dedup_key")),
    "location_tokens": _q(lambda t: _texts(t).select("doc_id", F.array_join(keys.location_tokens(F.col("title")), " ").alias("tokens"))),
    "prompt_text": _q(lambda t: t.scan("pages").select("page_id", prompt_line(F.col("html")).alias("line"))),
    "berlin_wall": _q(lambda t: t.scan("events").select("event_id", berlin_wall(F.col("ts"), "UTC").alias("wall"))),
    "course_date": _q(lambda t: _german_rows(t).select("id", D.course_date(F.col("text")).alias("at"))),
    "german_dates": _q(lambda t: _german_rows(t).select("id", D.german_dates(F.col("text"))["start"].alias("at"))),
    "infer_year": _q(lambda t: _german_rows(t).select(
        "id", D.next_year_if_past(F.dayofmonth("starts_at"), F.month("starts_at"), _label_now(), 1).alias("a"), D.next_year_if_past(F.dayofmonth("starts_at"), F.month("starts_at"), _label_now(), 7, True).alias("b"),
        D.roll_at_year_end(F.dayofmonth("starts_at"), F.month("starts_at"), _label_now()).alias("c"), D.nearest_year(F.dayofmonth("starts_at"), F.month("starts_at"), (_id() % 7 + 1).cast("int"), _label_now()).alias("d"))),
    "date_range": _q(lambda t: t.occurrences.select("id", D.date_range(
        F.date_format("starts_at", "dd.MM.yyyy"), F.when(~F.col("all_day"), F.date_format("starts_at", "HH:mm")), F.when(every(2), F.date_format(F.coalesce("ends_at", "starts_at"), "d.M.yyyy")),
        F.when(every(3, 1), F.date_format("ends_at", "HH:mm"))).alias("r")).select("id", "r.*")),
    "day_label": _q(lambda t: t.occurrences.select("id", D.day_label(F.col("starts_at"), _label_now()).alias("label"))),
    "year_segments": _q(lambda t: pages.year_segments(t.occurrences.select(F.col("id").alias("page_id"), F.concat(
        F.lit("Vorwort 1.1. Termine 2026 am "), F.date_format("starts_at", "d.M."), F.lit(" und 7.8. Termine"), F.when(every(2), " ").otherwise("  "), F.lit("2027: "), F.date_format("starts_at", "dd.MM.")).alias("text")))),
    "slug_union": _q(lambda t: t.occurrences.select("id", F.array_join(keys.all_slugs(F.array(F.lit("musik"), F.lit("")), F.col("category_slugs")), ",").alias("slugs"))),
    "stream_views": _q(lambda t: SV.current(SV.drain(SV.stream_views(_visit_stream(t)), _folder(t)), ["region_id", "route"])),
    "stream_views_with_late": _q(_views_with_late),
    "stream_event_views": _q(lambda t: SV.current(SV.drain(SV.stream_event_views(_visit_stream(t)), _folder(t)), ["event_id"])),
    "stream_visitors": _q(lambda t: SV.drain(SV.stream_visitors(_visit_stream(t)), _folder(t), "append").groupBy("region_id", "day").agg(F.count(F.lit(1)).alias("visitors"))),
}

# ---- the same in SQL ---------------------------------------------------------------------------

_L = "starts_at + INTERVAL 20 YEAR"


_W = f"SELECT id, category_slugs, ({WORDS!r})[id % {len(WORDS)} + 1] AS text FROM occ"


def _regex(words) -> str:
    return "|".join(words)


def _case(groups, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_regex(w)}') THEN '{k}'" for k, w in groups.items()) + f" ELSE {default} END"


_B = r"(^|[^a-zA-Zäöüß0-9_])"
_E = r"($|[^a-zA-Zäöüß0-9_])"
_HTML = "replace(replace(replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_NOTAG = "regexp_replace({}, '(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>', '', 'g')"
_PTEXT = "trim(regexp_replace(regexp_replace(" + _HTML.format(_NOTAG.format("regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(p|div|h[1-6]|li)>', chr(10), 'g')")) + ", '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
_CUR = f"""SELECT e.*, s.facts_only, s.approved_at, s.enabled, s.url AS source_home, s.type, v.name AS venue_name, v.city AS venue_city, v.street, v.postal_code FROM ev e JOIN src s ON s.id = e.source_id LEFT JOIN ven v ON v.id = e.venue_id"""
_PLACE = "CASE WHEN venue_name IS NOT NULL THEN venue_name || ' · ' || venue_city ELSE location_text END"
_ADDR = "concat_ws(', ', street, nullif(trim(concat_ws(' ', postal_code, venue_city)), ''))"
_URL = "'https://' || canonical_host || '/event/' || id || '/' || slug"
_Z = lambda x: f"strftime({utc(x)}, '%Y%m%dT%H%M%SZ')"
_ESC = lambda x: f"replace(replace(replace(replace({x}, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(10), '\\n')"
_MONTHS_SQL = repr(MONTH_NAMES)
_DAYS_SQL = repr(WEEKDAY_NAMES)
_SAFE = "CASE WHEN {m} = 2 AND {d} = 29 AND NOT ({y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0)) THEN NULL ELSE make_timestamp({y}, {m}, {d}, 0, 0, 0) END"


def _at(y: str) -> str:
    return _SAFE.format(y=y, m="m", d="d")


ORACLE = {
    "snapshot_roundtrip": with_tables("ev", "SELECT id, region_id, title, starts_at, status, array_to_string(locked_fields, ',') AS locks FROM ev"),
    "incremental_import": with_tables("occ", f"""SELECT 2 AS step, source_id, 'ok' AS status, count(*) AS seen, count(*) AS created, 0 AS updated, 0 AS unchanged, 0 AS duplicates, 0 AS errors
      FROM occ GROUP BY source_id
      UNION ALL SELECT 3, source_id, 'ok', count(*), 0, 0, count(*), 0, 0 FROM occ WHERE (id // 100) % 2 = 0 GROUP BY source_id
      UNION ALL VALUES (2, {FAILING}, 'failed', 0, 0, 0, 0, 0, 0), (2, {EMPTY}, 'ok', 0, 0, 0, 0, 0, 0), (3, {EMPTY}, 'failed', 1, 0, 0, 0, 0, 1)"""),
    "region_match": with_tables("inc src towns reg", f"""SELECT position, coalesce(CASE WHEN n IN (SELECT name FROM towns t WHERE t.region_id = x.region_id) AND n <> default_city THEN n END,
      CASE WHEN position % 11 = 1 THEN default_city END, (SELECT name FROM towns t WHERE t.region_id = x.region_id AND name <> default_city AND contains({norm('txt')}, t.key) ORDER BY ord LIMIT 1)) AS matched_city
      FROM (SELECT position, s.region_id, default_city, CASE WHEN position % 5 >= 3 THEN {canonical_city('inc.city', 's.region_id')} END AS n,
        concat_ws(' ', title, venue_name, CASE WHEN position % 5 = 0 THEN 'bei ' || city END, CASE WHEN position % 5 >= 3 THEN city END, CASE WHEN position % 11 = 1 THEN '33 330' ELSE 'x' END) AS txt
        FROM inc JOIN src s ON s.id = inc.source_id JOIN reg ON reg.id = s.region_id) x"""),
    "extract_ics": with_tables("occ src", """SELECT source_id, 'ext-' || occ.id AS external_id, title, starts_at, CASE WHEN ends_at > starts_at THEN ends_at END AS ends_at, all_day, 'Gruß, ' || description AS description,
      venue_name, config_city AS city, CASE WHEN occ.id % 6 = 0 THEN 'musik' ELSE 'kunst' END AS slugs, CASE WHEN occ.id % 23 = 0 THEN 'cancelled' END AS booking_status FROM occ JOIN src ON src.id = source_id"""),
    "extract_feed": with_tables("occ", f"""SELECT source_id, title, CASE WHEN id % 4 = 2 THEN date_trunc('hour', {_L}) ELSE {_L} END AS starts_at,
      CASE WHEN id % 4 = 0 AND date_trunc('day', {_L}) + INTERVAL 1410 MINUTE > {_L} THEN date_trunc('day', {_L}) + INTERVAL 1410 MINUTE END AS ends_at,
      CASE WHEN id % 4 = 0 THEN 'Haus ' || (id % 7) END AS venue_name, CASE WHEN source_url IS NULL THEN 'https://host.example/bild/' ELSE regexp_extract(source_url, '^https://[^/]*') || '/bild/' END || id || '.jpg' AS image_url,
      source_url, 'markt' AS slugs FROM occ WHERE (id // 100) % 7 <> 3"""),
    "extract_feed_errors": with_tables("occ", "SELECT DISTINCT source_id, 'https://host.example/feed/' || (id // 100) AS url FROM occ WHERE (id // 100) % 7 = 3"),
    "extract_jsonld": with_tables("occ", f"""SELECT source_id, title, starts_at, ends_at, all_day, venue_name, city, location_text, price, 'https://host.example/img/a.jpg' AS image_url, organizer, source_url FROM (
      SELECT source_id, title || ' & mehr' AS title, starts_at, CASE WHEN ends_at > starts_at THEN ends_at END AS ends_at, all_day, venue_name, city,
        concat_ws(', ', venue_name, 'Weg 1', '33330 ' || city) AS location_text, CASE WHEN id % 50 = 0 THEN 'kostenlos' ELSE ((id % 50) * 10) || ',00 €' END AS price, nullif(organizer, '') AS organizer,
        coalesce(source_url, 'https://host.example/feed/' || (id // 100)) AS source_url, row_number() OVER (PARTITION BY source_id, {norm("p")}, city, CASE WHEN all_day THEN date_trunc('day', starts_at) ELSE starts_at END, all_day ORDER BY id) AS rn
      FROM (SELECT *, regexp_replace(regexp_replace(title || ' & mehr', '\\s+-\\s+.*$', ''), '\\([^)]*\\)', '') AS p FROM occ)) WHERE rn = 1"""),
    "extract_plugin": with_tables("occ", """SELECT source_id, 'tribe-' || id AS external_id, title || ' – live' AS title, starts_at, ends_at, all_day, nullif(description, '') AS description, venue_name, city, price,
      array_to_string(CASE WHEN category_slugs[1] IN ('bildung', 'sonstiges') THEN CASE WHEN len(category_slugs) > 1 THEN ['musik'] ELSE ['sonstiges'] END ELSE category_slugs END, ',') AS slugs FROM occ"""),
    "extract_intervals": with_tables("occ src", f"""SELECT source_id, ':' || o.id || ':' || strftime(s, '%Y-%m-%dT%H:%M') AS external_id, title, s AS starts_at, s = date_trunc('day', s) AS all_day, 'lang' AS description,
      CASE WHEN o.id % 8 = 0 THEN config_city ELSE 'Neustadt' END AS city, venue_name, 'musik' AS slugs FROM (SELECT *, starts_at + to_days(d) AS s FROM occ, (VALUES (0), (7), (14)) AS g(d)) o JOIN src ON src.id = source_id
      WHERE s >= {T_NOW} - INTERVAL 1 DAY"""),
    "extract_flat_json": with_tables("occ", """SELECT source_id, 'flat:' || id || ':' || strftime(starts_at, '%Y-%m-%d %H:%M') AS external_id, CASE WHEN id % 3 = 0 THEN 'Die ' || title ELSE title END AS title, starts_at,
      CASE WHEN ends_at > starts_at THEN ends_at END AS ends_at, all_day, 'https://host.example/d/' || id AS source_url, CASE WHEN id % 3 = 1 THEN 'musik' WHEN id % 3 = 2 THEN 'party' ELSE 'sonstiges' END AS slugs FROM occ"""),
    "extract_microdata": with_tables("occ", "SELECT source_id, title, starts_at, CASE WHEN ends_at > starts_at THEN ends_at END AS ends_at, 'https://host.example/e/' || id AS source_url FROM occ"),
    "table_rows": f"""SELECT page_id, n AS row_no, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/t/' || page_id || '-' || n AS link, '0' || (page_id % 9 + 1) || '.0' || n || '.2026|Abend & Fest' AS cells
      FROM pages, (VALUES (1), (2), (3)) AS g(n) WHERE page_id % 3 <> n % 3""",
    "discover_links": """SELECT page_id, rn - 1 AS pos, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY p) AS rn FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || h AS url, min(p) AS p FROM (
      SELECT page_id, url, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS hs FROM pages)) WHERE regexp_matches(h, '^/[a-z]') GROUP BY ALL))""",
    "page_text": f"""SELECT page_id, text, CASE WHEN length(l) <= 600 THEN nullif(l, '') ELSE rtrim(left(l, 600)) || '…' END AS teaser FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS l FROM (SELECT page_id, {_PTEXT} AS text FROM pages))""",
    "lead_image": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^[a-z]+') || '://cdn.example/a.png' WHEN 1 THEN o || replace(regexp_replace(d, '[^/]*/$', '') || '/b/c.png', '//', '/') WHEN 3 THEN o || '/d.png' END AS image_url
      FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS o, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS d FROM pages)""",
    "seed_dimension": with_tables("src", """SELECT region_id, key, CASE WHEN id % 2 = 0 THEN 'Neu ' || name ELSE name END AS name, CASE WHEN id % 2 = 0 THEN 'rss' ELSE importer END AS importer, enabled, facts_only OR key = 'nation_6' AS facts_only,
      CASE WHEN id % 2 = 0 THEN 'X' ELSE config_city END AS config_city, 'kunst' AS config_category, CASE WHEN id % 2 = 0 THEN '1' END AS config_neu FROM src
      UNION ALL SELECT region_id, key || '_b', name, importer, false, false, config_city, 'kunst', NULL FROM src"""),
    "patch_config": with_tables("src", "SELECT id, CASE WHEN id % 3 = 0 THEN 'Y' ELSE config_city END AS config_city, CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) END AS config_max, 'kunst' AS config_category FROM src"),
    "calendar_export": with_tables("vi reg evcat", _ENTRIES := f"""SELECT id, array_to_string(list_filter(['BEGIN:VEVENT', 'UID:event-' || id || '@' || canonical_host, 'DTSTAMP:' || {_Z('last_seen_at')}, 'LAST-MODIFIED:' || {_Z('last_seen_at')}, 'SUMMARY:' || {_ESC('title')},
      'STATUS:CONFIRMED', 'URL:' || {_URL}, CASE WHEN all_day THEN 'DTSTART;VALUE=DATE:' || strftime(starts_at, '%Y%m%d') ELSE 'DTSTART:' || {_Z('starts_at')} END,
      CASE WHEN all_day THEN 'DTEND;VALUE=DATE:' || strftime(coalesce(ends_at, starts_at) + INTERVAL 1 DAY, '%Y%m%d') ELSE 'DTEND:' || {_Z('ends_at')} END,
      'LOCATION:' || {_ESC(f"CASE WHEN venue_name IS NOT NULL THEN {_ADDR} ELSE location_text END")},
      'DESCRIPTION:' || {_ESC(f"concat_ws(chr(10) || chr(10), CASE WHEN NOT facts_only THEN nullif(description, '') END, 'Mehr Infos: ' || {_URL})")}, 'CATEGORIES:' || cats, 'END:VEVENT'], lambda x: x IS NOT NULL), chr(10)) AS entry
      FROM (SELECT vi.*, canonical_host, (SELECT string_agg(cat.slug, ',' ORDER BY sort_order) FROM evcat JOIN cat ON cat.id = category_id WHERE event_id = vi.id) AS cats FROM vi JOIN reg ON reg.id = vi.region_id)"""),
    "calendar_files": with_tables("vi reg evcat", f"""SELECT region_id, (n - 1) // 100 AS file, (n - 1) % 100 + 1 AS nr, id, entry FROM ({_ENTRIES}) JOIN
      (SELECT id, region_id, row_number() OVER (PARTITION BY region_id ORDER BY starts_at, id) AS n FROM vi) USING (id)"""),
    "sitemap_export": with_tables("vi reg", f"""SELECT region_id, rank, id, '<url><loc>' || {_URL} || '</loc><lastmod>' || strftime(last_seen_at, '%Y-%m-%d') || '</lastmod></url>' AS entry FROM (SELECT vi.*, canonical_host,
      row_number() OVER (PARTITION BY region_id ORDER BY starts_at, vi.id) AS rank FROM vi JOIN reg ON reg.id = region_id WHERE {relevant(T_NOW)}) WHERE rank <= 20000"""),
    "schema_org_export": with_tables("vi reg", f"""SELECT id, title AS name, CASE WHEN all_day THEN strftime(starts_at, '%Y-%m-%d') ELSE {iso('starts_at')} END AS start, CASE WHEN all_day THEN strftime(ends_at, '%Y-%m-%d') ELSE {iso('ends_at')} END AS finish,
      CASE WHEN booking_status = 'cancelled' THEN 'https://schema.org/EventCancelled' ELSE 'https://schema.org/EventScheduled' END AS state, coalesce(venue_name, location_text) AS place, organizer,
      CASE WHEN organizer IS NOT NULL THEN regexp_extract(source_home, '^https://[^/]*') END AS home,
      CASE WHEN booking_status IS NOT NULL THEN 'https://schema.org/SoldOut' ELSE 'https://schema.org/InStock' END AS availability,
      CASE WHEN price LIKE '%frei%' THEN '0' ELSE replace(regexp_extract(price, '[0-9]+,[0-9]+'), ',', '.') END AS price,
      'https://' || canonical_host || CASE WHEN NOT facts_only AND image_url IS NOT NULL THEN '/bild/' || id ELSE '/share.png' END AS image,
      left(coalesce(CASE WHEN NOT facts_only THEN coalesce(nullif(summary, ''), nullif(description, '')) END, title || coalesce(' – ' || {_PLACE}, '')), 500) AS description
      FROM (SELECT vi.*, canonical_host FROM vi JOIN reg ON reg.id = region_id)"""),
    "drop_marked": with_tables("occ", f"SELECT id, text FROM w WHERE NOT regexp_matches(lower(text), '{_B}({_regex(K.INTERNAL_MARKERS)}){_E}')", w=_W),
    "drop_past": with_tables("occ", f"SELECT id FROM occ WHERE coalesce(ends_at, starts_at) >= {T_NOW} - INTERVAL 1 DAY"),
    "mask_rights": with_tables("ev src ven", f"""SELECT id, CASE WHEN NOT facts_only THEN description END AS description, CASE WHEN NOT facts_only THEN summary END AS summary,
      CASE WHEN NOT facts_only AND enabled AND approved_at IS NOT NULL AND image_url <> '' THEN image_url END AS image_url FROM ({_CUR})"""),
    "display_columns": with_tables("ev src ven", f"""SELECT id, {_PLACE} AS place, {_ADDR} AS address, CASE WHEN NOT all_day AND ends_at = date_trunc('day', ends_at) AND ends_at > starts_at THEN ends_at - INTERVAL 1 DAY ELSE ends_at END AS shown_end FROM ({_CUR})"""),
    "booking_status": with_tables("occ", f"SELECT id, {_case(K.BOOKING_WORDS)} AS state FROM w", w=_W),
    "price_amount": with_tables("occ", "SELECT id, CASE WHEN regexp_matches(lower(text), 'frei|kostenlos|gratis|umsonst') THEN '0' ELSE nullif(replace(regexp_extract(text, '[0-9]+([.,][0-9]{1,2})?'), ',', '.'), '') END AS amount FROM w", w=_W),
    "keyword_category": with_tables("occ", "SELECT id, " + _case(K.COURSE_CATEGORIES, "'bildung'") + " AS slug FROM w", w=_W),
    "course_flag": with_tables("occ", f"SELECT id, regexp_matches(lower(text), '{_B}({_regex(K.COURSE_WORDS)}){_E}') AS course FROM w", w=_W),
    "normalize_text": "SELECT doc_id, " + norm("text") + " AS plain, " + norm_title("text") + " AS title_key, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS venue_form FROM documents",
    "content_hash": with_tables("ev", "SELECT id, content_hash, slug, dedup_key FROM ev"),
    "location_tokens": """SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS tokens FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
      SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z0-9äöüß]+', ' ', 'g'), ' ') AS ws FROM documents)) WHERE length(w) >= 4 GROUP BY doc_id, w) RIGHT JOIN (SELECT doc_id FROM documents) USING (doc_id) GROUP BY doc_id""",
    "prompt_text": "SELECT page_id, trim(regexp_replace(translate(html, '<>', '  '), '\\s+', ' ', 'g')) AS line FROM pages",
    "berlin_wall": "SELECT event_id, timezone('Europe/Berlin', timezone('UTC', ts)) AS wall FROM events",
    "course_date": with_tables("occ", """SELECT id, CASE WHEN id % 97 <> 0 THEN CASE WHEN id % 4 = 0 THEN date_trunc('day', starts_at) ELSE starts_at END + CASE WHEN id % 3 = 0 AND starts_at < TIMESTAMP '2000-01-01' THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END END AS at FROM occ"""),
    "german_dates": with_tables("occ", """SELECT id, CASE WHEN id % 97 <> 0 AND y BETWEEN 2000 AND 2100 THEN make_timestamp(y, month(starts_at), day(starts_at), CASE WHEN id % 4 = 1 THEN minute(starts_at) ELSE hour(starts_at) END, 0, 0) END AS at FROM (
      SELECT *, CASE WHEN id % 3 = 0 AND year(starts_at) < 2000 THEN year(starts_at) + 100 ELSE year(starts_at) END AS y FROM occ)"""),
    "infer_year": with_tables("occ", f"""SELECT id, CASE WHEN t < {T_NOW} - INTERVAL 1 DAY THEN coalesce(n, t) ELSE t END AS a, CASE WHEN t IS NULL OR t < {T_NOW} - INTERVAL 7 DAY THEN n ELSE t END AS b,
      CASE WHEN t < {T_NOW} - INTERVAL 40 DAY AND n <= {T_NOW} + INTERVAL 6 MONTH THEN n ELSE t END AS c,
      (SELECT x FROM (VALUES (p), (t), (n)) v(x) WHERE x IS NOT NULL ORDER BY abs(epoch(x) - epoch({T_NOW})) + CASE WHEN isodow(x) = id % 7 + 1 THEN 0 ELSE 400 * 86400 END, x LIMIT 1) AS d
      FROM (SELECT id, {_at('1997')} AS p, {_at('1998')} AS t, {_at('1999')} AS n FROM (SELECT id, month(starts_at) AS m, day(starts_at) AS d FROM occ))"""),
    "date_range": with_tables("occ", """SELECT id, starts_at AS start, CASE WHEN e >= starts_at THEN e END AS "end", all_day FROM (SELECT *, CASE
      WHEN id % 2 = 0 AND id % 3 = 1 AND ends_at IS NOT NULL THEN ends_at
      WHEN id % 2 = 0 AND NOT all_day AND CAST(coalesce(ends_at, starts_at) AS DATE) = CAST(starts_at AS DATE) THEN NULL
      WHEN id % 2 = 0 THEN date_trunc('day', coalesce(ends_at, starts_at)) + INTERVAL 1439 MINUTE
      WHEN id % 3 = 1 AND ends_at IS NOT NULL THEN date_trunc('day', starts_at) + (ends_at - date_trunc('day', ends_at)) END AS e FROM occ)"""),
    "day_label": with_tables("occ", f"""SELECT id, CASE datediff('day', {T_NOW}, starts_at) WHEN 0 THEN 'Heute' WHEN 1 THEN 'Morgen' WHEN 2 THEN 'Übermorgen' ELSE
      ({_DAYS_SQL})[isodow(starts_at)] || ', ' || day(starts_at) || '. ' || ({_MONTHS_SQL})[month(starts_at)] || CASE WHEN year(starts_at) <> 1998 THEN ' ' || year(starts_at) ELSE '' END END AS label FROM occ"""),
    "year_segments": with_tables("occ", """SELECT id AS page_id, 1 AS segment_no, 2026 AS year, 0 AS line_no, strftime(starts_at, '%-d.%-m') AS day_month FROM occ UNION ALL SELECT id, 1, 2026, 1, '7.8' FROM occ
      UNION ALL SELECT id, 2, 2027, 0, strftime(starts_at, '%d.%m') FROM occ"""),
    "slug_union": with_tables("occ", "SELECT id, array_to_string(list_concat(['musik'], list_filter(category_slugs, lambda s: s <> 'musik')), ',') AS slugs FROM occ"),
    "stream_views": with_tables("vis", "SELECT region_id, day, route, count(*) AS views FROM pv GROUP BY ALL", pv=PV),
    "stream_views_with_late": with_tables("vis", "SELECT region_id, day, route, count(*) AS views FROM pv GROUP BY ALL", pv=PV),
    "stream_event_views": with_tables("vis", "SELECT day, event_id, count(*) AS views FROM pv WHERE route = 'event_show' AND event_id > 0 GROUP BY ALL", pv=PV),
    "stream_visitors": with_tables("vis", "SELECT region_id, day, visitors FROM ds", **_VIS),
}
