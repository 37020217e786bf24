"""Exports: calendar feed texts, sitemap entries, schema.org documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.functions.classify import price_amount
from kalendarium.functions.text import blank_to_null, decode_entities, strip_tags, trim_edges
from kalendarium.functions.times import iso_berlin, utc_wall
from kalendarium.functions.urls import homepage
from kalendarium.operators.dims import full_address
from kalendarium.operators.listing import find_for_sitemap
from kalendarium.operators.review import display_location

DESCRIPTION_CAP = 500
#: entries of one calendar file
FILE_ENTRIES = 10_000
PUBLISHER = "kalendarium"


def with_host(enriched: DataFrame, regions: DataFrame) -> DataFrame:
    return enriched.join(regions.select(F.col("id").alias("region_id"), F.col("canonical_host").alias("host"), "site_name"), "region_id")


def detail_url() -> Column:
    return F.concat(F.lit("https://"), F.col("host"), F.lit("/event/"), F.col("id").cast("string"), F.lit("/"), F.col("slug"))


def _escape(c: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def _line(name: str, value: Column) -> Column:
    """A content line, or null when there is no value."""
    return F.concat(F.lit(f"{name}:"), value)


def calendar_entries(rows: DataFrame) -> DataFrame:
    """One VEVENT text per event. Needs host and category_names; timed moments in UTC, all-day as
    dates with an exclusive end; facts-only sources export no description."""
    zulu = lambda c: F.date_format(utc_wall(c), "yyyyMMdd'T'HHmmss'Z'")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    one_day = F.expr("INTERVAL 1 DAY")
    start = F.when(F.col("all_day"), _line("DTSTART;VALUE=DATE", day(F.col("starts_at")))).otherwise(_line("DTSTART", zulu(F.col("starts_at"))))
    until = day(F.coalesce("ends_at", "starts_at") + one_day)
    end = F.when(F.col("all_day"), _line("DTEND;VALUE=DATE", until)).otherwise(_line("DTEND", zulu(F.col("ends_at"))))
    place = F.coalesce(F.when(F.col("venue_name").isNotNull(), blank_to_null(full_address())), blank_to_null(display_location()))
    text = F.when(~F.col("source_facts_only"), blank_to_null(trim_edges(decode_entities(strip_tags(F.coalesce("description", F.lit("")))))))
    more = F.concat(F.lit("Mehr Infos: "), detail_url())
    names = F.when(F.size("category_names") > 0, F.array_join(F.transform("category_names", _escape), ","))
    stamp = zulu(F.col("last_seen_at"))
    uid = F.concat(F.lit("event-"), F.col("id").cast("string"), F.lit("@"), F.col("host"))
    lines = F.array(
        F.lit("BEGIN:VEVENT"), _line("UID", uid), _line("DTSTAMP", stamp), _line("LAST-MODIFIED", stamp), _line("SUMMARY", _escape(F.col("title"))),
        F.lit("STATUS:CONFIRMED"), _line("URL", detail_url()), start, end, _line("LOCATION", _escape(place)),
        _line("DESCRIPTION", _escape(F.concat_ws("\n\n", text, more))), _line("CATEGORIES", names), F.lit("END:VEVENT"),
    )
    return rows.select("region_id", "id", "starts_at", F.array_join(F.array_compact(lines), "\n").alias("entry"))


def export_ics(rows: DataFrame, path: str, per_file: int = FILE_ENTRIES) -> None:
    """Calendar text files below ``region_id=/file=``: header, at most ``per_file`` entries, footer. A
    region's files follow each other in start order, each a calendar of its own, so a region of any size
    is dealt to as many tasks as it has files."""
    numbered = scale.number_rows(calendar_entries(rows), ["region_id"], "starts_at", "id", "nr")
    file = lambda nr: F.floor((nr - 1) / per_file).cast("long")
    entries = numbered.select("region_id", file(F.col("nr")).alias("file"), F.lit(1).alias("part"), "nr", F.col("entry").alias("value"))
    regions = rows.groupBy("region_id").agg(F.min("site_name").alias("site_name"), file(F.count(F.lit(1))).alias("last"))
    files = regions.select("region_id", "site_name", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("file"))
    head = F.concat(F.lit(f"BEGIN:VCALENDAR\nVERSION:2.0\nPRODID:-//{PUBLISHER}//"), "site_name", F.lit("//DE\nMETHOD:PUBLISH\nX-WR-CALNAME:"), "site_name", F.lit("\nX-WR-TIMEZONE:Europe/Berlin"))
    frame = lambda part, text: files.select("region_id", "file", F.lit(part).alias("part"), F.lit(0).cast("long").alias("nr"), text.alias("value"))
    texts = frame(0, head).unionByName(entries).unionByName(frame(2, F.lit("END:VCALENDAR")))
    ordered = texts.repartition("region_id", "file").sortWithinPartitions("region_id", "file", "part", "nr")
    lines = ordered.select("region_id", "file", F.regexp_replace("value", "\n", "\r\n").alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").partitionBy("region_id", "file").text(path)


def read_ics(spark: SparkSession, path: str) -> DataFrame:
    """Entries of exported files, in file order (``nr`` from 1); a file without header or footer gives none."""
    texts = spark.read.text(path, wholetext=True).withColumn("value", F.replace("value", F.lit("\r\n"), F.lit("\n")))
    whole = texts.filter(F.startswith("value", F.lit("BEGIN:VCALENDAR\n")) & F.endswith("value", F.lit("\nEND:VCALENDAR\n")))
    inner = F.regexp_replace("value", "\nEND:VCALENDAR\n$", "")
    split = F.split(inner, "\n(?=BEGIN:VEVENT\n)")
    # the first piece is the header
    pieces = F.slice(split, F.lit(2), F.size(split))
    rows = whole.select(F.col("region_id").cast("long").alias("region_id"), F.col("file").cast("long").alias("file"), F.posexplode(pieces).alias("pos", "entry"))
    found = F.regexp_extract("entry", r"\nUID:event-(\d+)@", 1).cast("long")
    return rows.select("region_id", "file", (F.col("pos") + 1).cast("long").alias("nr"), found.alias("id"), "entry")


def sitemap_entries(visible_rows: DataFrame, regions: DataFrame, now: str) -> DataFrame:
    rows = with_host(find_for_sitemap(visible_rows, now), regions)
    stamp = F.date_format("last_seen_at", "yyyy-MM-dd")
    entry = F.format_string("<url><loc>%s</loc><lastmod>%s</lastmod></url>", detail_url(), stamp)
    return rows.select("region_id", "rank", "id", entry.alias("entry"))


def schema_org(rows: DataFrame) -> DataFrame:
    """schema.org Event document per event; unset parts are left out. Creative parts only where allowed."""
    moment = lambda c: F.when(F.col("all_day"), F.date_format(c, "yyyy-MM-dd")).otherwise(iso_berlin(F.col(c)))
    url, base = detail_url(), F.concat(F.lit("https://"), F.col("host"))
    text = lambda v: F.lit(v)
    venue = F.struct(text("Place").alias("@type"), F.col("venue_name").alias("name"), blank_to_null(full_address()).alias("address"))
    loose = F.struct(text("Place").alias("@type"), F.col("location_text").alias("name"), F.lit(None).cast("string").alias("address"))
    organizer = F.struct(text("Organization").alias("@type"), F.col("organizer").alias("name"), homepage(F.col("source_home")).alias("url"))
    amount = price_amount(F.col("price"))
    offer = F.struct(
        text("Offer").alias("@type"), F.when(F.col("source_url").rlike("^https?://"), F.col("source_url")).otherwise(url).alias("url"),
        F.when(F.col("booking_status").isin("waitlist", "full", "cancelled", "closed"), "https://schema.org/SoldOut").otherwise("https://schema.org/InStock").alias("availability"),
        amount.alias("price"), F.when(amount.isNotNull(), "EUR").alias("priceCurrency"),
    )
    own = ~F.col("source_facts_only")
    teaser = F.when(own, F.coalesce(blank_to_null(F.col("summary")), blank_to_null(trim_edges(strip_tags(F.col("description"))))))
    plain = F.concat("title", F.coalesce(F.concat(F.lit(" – "), display_location()), F.lit("")))
    image = F.when(own & F.col("image_url").isNotNull(), F.concat(base, F.lit("/bild/"), F.col("id").cast("string"))).otherwise(F.concat(base, F.lit("/share.png")))
    document = F.struct(
        text("https://schema.org").alias("@context"), text("Event").alias("@type"), F.col("title").alias("name"), moment("starts_at").alias("startDate"),
        F.when(F.col("booking_status") == "cancelled", "https://schema.org/EventCancelled").otherwise("https://schema.org/EventScheduled").alias("eventStatus"),
        text("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"), url.alias("url"), moment("ends_at").alias("endDate"),
        F.when(F.col("venue_name").isNotNull(), venue).when(F.col("location_text").isNotNull(), loose).alias("location"),
        F.when(F.col("organizer").isNotNull(), organizer).alias("organizer"), offer.alias("offers"), image.alias("image"),
        F.left(F.coalesce(teaser, plain), F.lit(DESCRIPTION_CAP)).alias("description"),
    )
    escaped = F.to_json(document)
    for mark, code in (("<", "\\u003C"), (">", "\\u003E"), ("&", "\\u0026")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(code))
    return rows.select("id", escaped.alias("json"))
