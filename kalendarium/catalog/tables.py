"""Gives the given tables the shape of the event model (orders as events, nations as sources, ...).

Every table here is a lazy projection of a parquet scan; nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendarium.functions import keys
from kalendarium.functions.times import ts
from kalendarium.model import CATEGORY_SLUGS
from kalendarium.session import cut_lineage

NOW = "1998-06-03 12:00:00"
RUNS_NOW = "2024-01-30 12:00:00"

#: ids of second listings begin here
SECOND = 1_000_000_000_000

SEGMENT_SLUG = {"MACHINERY": "bildung", "BUILDING": "kunst", "AUTOMOBILE": "markt", "FURNITURE": "familie", "HOUSEHOLD": "sonstiges"}


def every(n: int, at: int = 0):
    return F.col("id") % n == at


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def stored_events(self) -> DataFrame:
        """The event table as a stored snapshot, for operators that read it many times."""
        return cut_lineage(self.events)

    @cached_property
    def occurrences(self) -> DataFrame:
        """Orders as event occurrences with the place and category still inline (the import shape). A fifth of
        them is listed a second time by another source: same title, day and town, other id, address and picture."""
        i, again = F.col("id"), F.col("_again")
        # both listings come from one pass over the joined tables
        twice = F.when(every(5, 3), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        listed = self._first_listing.withColumn("_again", F.explode(twice))
        second = {
            "id": i + F.lit(SECOND), "source_id": (F.col("source_id") + 5) % 25, "source_url": F.concat(F.lit("https://zweit.example/e/"), i.cast("string")),
            "image_url": F.when(every(3), F.col("image_url")).otherwise(F.concat(F.lit("https://zweit.example/"), i.cast("string"), F.lit(".jpg"))),
            "description": F.when(~every(4, 1), F.col("description")), "price": F.when(~every(7, 2), F.col("price")),
            "external_id": F.concat(F.lit("zweit-"), i.cast("string")), "status": F.when(F.col("status") == "duplicate", "published").otherwise(F.col("status")),
        }
        return listed.withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in second.items()}).drop("_again")

    @cached_property
    def _first_listing(self) -> DataFrame:
        orders = self.scan("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        customer = self.scan("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment")
        part = self.scan("part").select("p_partkey", "p_name", "p_type", "p_brand")
        supplier = self.scan("supplier").select("s_suppkey", "s_name", "s_nationkey")
        nation = self.scan("nation").select("n_nationkey", "n_name", "n_regionkey")
        # an order's first line gives the title and the venue; orders without lines have neither
        first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey"))
        line = self.scan("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(first.alias("l"))
        rows = (
            orders.join(customer, "o_custkey")
            .join(line.select("o_orderkey", F.col("l.l_partkey").alias("p_partkey"), F.col("l.l_suppkey").alias("s_suppkey")), "o_orderkey", "left")
            .join(part, "p_partkey", "left")
            .join(supplier, "s_suppkey", "left")
            .join(nation, F.col("n_nationkey") == F.coalesce("s_nationkey", "c_nationkey"))
            .withColumn("id", F.col("o_orderkey"))
            .withColumn("all_day", every(4))
        )
        day, i = F.col("o_orderdate"), F.col("id")
        hours = lambda n: F.make_dt_interval(hours=n.cast("int"))
        days = lambda n: F.make_dt_interval(days=n.cast("int"))
        suffix = F.element_at(F.array(F.lit(""), F.lit(" - Eintritt frei"), F.lit(" (Open Air)")), (F.floor(i / 20) % 3 + 1).cast("int"))
        segment = F.create_map(*[F.lit(v) for pair in SEGMENT_SLUG.items() for v in pair])
        return rows.select(
            "id",
            F.concat(F.coalesce("p_name", F.lit("Ohne Titel")), suffix).alias("title"),
            F.when(F.col("all_day"), day).otherwise(day + hours(8 + i % 12)).alias("starts_at"),
            F.when(every(3), F.lit(None).cast("timestamp_ntz"))
            .when(F.col("all_day"), day + days(i % 5))
            .otherwise(day + days(i % 2) + hours(10 + i % 12)).alias("ends_at"),
            "all_day",
            F.when(every(10), F.lit(None)).otherwise(F.repeat("p_type", (i % 5).cast("int"))).alias("description"),
            F.when(every(4, 1), F.concat(F.lit("Kurz: "), "p_brand")).when(every(4, 3), "").alias("summary"),
            F.when(~every(7), F.col("s_suppkey")).alias("venue_id"),
            F.when(~every(7), F.col("s_name")).alias("venue_name"),
            F.col("n_name").alias("city"),
            F.when(every(14), F.concat(F.lit("Saal "), "p_brand")).alias("location_text"),
            F.col("n_regionkey").cast("long").alias("region_id"),
            F.col("c_nationkey").cast("long").alias("source_id"),
            F.when(~every(8), F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example/e/"), i.cast("string"))).alias("source_url"),
            F.when(every(2), F.concat(F.lit("https://img.example/"), i.cast("string"), F.lit(".jpg"))).alias("image_url"),
            F.when(every(4, 1), "Eintritt frei").when(every(4, 2), F.concat((i % 50).cast("string"), F.lit(",50 €"))).alias("price"),
            F.when(every(9), "").when(~every(3, 1), F.col("c_name")).alias("organizer"),
            F.when(every(10, 5), F.concat(F.lit("manual:"), i.cast("string"))).when(~every(10), F.concat(F.lit("ext-"), i.cast("string"))).alias("external_id"),
            F.when(every(13), "hidden").when(F.col("o_orderstatus") == "F", "duplicate").otherwise("published").alias("status"),
            F.when(every(6), True).otherwise(False).alias("is_course"),
            F.when(every(23), "cancelled").when(every(19), "full").alias("booking_status"),
            F.array_compact(F.array(segment[F.col("c_mktsegment")], F.when(F.col("o_orderpriority") == "1-URGENT", "musik"))).alias("category_slugs"),
        )

    @cached_property
    def events(self) -> DataFrame:
        o = self.occurrences
        i = F.col("id")
        fields = {c: F.col(c) for c in o.columns}
        locks = F.array_compact(F.array(
            F.when(every(29), "title"), F.when(every(31), "imageUrl"), F.when(every(31), "description"),
            F.when(every(12), "categories"), F.when(every(37), "datum"), F.when(every(41), "organizer"),
        ))
        return o.select(
            "id", "title", keys.slug(F.col("starts_at"), F.col("title")).alias("slug"), "description", "summary",
            "starts_at", "ends_at", "all_day", "venue_id", "location_text", "region_id", "source_id", "source_url",
            "image_url", "price", "organizer", "external_id", keys.content_hash(fields).alias("content_hash"),
            keys.dedup_key(F.col("title"), F.col("starts_at"), F.col("all_day"), F.col("city")).alias("dedup_key"),
            F.when((F.col("status") == "duplicate") & ~every(11), F.when(every(17), i + 1).otherwise(i - 1)).alias("duplicate_of"),
            "status",
            F.when((F.col("status") == "hidden") & every(2), ts(NOW) - F.expr("INTERVAL 3 DAY")).alias("pruned_at"),
            "is_course", "booking_status", F.lit(None).cast("string").alias("raw"), locks.alias("locked_fields"),
            (ts(NOW) - F.expr("INTERVAL 40 DAY")).alias("first_seen_at"),
            (ts(NOW) - F.make_dt_interval(days=(i % 15).cast("int"))).alias("last_seen_at"),
        )

    @cached_property
    def venues(self) -> DataFrame:
        supplier, nation = self.scan("supplier"), self.scan("nation")
        rows = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
        null = lambda t: F.lit(None).cast(t)
        return rows.select(
            F.col("s_suppkey").alias("id"), F.col("n_regionkey").cast("long").alias("region_id"), F.col("s_name").alias("name"),
            F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("Weg "), F.col("s_suppkey").cast("string"))).alias("street"),
            F.when(F.col("s_suppkey") % 4 != 0, F.lpad((F.col("s_suppkey") * 37 % 100000).cast("string"), 5, "0")).alias("postal_code"),
            F.col("n_name").alias("city"), null("double").alias("latitude"), null("double").alias("longitude"),
            null("string").alias("website"), keys.venue_key(F.col("s_name"), F.col("n_name")).alias("dedup_key"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        n = F.col("n_nationkey")
        key = F.lower("n_name")
        return self.scan("nation").select(
            n.cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region_id"), key.alias("key"),
            F.concat(F.lit("Quelle "), "n_name").alias("name"), F.when(n % 5 == 4, "manual").otherwise("feed").alias("type"),
            F.concat(F.lit("https://www."), key, F.lit(".example/feed?x=1")).alias("url"), F.lit("ics").alias("importer"),
            (n % 9 != 0).alias("enabled"), (n % 4 == 0).alias("facts_only"),
            F.when(n % 3 != 0, ts("1998-01-01 00:00:00")).alias("approved_at"),
            F.create_map(
                F.lit("city"), F.col("n_name"), F.lit("category"), F.lit("kunst"), F.lit("categoryMap"), F.lit('{"musik":"musik","fest":"markt"}'),
            ).alias("config"),
            F.lit(None).cast("timestamp_ntz").alias("last_run_at"), F.lit(None).cast("string").alias("last_status"),
        )

    @cached_property
    def regions(self) -> DataFrame:
        """Default city and town list of a region: its nations, by number."""
        towns = self.scan("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda t: t["n_name"]).alias("cities")
        )
        low = F.lower(F.replace("r_name", F.lit(" "), F.lit("-")))
        alias = F.concat(F.lit("ort"), F.col("r_regionkey").cast("string"))
        return self.scan("region").join(towns, "r_regionkey").select(
            F.col("r_regionkey").cast("long").alias("id"), low.alias("key"), F.col("r_name").alias("site_name"),
            F.concat(F.lit("Raum "), "r_name").alias("area_name"), F.concat(low, F.lit(".example")).alias("canonical_host"),
            F.element_at("cities", 1).alias("default_city"),
            F.array(F.concat(F.lit("www."), low, F.lit(".example")), F.concat(F.lit("alt-"), low, F.lit(".example"))).alias("host_aliases"),
            "cities", F.create_map(alias, F.element_at("cities", 2)).alias("city_aliases"), F.lit(True).alias("enabled"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        slugs = F.array(*[F.lit(s) for s in CATEGORY_SLUGS])
        return self.spark.range(1, len(CATEGORY_SLUGS) + 1).select(
            "id", F.element_at(slugs, F.col("id").cast("int")).alias("slug"),
            F.initcap(F.element_at(slugs, F.col("id").cast("int"))).alias("name"), F.col("id").cast("int").alias("sort_order"),
        )

    @cached_property
    def event_categories(self) -> DataFrame:
        tagged = self.occurrences.select(F.col("id").alias("event_id"), F.explode("category_slugs").alias("slug"))
        return tagged.join(self.categories.select(F.col("id").alias("category_id"), "slug"), "slug").select("event_id", "category_id")

    @cached_property
    def decisions(self) -> DataFrame:
        rows = self.events.filter((F.col("status") == "duplicate") & F.col("duplicate_of").isNotNull() & every(5))
        return rows.select(
            "id", F.to_date("starts_at").alias("day"), F.col("id").alias("duplicate_event_id"),
            F.col("duplicate_of").alias("canonical_event_id"), F.concat(F.lit("gleich "), F.col("id").cast("string")).alias("reason"),
            F.lit("m1").alias("model"), (~every(7)).alias("active"),
            F.when(every(35), ts(NOW) - F.expr("INTERVAL 1 DAY")).alias("undone_by_admin_at"),
            (ts(NOW) - F.make_dt_interval(days=(F.col("id") % 30).cast("int"))).alias("created_at"),
        )

    @cached_property
    def category_decisions(self) -> DataFrame:
        rows = self.events.filter(every(4, 2)).select("id")
        return rows.select(
            "id", F.col("id").alias("event_id"), F.when(every(8, 2), "fill").otherwise("opinion").alias("mode"),
            F.when(every(12, 2), "applied").when(every(12, 6), "pending").otherwise("agreed").alias("status"),
            F.array(F.lit("sonstiges")).alias("previous_slugs"), F.array(F.lit("musik"), F.lit("party")).alias("proposed_slugs"),
            F.lit("passt").alias("reason"), F.lit("m1").alias("model"),
            (ts(NOW) - F.make_dt_interval(mins=(F.col("id") % 100 + 1).cast("int"))).alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
        )

    @cached_property
    def import_runs(self) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind == "error", "failed").when(kind == "signup", "partial").when(kind == "click", "running").otherwise("ok")
        k = F.get_json_object("props", "$.k").cast("int")
        return self.scan("events").select(
            F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("source_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("started_at"),
            status.alias("status"), (k % 4).alias("seen"), (F.col("event_id") % 21 == 0).alias("dry_run"),
            F.when((kind == "error") & (F.col("event_id") % 2 == 0), F.concat(F.lit("Fehler "), k.cast("string"))).alias("message"),
        )

    @cached_property
    def visits(self) -> DataFrame:
        kind, user = F.col("event_type"), F.col("user_id")
        region = user % 5
        host = F.element_at(
            F.array(F.lit("africa.example"), F.lit("www.america.example"), F.lit("alt-asia.example"), F.lit("europe.example"), F.lit("unknown.example")),
            (region + 1).cast("int"),
        )
        route = F.when(kind == "view", "event_show").when(kind == "error", "_error").when(kind == "signup", "admin_home").otherwise(kind)
        return self.scan("events").select(
            F.col("ts"), host.alias("host"), route.alias("route"), F.get_json_object("props", "$.k").cast("long").alias("event_id"),
            F.lit("GET").alias("method"), F.when(F.col("event_id") % 17 == 0, 404).otherwise(200).alias("status"),
            F.lit("text/html; charset=UTF-8").alias("content_type"), user.cast("string").alias("client_ip"),
            F.when(F.col("event_id") % 11 == 0, "SomeBot/1.0").when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit("Mozilla "), (user % 7).cast("string"))).alias("user_agent"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.scan("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("name"), F.lit("a@b.example").alias("email"),
            F.col("text").alias("message"), (ts("2024-01-01 00:00:00") + F.make_dt_interval(hours=F.col("turn").cast("int"), mins=(F.col("conv_id") % 60).cast("int"))).alias("created_at"),
            (F.col("conv_id") % 4 == 0).alias("spam"), F.lit(None).cast("string").alias("spam_reason"), (F.col("turn") % 2 == 0).alias("seen"),
        )

    @cached_property
    def incoming(self) -> DataFrame:
        """A second snapshot: a third as stored, a third edited, a third new (new second listings keep the title of
        the first), some ids listed twice."""
        o = self.occurrences
        i = F.col("id")
        new = every(3, 2)
        rows = o.select(
            "source_id", i.alias("position"), F.when(every(97), "").when(new & (i < SECOND), F.concat(F.lit("Neu "), "title")).otherwise(F.col("title")).alias("title"),
            "starts_at", "ends_at", "all_day",
            F.when(every(3, 1), F.concat(F.coalesce("description", F.lit("")), F.lit(" neu"))).otherwise(F.col("description")).alias("description"),
            "venue_name", F.when(every(9), F.lower("city")).when(every(9, 1), F.concat(F.lit("Ort "), F.col("region_id").cast("string"))).otherwise(F.col("city")).alias("city"),
            "location_text", "category_slugs", "source_url", "image_url", "price", "organizer",
            F.when(new & every(10), F.lit(None)).when(new, F.concat(F.lit("neu-"), i.cast("string"))).otherwise(F.col("external_id")).alias("external_id"),
            F.lit(None).cast("string").alias("raw"), "is_course", "booking_status",
        )
        again = {
            "position": F.col("position") + 10_000_000_000, "title": F.concat("title", F.lit(" II")), "description": F.lit("zweiter Stand"),
        }
        twice = F.when(F.col("position") % 20 == 7, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        listed = rows.withColumn("_again", F.explode(twice))
        return listed.withColumns({c: F.when(F.col("_again"), v).otherwise(F.col(c)) for c, v in again.items()}).drop("_again")

    def bodies(self, text, head: str = "", tail: str = "", joint: str = "", where=None) -> DataFrame:
        """Fetched bodies: the rows of up to 100 consecutive ids of a source joined into one text."""
        rows = self.occurrences if where is None else self.occurrences.filter(where)
        chunk = F.floor(F.col("id") / 100)
        texts = rows.select("source_id", chunk.alias("chunk"), "id", text.alias("text")).groupBy("source_id", "chunk").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda r: r["text"]), joint).alias("inner")
        )
        return texts.select(
            "source_id", F.concat(F.lit("https://host.example/feed/"), F.col("chunk").cast("string")).alias("url"), ts(NOW).alias("fetched_at"),
            (F.col("chunk") * 1_000_000).alias("position"), F.concat(F.lit(head), "inner", F.lit(tail)).alias("body"), "chunk",
        )
