"""Counts and join views for operators of the site: per source, per merge, per region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.functions.times import as_ntz, still_relevant

STATUSES = ("published", "hidden", "duplicate")


def status_counts(events: DataFrame, now: str) -> DataFrame:
    """Per source: events by status, all, and still shown. One pass."""
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    shown = (F.col("status") == "published") & still_relevant(now)
    return events.groupBy("source_id").agg(*by_status, F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("upcoming"))


def won_duplicates(events: DataFrame) -> DataFrame:
    """Per source: events of other sources demoted behind one of its own. Pre-aggregated per
    (target, source), so a target with very many copies is one row per source in the join."""
    demoted = events.filter(F.col("duplicate_of").isNotNull()).groupBy("duplicate_of", F.col("source_id").alias("loser")).agg(F.count(F.lit(1)).alias("n"))
    target = events.select(F.col("id").alias("duplicate_of"), "source_id")
    pairs = demoted.join(target, "duplicate_of").filter(F.col("loser") != F.col("source_id"))
    return pairs.groupBy("source_id").agg(F.sum("n").alias("won"))


def source_events(events: DataFrame, sources: DataFrame, source_id: int, limit: int = 300) -> DataFrame:
    """One source's events of every status with the canonical event and its source."""
    mine = events.filter(F.col("source_id") == source_id).orderBy("starts_at", "id").limit(limit)
    canonical = events.select(F.col("id").alias("duplicate_of"), F.col("title").alias("canonical_title"), F.col("source_id").alias("canonical_source_id"))
    names = sources.select(F.col("id").alias("canonical_source_id"), F.col("name").alias("canonical_source"))
    return mine.join(canonical, "duplicate_of", "left").join(names, "canonical_source_id", "left")


def dedup_review(decisions: DataFrame, events: DataFrame, venues: DataFrame, sources: DataFrame, region: int | None = None, limit: int = 100) -> DataFrame:
    """Newest active merges with both events, their sources and venues."""
    def side(name: str) -> DataFrame:
        rows = (
            events.select("id", "title", "region_id", "source_id", "venue_id")
            .join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left")
            .join(venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue")), "venue_id", "left")
        )
        return rows.select(F.col("id").alias(f"{name}_event_id"), *[F.col(c).alias(f"{name}_{c}") for c in ("title", "region_id", "source", "venue")])

    active = decisions.filter("active").select("id", "day", "duplicate_event_id", "canonical_event_id", "reason", "created_at")
    rows = active.join(side("duplicate"), "duplicate_event_id", "left").join(side("canonical"), "canonical_event_id", "left")
    if region is not None:
        rows = rows.filter((F.col("duplicate_region_id") == region) | (F.col("canonical_region_id") == region))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def inbox_counts(messages: DataFrame) -> DataFrame:
    real = ~F.col("spam")
    return messages.agg(F.count_if(real).alias("real"), F.count_if("spam").alias("spam"), F.count_if(real & ~F.col("seen")).alias("unseen"))


def inbox(messages: DataFrame, spam: bool, limit: int = 200) -> DataFrame:
    return messages.filter(F.col("spam") == spam).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def pipeline_progress(enriched: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """Teaser and category progress over visible, relevant events; ``active`` when a decision is
    under two minutes old."""
    rows = enriched.filter((F.col("status") == "published") & F.col("source_enabled") & still_relevant(now))
    decided = decisions.select(F.col("event_id").alias("id"), F.lit(True).alias("_decided")).distinct()
    own = ~F.col("source_facts_only")
    counts = rows.join(decided, "id", "left").agg(
        F.count_if(own & F.col("summary").isNotNull()).alias("with_summary"),
        F.count_if(own & (F.coalesce("description", F.lit("")) != "")).alias("eligible"),
        F.count_if(F.col("_decided").isNull()).alias("without_decision"),
    )
    states = ("applied", "pending", "agreed", "dismissed", "undone")
    by_state = decisions.agg(
        F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col("status") == s).alias(s) for s in states], F.max("created_at").alias("last_at")
    )
    running = F.coalesce(F.col("last_at") > as_ntz(now) - F.expr("INTERVAL 2 MINUTE"), F.lit(False))
    # two one-row results laid over each other; no join needed
    both = counts.unionByName(by_state, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("running", running)


def decision_log(decisions: DataFrame, status: str | None, limit: int, offset: int = 0) -> DataFrame:
    rows = decisions if status is None else decisions.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def cross_source_match(incoming: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """For each (region, key, source): the lowest id published under the same key by another enabled
    source. Candidates are reduced to the two lowest distinct sources per key before the join, which
    is enough to answer for any source and keeps a hot key at two rows."""
    enabled = sources.filter("enabled").select(F.col("id").alias("source_id"))
    keys = ["region_id", "dedup_key"]
    sizes = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    published = events.filter(F.col("status") == "published").select(*keys, "source_id", "id").join(enabled, "source_id", "left_semi").join(sizes.select(*keys), keys, "left_semi")
    per_source = published.groupBy("region_id", "dedup_key", "source_id").agg(F.min("id").alias("id"))
    best = per_source.groupBy("region_id", "dedup_key").agg(F.min(F.struct("id", "source_id")).alias("first"))
    second = (
        per_source.join(best, ["region_id", "dedup_key"]).filter(F.col("source_id") != F.col("first.source_id"))
        .groupBy("region_id", "dedup_key").agg(F.min("id").alias("second_id"))
    )
    answer = sizes.join(best, ["region_id", "dedup_key"]).join(second, ["region_id", "dedup_key"], "left")
    joined = scale.join_back(incoming, answer, ["region_id", "dedup_key"], "position")
    match = F.when(F.col("first.source_id") != F.col("source_id"), F.col("first.id")).otherwise(F.col("second_id"))
    return joined.withColumn("matched_id", match).drop("first", "second_id", "_n")
