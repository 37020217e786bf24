"""Key-based resolution: winner per key, borrowed fields, chain ends, rescue of stranded duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.functions.times import as_ntz, still_relevant
from kalendarium.operators.health import PRUNE_DAYS, hand_kept
from kalendarium.session import cut_lineage

IMAGE_BONUS = 100_000


def with_source(events: DataFrame, sources: DataFrame) -> DataFrame:
    return events.join(
        sources.select(
            F.col("id").alias("source_id"), F.col("enabled").alias("source_enabled"), F.col("facts_only").alias("source_facts_only"),
            F.col("approved_at").alias("source_approved_at"), F.col("type").alias("source_type"),
        ),
        "source_id",
    )


def can_show_image() -> Column:
    """Publishable: an image, not facts-only, approved and enabled source."""
    return (F.coalesce("image_url", F.lit("")) != "") & ~F.col("source_facts_only") & F.col("source_approved_at").isNotNull() & F.col("source_enabled")


def rank_order() -> Column:
    """Enabled before disabled, own before aggregated, richer first, then the lowest id."""
    richness = F.when(F.col("image_url").isNotNull(), IMAGE_BONUS).otherwise(0) + F.coalesce(F.length("description"), F.lit(0))
    return F.struct(
        (~F.col("source_enabled")).alias("off"), F.col("source_facts_only").alias("facts"), (-richness).alias("poor"), F.col("id").alias("id")
    )


def group_facts(relevant: DataFrame) -> DataFrame:
    """Per (region, key): size, winner and, for each borrowable field, the best-ranked value a member
    may lend. All are mergeable aggregates, so a hot key never needs a sort in one task."""
    order = rank_order()
    lender = F.col("source_enabled") & ~F.col("source_facts_only")
    best = lambda field, ok: F.min_by(field, F.when(lender & ok, order)).alias(f"lent_{field}")
    return relevant.groupBy("region_id", "dedup_key").agg(
        F.count(F.lit(1)).alias("group_size"), F.min_by("id", order).alias("winner_id"),
        best("image_url", can_show_image()), best("description", F.coalesce("description", F.lit("")) != ""),
        best("organizer", F.coalesce("organizer", F.lit("")) != ""),
    )


def _relevant(now: str) -> Column:
    return F.col("status").isin("published", "duplicate") & still_relevant(now)


def rank_group(events: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """Winner and size of every key with at least two relevant members."""
    facts = group_facts(with_source(events.filter(_relevant(now)), sources))
    return facts.filter("group_size >= 2")


def rededup(events: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """All events after the key pass, with ``group_size`` (null outside the window) and ``flip``:
    promoted, demoted, or null."""
    marked = with_source(events, sources).withColumn("_key", F.when(_relevant(now), F.col("dedup_key")))
    facts = group_facts(marked.filter(F.col("_key").isNotNull())).withColumnRenamed("dedup_key", "_key").withColumn("_n", F.col("group_size"))
    joined = scale.join_back(marked, facts, ["region_id", "_key"], "id")
    grouped = F.coalesce(F.col("group_size") >= 2, F.lit(False))
    wins = grouped & (F.col("winner_id") == F.col("id"))
    loses = grouped & (F.col("winner_id") != F.col("id"))
    duplicate = F.col("status") == "duplicate"
    flip = F.when(wins & duplicate, "promoted").when(loses & (~duplicate | ~F.col("duplicate_of").eqNullSafe(F.col("winner_id"))), "demoted")

    def borrowed(field: str, pin: str, missing: Column) -> Column:
        takes = wins & missing & ~F.array_contains("locked_fields", pin)
        return F.when(takes, F.coalesce(F.col(f"lent_{field}"), F.col(field))).otherwise(F.col(field))

    values = {
        "status": F.when(flip == "promoted", "published").when(flip == "demoted", "duplicate").otherwise(F.col("status")),
        "duplicate_of": F.when(flip == "demoted", F.col("winner_id")).when(flip.isNull() | (flip != "promoted"), F.col("duplicate_of")),
        "image_url": borrowed("image_url", "imageUrl", F.col("image_url").isNull()),
        "description": borrowed("description", "description", F.coalesce("description", F.lit("")) == ""),
        "organizer": borrowed("organizer", "organizer", F.col("organizer").isNull()),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in events.columns], "group_size", flip.alias("flip"))


def chain_end(events: DataFrame) -> DataFrame:
    """(id, end_id) for every duplicate: the first non-duplicate along ``duplicate_of``, null for a hole
    or a cycle. Pointer doubling: each round a row learns the pointer of its pointer, so a chain of
    length L takes log2(L) rounds; a round that resolves nothing proves the rest are cycles."""
    nodes = events.select("id", "status", "duplicate_of")
    duplicates = nodes.filter(F.col("status") == "duplicate").select("id", F.col("duplicate_of").alias("ptr"))
    target = nodes.select(F.col("id").alias("ptr"), (F.col("status") == "duplicate").alias("onward"))
    first = _follow(duplicates, target)
    state = cut_lineage(first.select(
        "id", "ptr", F.coalesce(~F.col("onward"), F.lit(True)).alias("done"),
        F.when(~F.col("onward"), F.col("ptr")).alias("end_id"),
    ))
    open_rows = state.filter(~F.col("done")).count()
    while open_rows:
        step = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next_ptr"), F.col("done").alias("next_done"), F.col("end_id").alias("next_end"))
        moved = _follow(state.filter(~F.col("done")).select("id", "ptr"), step)
        state = cut_lineage(state.filter("done").unionByName(moved.select(
            "id", F.col("next_ptr").alias("ptr"), F.col("next_done").alias("done"), F.col("next_end").alias("end_id")
        )))
        left = state.filter(~F.col("done")).count()
        if left == open_rows:
            break
        open_rows = left
    return state.select("id", F.when(F.col("done"), F.col("end_id")).alias("end_id"))


def _follow(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Join rows to their pointer's row; many rows may point at one target."""
    return _attach(rows, targets, "ptr")


def rescue(rededuped: DataFrame, sources: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """Stranded duplicates judged on the key pass's output: all its rows with ``action`` (promote,
    rehang, refused, keep; null where nothing was judged), ``reason`` and ``new_target``."""
    rededuped = cut_lineage(rededuped)  # read five times below
    judged = with_source(rededuped, sources)
    info = judged.select(
        F.col("id").alias("ptr"), F.struct("status", "pruned_at", "source_enabled", "dedup_key").alias("t"),
    )
    stranded = (
        judged.filter((F.col("status") == "duplicate") & (F.col("group_size") < 2))
        .select("id", F.col("duplicate_of").alias("ptr"), "dedup_key", "source_type", "external_id", "last_seen_at")
    )
    first = _follow(stranded, info)
    chained = _attach(first, chain_end(rededuped).withColumnRenamed("id", "ptr"), "ptr")
    ended = _attach(chained, info.select(F.col("ptr").alias("end_id"), F.col("t").alias("e")), "end_id")
    backed = decisions.filter("active").select(F.col("duplicate_event_id").alias("id"), F.lit(True).alias("_backed")).distinct()
    rows = ended.join(backed, "id", "left")
    t, e = F.col("t"), F.col("e")
    in_chain = t["status"] == "duplicate"
    verdict = (
        F.when(t.isNull(), "orphan")
        .when(in_chain & e.isNull(), "dangling_chain")
        .when(in_chain & (e["status"] == "published") & ~e["source_enabled"], "chain_end_source_disabled")
        .when(in_chain & (e["status"] == "published"), "rehang")
        .when(in_chain & e["pruned_at"].isNotNull(), "chain_end_pruned")
        .when(in_chain, "keep")
        .when(t["status"] == "hidden", F.when(t["pruned_at"].isNotNull(), "target_pruned").otherwise("keep"))
        .when(~t["source_enabled"], "target_source_disabled")
        .when(t["dedup_key"] == F.col("dedup_key"), "keep")
        .when(F.col("_backed").isNull(), "key_without_counterpart").otherwise("keep")
    )
    unseen = ~hand_kept(F.col("source_type"), F.col("external_id")) & (F.col("last_seen_at") < as_ntz(now) - F.make_dt_interval(days=F.lit(PRUNE_DAYS)))
    action = F.when(verdict.isin("keep", "rehang"), verdict).when(unseen, "refused").otherwise("promote")
    verdicts = rows.select("id", action.alias("action"), verdict.alias("reason"), F.when(verdict == "rehang", F.col("end_id")).alias("new_target"))
    joined = rededuped.join(verdicts, "id", "left")
    promote, rehang = F.col("action") == "promote", F.col("action") == "rehang"
    values = {
        "status": F.when(promote, "published").otherwise(F.col("status")),
        "duplicate_of": F.when(promote, F.lit(None).cast("long")).when(rehang, F.col("new_target")).otherwise(F.col("duplicate_of")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in rededuped.columns], "action", "reason", "new_target")


def _attach(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    sizes = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return scale.join_back(rows, sizes.join(targets, key), [key], "id").drop("_n")


def sync_decisions(decisions: DataFrame, rescued: DataFrame) -> DataFrame:
    """Active decisions follow a re-hung duplicate; those whose canonical is now a duplicate retire."""
    moved = rescued.filter(F.col("action") == "rehang").select(F.col("id").alias("duplicate_event_id"), F.col("new_target").alias("_target"))
    pointed = decisions.join(moved, "duplicate_event_id", "left").withColumn(
        "canonical_event_id", F.when(F.col("active"), F.coalesce("_target", "canonical_event_id")).otherwise(F.col("canonical_event_id"))
    )
    demoted = rescued.filter(F.col("status") == "duplicate").select(F.col("id").alias("canonical_event_id"), F.lit(True).alias("_demoted"))
    return (
        pointed.join(demoted, "canonical_event_id", "left")
        .withColumn("active", F.col("active") & F.col("_demoted").isNull()).select(*decisions.columns)
    )
