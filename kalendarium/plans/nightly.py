"""Nightly maintenance as steps of the state: key pass with rescue and decision sync, prune with log
retention, and the three passes that apply judged proposals (duplicates, categories, teasers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.operators import enrich, health, listing, resolve, review
from kalendarium.session import cut_lineage
from kalendarium.sources.state import State, current


def rededup(spark: SparkSession, root: str, now: str) -> State:
    state = current(spark, root)
    events, decisions, sources = (state.read(n) for n in ("events", "dedup_decisions", "sources"))
    rescued = resolve.rescue(resolve.rededup(events, sources, now), sources, decisions, now)
    return state.commit(f"rededup-{state.number + 1}", {"events": rescued.select(*events.columns), "dedup_decisions": resolve.sync_decisions(decisions, rescued)})


def prune(spark: SparkSession, root: str, now: str) -> State:
    """Weekly: hide what healthy sources stopped listing; the run log becomes one part without old rows."""
    state = current(spark, root)
    events, runs, sources = (state.read(n) for n in ("events", "import_runs", "sources"))
    return state.commit(f"prune-{state.number + 1}", {"events": health.prune(events, sources, runs, now), "import_runs": health.retain_runs(runs, now)})


def _visible(state: State, now: str) -> DataFrame:
    """What the passes look at; row groups that only hold past events are skipped."""
    return listing.visible(listing.enrich(state.read("events", relevant_from=now), state.read("venues"), state.read("sources")))


def _logged(old: DataFrame, new: DataFrame, number: int, order: str) -> DataFrame:
    """New log rows under the step's own id range, numbered in buckets of their keys."""
    numbered = scale.number_keys(new, F.col(order).cast("string"), "_number").withColumn("id", F.lit(number * 1_000_000_000) + F.col("_number"))
    return old.unionByName(numbered.select(*old.columns))


def review_duplicates(spark: SparkSession, root: str, proposals: DataFrame, now: str, model: str, budget: int | None = None) -> State:
    """Apply the valid judged pairs (region_id, day, position, duplicate_id, canonical_id, reason) of the
    days on the work list, log them, and remember each day's fingerprint without what was merged away."""
    state = current(spark, root)
    events, decisions, days = (state.read(n) for n in ("events", "dedup_decisions", "dedup_days"))
    sets = cut_lineage(review.day_sets(_visible(state, now), now))
    work = cut_lineage(review.worklist(sets, days, budget))
    judged = proposals.join(work.filter("state = 'review'").select("region_id", "day"), ["region_id", "day"], "left_semi")
    valid = review.valid_proposals(judged, sets, events, review.veto_pairs(decisions))
    accepted = cut_lineage(review.accept_in_order(valid))
    merged, log = review.apply_merges(events, accepted, now, model)
    prints = review.remaining_fingerprints(sets, accepted).join(work.select("region_id", "day"), ["region_id", "day"], "left_semi")
    fresh = prints.select("region_id", "day", "fingerprint", F.lit(now).cast("timestamp_ntz").alias("reviewed_at"))
    kept = days.join(fresh.select("region_id", "day"), ["region_id", "day"], "left_anti")
    changed = {"events": merged, "dedup_decisions": _logged(decisions, log, state.number + 1, "duplicate_event_id"), "dedup_days": kept.unionByName(fresh.select(*kept.columns))}
    return state.commit(f"review-{state.number + 1}", changed)


def categorize(spark: SparkSession, root: str, proposals: DataFrame, now: str, model: str) -> State:
    """Decide on the proposals (event_id, position, primary, secondary, reason) for unchecked events."""
    state = current(spark, root)
    bridge, categories, decisions = (state.read(n) for n in ("event_categories", "categories", "category_decisions"))
    sent = listing.with_categories(listing.unchecked(_visible(state, now), decisions, now), bridge, categories)
    # a dimension of a few rows
    catalogue = F.array(*[F.lit(r["slug"]) for r in categories.select("slug").collect()])
    decided = cut_lineage(enrich.decide_categories(sent, proposals, catalogue, now, model))
    changed = {"event_categories": enrich.apply_categories(bridge, categories, decided), "category_decisions": _logged(decisions, decided, state.number + 1, "event_id")}
    return state.commit(f"categories-{state.number + 1}", changed)


def summarize(spark: SparkSession, root: str, proposals: DataFrame, now: str) -> State:
    """Store the proposed teasers (event_id, position, summary) of events that need one."""
    state = current(spark, root)
    sent = listing.needs_summary(_visible(state, now), now)
    return state.commit(f"summaries-{state.number + 1}", {"events": enrich.apply_summaries(state.read("events"), sent, proposals)})
