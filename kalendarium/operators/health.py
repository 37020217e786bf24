"""Import monitoring over the run log, and the lifecycle steps that depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.functions.times import as_ntz, still_relevant

PRUNE_DAYS = 7
RETENTION_DAYS = 90
STALE_DAYS = 7
NO_MESSAGE = "Fehler ohne Meldung"


def _ago(now: str, days: int):
    return as_ntz(now) - F.make_dt_interval(days=F.lit(days))


def last_success(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status").isin("ok", "partial")).groupBy("source_id").agg(F.max("started_at").alias("last_success_at"))


def healthy_sources(runs: DataFrame, cutoff) -> DataFrame:
    """Sources with a real ok run that saw events since the cutoff."""
    good = (F.col("status") == "ok") & ~F.col("dry_run") & (F.col("seen") > 0) & (F.col("started_at") >= as_ntz(cutoff))
    return runs.filter(good).select("source_id").distinct()


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run per source, ties on the newest id. Mergeable aggregate, one row per source leaves each task."""
    return scale.pick_one(runs, ["source_id"], [F.col("started_at"), F.col("id")], largest=True)


def recent_seen(runs: DataFrame, now: str, n: int = 3, days: int = 3) -> DataFrame:
    """The newest ``n`` finished runs per source within ``days``: how many, and what they saw."""
    rows = runs.filter((F.col("status") != "running") & (F.col("started_at") >= _ago(now, days)))
    top = scale.top_per_group(rows.select("source_id", "id", "started_at", "seen"), ["source_id"], [F.desc("started_at"), F.desc("id")], n, "id")
    return top.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("seen").alias("seen_sum"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "seen"))), lambda r: r["seen"]).alias("seen"),
    )


def source_warnings(runs: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """Enabled sources whose last run failed, whose last success is stale, or that keep coming back empty."""
    latest = latest_run(runs).select("source_id", "status", "message")
    whole_days = F.abs(F.timestamp_diff("DAY", F.col("last_success_at"), as_ntz(now)))
    rows = (
        sources.filter("enabled").select(F.col("id").alias("source_id"))
        .join(latest, "source_id").join(last_success(runs), "source_id", "left")
        .join(recent_seen(runs, now).select("source_id", "runs", "seen_sum"), "source_id", "left")
    )
    warned = rows.select(
        "source_id",
        F.when(F.col("status") == "failed", F.coalesce("message", F.lit(NO_MESSAGE))).alias("failed"),
        F.when(whole_days > STALE_DAYS, whole_days).alias("stale_days"),
        F.coalesce((F.col("runs") >= 3) & (F.col("seen_sum") == 0), F.lit(False)).alias("zero_events"),
    )
    return warned.filter(F.col("failed").isNotNull() | F.col("stale_days").isNotNull() | F.col("zero_events"))


def recent_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def run_history(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest ``limit`` runs of every source at once."""
    return scale.top_per_group(runs, ["source_id"], [F.desc("started_at"), F.desc("id")], limit, "id")


def source_overview(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Enabled first, then latest run, never-run last."""
    latest = latest_run(runs).select(F.col("source_id").alias("id"), F.col("started_at").alias("last_started_at"), F.col("status").alias("last_run_status"))
    rows = sources.select("id", "name", "enabled").join(latest, "id", "left")
    return rows.orderBy(F.desc("enabled"), F.desc_nulls_last("last_started_at"), "name", "id")


def retain_runs(runs: DataFrame, now: str, days: int = RETENTION_DAYS) -> DataFrame:
    return runs.filter(F.col("started_at") >= _ago(now, days))


def hand_kept(source_type, external_id):
    """Rows no import refreshes: manual sources and hand-added ids."""
    return (source_type == "manual") | F.coalesce(external_id, F.lit("")).startswith("manual:")


def prune(events: DataFrame, sources: DataFrame, runs: DataFrame, now: str, days: int = PRUNE_DAYS, runs_now: str | None = None) -> DataFrame:
    """All events, with those a healthy source stopped listing hidden and marked."""
    cutoff = _ago(runs_now or now, days)
    sound = (
        sources.filter("enabled").join(healthy_sources(runs, cutoff).withColumnRenamed("source_id", "id"), "id", "left_semi")
        .select(F.col("id").alias("source_id"), F.col("type").alias("_type"))
    )
    gone = (
        (F.col("status") == "published") & still_relevant(now) & (F.col("last_seen_at") < _ago(now, days))
        & F.col("_type").isNotNull() & ~hand_kept(F.col("_type"), F.col("external_id"))
    )
    flagged = events.join(sound, "source_id", "left").withColumn("_gone", F.coalesce(gone, F.lit(False)))
    return flagged.withColumns({
        "status": F.when(F.col("_gone"), "hidden").otherwise(F.col("status")),
        "pruned_at": F.when(F.col("_gone"), as_ntz(now)).otherwise(F.col("pruned_at")),
    }).select(*events.columns)


def set_source_flags(sources: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Overlay of toggles and approvals; listings follow on their next run without touching events."""
    delta = changes.select("id", F.col("enabled").alias("_enabled"), F.col("approved").alias("_approved"))
    approved = F.when(F.col("_approved"), F.coalesce("approved_at", as_ntz(now))).when(~F.col("_approved"), F.lit(None).cast("timestamp_ntz")).otherwise(F.col("approved_at"))
    return sources.join(delta, "id", "left").withColumns({"enabled": F.coalesce("_enabled", "enabled"), "approved_at": approved}).select(*sources.columns)


def import_report(actions: DataFrame, fatal: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Tallies per source from the merge's action column (``error`` for rejected rows). A run is failed
    when its body could not be read (``fatal``: source_id, message) or when every row was rejected.
    Sources that were asked (``asked``: source_id) but yielded nothing get a row of zeros."""
    per = lambda name: F.count_if(F.col("action") == name)
    tally = actions.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("seen"), per("created").alias("created"), per("updated").alias("updated"),
        per("unchanged").alias("unchanged"), per("duplicate").alias("duplicates"), per("error").alias("errors"),
    )
    if asked is not None:
        counts = [c for c in tally.columns if c != "source_id"]
        tally = tally.join(asked, "source_id", "full").fillna(0, counts)
    if fatal is None:
        rows = tally.withColumn("message", F.lit(None).cast("string"))
    else:
        rows = tally.join(fatal.groupBy("source_id").agg(F.min("message").alias("message")), "source_id", "full")
        rows = rows.fillna(0, ["seen", "created", "updated", "unchanged", "duplicates", "errors"])
    all_rejected = F.when((F.col("seen") > 0) & (F.col("errors") == F.col("seen")), F.format_string("Alle %d Events konnten nicht gespeichert werden (siehe Log).", "seen"))
    rows = rows.withColumn("message", F.coalesce("message", all_rejected))
    status = F.when(F.col("message").isNotNull(), "failed").when(F.col("errors") > 0, "partial").otherwise("ok")
    return rows.withColumn("status", status)


def close_runs(report: DataFrame, started_at, finished_at) -> DataFrame:
    """Run-log rows for a finished import."""
    begin, end = as_ntz(started_at), as_ntz(finished_at)
    millis = F.timestamp_diff("MILLISECOND", begin, end)
    return report.select("source_id", begin.alias("started_at"), end.alias("finished_at"), millis.alias("duration_ms"),
                         "status", "seen", "created", "updated", "unchanged", "duplicates", "errors", F.lit(False).alias("dry_run"), "message")
