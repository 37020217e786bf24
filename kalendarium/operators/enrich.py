"""Model-assisted enrichment around an external judge: work lists in, proposals out.

A judge (outside this library) answers request batches with a ``proposals`` table; these operators
build the batches and apply the answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.functions.text import prompt_html, prompt_line, trim_edges
from kalendarium.functions.times import as_ntz
from kalendarium.model import CATCH_ALL
from kalendarium.operators.review import display_location

CATEGORY_BATCH, SUMMARY_BATCH = 25, 20
SUMMARY_CAP = 400


def has_real_category(slugs: Column) -> Column:
    return F.exists(F.coalesce(slugs, F.array().cast("array<string>")), lambda s: s != CATCH_ALL)


def split_modes(worklist: DataFrame, mode: str = "all") -> DataFrame:
    """``fill`` (no real category yet) or ``opinion``; a restricted run drops the other kind first."""
    marked = worklist.withColumn("mode", F.when(has_real_category(F.col("category_slugs")), "opinion").otherwise("fill"))
    return marked if mode == "all" else marked.filter(F.col("mode") == mode)


def _or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(prompt_line(c), F.lit("")), F.lit("—"))


def category_line() -> Column:
    text = prompt_html(F.col("description"), 240)
    return F.concat(
        F.lit("id="), F.col("id").cast("string"), F.lit(' | "'), prompt_line(F.col("title")), F.lit('" | Ort: '), _or_dash(display_location()),
        F.lit(" | Veranstalter: "), _or_dash(F.col("organizer")), F.when(text != "", F.concat(F.lit(" | "), text)).otherwise(""),
    )


def summary_line() -> Column:
    return F.concat(F.lit("id="), F.col("id").cast("string"), F.lit(' | Titel: "'), prompt_line(F.col("title")), F.lit('" | Text: '), prompt_html(F.col("description"), 1200))


def dedup_line() -> Column:
    clock = F.when(F.col("all_day"), "ganztägig").otherwise(F.date_format("starts_at", "HH:mm"))
    image = F.when(F.coalesce("image_url", F.lit("")) != "", "ja").otherwise("nein")
    text = prompt_html(F.col("description"), 200)
    return F.concat(
        F.lit("id="), F.col("id").cast("string"), F.lit(" | "), clock, F.lit(' | "'), prompt_line(F.col("title")), F.lit('" | '), _or_dash(display_location()),
        F.lit(" | Bild: "), image, F.lit(" | Veranstalter: "), _or_dash(F.col("organizer")), F.lit(" | Quelle: "), F.col("source_key"),
        F.when(text != "", F.concat(F.lit(" | "), text)).otherwise(""),
    )


def prompt_batches(worklist: DataFrame, line: Column, size: int, max_batches: int = 0) -> DataFrame:
    """Per region, soonest first: batches of ``size`` rows with one text each. Rows are numbered
    without sorting a region in one task; a batch holds ``size`` rows, so its text is bounded. A
    budget takes the first ``max_batches`` batches, region by region."""
    numbered = scale.number_rows(worklist.select("region_id", "starts_at", "id", line.alias("line")), ["region_id"], "starts_at", "id", "nr")
    batched = numbered.withColumn("batch_no", F.floor((F.col("nr") - 1) / size))
    if max_batches:
        sizes = numbered.groupBy("region_id").agg(F.ceil(F.max("nr") / size).alias("batches"))
        # one row per region
        earlier = F.coalesce(F.sum("batches").over(scale.W.orderBy("region_id").rowsBetween(scale.W.unboundedPreceding, -1)), F.lit(0))
        room = sizes.select("region_id", (F.lit(max_batches) - earlier).alias("room"))
        batched = batched.join(room, "region_id").filter(F.col("batch_no") < F.col("room")).drop("room")
    rows = batched.groupBy("region_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("nr", "id", "line"))).alias("rows"))
    return rows.select(
        "region_id", "batch_no", F.transform("rows", lambda r: r["id"]).alias("ids"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("prompt")
    )


def picked_slugs(primary: Column, secondary: Column, catalogue: Column) -> Column:
    """Primary and, when different, secondary; anything outside the catalogue is dropped. Null without a primary."""
    second = F.when(F.array_contains(catalogue, secondary) & (secondary != primary), secondary)
    return F.when(F.array_contains(catalogue, primary), F.array_compact(F.array(primary, second)))


def decide_categories(sent: DataFrame, proposals: DataFrame, catalogue: Column, now: str, model: str) -> DataFrame:
    """One decision per sent event (id, category_slugs, locked_fields). The last proposal of an event counts."""
    answers = scale.pick_one(
        proposals.withColumn("picked", picked_slugs(F.col("primary"), F.col("secondary"), catalogue)).filter(F.col("picked").isNotNull())
        .select(F.col("event_id").alias("id"), "position", "picked", F.trim(F.coalesce("reason", F.lit(""))).alias("said")),
        ["id"], [F.col("position")], largest=True,
    )
    rows = sent.select("id", F.coalesce("category_slugs", F.array().cast("array<string>")).alias("current"), "locked_fields").join(answers, "id", "left")
    none, pinned = F.col("picked").isNull(), F.array_contains("locked_fields", "categories")
    fill = ~has_real_category(F.col("current"))
    differs = ~F.array_contains("current", F.col("picked")[0])
    agreed = ~none & ~pinned & ~fill & ~differs
    status = F.when(none | pinned, "dismissed").when(agreed, "agreed").otherwise("applied")
    reason = F.when(none, "kein KI-Vorschlag").when(pinned, "Kategorien vom Admin gepinnt").when(~agreed, F.col("said"))
    return rows.select(
        F.col("id").alias("event_id"), F.when(none | fill, "fill").otherwise("opinion").alias("mode"), status.alias("status"),
        F.col("current").alias("previous_slugs"), F.when(none | agreed, F.col("current")).otherwise(F.col("picked")).alias("proposed_slugs"),
        reason.alias("reason"), F.lit(model).alias("model"), as_ntz(now).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
    )


def rewrite_categories(event_categories: DataFrame, categories: DataFrame, changed: DataFrame) -> DataFrame:
    """Bridge rows of the changed events (event_id, slugs) replaced by the given slugs."""
    kept = event_categories.join(changed.select("event_id"), "event_id", "left_anti")
    fresh = changed.select("event_id", F.explode("slugs").alias("slug")).join(categories.select(F.col("id").alias("category_id"), "slug"), "slug")
    return kept.unionByName(fresh.select("event_id", "category_id"))


def apply_categories(event_categories: DataFrame, categories: DataFrame, decided: DataFrame) -> DataFrame:
    applied = decided.filter(F.col("status") == "applied")
    return rewrite_categories(event_categories, categories, applied.select("event_id", F.col("proposed_slugs").alias("slugs")))


def review_categories(event_categories, categories, decisions: DataFrame, choices: DataFrame, events: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Human choices (id, choice: accept, dismiss, undo). Accept and dismiss settle pending decisions;
    undo restores what an applied one replaced, unless the event's categories are pinned."""
    pins = events.select(F.col("id").alias("event_id"), F.array_contains("locked_fields", "categories").alias("_pinned"))
    rows = decisions.join(choices.select("id", "choice"), "id", "left")
    pending, applied = F.col("status") == "pending", F.col("status") == "applied"
    accept, dismiss, undo = (F.coalesce(F.col("choice") == c, F.lit(False)) & s for c, s in (("accept", pending), ("dismiss", pending), ("undo", applied)))
    verdict = F.when(accept, "applied").when(dismiss, "dismissed").when(undo, "undone")
    judged = rows.withColumn("_to", verdict)
    changed = (
        judged.filter(F.col("_to").isin("applied", "undone")).join(pins, "event_id").filter((F.col("_to") == "applied") | ~F.col("_pinned"))
        .select("event_id", F.when(F.col("_to") == "applied", F.col("proposed_slugs")).otherwise(F.col("previous_slugs")).alias("slugs"))
    )
    log = judged.withColumns({
        "status": F.coalesce("_to", "status"), "reviewed_at": F.when(F.col("_to").isNotNull(), as_ntz(now)).otherwise(F.col("reviewed_at")),
    }).select(*decisions.columns)
    return rewrite_categories(event_categories, categories, changed), log


def reset_categories(event_categories, categories, decisions: DataFrame, events: DataFrame, region: int | None, now: str) -> tuple[DataFrame, DataFrame]:
    """Undo all applied decisions (of a region) and drop them; the next run starts afresh."""
    scope = events if region is None else events.filter(F.col("region_id") == region)
    hit = decisions.join(scope.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    bridge, _ = review_categories(event_categories, categories, hit, hit.select("id", F.lit("undo").alias("choice")), events, now)
    return bridge, decisions.join(hit.select("id"), "id", "left_anti")


def apply_summaries(events: DataFrame, sent: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed teasers (capped); a sent event without one gets an empty text and leaves the work list."""
    answers = scale.pick_one(
        proposals.select(F.col("event_id").alias("id"), "position", trim_edges("summary").alias("text")).filter(F.col("text") != ""),
        ["id"], [F.col("position")], largest=True,
    ).select("id", F.left("text", F.lit(SUMMARY_CAP)).alias("_text"))
    asked = sent.select("id", F.lit(True).alias("_sent")).distinct()
    rows = events.join(asked, "id", "left").join(answers, "id", "left")
    return rows.withColumn("summary", F.when(F.col("_sent"), F.coalesce("_text", F.lit(""))).otherwise(F.col("summary"))).select(*events.columns)
