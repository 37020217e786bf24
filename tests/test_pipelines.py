"""Merge, resolution, review, places and streaming behaviour: literals, idempotence, invariants, brute force."""

import datetime
import hashlib
import itertools
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from kalendarium import model
from kalendarium.catalog import extract as catalog_extract
from kalendarium.catalog import health as catalog_health
from kalendarium.catalog import resolve as catalog_resolve
from kalendarium.catalog.resolve import _chain_proposals, _sets
from kalendarium.catalog.tables import NOW, Tables
from kalendarium.functions.similarity import covered
from kalendarium.operators import enrich, listing, merge, places, resolve, review
from kalendarium.plans import nightly
from kalendarium.plans.listing_page import listing_page
from kalendarium.sinks import exports
from kalendarium.sources import regional
from kalendarium.sources.state import current
from kalendarium.sources.tables import read_table, write_snapshot
from kalendarium.streaming import imports, visits
from tests.helpers import at, events, incoming, regions, rows, sources, table

SF = "/root/testdata/sf0.001"
NOW_T = "2026-06-15 12:00:00"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def run(spark, stored, batch, decisions=(), bridge=(), **kw):
    cats = spark.createDataFrame([(i + 1, s) for i, s in enumerate(model.CATEGORY_SLUGS)], "id long, slug string")
    return merge.upsert(
        stored, spark.createDataFrame(list(bridge), model.EVENT_CATEGORIES), batch, kw.get("sources", sources(spark)), regions(spark), table(spark, model.VENUES, []), cats,
        table(spark, model.CATEGORY_DECISIONS, list(decisions)), NOW_T,
    )


def test_listings_come_from_one_pass(t):
    for df in (t.occurrences, t.incoming):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("o_orderdate") > 0
        assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 6


@pytest.mark.parametrize("name", ["candidate_days", "review_worklist"])
def test_review_reads_stored_sets(spark, name):
    plan = catalog_resolve.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan


def test_entities_are_grouped_once(spark):
    staged = []
    none = spark.createDataFrame([], model.EVENT_CATEGORIES)
    cats = spark.createDataFrame([(1, "kunst")], "id long, slug string")
    stage = lambda df: staged.append(df.columns) or df
    merge.upsert(events(spark, []), none, incoming(spark, [{}]), sources(spark), regions(spark), table(spark, model.VENUES, []), cats, table(spark, model.CATEGORY_DECISIONS, []), NOW_T, stage)
    assert any("new_text" in columns and "venue_id" not in columns for columns in staged)


def test_content_moves_once_before_the_stored_rows_meet_it(spark):
    """Matching, order, venue, duplicate and new id are found on keys and digests; the batch is the one staged table of whole rows."""
    staged = []
    cats, none = spark.createDataFrame([(1, "kunst")], "id long, slug string"), table(spark, model.CATEGORY_DECISIONS, [])
    stored = events(spark, [{"id": 1, "external_id": "x", "description": "alt", "content_hash": "h"}])
    batch = incoming(spark, [{"external_id": "x", "description": "neu", "venue_name": "Saal"}, {"external_id": "x", "description": "neuer"}, {"external_id": "n", "title": "Neu"}])
    stage = lambda df: staged.append(merge.cut_lineage(df)) or staged[-1]
    out = merge.upsert(stored, spark.createDataFrame([], model.EVENT_CATEGORIES), batch, sources(spark), regions(spark), table(spark, model.VENUES, []), cats, none, NOW_T, stage)
    assert rows(out.events, "id", "description") == [(1, "neuer"), (2, None)]
    assert rows(out.actions, "position", "action") == [(0, "updated"), (1, "updated"), (2, "created")]
    assert [i for i, df in enumerate(staged) if "description" in df.columns] == [0]
    verdicts = [df for df in staged if "action" in df.columns]
    assert len(verdicts) == 1 and not {"title", "description", "content_hash"} & set(verdicts[0].columns)


def test_merge_creates_then_is_unchanged(spark):
    batch = incoming(spark, [{"title": "A", "external_id": "1", "venue_name": "Saal", "city": "Isselhorst"}, {"title": "B", "starts_at": at("2026-07-03 10:00")}, {"title": ""}, {"title": "A2", "external_id": "1"}])
    first = run(spark, events(spark, []), batch)
    assert rows(first.actions, "action") == ["created", "created", "unchanged"]
    stored = merge.cut_lineage(first.events)
    assert rows(stored, "title", "status") == [("A", "published"), ("B", "published")]
    assert rows(first.venues, "name", "city") == [("Saal", "Gütersloh")]
    again = merge.upsert(stored, first.event_categories, incoming(spark, [{"title": "A", "external_id": "1", "venue_name": "Saal", "city": "Isselhorst"}]), sources(spark), regions(spark), first.venues,
                         spark.createDataFrame([(1, "musik")], "id long, slug string"), table(spark, model.CATEGORY_DECISIONS, []), "2026-06-16 12:00:00")
    assert rows(again.actions, "action") == ["unchanged"] and again.venues.count() == 1 and again.events.count() == 2


def test_changed_text_clears_summary_and_decided_categories_stay(spark):
    stored = events(spark, [{"id": 1, "external_id": "x", "description": "alt", "summary": "s", "content_hash": "h"}, {"id": 2, "external_id": "y", "description": "gleich", "summary": "s", "content_hash": "h"}])
    batch = incoming(spark, [{"external_id": "x", "description": "neu", "category_slugs": ["party"]}, {"external_id": "y", "description": "gleich", "category_slugs": ["party"]}])
    out = run(spark, stored, batch, [{"id": 1, "event_id": 1, "status": "applied"}], [(1, 1), (2, 1)])
    assert rows(out.events, "id", "description", "summary") == [(1, "neu", None), (2, "gleich", "s")]
    assert rows(out.event_categories, "event_id", "category_id") == [(1, 1), (2, 2)]


def test_locks_republish_and_demotion(spark):
    stored = events(spark, [
        {"id": 1, "external_id": "x", "title": "Fest", "locked_fields": ["title", "datum"], "status": "hidden", "pruned_at": at("2026-06-01"), "content_hash": "h"},
        {"id": 2, "external_id": "z", "title": "Hand", "status": "hidden", "content_hash": "h"},
        {"id": 3, "source_id": 2, "title": "Gala", "dedup_key": "gala|2026-07-01 2000|verl"},
    ])
    batch = incoming(spark, [{"external_id": "x", "title": "Neu", "starts_at": at("2027-01-01")}, {"external_id": "z", "title": "Hand 2"}, {"external_id": "g", "title": "Gala", "city": "Verl"}])
    out = run(spark, stored, batch, sources=sources(spark, [{"id": 1}, {"id": 2}]))
    got = {r.external_id: r for r in out.events.collect() if r.source_id == 1}
    assert (got["x"].title, got["x"].starts_at, got["x"].status, got["x"].pruned_at) == ("Fest", at("2026-07-01 20:00"), "published", None)
    assert got["z"].status == "hidden" and (got["g"].status, got["g"].duplicate_of) == ("duplicate", 3)
    assert rows(out.actions, "action") == ["duplicate", "updated", "updated"]


@pytest.mark.parametrize("raw, key, expected", [
    ("Guetersloh", "guetersloh", "Gütersloh"), ("Gütersloh-Isselhorst", "guetersloh", "Gütersloh"), ("Marienfeld", "guetersloh", "Harsewinkel"), ("Halle Westfalen", "guetersloh", "Halle (Westf.)"),
    ("Verlar", "paderborn", "Verlar"), ("Delbruck", "paderborn", "Delbrück"), ("Delbrück-Ost", "paderborn", "Delbrück"), ("  ", "paderborn", None),
])
def test_cities(spark, raw, key, expected):
    region = regions(spark, [{"id": 1, "key": key, "cities": ["Delbrück"] if key == "paderborn" else [], "city_aliases": {"delbruck": "Delbrück"} if key == "paderborn" else {}}])
    df = spark.createDataFrame([(1, raw)], "region_id long, city string")
    assert places.normalize_city(df, region).first()["city"] == expected


def test_region_match(spark):
    region = regions(spark, [{"id": 1, "key": "x", "default_city": "Kreis", "cities": ["Kreis", "Verl", "Rietberg"], "city_aliases": {"kaunitz": "Verl", "bad": "Kreis"}}])
    data = [(1, "T", "V", "", "33415 Verl", ""), (1, "T", "V", "", "Köln", "33 330"), (1, "Turnier in Kaunitz", "V", "", "", ""), (1, "T", "Reitverein Rietbergwest", "", "", ""), (1, "T", "V", "Verler Weg", "", ""), (1, "bad", "", "", "", "")]
    df = spark.createDataFrame(data, "region_id long, title string, venue_name string, address string, city string, zip string")
    got = [r["matched_city"] for r in places.region_match(df, region, F.array(F.lit("333"))).orderBy("title", "venue_name", "address", "city").collect()]
    assert sorted(got, key=str) == ["Kreis", None, None, "Rietberg", "Verl", "Verl"]


def test_rededup_leaves_one_published_per_key_and_is_idempotent(t):
    once = merge.cut_lineage(resolve.rededup(t.events, t.sources, NOW))
    groups = once.filter("group_size >= 2").groupBy("region_id", "dedup_key").agg(F.count_if(F.col("status") == "published").alias("n"))
    assert groups.filter("n <> 1").isEmpty() and not once.filter("flip is not null").isEmpty()
    twice = resolve.rededup(once.select(*t.events.columns), t.sources, NOW)
    assert twice.filter("flip is not null").isEmpty()


def test_rescue_leaves_no_link_onto_a_duplicate_except_kept(t):
    out = merge.cut_lineage(resolve.rescue(resolve.rededup(t.events, t.sources, NOW), t.sources, t.decisions, NOW))
    targets = out.select(F.col("id").alias("duplicate_of"), F.col("status").alias("target"))
    moved = out.filter("action in ('rehang')").join(targets, "duplicate_of")
    assert moved.filter("target <> 'published'").isEmpty()


def test_chain_end_cycles_and_holes(spark):
    links = {1: None, 2: 1, 3: 2, 4: 5, 5: 4, 6: 99, 7: 3, 8: 4}
    stored = events(spark, [{"id": i, "status": "published" if i == 1 else "duplicate", "duplicate_of": d} for i, d in links.items()])
    assert rows(resolve.chain_end(stored), "id", "end_id") == [(2, 1), (3, 1), (4, None), (5, None), (6, None), (7, 1), (8, None)]


def test_long_chain(spark):
    stored = events(spark, [{"id": i, "status": "duplicate" if i else "published", "duplicate_of": i - 1 if i else None} for i in range(60)])
    assert set(rows(resolve.chain_end(stored), "end_id")) == {0}


def test_accept_in_order_against_a_loop(spark):
    rng = random.Random(5)
    proposals = [(1, at("2026-06-01").date(), i, *rng.sample(range(25), 2), "r") for i in range(120)]
    df = spark.createDataFrame(proposals, "region_id long, day date, position long, duplicate_id long, canonical_id long, reason string")
    gone, kept = set(), []
    for p in proposals:
        if p[3] not in gone and p[4] not in gone:
            gone.add(p[3])
            kept.append(p[2])
    assert rows(review.accept_in_order(df), "position") == sorted(kept, key=repr)


def naive_candidate(day_events):
    for a, b in itertools.combinations(sorted(day_events, key=lambda e: (e["starts_at"], e["id"])), 2):
        x, y = a["t"], b["t"]
        if x and y:
            short, long = sorted((x, y), key=len)
            if x == y or (len(short) >= 5 and short in long) or 2 * covered(x, y) * 100 / (len(x) + len(y)) >= 60:
                return True
        if a["clock"] == b["clock"] and set(a["tokens"]) & set(b["tokens"]):
            return True
    return False


def test_candidate_days_against_all_pairs(spark):
    rng = random.Random(11)
    words = ["jazz", "kino", "markt", "lesung", "orgel", "tanztee", "flohmarkt", "qigong", "yoga", "repaircafe", "chor", "zumba", "bingo"]
    data = []
    for i in range(160):
        title = " ".join(rng.sample(words, rng.choice([1, 1, 2])))
        data.append({"id": i, "title": title, "starts_at": at(f"2026-07-{rng.randrange(1, 29):02d} {rng.randrange(8, 22):02d}:00"), "location_text": rng.choice(["Halle Verl", "Saal", None, "Markt 1"]), "region_id": rng.randrange(3)})
    rich = events(spark, data).withColumns({"venue_name": F.lit(None).cast("string"), "venue_city": F.lit(None).cast("string")})
    sets = review.day_sets(rich, NOW_T)
    shaped = sets.select("region_id", "day", "id", "starts_at", review.normalize_title(F.col("title")).alias("t"), F.date_format("starts_at", "HH:mm").alias("clock"), review.location_tokens(review.display_location()).alias("tokens"))
    by_day = {}
    for r in shaped.collect():
        by_day.setdefault((r.region_id, r.day), []).append(r.asDict())
    expected = sorted(k for k, v in by_day.items() if naive_candidate(v))
    assert sorted(rows(review.candidate_days(sets), "region_id", "day")) == expected and 0 < len(expected) < len(by_day)


def test_similar_titles_against_all_pairs(t):
    sets = merge.cut_lineage(_sets(t, 400).withColumn("title", F.concat(F.col("title"), F.lit(" "), (F.col("id") % 7).cast("string"), F.col("venue_id").cast("string"))))
    expected = set()
    listed = sets.select("region_id", "day", "starts_at", "id", review.normalize_title(F.col("title")).alias("t")).filter("t <> ''").collect()
    by_day = {}
    for r in sorted(listed, key=lambda r: (r.starts_at, r.id)):
        by_day.setdefault((r.region_id, r.day), []).append(r.t)
    for day, titles in by_day.items():
        if any(a != b and 2 * covered(a, b) * 100 / (len(a) + len(b)) >= 60 for a, b in itertools.combinations(titles, 2)):
            expected.add(day)
    got = set(rows(review.days_with_similar_titles(sets), "region_id", "day"))
    assert got == expected


@pytest.mark.parametrize("id_range", [65_536, 100])
def test_day_fingerprints_by_hand(t, monkeypatch, id_range):
    monkeypatch.setattr(review, "ID_RANGE", id_range)
    sets, days = _sets(t), {}
    for r in sets.select("region_id", "day", "id").collect():
        days.setdefault((r["region_id"], r["day"]), []).append(r["id"])
    digest = lambda parts: hashlib.sha1(",".join(parts).encode()).hexdigest()
    expected = []
    for (region, day), ids in days.items():
        ranges = [digest(map(str, part)) for _, part in itertools.groupby(sorted(ids), lambda i: i // id_range)]
        expected.append((region, day, len(ids), digest(ranges)))
    for given in (sets, sets.repartition(7)):
        assert rows(review.day_fingerprints(given), "region_id", "day", "n", "fingerprint") == sorted(expected, key=repr)


def test_budget_stops_the_worklist(t):
    none = t.spark.createDataFrame([], "region_id long, day date, fingerprint string")
    full = review.worklist(_sets(t), none, budget=10_000)
    short = review.worklist(_sets(t), none, budget=3)
    assert short.filter("state = 'review'").count() == min(3, full.filter("state = 'review'").count())


def test_merge_then_undo_restores(t):
    accepted = review.accept_in_order(_chain_proposals(t))
    after, log = review.apply_merges(t.events, accepted, NOW, "m")
    log = log.withColumn("id", F.col("duplicate_event_id"))
    back, marked = review.undo_merges(merge.cut_lineage(after), merge.cut_lineage(log), log.select("id"), NOW, True)
    assert rows(back, "id", "status", "duplicate_of") == rows(t.events, "id", "status", "duplicate_of")
    assert marked.filter("active or undone_by_admin_at is null").isEmpty()


def test_prompt_budget(t):
    rows_ = listing.needs_summary(listing.visible(listing.enrich(t.events, t.venues, t.sources)), NOW)
    batches = enrich.prompt_batches(rows_, enrich.summary_line(), 3, 4)
    assert batches.count() == 4


def test_late_visits_are_kept_and_the_state_is_evicted(t, tmp_path):
    folder = str(tmp_path / "late")
    catalog_extract._late_arrivals(t, folder)
    keys = ("region_id", "route")
    late = visits.late_views(t.spark, folder, *keys).agg(F.sum("views")).first()[0]
    whole = catalog_health.prepared_visits(t).groupBy("day", *keys).agg(F.count(F.lit(1)).alias("views"))
    assert late > 0
    assert sorted(map(str, visits.all_views(t.spark, folder, *keys).select("day", *keys, "views").collect())) == sorted(map(str, whole.select("day", *keys, "views").collect()))
    # the state store itself holds no hour older than the watermark of a day, of many seen
    held = visits.stored_windows(t.spark, f"{folder}/checkpoint").agg(F.min("window.end").alias("low"), F.count(F.lit(1)).alias("n")).first()
    newest = catalog_health.prepared_visits(t).agg(F.max(F.col("ts").cast("timestamp_ltz"))).first()[0]
    assert 0 < held["n"] < whole.count() and held["low"] > newest - datetime.timedelta(days=1)


def test_visitor_tokens_leave_the_state(t, tmp_path):
    stream = catalog_extract._visit_stream(t)
    for _ in range(2):  # the second start runs the batch without rows that evicts, if the first has not
        query = visits.update_log(visits.stream_visitors(stream), str(tmp_path / "log"), str(tmp_path / "cp"), "append")
        query.awaitTermination()
    seen = t.spark.read.parquet(str(tmp_path / "log")).count()
    assert 0 < t.spark.read.format("statestore").load(str(tmp_path / "cp")).count() < seen / 2


ICS = "BEGIN:VEVENT\nSUMMARY:{0}\nUID:{0}\nDTSTART:20260720T200000\nEND:VEVENT\n"
BODY = "source_id long, url string, position long, body string"


def _started(spark, root):
    src = sources(spark, [{"id": 1, "importer": "ics"}, {"id": 2, "importer": "rss", "key": "r"}, {"id": 3, "importer": "ics", "key": "q"}])
    cats = spark.createDataFrame([(1, "musik"), (2, "sonstiges")], "id long, slug string").withColumns({"name": F.col("slug"), "sort_order": F.col("id").cast("int")})
    return current(spark, root).commit("start", {"sources": src, "regions": regions(spark), "categories": cats})


def _arrive(spark, folder, bodies):
    spark.createDataFrame(bodies, BODY).write.mode("append").parquet(folder)


def test_imports_and_nightly_passes_lose_nothing(spark, tmp_path):
    """Import, key pass, import, prune, import, with restarts and a replayed batch between."""
    root, drop = str(tmp_path / "state"), str(tmp_path / "bodies")
    _started(spark, root)

    def run(now):
        imports.stream_import(spark.readStream.schema(BODY).parquet(drop), root, str(tmp_path / "cp"), now, ["ics", "rss"]).awaitTermination()

    _arrive(spark, drop, [(1, "u", 0, ICS.format("X")), (2, "v", 0, "<html>weg"), (3, "w", 0, "BEGIN:VCALENDAR\nEND:VCALENDAR")])
    run("2026-07-01 12:00:00")
    run("2026-07-01 12:00:00")  # a restart finds nothing new
    state = current(spark, root)
    assert rows(state.read("events"), "title", "external_id") == [("X", "X")]
    assert rows(state.read("import_runs"), "source_id", "status", "seen", "created") == [(1, "ok", 1, 1), (2, "failed", 0, 0), (3, "ok", 0, 0)]
    number = state.number
    again = imports.import_batch(spark, root, spark.createDataFrame([(1, "u", 0, ICS.format("X"))], BODY), "2026-07-01 12:00:00", ["ics", "rss"], str(tmp_path / "cp") + "#0")
    assert rows(again, "source_id") == [1, 2, 3] and current(spark, root).number == number

    nightly.rededup(spark, root, "2026-07-02 03:00:00")
    impossible = "BEGIN:VEVENT\nSUMMARY:Alt\nUID:a\nDTSTART:09990101T100000\nEND:VEVENT\n"
    _arrive(spark, drop, [(1, "u", 0, ICS.format("X") + impossible + ICS.format("Y"))])
    run("2026-07-02 12:00:00")
    nightly.prune(spark, root, "2026-07-03 03:00:00")
    _arrive(spark, drop, [(1, "u", 0, ICS.format("Z"))])
    run("2026-07-03 12:00:00")

    state = current(spark, root)
    assert rows(state.read("events"), "title", "status") == [("X", "published"), ("Y", "published"), ("Z", "published")]
    log = rows(state.read("import_runs"), "source_id", "status", "seen", "created", "unchanged", "errors")
    assert log == [(1, "ok", 1, 1, 0, 0), (1, "ok", 1, 1, 0, 0), (1, "partial", 3, 1, 1, 1), (2, "failed", 0, 0, 0, 0), (3, "ok", 0, 0, 0, 0)]
    assert len({r["id"] for r in state.read("import_runs").collect()}) == 5
    # ten days later the log begins anew, the state stays
    nightly.prune(spark, root, "2026-10-15 03:00:00")
    assert current(spark, root).read("import_runs").isEmpty() and current(spark, root).read("events").count() == 3


def test_an_uncommitted_step_leaves_no_trace(spark, tmp_path):
    root = str(tmp_path)
    state = _started(spark, root)
    write_snapshot(events(spark, [{"id": 9}]), root, "events", state.number + 1)  # what a failed step left
    assert current(spark, root).read("events").isEmpty()
    state.commit("retry", {"events": events(spark, [{"id": 1}])})
    assert rows(current(spark, root).read("events"), "id") == [1]


def test_passes_over_the_state(spark, tmp_path):
    root, now = str(tmp_path), "2026-07-01 12:00:00"
    day = at("2026-07-20").date()
    rows_ = [{"id": 1, "title": "Sommerfest im Park", "description": "lang"}, {"id": 2, "title": "Sommerfest Park", "description": "lang", "dedup_key": "b"}]
    _started(spark, root).commit("rows", {"events": events(spark, [{**r, "starts_at": at("2026-07-20 20:00")} for r in rows_])})
    pairs = spark.createDataFrame([(1, day, 1, 2, 1, "gleich")], "region_id long, day date, position long, duplicate_id long, canonical_id long, reason string")
    nightly.review_duplicates(spark, root, pairs, now, "m")
    state = current(spark, root)
    assert rows(state.read("events"), "id", "status", "duplicate_of") == [(1, "published", None), (2, "duplicate", 1)]
    assert rows(state.read("dedup_decisions"), "duplicate_event_id", "canonical_event_id", "active") == [(2, 1, True)]
    assert state.read("dedup_days").count() == 1
    proposals = spark.createDataFrame([(1, 1, "musik", None, "passt"), (2, 2, "musik", None, "")], "event_id long, position long, primary string, secondary string, reason string")
    nightly.categorize(spark, root, proposals, now, "m")
    nightly.summarize(spark, root, spark.createDataFrame([(1, 1, "Ein Fest.")], "event_id long, position long, summary string"), now)
    state = current(spark, root)
    assert rows(state.read("event_categories"), "event_id", "category_id") == [(1, 1)]
    assert rows(state.read("category_decisions"), "event_id", "status") == [(1, "applied")]
    assert rows(state.read("events"), "id", "summary") == [(1, "Ein Fest."), (2, None)]


def test_listing_page_plan(t):
    out = listing_page(t.events, t.venues, t.sources, t.event_categories, t.categories, listing.Filter(), NOW, limit=10).collect()
    assert len(out) == 10 and [r.effective_start for r in out] == sorted(r.effective_start for r in out)
    assert all(r.category_slugs for r in out) and any(r.occurrences for r in out)


def test_nightly_plan_writes_new_versions(t, tmp_path):
    root = str(tmp_path)
    before = current(t.spark, root).commit("start", {"events": t.events, "dedup_decisions": t.decisions, "sources": t.sources}).read("events")
    after = nightly.rededup(t.spark, root, NOW).read("events")
    assert before.count() == after.count() and before.select("id", "status").exceptAll(after.select("id", "status")).count() > 0


def _scanned(df):
    df.collect()
    found = []

    def walk(plan):
        if plan.nodeName().startswith("Scan"):
            found.append(plan.metrics().apply("numOutputRows").value())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_stored_events_skip_row_groups_of_the_past(t, tmp_path):
    write_snapshot(t.events, str(tmp_path), "events", 1)
    late = "2001-01-01 12:00:00"
    every = read_table(t.spark, str(tmp_path), "events", 1)
    pruned = read_table(t.spark, str(tmp_path), "events", 1, relevant_from=late)
    assert rows(pruned.filter(listing.still_relevant(late)), "id") == rows(every.filter(listing.still_relevant(late)), "id")
    assert _scanned(read_table(t.spark, str(tmp_path), "events", 1, relevant_from="2030-01-01").select("id")) == 0


def _two_regions(spark, tmp_path, name, count=40):
    """A store of two regions, sources 1 and 2, with its plain tables."""
    src = sources(spark, [{"id": 1, "region_id": 1}, {"id": 2, "region_id": 2, "key": "zwei"}])
    both = table(spark, model.REGIONS, [{"id": r, "key": f"r{r}", "default_city": "Ort", "enabled": True, "cities": [], "host_aliases": []} for r in (1, 2)])
    stored = merge.cut_lineage(events(spark, [
        {"id": i, "source_id": 1 + i % 2, "region_id": 1 + i % 2, "external_id": f"e{i}", "dedup_key": f"k{i}", "content_hash": "h", "title": f"T{i}"} for i in range(count)]))
    bridge = spark.createDataFrame([(i, 1) for i in range(count)], model.EVENT_CATEGORIES)
    store = regional.Regional(spark, str(tmp_path / name), buckets=4)
    store.start(stored, bridge, table(spark, model.VENUES, []))
    return store, src, both, stored, bridge


def _files(store, table, region):
    folder = pathlib.Path(store.root, table, f"region_id={region}")
    return {(p.name, p.stat().st_mtime_ns) for p in folder.glob("*.parquet")}


def test_regional_merge_writes_the_regions_of_its_batch(spark, tmp_path):
    store, src, both, stored, bridge = _two_regions(spark, tmp_path, "store")
    cats, none = spark.createDataFrame([(1, "musik")], "id long, slug string"), table(spark, model.CATEGORY_DECISIONS, [])
    batch = merge.cut_lineage(incoming(spark, [
        {"source_id": 2, "external_id": "e1", "title": "T1 neu", "venue_name": "Saal"}, {"source_id": 2, "external_id": "neu", "title": "Frisch", "category_slugs": ["musik"]}]))
    tables = ("events", "event_categories", "own", "shared")
    before = {x: (_files(store, x, 1), _files(store, x, 2)) for x in tables}
    actions = store.merge("a", batch, src, both, cats, none, NOW_T)
    assert rows(actions, "action") == ["created", "updated"]
    for x in tables:
        assert before[x][0] and _files(store, x, 1) == before[x][0]
        assert _files(store, x, 2) != before[x][1]
    whole = merge.upsert(stored, bridge, batch, src, both, table(spark, model.VENUES, []), cats, none, NOW_T)
    compared = [c for c in model.EVENT_COLUMNS if c not in ("raw", "locked_fields")]
    assert sorted(map(str, store.events().select(*compared).collect())) == sorted(map(str, whole.events.select(*compared).collect()))
    assert rows(store.bridge().drop("region_id"), "event_id", "category_id") == rows(whole.event_categories, "event_id", "category_id")
    # a step done before changes nothing; the same rows as another step are known
    assert store.merge("a", batch, src, both, cats, none, NOW_T).isEmpty()
    assert rows(store.merge("b", batch, src, both, cats, none, NOW_T), "action") == ["unchanged", "unchanged"]


def test_regional_step_left_open_is_carried_out_when_the_store_is_opened(spark, tmp_path, monkeypatch):
    store, src, both, _, _ = _two_regions(spark, tmp_path, "store")
    cats, none = spark.createDataFrame([(1, "musik")], "id long, slug string"), table(spark, model.CATEGORY_DECISIONS, [])
    batch = incoming(spark, [{"source_id": 2, "external_id": "neu", "title": "Frisch"}, {"source_id": 2, "external_id": "e1", "title": "Anders"}])
    log = regional.Regional._log

    def lost(self, step, state, touched):
        if state == "done":
            raise RuntimeError("driver lost")
        log(self, step, state, touched)

    with monkeypatch.context() as m:
        m.setattr(regional.Regional, "_log", lost)
        with pytest.raises(RuntimeError):
            store.merge("a", batch, src, both, cats, none, NOW_T)
        m.setattr(regional.Regional, "_write", lambda self, *a: None)
        with pytest.raises(RuntimeError):
            store.merge("a", batch, src, both, cats, none, NOW_T)
    opened = regional.Regional(spark, store.root, buckets=4)
    assert opened.events().filter("title IN ('Frisch', 'Anders')").count() == 2 and opened.events().count() == 41
    assert opened.merge("a", batch, src, both, cats, none, NOW_T).isEmpty()


def test_a_region_left_without_categories_is_overwritten(spark, tmp_path):
    store, src, both, _, _ = _two_regions(spark, tmp_path, "store", 2)
    cats, none = spark.createDataFrame([(1, "musik")], "id long, slug string"), table(spark, model.CATEGORY_DECISIONS, [])
    store.merge("a", incoming(spark, [{"source_id": 2, "external_id": "e1", "title": "Anders", "category_slugs": []}]), src, both, cats, none, NOW_T)
    assert rows(store.bridge(), "event_id", "region_id") == [(0, 1)]


def test_key_lookup_leaves_the_stored_keys_where_they_are(spark, tmp_path):
    store, src, both, stored, _ = _two_regions(spark, tmp_path, "store")
    batch = merge.cut_lineage(merge.prepare_incoming(incoming(spark, [{"source_id": 2, "external_id": f"e{i}"} for i in range(50)]), src, both))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.match(batch)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert rows(found.filter("matched_id IS NOT NULL"), "matched_id") == sorted(range(1, 40, 2), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    # the only exchange deals the batch; between the key table and the joins there is none
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM")


def test_calendar_files_split_a_region_in_order(t, tmp_path):
    path = str(tmp_path / "ics")
    wanted = catalog_extract._categories_named(t).filter("region_id = 1")
    exports.export_ics(wanted, path, 25)
    texts = {int(f.parent.name[5:]): f.read_bytes().decode() for f in pathlib.Path(path).glob("region_id=1/file=*/*.txt")}
    count = wanted.count()
    assert count > 50 and sorted(texts) == list(range((count + 24) // 25))
    for text in texts.values():
        assert text.startswith("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n") and text.endswith("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
        assert text.count("BEGIN:VEVENT") <= 25 and "\n" not in text.replace("\r\n", "")
    read = [r["id"] for r in exports.read_ics(t.spark, path).orderBy("file", "nr").collect()]
    assert read == [r["id"] for r in wanted.orderBy("starts_at", "id").select("id").collect()]
    # nothing to export: no file, not a broken one
    exports.export_ics(wanted.limit(0), str(tmp_path / "none"))
    assert not list(pathlib.Path(str(tmp_path / "none")).rglob("*.txt"))


def test_calendar_folders_are_listed_by_a_bounded_number_of_tasks(t, tmp_path):
    path, context = str(tmp_path / "many"), t.spark.sparkContext
    wanted = catalog_extract._categories_named(t).withColumn("region_id", F.lit(1).cast("long")).orderBy("id").limit(300)
    exports.export_ics(wanted, path, 1)
    context.setJobGroup("listing", "folders of one file each")
    try:
        read = exports.read_ics(t.spark, path)
        tracker, until = context.statusTracker(), time.monotonic() + 20
        while not tracker.getJobIdsForGroup("listing") and time.monotonic() < until:
            time.sleep(0.1)  # jobs are recorded a little later
        stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert stages and all(s.numTasks <= 256 for s in stages)
    assert read.count() == 300 and sorted(r["file"] for r in read.collect()) == list(range(300))
