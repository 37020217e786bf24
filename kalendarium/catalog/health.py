"""Calendar shapes, inventory counts, import health and visit queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalendarium.catalog.listing import SHOW, _enriched, _q, _visible
from kalendarium.catalog.sql import T_NOW, T_RUNS, relevant, with_tables
from kalendarium.catalog.tables import NOW, RUNS_NOW, Tables
from kalendarium.operators import calendar as C
from kalendarium.operators import health as H
from kalendarium.operators import inventory as I
from kalendarium.operators import visits as V

_S = ", ".join(SHOW)
SECRET = "geheim"
DEFAULT_REGION = "africa"
YEAR, WEEK, MONTH = 1998, 23, 7


def prepared_visits(t: Tables):
    return V.prepared(t.visits, t.regions, DEFAULT_REGION, SECRET)


def _source_changes(t: Tables):
    i = F.col("id")
    return t.sources.filter(i % 3 == 1).select("id", (i % 2 == 0).alias("enabled"), F.when(i % 6 == 1, True).when(i % 6 == 4, False).alias("approved"))


def _actions(t: Tables):
    """An import's row outcomes, by order number."""
    i = F.col("o_orderkey")
    kind = F.when((i % 25 == 3) | (i % 11 == 5), "error").when(i % 5 == 0, "created").when(i % 5 == 1, "updated").when(i % 5 == 2, "duplicate").otherwise("unchanged")
    return t.scan("orders").select((i % 25).alias("source_id"), kind.alias("action"))


QUERIES = {
    "day_buckets": _q(lambda t: C.group_by_day(C.in_range(_visible(t), "1998-07-01", "1998-08-01"), "1998-07-01").select("id", "day")),
    "day_bucket_counts": _q(lambda t: C.day_counts(C.in_range(_visible(t), "1998-07-01", "1998-08-01"), "1998-07-01")),
    "week_view": _q(lambda t: C.week_view(_visible(t), YEAR, WEEK)),
    "month_grid": _q(lambda t: C.month_grid(_visible(t), YEAR, MONTH)),
    "todays_pool": _q(lambda t: C.today(_visible(t), NOW).select(*SHOW)),
    "status_counts": _q(lambda t: I.status_counts(t.events, NOW)),
    "won_duplicates": _q(lambda t: I.won_duplicates(t.events)),
    "source_events": _q(lambda t: I.source_events(t.events, t.sources, 6).select("id", "status", "duplicate_of", "canonical_title", "canonical_source")),
    "dedup_review": _q(lambda t: I.dedup_review(t.decisions, t.events, t.venues, t.sources, 2).drop("created_at")),
    "inbox_counts": _q(lambda t: I.inbox_counts(t.messages)),
    "inbox_list": _q(lambda t: I.inbox(t.messages, False).select("id", "created_at", "spam")),
    "pipeline_progress": _q(lambda t: I.pipeline_progress(_enriched(t), t.category_decisions, NOW)),
    "decision_log": _q(lambda t: I.decision_log(t.category_decisions, "applied", 50, 10).select("id", "event_id", "created_at")),
    "cross_source_match": _q(lambda t: I.cross_source_match(
        t.events.select("id", F.col("id").alias("position"), "region_id", "dedup_key", "source_id"), t.events, t.sources).select("id", "matched_id")),
    "last_success": _q(lambda t: H.last_success(t.import_runs)),
    "healthy_sources": _q(lambda t: H.healthy_sources(t.import_runs, "2024-01-23 12:00:00")),
    "latest_run": _q(lambda t: H.latest_run(t.import_runs)),
    "recent_seen": _q(lambda t: H.recent_seen(t.import_runs, RUNS_NOW).select("source_id", "runs", "seen_sum", F.array_join("seen", ",").alias("seen"))),
    "source_warnings": _q(lambda t: H.source_warnings(t.import_runs, t.sources, RUNS_NOW)),
    "recent_runs": _q(lambda t: H.recent_runs(t.import_runs)),
    "run_history": _q(lambda t: H.run_history(t.import_runs).select("source_id", "id", "started_at", "rank")),
    "source_overview": _q(lambda t: H.source_overview(t.sources, t.import_runs)),
    "retain_runs": _q(lambda t: H.retain_runs(t.import_runs, "2024-04-10 00:00:00").select("id", "started_at")),
    "prune_unseen": _q(lambda t: H.prune(t.events, t.sources, t.import_runs, NOW, runs_now=RUNS_NOW).select("id", "status", "pruned_at")),
    "source_flags": _q(lambda t: H.set_source_flags(t.sources, _source_changes(t), NOW).select("id", "enabled", "approved_at")),
    "import_report": _q(lambda t: H.import_report(_actions(t))),
    "countable_visits": _q(lambda t: V.countable(t.visits).select("ts", "route", "client_ip", "user_agent")),
    "region_for_host": _q(lambda t: V.region_for_host(t.visits, t.regions, DEFAULT_REGION).groupBy("host", "region_id").agg(F.count(F.lit(1)).alias("n"))),
    "visitor_token": _q(lambda t: prepared_visits(t).select("ts", "day", "region_id", "token")),
    "daily_stats": _q(lambda t: V.daily_stats(prepared_visits(t))),
    "page_stats": _q(lambda t: V.page_stats(prepared_visits(t))),
    "event_stats": _q(lambda t: V.event_stats(prepared_visits(t))),
    "daily_series": _q(lambda t: V.daily_series(V.daily_stats(prepared_visits(t)), RUNS_NOW)),
    "window_totals": _q(lambda t: V.totals(V.daily_stats(prepared_visits(t)), V.since(RUNS_NOW, 14))),
    "top_pages": _q(lambda t: V.top_pages(V.page_stats(prepared_visits(t)), V.since(RUNS_NOW))),
    "top_events": _q(lambda t: V.top_events(V.event_stats(prepared_visits(t)), t.events, t.regions, V.since(RUNS_NOW))),
    "headline_metrics": _q(lambda t: V.headline(V.daily_series(V.daily_stats(prepared_visits(t)), RUNS_NOW), RUNS_NOW)),
    "trailing_sums": _q(lambda t: V.trailing_sums(V.daily_series(V.daily_stats(prepared_visits(t)), RUNS_NOW))),
}

_JULY = f"""starts_at < TIMESTAMP '1998-08-01' AND {relevant("TIMESTAMP '1998-07-01'")}"""
_WEEK = f"""starts_at < TIMESTAMP '1998-06-08' AND {relevant("TIMESTAMP '1998-06-01'")}"""
_CLAMP = "greatest(CAST(starts_at AS DATE), DATE '{d}')"
_AGO = lambda n, base=T_RUNS: f"{base} - INTERVAL {n} DAY"
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rn FROM runs) WHERE rn = 1"
_SUCC = "SELECT source_id, max(started_at) AS last_success_at FROM runs WHERE status IN ('ok', 'partial') GROUP BY source_id"
_SEEN = f"""SELECT source_id, count(*) AS runs, sum(seen) AS seen_sum, string_agg(seen, ',' ORDER BY rn) AS seen FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rn FROM runs
  WHERE status <> 'running' AND started_at >= {_AGO(3)}) WHERE rn <= 3 GROUP BY source_id"""
PV = f"""SELECT *, sha256('{SECRET}|' || region_id || '|' || day || '|' || client_ip || '|' || user_agent) AS token FROM (
  SELECT ts, CASE WHEN bucket = 4 THEN 0 ELSE bucket END AS region_id, CAST(timezone('Europe/Berlin', timezone('UTC', ts)) AS DATE) AS day,
    route, event_id, client_ip, user_agent
  FROM vis WHERE status = 200 AND route NOT LIKE '\\_%' ESCAPE '\\' AND route NOT LIKE 'admin\\_%' ESCAPE '\\' AND user_agent <> '' AND user_agent NOT LIKE '%Bot%')"""
DS = "SELECT region_id, day, count(*) AS views, count(DISTINCT token) AS visitors FROM pv GROUP BY region_id, day"
SERIES = """SELECT CAST(d AS DATE) AS day, coalesce(sum(views), 0) AS views, coalesce(sum(visitors), 0) AS visitors
  FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) g(d) LEFT JOIN ds ON ds.day = CAST(d AS DATE) GROUP BY 1"""
_VIS = {"pv": PV, "ds": DS}


def _sum_age(c: str, days: int) -> str:
    return f"sum(CASE WHEN DATE '2024-01-30' - day < {days} THEN {c} ELSE 0 END)"


ORACLE = {
    "day_buckets": with_tables("vi", f"SELECT id, {_CLAMP.format(d='1998-07-01')} AS day FROM vi WHERE {_JULY}"),
    "day_bucket_counts": with_tables("vi", f"SELECT {_CLAMP.format(d='1998-07-01')} AS day, count(*) AS events, min(starts_at) AS first_start FROM vi WHERE {_JULY} GROUP BY 1"),
    "week_view": with_tables("vi", f"""SELECT CAST(d AS DATE) AS day, id, title, starts_at FROM generate_series(DATE '1998-06-01', DATE '1998-06-07', INTERVAL 1 DAY) g(d)
      LEFT JOIN (SELECT *, {_CLAMP.format(d='1998-06-01')} AS cell FROM vi WHERE {_WEEK}) x ON x.cell = CAST(d AS DATE)"""),
    "month_grid": with_tables("vi", f"""SELECT CAST((CAST(d AS DATE) - DATE '1998-06-29') // 7 + 1 AS INT) AS week_no, CAST(d AS DATE) AS day, month(d) = 7 AS in_month, id, title
      FROM generate_series(DATE '1998-06-29', DATE '1998-08-02', INTERVAL 1 DAY) g(d) LEFT JOIN (
        SELECT *, CAST(starts_at AS DATE) AS c0, CAST(CASE WHEN NOT all_day AND ends_at = date_trunc('day', ends_at) AND ends_at > date_trunc('day', starts_at) THEN ends_at - INTERVAL 1 DAY
          ELSE coalesce(ends_at, starts_at) END AS DATE) AS c1 FROM vi WHERE {_JULY}) x ON CAST(d AS DATE) BETWEEN c0 AND c1"""),
    "todays_pool": with_tables("vi", f"""SELECT {_S} FROM vi WHERE starts_at < TIMESTAMP '1998-06-04' AND {relevant("TIMESTAMP '1998-06-03'")}"""),
    "status_counts": with_tables("ev", f"""SELECT source_id, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'hidden') AS hidden,
      count(*) FILTER (status = 'duplicate') AS duplicate, count(*) AS total, count(*) FILTER (status = 'published' AND {relevant(T_NOW)}) AS upcoming FROM ev GROUP BY source_id"""),
    "won_duplicates": with_tables("ev", "SELECT d.source_id, count(*) AS won FROM ev e JOIN ev d ON d.id = e.duplicate_of WHERE e.source_id <> d.source_id GROUP BY d.source_id"),
    "source_events": with_tables("ev src", """SELECT e.id, e.status, e.duplicate_of, d.title AS canonical_title, s.name AS canonical_source
      FROM (SELECT * FROM ev WHERE source_id = 6 ORDER BY starts_at, id LIMIT 300) e LEFT JOIN ev d ON d.id = e.duplicate_of LEFT JOIN src s ON s.id = d.source_id"""),
    "dedup_review": with_tables("dec src ven", """SELECT x.id, x.day, x.duplicate_event_id, x.canonical_event_id, x.reason, a.title AS duplicate_title, a.region_id AS duplicate_region_id,
      sa.name AS duplicate_source, va.name AS duplicate_venue, b.title AS canonical_title, b.region_id AS canonical_region_id, sb.name AS canonical_source, vb.name AS canonical_venue
      FROM dec x LEFT JOIN ev a ON a.id = duplicate_event_id LEFT JOIN ev b ON b.id = canonical_event_id LEFT JOIN src sa ON sa.id = a.source_id LEFT JOIN src sb ON sb.id = b.source_id
      LEFT JOIN ven va ON va.id = a.venue_id LEFT JOIN ven vb ON vb.id = b.venue_id WHERE active AND (a.region_id = 2 OR b.region_id = 2) ORDER BY created_at DESC, x.id DESC LIMIT 100"""),
    "inbox_counts": "SELECT count(*) FILTER (conv_id % 4 <> 0) AS real, count(*) FILTER (conv_id % 4 = 0) AS spam, count(*) FILTER (conv_id % 4 <> 0 AND turn % 2 <> 0) AS unseen FROM conversations",
    "inbox_list": """SELECT conv_id * 1000 + turn AS id, TIMESTAMP '2024-01-01' + to_hours(turn) + to_minutes(conv_id % 60) AS created_at, false AS spam
      FROM conversations WHERE conv_id % 4 <> 0 ORDER BY created_at DESC, id DESC LIMIT 200""",
    "pipeline_progress": with_tables("vi cdec", f"""SELECT *, last_at > {T_NOW} - INTERVAL 2 MINUTE AS running FROM (SELECT count(*) FILTER (NOT facts_only AND summary IS NOT NULL) AS with_summary,
      count(*) FILTER (NOT facts_only AND coalesce(description, '') <> '') AS eligible, count(*) FILTER (id NOT IN (SELECT event_id FROM cdec)) AS without_decision FROM vi WHERE {relevant(T_NOW)}),
      (SELECT count(*) AS processed, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'agreed') AS agreed,
      0 AS dismissed, 0 AS undone, max(created_at) AS last_at FROM cdec)"""),
    "decision_log": with_tables("cdec", "SELECT id, event_id, created_at FROM cdec WHERE status = 'applied' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10"),
    "cross_source_match": with_tables("ev src", """SELECT e.id, min(m.id) AS matched_id FROM ev e LEFT JOIN (SELECT ev.* FROM ev JOIN src ON src.id = ev.source_id WHERE enabled AND status = 'published') m
      ON m.region_id = e.region_id AND m.dedup_key = e.dedup_key AND m.source_id <> e.source_id GROUP BY e.id"""),
    "last_success": with_tables("runs", _SUCC),
    "healthy_sources": with_tables("runs", f"SELECT DISTINCT source_id FROM runs WHERE status = 'ok' AND NOT dry_run AND seen > 0 AND started_at >= {_AGO(7)}"),
    "latest_run": with_tables("runs", f"SELECT id, source_id, started_at, status, seen, dry_run, message FROM ({_LATEST})"),
    "recent_seen": with_tables("runs", _SEEN),
    "source_warnings": with_tables("runs src", f"""SELECT * FROM (SELECT src.id AS source_id, CASE WHEN l.status = 'failed' THEN coalesce(l.message, 'Fehler ohne Meldung') END AS failed,
      CASE WHEN date_sub('day', last_success_at, {T_RUNS}) > 7 THEN date_sub('day', last_success_at, {T_RUNS}) END AS stale_days,
      coalesce(runs >= 3 AND seen_sum = 0, false) AS zero_events FROM src JOIN lr l ON l.source_id = src.id LEFT JOIN su ON su.source_id = src.id LEFT JOIN se ON se.source_id = src.id WHERE enabled)
      WHERE failed IS NOT NULL OR stale_days IS NOT NULL OR zero_events""", lr=_LATEST, su=_SUCC, se=_SEEN),
    "recent_runs": with_tables("runs", "SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 100"),
    "run_history": with_tables("runs", "SELECT * FROM (SELECT source_id, id, started_at, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rank FROM runs) WHERE rank <= 50"),
    "source_overview": with_tables("runs src", "SELECT src.id, name, enabled, l.started_at AS last_started_at, l.status AS last_run_status FROM src LEFT JOIN lr l ON l.source_id = src.id", lr=_LATEST),
    "retain_runs": with_tables("runs", "SELECT id, started_at FROM runs WHERE started_at >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY"),
    "prune_unseen": with_tables("ev src runs", f"""SELECT ev.id, CASE WHEN g THEN 'hidden' ELSE status END AS status, CASE WHEN g THEN {T_NOW} ELSE pruned_at END AS pruned_at FROM (SELECT ev.*,
      status = 'published' AND {relevant(T_NOW)} AND last_seen_at < {_AGO(7, T_NOW)} AND s.enabled AND s.type <> 'manual' AND coalesce(external_id NOT LIKE 'manual:%', true)
      AND s.id IN (SELECT source_id FROM runs WHERE status = 'ok' AND NOT dry_run AND seen > 0 AND started_at >= {_AGO(7)}) AS g FROM ev JOIN src s ON s.id = ev.source_id) ev"""),
    "source_flags": with_tables("src", f"""SELECT id, CASE WHEN id % 3 = 1 THEN id % 2 = 0 ELSE enabled END AS enabled,
      CASE WHEN id % 6 = 1 THEN coalesce(approved_at, {T_NOW}) WHEN id % 6 = 4 THEN NULL ELSE approved_at END AS approved_at FROM src"""),
    "import_report": """SELECT *, CASE WHEN errors = seen THEN 'Alle ' || seen || ' Events konnten nicht gespeichert werden (siehe Log).' END AS message,
      CASE WHEN errors = seen THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'ok' END AS status FROM (
      SELECT source_id, count(*) AS seen, count(*) FILTER (a = 'created') AS created, count(*) FILTER (a = 'updated') AS updated, count(*) FILTER (a = 'unchanged') AS unchanged,
      count(*) FILTER (a = 'duplicate') AS duplicates, count(*) FILTER (a = 'error') AS errors FROM (SELECT o_orderkey % 25 AS source_id,
      CASE WHEN o_orderkey % 25 = 3 OR o_orderkey % 11 = 5 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'created' WHEN o_orderkey % 5 = 1 THEN 'updated' WHEN o_orderkey % 5 = 2 THEN 'duplicate' ELSE 'unchanged' END AS a
      FROM orders) GROUP BY source_id)""",
    "countable_visits": with_tables("vis", "SELECT ts, route, client_ip, user_agent FROM pv", pv=PV),
    "region_for_host": with_tables("vis", """SELECT CASE bucket WHEN 0 THEN 'africa.example' WHEN 1 THEN 'www.america.example' WHEN 2 THEN 'alt-asia.example' WHEN 3 THEN 'europe.example' ELSE 'unknown.example' END AS host,
      CASE WHEN bucket = 4 THEN 0 ELSE bucket END AS region_id, count(*) AS n FROM vis GROUP BY 1, 2"""),
    "visitor_token": with_tables("vis", "SELECT ts, day, region_id, token FROM pv", pv=PV),
    "daily_stats": with_tables("vis", DS, pv=PV),
    "page_stats": with_tables("vis", "SELECT region_id, day, route, count(*) AS views FROM pv GROUP BY ALL", pv=PV),
    "event_stats": with_tables("vis", "SELECT day, event_id, count(*) AS views FROM pv WHERE route = 'event_show' AND event_id > 0 GROUP BY ALL", pv=PV),
    "daily_series": with_tables("vis", SERIES, **_VIS),
    "window_totals": with_tables("vis", "SELECT coalesce(sum(views), 0) AS views, coalesce(sum(visitors), 0) AS visitors FROM ds WHERE day >= DATE '2024-01-17'", **_VIS),
    "top_pages": with_tables("vis", "SELECT route, count(*) AS views FROM pv WHERE day >= DATE '2024-01-01' GROUP BY route ORDER BY views DESC, route LIMIT 15", pv=PV),
    "top_events": with_tables("vis ev reg", """SELECT ev.id, slug, title, canonical_host, views FROM (SELECT event_id, count(*) AS views FROM pv WHERE day >= DATE '2024-01-01' AND route = 'event_show'
      AND event_id > 0 GROUP BY event_id) x JOIN ev ON ev.id = event_id JOIN reg ON reg.id = ev.region_id ORDER BY views DESC, ev.id LIMIT 15""", pv=PV),
    "headline_metrics": with_tables("vis", "SELECT " + ", ".join(
        [f"{_sum_age(c, d)} AS {c}_{n}" for c in ("views", "visitors") for n, d in (("today", 1), ("7", 7), ("30", 30))] + [f"greatest(max({c}), 1) AS max_{c}" for c in ("views", "visitors")]
    ) + " FROM se", **_VIS, se=SERIES),
    "trailing_sums": with_tables("vis", "SELECT day, " + ", ".join(
        f"sum({c}) OVER (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_{n}" for c in ("views", "visitors") for n in (7, 30)
    ) + " FROM se", **_VIS, se=SERIES),
}
