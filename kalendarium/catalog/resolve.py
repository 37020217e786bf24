"""Resolution, review and enrichment queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalendarium.catalog.listing import _q, _shown, _visible
from kalendarium.catalog.sql import T_NOW, norm_title, relevant, with_tables
from kalendarium.catalog.tables import NOW, Tables, every
from kalendarium.model import CATEGORY_SLUGS
from kalendarium.operators import enrich as E
from kalendarium.operators import listing as L
from kalendarium.operators import resolve as R
from kalendarium.operators import review as V
from kalendarium.session import cut_lineage


def _sets(t: Tables, horizon: int = 60):
    return V.day_sets(_shown(t), NOW, horizon)


def _stored_sets(t: Tables):
    """The sets as stored rows: the review reads them several times, the tables behind them are joined once."""
    return cut_lineage(_sets(t))


def _reviewed(sets):
    """Checkpoints of every third day, as of now."""
    return V.day_fingerprints(sets).filter(F.dayofmonth("day") % 3 == 0).select("region_id", "day", "fingerprint")


def _worklist(t: Tables):
    sets = _stored_sets(t)
    return V.worklist(sets, _reviewed(sets), None)


def _proposals(t: Tables):
    """Judged pairs: every event with the next id of its region (chains), some turned round."""
    i = F.col("id")
    pairs = t.events.select(i.alias("position"), "region_id", F.to_date("starts_at").alias("day"), i.alias("a"), (i + 10).alias("b"))
    turned = F.col("position") % 3 == 0
    return pairs.select(
        "region_id", "day", "position", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("duplicate_id"),
        F.when(turned, F.col("a")).otherwise(F.col("b")).alias("canonical_id"), F.lit("gleich").alias("reason"),
    )


def _day_proposals(t: Tables):
    """Per judged day: its lowest and highest id both ways, a self pair, and a stranger."""
    ends = _sets(t).groupBy("region_id", "day").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    row = lambda n, d, c: F.struct(F.lit(n).alias("position"), d.alias("duplicate_id"), c.alias("canonical_id"))
    lo, hi = F.col("lo"), F.col("hi")
    return ends.select("region_id", "day", F.inline(F.array(row(1, hi, lo), row(2, lo, hi), row(3, lo, lo), row(4, lo + 1, hi))))


def _chain_proposals(t: Tables):
    """Proposals valid for applying: both sides visible; no day restriction, so chains are long."""
    ids = _visible(t).select("id")
    rows = _proposals(t).withColumns({"day": F.lit("1998-06-03").cast("date"), "region_id": F.col("position") % 10})  # chains of ids ten apart
    for side in ("duplicate_id", "canonical_id"):
        rows = rows.join(ids.withColumnRenamed("id", side), side, "left_semi")
    return rows


def _category_proposals(t: Tables):
    i = F.col("id")
    slug = lambda n: F.element_at(F.array(*[F.lit(s) for s in CATEGORY_SLUGS + ["unfug"]]), (n % 12 + 1).cast("int"))
    return t.events.filter(~every(9)).select(i.alias("event_id"), i.alias("position"), slug(i).alias("primary"), slug(i + 3).alias("secondary"), F.lit(" passt ").alias("reason"))


def _sent(t: Tables):
    rows = L.unchecked(_shown(t), t.category_decisions, NOW)
    return L.with_categories(rows, t.event_categories, t.categories)


def _decided(t: Tables):
    return E.decide_categories(_sent(t), _category_proposals(t), F.array(*[F.lit(s) for s in CATEGORY_SLUGS]), NOW, "m1")


def _choices(t: Tables):
    i = F.col("id")
    return t.category_decisions.select("id", F.when(i % 16 == 2, "undo").when(i % 8 == 6, "accept").when(i % 16 == 14, "dismiss").otherwise("accept").alias("choice"))


def _summary_proposals(t: Tables):
    i = F.col("id")
    return t.events.filter(every(3)).select(i.alias("event_id"), i.alias("position"), F.when(every(9), "  ").otherwise(F.concat(F.lit(" "), F.repeat("title", 40))).alias("summary"))


def _rescued(t: Tables, decisions=None):
    return R.rescue(R.rededup(t.stored_events, t.sources, NOW), t.sources, t.decisions if decisions is None else decisions, NOW)


def _synced(t: Tables):
    decisions = cut_lineage(t.decisions)
    return R.sync_decisions(decisions, _rescued(t, decisions))


def _slugs(bridge, t: Tables):
    named = bridge.join(t.categories.select(F.col("id").alias("category_id"), "slug"), "category_id")
    return named.select("event_id", "slug")


_ROW = ["id", "status", "duplicate_of", "image_url", "description", "organizer", "group_size", "flip"]

QUERIES = {
    "rank_group": _q(lambda t: R.rank_group(t.events, t.sources, NOW).select("region_id", "dedup_key", "group_size", "winner_id")),
    "rededup": _q(lambda t: R.rededup(t.events, t.sources, NOW).select(*_ROW)),
    "chain_end": _q(lambda t: R.chain_end(t.stored_events)),
    "rescue": _q(lambda t: _rescued(t).select("id", "status", "duplicate_of", "action", "reason")),
    "sync_decisions": _q(lambda t: _synced(t).select("id", "canonical_event_id", "active")),
    "day_fingerprints": _q(lambda t: V.day_fingerprints(_sets(t))),
    "candidate_equal_titles": _q(lambda t: V.days_with_equal_titles(_sets(t))),
    "candidate_shared_place": _q(lambda t: V.days_with_shared_place(_sets(t))),
    "candidate_contained_titles": _q(lambda t: V.days_with_contained_title(_sets(t).withColumn("title", F.when(every(3), F.concat(F.lit("Großes "), "title")).otherwise(F.col("title"))))),
    "candidate_similar_titles": _q(lambda t: V.days_with_similar_titles(_sets(t))),
    "candidate_days": _q(lambda t: V.candidate_days(_stored_sets(t))),
    "review_worklist": _q(_worklist),
    "remaining_fingerprints": _q(lambda t: V.remaining_fingerprints(_sets(t), _chain_proposals(t))),
    "veto_pairs": _q(lambda t: V.veto_pairs(t.decisions)),
    "valid_proposals": _q(lambda t: V.valid_proposals(_day_proposals(t), _sets(t), t.events, V.veto_pairs(t.decisions)).select("day", "position", "duplicate_id", "canonical_id")),
    "accept_in_order": _q(lambda t: V.accept_in_order(_chain_proposals(t)).select("position", "duplicate_id", "canonical_id")),
    "apply_merges": _q(lambda t: V.apply_merges(t.events, V.accept_in_order(_chain_proposals(t)), NOW, "m1")[0].select("id", "status", "duplicate_of")),
    "undo_merges": _q(lambda t: V.undo_merges(t.events, t.decisions, t.decisions.filter(every(3)), NOW, True)[0].select("id", "status", "duplicate_of")),
    "undo_merges_log": _q(lambda t: V.undo_merges(t.events, t.decisions, t.decisions.filter(every(3)), NOW, True)[1].select("id", "active", "undone_by_admin_at")),
    "reset_region": _q(lambda t: V.reset_region(t.events, t.decisions, _reviewed(_sets(t)), 2, NOW)[1].select("id", "active")),
    "real_category": _q(lambda t: E.split_modes(_sent(t)).select("id", "mode")),
    "category_decisions": _q(lambda t: _decided(t).select("event_id", "mode", "status", F.array_join("previous_slugs", ",").alias("previous"), F.array_join("proposed_slugs", ",").alias("proposed"), "reason")),
    "apply_categories": _q(lambda t: _slugs(E.apply_categories(t.event_categories, t.categories, _decided(t)), t)),
    "review_categories": _q(lambda t: _slugs(E.review_categories(t.event_categories, t.categories, t.category_decisions, _choices(t), t.events, NOW)[0], t)),
    "review_categories_log": _q(lambda t: E.review_categories(t.event_categories, t.categories, t.category_decisions, _choices(t), t.events, NOW)[1].select("id", "status", "reviewed_at")),
    "reset_categories": _q(lambda t: E.reset_categories(t.event_categories, t.categories, t.category_decisions, t.events, 1, NOW)[1].select("id")),
    "apply_summaries": _q(lambda t: E.apply_summaries(t.events, L.needs_summary(_visible(t), NOW), _summary_proposals(t)).select("id", "summary")),
    "summary_batches": _q(lambda t: E.prompt_batches(L.needs_summary(_visible(t), NOW), E.summary_line(), E.SUMMARY_BATCH).select("region_id", "batch_no", F.array_join("ids", ",").alias("ids"), "prompt")),
    "category_batches": _q(lambda t: E.prompt_batches(_sent(t), E.category_line(), E.CATEGORY_BATCH).select("region_id", "batch_no", F.array_join("ids", ",").alias("ids"), "prompt")),
    "dedup_lines": _q(lambda t: _sets(t).select("region_id", "day", "id", E.dedup_line().alias("line"))),
}

_SETS = f"""SELECT region_id, CAST(d AS DATE) AS day, vi.* EXCLUDE (region_id) FROM vi, generate_series(DATE '1998-06-03', DATE '1998-08-01', INTERVAL 1 DAY) g(d)
  WHERE starts_at < d + INTERVAL 1 DAY AND {relevant('CAST(d AS TIMESTAMP)')}"""


def _fp(rows: str) -> str:
    return f"""SELECT region_id, day, CAST(sum(n) AS BIGINT) AS n, sha1(string_agg(digest, ',' ORDER BY r)) AS fingerprint FROM (
  SELECT region_id, day, id // {V.ID_RANGE} AS r, count(*) AS n, sha1(string_agg(id, ',' ORDER BY id)) AS digest FROM {rows} GROUP BY ALL) GROUP BY region_id, day"""


_FP = _fp("sets")
_LOC = "CASE WHEN venue_name IS NOT NULL THEN venue_name || ' · ' || venue_city ELSE location_text END"
_TT = f"SELECT DISTINCT region_id, day, id, {norm_title('title')} AS t FROM sets"
_TOK = f"""SELECT DISTINCT region_id, day, id, CASE WHEN all_day THEN 'allday' ELSE strftime(starts_at, '%H:%M') END AS clock,
  unnest(string_split(regexp_replace(lower(coalesce({_LOC}, '')), '[^a-z0-9äöüß]+', ' ', 'g'), ' ')) AS token FROM sets"""
_EQ = "SELECT DISTINCT region_id, day FROM (SELECT region_id, day, t FROM tt WHERE t <> '' GROUP BY ALL HAVING count(*) > 1)"
_PL = "SELECT DISTINCT region_id, day FROM (SELECT region_id, day, clock, token FROM tok WHERE length(token) >= 4 GROUP BY ALL HAVING count(*) > 1)"
_CO = """SELECT DISTINCT a.region_id, a.day FROM (SELECT DISTINCT region_id, day, t FROM tt WHERE length(t) >= 5) a
  JOIN (SELECT DISTINCT region_id, day, t FROM tt) b ON a.region_id = b.region_id AND a.day = b.day AND a.t <> b.t AND contains(b.t, a.t)"""
_SIMS = """SELECT region_id, day, t, min({'s': starts_at, 'i': id}) AS first, max({'s': starts_at, 'i': id}) AS last FROM (
  SELECT region_id, day, id, starts_at, """ + norm_title("title") + """ AS t FROM sets) WHERE t <> '' GROUP BY region_id, day, t"""
_SIMP = """SELECT row_number() OVER () AS pid, a.region_id, a.day, a.t AS x, b.t AS y FROM simt a JOIN simt b
  ON a.region_id = b.region_id AND a.day = b.day AND a.t <> b.t AND a.first < b.last"""
# the longest common run of a piece (leftmost in x, then in y), then the pieces left and right of it
_SIMW = """SELECT pid, x, y, 0 AS got, '' AS place FROM simp
  UNION ALL SELECT pid, CASE side WHEN 0 THEN left(x, i - 1) ELSE substr(x, i + n) END, CASE side WHEN 0 THEN left(y, j - 1) ELSE substr(y, j + n) END,
    CASE side WHEN 0 THEN n ELSE 0 END, place || side FROM (
    SELECT pid, x, y, place, r.n AS n, -r.i AS i, strpos(y, substr(x, -r.i, r.n)) AS j FROM (
      SELECT *, list_max(flatten([[{'n': n, 'i': -i} for n in range(1, least(length(x) - i + 1, length(y)) + 1) if contains(y, substr(x, i, n))] for i in range(1, length(x) + 1)])) AS r
      FROM simw WHERE x <> '' AND y <> '') WHERE r IS NOT NULL), (VALUES (0), (1)) v(side)"""
_SIM = """SELECT DISTINCT region_id, day FROM (SELECT pid, sum(got) AS common FROM simw GROUP BY pid) JOIN simp USING (pid)
  WHERE common * 200 >= (length(x) + length(y)) * 60"""
_RSIM = {"simt": _SIMS, "simp": _SIMP, "simw": _SIMW}
_GRP = f"""SELECT e.*, s.enabled, s.facts_only, s.approved_at, s.type, count(*) OVER g AS n, first_value(e.id) OVER r AS winner_id, row_number() OVER r AS pos
  FROM ev e JOIN src s ON s.id = e.source_id WHERE status IN ('published', 'duplicate') AND {relevant(T_NOW)}
  WINDOW g AS (PARTITION BY e.region_id, dedup_key), r AS (PARTITION BY e.region_id, dedup_key
    ORDER BY enabled DESC, facts_only, CASE WHEN image_url IS NOT NULL THEN 100000 ELSE 0 END + coalesce(length(description), 0) DESC, e.id)"""


def _lend(field: str, ok: str) -> str:
    return f"(SELECT {field} FROM grp l WHERE l.region_id = g.region_id AND l.dedup_key = g.dedup_key AND l.pos > 1 AND l.enabled AND NOT l.facts_only AND {ok} ORDER BY l.pos LIMIT 1)"


def _borrow(field: str, missing: str, pin: str, ok: str) -> str:
    return f"CASE WHEN g.n >= 2 AND g.pos = 1 AND {missing} AND NOT list_contains(g.locked_fields, '{pin}') THEN coalesce({_lend(field, ok)}, g.{field}) ELSE e.{field} END AS {field}"


_RED = f"""SELECT e.* REPLACE (
    CASE WHEN g.n >= 2 AND g.pos = 1 THEN 'published' WHEN g.n >= 2 THEN 'duplicate' ELSE e.status END AS status,
    CASE WHEN g.n >= 2 AND g.pos = 1 THEN CASE WHEN e.status = 'duplicate' THEN NULL ELSE e.duplicate_of END WHEN g.n >= 2 THEN g.winner_id ELSE e.duplicate_of END AS duplicate_of,
    {_borrow('image_url', 'g.image_url IS NULL', 'imageUrl', "coalesce(l.image_url, '') <> '' AND l.approved_at IS NOT NULL")},
    {_borrow('description', "coalesce(g.description, '') = ''", 'description', "coalesce(l.description, '') <> ''")},
    {_borrow('organizer', 'g.organizer IS NULL', 'organizer', "coalesce(l.organizer, '') <> ''")}),
  g.n AS group_size, CASE WHEN g.n >= 2 AND g.pos = 1 AND e.status = 'duplicate' THEN 'promoted' WHEN g.n >= 2 AND g.pos > 1 AND (e.status <> 'duplicate' OR e.duplicate_of IS DISTINCT FROM g.winner_id) THEN 'demoted' END AS flip
  FROM ev e LEFT JOIN grp g ON g.id = e.id"""


def _chain(table: str) -> str:
    return f"""SELECT d.id, max(w.cur) FILTER (x.status IS NOT NULL AND x.status <> 'duplicate') AS end_id FROM {table} d LEFT JOIN walk w ON w.start = d.id LEFT JOIN {table} x ON x.id = w.cur
      WHERE d.status = 'duplicate' GROUP BY d.id"""


def _walk(table: str) -> str:
    return f"""SELECT id AS start, duplicate_of AS cur, 1 AS depth FROM {table} WHERE status = 'duplicate' AND duplicate_of IS NOT NULL
      UNION ALL SELECT start, e.duplicate_of, depth + 1 FROM walk JOIN {table} e ON e.id = cur WHERE e.status = 'duplicate' AND e.duplicate_of IS NOT NULL AND depth < 200"""


_RESC = f"""SELECT r.id, CASE WHEN action = 'promote' THEN 'published' ELSE r.status END AS status,
    CASE WHEN action = 'promote' THEN NULL WHEN action = 'rehang' THEN v.end_id ELSE r.duplicate_of END AS duplicate_of, action, reason, v.end_id
  FROM red r LEFT JOIN (SELECT id, end_id, reason, CASE WHEN reason IN ('keep', 'rehang') THEN reason WHEN unseen THEN 'refused' ELSE 'promote' END AS action FROM (
    SELECT r.id, c.end_id, s.type <> 'manual' AND coalesce(r.external_id NOT LIKE 'manual:%', true) AND r.last_seen_at < {T_NOW} - INTERVAL 7 DAY AS unseen,
      CASE WHEN t.id IS NULL THEN 'orphan' WHEN t.status = 'duplicate' AND e.id IS NULL THEN 'dangling_chain' WHEN t.status = 'duplicate' AND e.status = 'published' AND NOT se.enabled THEN 'chain_end_source_disabled'
        WHEN t.status = 'duplicate' AND e.status = 'published' THEN 'rehang' WHEN t.status = 'duplicate' AND e.pruned_at IS NOT NULL THEN 'chain_end_pruned' WHEN t.status = 'duplicate' THEN 'keep'
        WHEN t.status = 'hidden' AND t.pruned_at IS NOT NULL THEN 'target_pruned' WHEN t.status = 'hidden' THEN 'keep' WHEN NOT st.enabled THEN 'target_source_disabled'
        WHEN t.dedup_key = r.dedup_key THEN 'keep' WHEN r.id NOT IN (SELECT duplicate_event_id FROM dec WHERE active) THEN 'key_without_counterpart' ELSE 'keep' END AS reason
    FROM red r JOIN src s ON s.id = r.source_id LEFT JOIN red t ON t.id = r.duplicate_of LEFT JOIN src st ON st.id = t.source_id
      LEFT JOIN chains c ON c.id = t.id LEFT JOIN red e ON e.id = c.end_id LEFT JOIN src se ON se.id = e.source_id
    WHERE r.status = 'duplicate' AND r.group_size < 2)) v ON v.id = r.id"""
_PROP = """SELECT position, CASE WHEN position % 3 = 0 THEN b ELSE a END AS d, CASE WHEN position % 3 = 0 THEN a ELSE b END AS c, region_id, day FROM (
  SELECT id AS position, id AS a, id + 10 AS b, region_id, CAST(starts_at AS DATE) AS day FROM ev)"""
_CHAINP = "SELECT *, row_number() OVER (PARTITION BY position % 10 ORDER BY position) AS step, position % 10 AS lane FROM prop WHERE d IN (SELECT id FROM vi) AND c IN (SELECT id FROM vi)"
# proposals only link ids ten apart, so lanes (id mod 10) are independent and each is applied in order
_APPLY = """SELECT lane, 0 AS step, CAST(-1 AS BIGINT) AS recent, CAST(-1 AS BIGINT) AS position, false AS ok FROM (SELECT DISTINCT lane FROM chainp)
  UNION ALL SELECT p.lane, p.step, CASE WHEN p.d <> a.recent AND p.c <> a.recent THEN p.d ELSE CASE WHEN a.recent IN (p.d, p.c) THEN a.recent ELSE -1 END END, p.position, p.d <> a.recent AND p.c <> a.recent
  FROM applied a JOIN chainp p ON p.lane = a.lane AND p.step = a.step + 1"""
_RSETS = {"sets": _SETS}
_BIG = "CASE WHEN id % 3 = 0 THEN 'Großes ' || title ELSE title END"
_SENT = f"SELECT vi.*, coalesce((SELECT list(cat.slug ORDER BY sort_order) FROM evcat JOIN cat ON cat.id = category_id WHERE event_id = vi.id), []) AS slugs FROM vi WHERE {relevant(T_NOW)} AND id NOT IN (SELECT event_id FROM cdec)"
_CATS = "[" + ", ".join(f"'{s}'" for s in CATEGORY_SLUGS + ["unfug"]) + "]"
_DECIDE = f"""SELECT *, CASE WHEN picked IS NULL OR pinned THEN 'dismissed' WHEN real AND list_contains(slugs, picked[1]) THEN 'agreed' ELSE 'applied' END AS status FROM (
  SELECT id, slugs, list_contains(locked_fields, 'categories') AS pinned, len(list_filter(slugs, lambda s: s <> 'sonstiges')) > 0 AS real,
    CASE WHEN id % 9 <> 0 AND id % 12 <> 11 THEN CASE WHEN (id + 3) % 12 <> 11 THEN [{_CATS}[id % 12 + 1], {_CATS}[(id + 3) % 12 + 1]] ELSE [{_CATS}[id % 12 + 1]] END END AS picked FROM sent)"""
_NEED = f"SELECT * FROM vi WHERE {relevant(T_NOW)} AND summary IS NULL AND coalesce(description, '') <> '' AND NOT facts_only"
_CLEAN = "trim(regexp_replace(translate(coalesce({}, ''), '<>', '  '), '\\s+', ' ', 'g'))"


def _dash(x: str) -> str:
    return f"coalesce(nullif({_CLEAN.format(x)}, ''), '—')"


def _batches(rows: str, line: str, size: int, top: str = "") -> str:
    return f"""SELECT region_id, batch_no, string_agg(id, ',' ORDER BY nr) AS ids, string_agg(line, chr(10) ORDER BY nr) AS prompt FROM (
      SELECT *, (nr - 1) // {size} AS batch_no FROM (SELECT region_id, id, {line} AS line, row_number() OVER (PARTITION BY region_id ORDER BY starts_at, id) AS nr FROM {rows})) GROUP BY ALL {top}"""


_CATLINE = f"""'id=' || id || ' | "' || {_CLEAN.format('title')} || '" | Ort: ' || {_dash(_LOC)} || ' | Veranstalter: ' || {_dash('organizer')} ||
  CASE WHEN left({_CLEAN.format('description')}, 240) <> '' THEN ' | ' || left({_CLEAN.format('description')}, 240) ELSE '' END"""
_SUMLINE = f"""'id=' || id || ' | Titel: "' || {_CLEAN.format('title')} || '" | Text: ' || left({_CLEAN.format('description')}, 1200)"""
_DEDLINE = f"""'id=' || id || ' | ' || CASE WHEN all_day THEN 'ganztägig' ELSE strftime(starts_at, '%H:%M') END || ' | "' || {_CLEAN.format('title')} || '" | ' || {_dash(_LOC)} ||
  ' | Bild: ' || CASE WHEN coalesce(image_url, '') <> '' THEN 'ja' ELSE 'nein' END || ' | Veranstalter: ' || {_dash('organizer')} || ' | Quelle: ' || source_key ||
  CASE WHEN left({_CLEAN.format('description')}, 200) <> '' THEN ' | ' || left({_CLEAN.format('description')}, 200) ELSE '' END"""
_CHOICE = "CASE WHEN id % 16 = 2 THEN 'undo' WHEN id % 8 = 6 THEN 'accept' WHEN id % 16 = 14 THEN 'dismiss' ELSE 'accept' END"
_REVIEWED = f"""SELECT id, event_id, CASE WHEN status = 'pending' AND {_CHOICE} = 'accept' THEN 'applied' WHEN status = 'pending' AND {_CHOICE} = 'dismiss' THEN 'dismissed'
  WHEN status = 'applied' AND {_CHOICE} = 'undo' THEN 'undone' END AS verdict, status, previous_slugs, proposed_slugs FROM cdec"""
_PINNED = "list_contains(ev.locked_fields, 'categories')"

ORACLE = {
    "rank_group": with_tables("ev src", "SELECT DISTINCT region_id, dedup_key, n AS group_size, winner_id FROM grp WHERE n >= 2", grp=_GRP),
    "rededup": with_tables("ev src", f"SELECT {', '.join(_ROW)} FROM ({_RED})", grp=_GRP),
    "chain_end": with_tables("ev", _chain("ev"), recursive=True, walk=_walk("ev")),
    "rescue": with_tables("ev src dec", f"SELECT id, status, duplicate_of, action, reason FROM ({_RESC})", recursive=True, grp=_GRP, red=_RED, walk=_walk("red"), chains=_chain("red")),
    "sync_decisions": with_tables("ev src dec", """SELECT d.id, d.c AS canonical_event_id, active AND coalesce(x.status <> 'duplicate', true) AS active FROM (
      SELECT dec.*, CASE WHEN active AND r.action = 'rehang' THEN r.end_id ELSE canonical_event_id END AS c FROM dec LEFT JOIN resc r ON r.id = duplicate_event_id) d LEFT JOIN resc x ON x.id = d.c""",
      recursive=True, grp=_GRP, red=_RED, walk=_walk("red"), chains=_chain("red"), resc=_RESC),
    "day_fingerprints": with_tables("vi", _FP, **_RSETS),
    "candidate_equal_titles": with_tables("vi", _EQ, **_RSETS, tt=_TT),
    "candidate_shared_place": with_tables("vi", _PL, **_RSETS, tok=_TOK),
    "candidate_contained_titles": with_tables("vi", _CO, **_RSETS, tt=f"SELECT DISTINCT region_id, day, id, {norm_title(_BIG)} AS t FROM sets"),
    "candidate_similar_titles": with_tables("vi", _SIM, recursive=True, **_RSETS, **_RSIM),
    "candidate_days": with_tables("vi", f"{_EQ} UNION {_PL} UNION {_CO} UNION {_SIM}", recursive=True, **_RSETS, tt=_TT, tok=_TOK, **_RSIM),
    "review_worklist": with_tables("vi", f"""SELECT fp.*, CASE WHEN (region_id, day) IN (SELECT (region_id, day) FROM ({_EQ} UNION {_PL} UNION {_CO} UNION {_SIM})) THEN 'review' ELSE 'store' END AS state
      FROM fp WHERE n > 1 AND day(day) % 3 <> 0""", recursive=True, **_RSETS, tt=_TT, tok=_TOK, fp=_FP, **_RSIM),
    "remaining_fingerprints": with_tables("vi", _fp("(SELECT * FROM sets WHERE id NOT IN (SELECT d FROM chainp))"),
      **_RSETS, prop=_PROP, chainp=_CHAINP),
    "veto_pairs": with_tables("dec", """SELECT duplicate_event_id AS duplicate_id, canonical_event_id AS canonical_id FROM dec WHERE undone_by_admin_at IS NOT NULL
      UNION SELECT canonical_event_id, duplicate_event_id FROM dec WHERE undone_by_admin_at IS NOT NULL"""),
    "valid_proposals": with_tables("vi dec", """SELECT p.day, position, d AS duplicate_id, c AS canonical_id FROM dp p JOIN ev a ON a.id = d JOIN ev b ON b.id = c
      WHERE d <> c AND a.status = 'published' AND b.status = 'published' AND b.duplicate_of IS NULL
      AND (p.region_id, p.day, d) IN (SELECT (region_id, day, id) FROM sets) AND (p.region_id, p.day, c) IN (SELECT (region_id, day, id) FROM sets)
      AND NOT EXISTS (SELECT 1 FROM dec WHERE undone_by_admin_at IS NOT NULL AND ((duplicate_event_id = d AND canonical_event_id = c) OR (duplicate_event_id = c AND canonical_event_id = d)))""",
      **_RSETS, ends="SELECT region_id, day, min(id) AS lo, max(id) AS hi FROM sets GROUP BY ALL",
      dp="SELECT *, 1 AS position, hi AS d, lo AS c FROM ends UNION ALL SELECT *, 2, lo, hi FROM ends UNION ALL SELECT *, 3, lo, lo FROM ends UNION ALL SELECT *, 4, lo + 1, hi FROM ends"),
    "accept_in_order": with_tables("vi", "SELECT chainp.position, d AS duplicate_id, c AS canonical_id FROM applied JOIN chainp USING (position) WHERE ok", recursive=True, prop=_PROP, chainp=_CHAINP, applied=_APPLY),
    "apply_merges": with_tables("vi", """SELECT ev.id, CASE WHEN x.d IS NOT NULL THEN 'duplicate' ELSE status END AS status, coalesce(x.c, duplicate_of) AS duplicate_of FROM ev
      LEFT JOIN (SELECT d, c FROM applied JOIN chainp USING (position) WHERE ok) x ON x.d = ev.id""", recursive=True, prop=_PROP, chainp=_CHAINP, applied=_APPLY),
    "undo_merges": with_tables("dec", """SELECT id, CASE WHEN u THEN 'published' ELSE status END AS status, CASE WHEN NOT u THEN duplicate_of END AS duplicate_of FROM (
      SELECT *, status = 'duplicate' AND id IN (SELECT duplicate_event_id FROM dec WHERE active AND id % 3 = 0) AS u FROM ev)"""),
    "undo_merges_log": with_tables("dec", f"SELECT id, active AND id % 3 <> 0 AS active, CASE WHEN active AND id % 3 = 0 THEN {T_NOW} ELSE undone_by_admin_at END AS undone_by_admin_at FROM dec"),
    "reset_region": with_tables("dec", "SELECT dec.id, active AND ev.region_id <> 2 AS active FROM dec JOIN ev ON ev.id = duplicate_event_id"),
    "real_category": with_tables("vi evcat cdec", "SELECT id, CASE WHEN len(list_filter(slugs, lambda s: s <> 'sonstiges')) > 0 THEN 'opinion' ELSE 'fill' END AS mode FROM sent", sent=_SENT),
    "category_decisions": with_tables("vi evcat cdec", """SELECT id AS event_id, CASE WHEN picked IS NULL OR NOT real THEN 'fill' ELSE 'opinion' END AS mode, status, array_to_string(slugs, ',') AS previous,
      array_to_string(CASE WHEN picked IS NULL OR status = 'agreed' THEN slugs ELSE picked END, ',') AS proposed,
      CASE WHEN picked IS NULL THEN 'kein KI-Vorschlag' WHEN pinned THEN 'Kategorien vom Admin gepinnt' WHEN status = 'applied' THEN 'passt' END AS reason FROM decided""", sent=_SENT, decided=_DECIDE),
    "apply_categories": with_tables("vi evcat cdec", """SELECT event_id, cat.slug FROM evcat JOIN cat ON cat.id = category_id WHERE event_id NOT IN (SELECT id FROM decided WHERE status = 'applied')
      UNION ALL SELECT id, unnest(picked) FROM decided WHERE status = 'applied'""", sent=_SENT, decided=_DECIDE),
    "review_categories": with_tables("evcat cdec", f"""SELECT event_id, cat.slug FROM evcat JOIN cat ON cat.id = category_id WHERE event_id NOT IN (SELECT event_id FROM ch)
      UNION ALL SELECT event_id, unnest(slugs) FROM ch""", rv=_REVIEWED,
      ch=f"SELECT event_id, CASE WHEN verdict = 'applied' THEN proposed_slugs ELSE previous_slugs END AS slugs FROM rv JOIN ev ON ev.id = event_id WHERE verdict = 'applied' OR (verdict = 'undone' AND NOT {_PINNED})"),
    "review_categories_log": with_tables("cdec", f"SELECT id, coalesce(verdict, status) AS status, CASE WHEN verdict IS NOT NULL THEN {T_NOW} END AS reviewed_at FROM rv", rv=_REVIEWED),
    "reset_categories": with_tables("cdec", "SELECT cdec.id FROM cdec JOIN ev ON ev.id = event_id WHERE region_id <> 1"),
    "apply_summaries": with_tables("vi", "SELECT id, CASE WHEN id IN (SELECT id FROM need) THEN CASE WHEN id % 3 = 0 AND id % 9 <> 0 THEN left(repeat(title, 40), 400) ELSE '' END ELSE summary END AS summary FROM ev", need=_NEED),
    "summary_batches": with_tables("vi", _batches("need", _SUMLINE, 20), need=_NEED),
    "category_batches": with_tables("vi evcat cdec", _batches("sent", _CATLINE, 25), sent=_SENT),
    "dedup_lines": with_tables("vi", f"SELECT region_id, day, id, {_DEDLINE} AS line FROM sets", **_RSETS),
}
