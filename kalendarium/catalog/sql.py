"""The same model as SQL common table expressions, for checking results on another engine."""

from __future__ import annotations

from kalendarium.catalog.tables import NOW, RUNS_NOW
from kalendarium.model import CATEGORY_SLUGS

T_NOW = f"TIMESTAMP '{NOW}'"
T_RUNS = f"TIMESTAMP '{RUNS_NOW}'"


def translit(x: str) -> str:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"), ("ẞ", "ss")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def strip(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def norm(x: str) -> str:
    return strip(translit(x))


def norm_title(x: str) -> str:
    cut = f"regexp_replace(lower(trim({x}, ' ' || chr(9) || chr(10) || chr(13))), '\\s+[–—-]\\s+.*$', '')"
    return norm(f"regexp_replace({cut}, '\\([^)]*\\)', '', 'g')")


def when_part(s: str, a: str) -> str:
    return f"CASE WHEN {a} THEN strftime({s}, '%Y-%m-%d') ELSE strftime({s}, '%Y-%m-%d %H%M') END"


def dedup_key(title: str, s: str, a: str, place: str) -> str:
    return f"left({norm_title(title)} || '|' || {when_part(s, a)} || '|' || {norm(place)}, 191)"


def utc(x: str) -> str:
    return f"timezone('UTC', timezone('Europe/Berlin', {x}))"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S') || '+0' || CAST(datediff('hour', {utc(x)}, {x}) AS VARCHAR) || ':00'"


def content_hash(p: str = "") -> str:
    c = lambda x: f"coalesce({p}{x}, '')"
    parts = [
        c("title"), f"coalesce({iso(p + 'starts_at')}, '')", f"coalesce({iso(p + 'ends_at')}, '')",
        f"CASE WHEN {p}all_day THEN '1' ELSE '0' END",
        *[c(x) for x in ("venue_name", "city", "location_text", "description", "source_url", "image_url", "price", "organizer")],
        f"array_to_string({p}category_slugs, ',')", f"CASE WHEN {p}is_course THEN '1' ELSE '0' END", c("booking_status"),
    ]
    return "sha1(" + " || '|' || ".join(parts) + ")"


def slug(s: str, title: str) -> str:
    base = f"trim(regexp_replace(lower(left({title}, 80)), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"left(strftime({s}, '%Y-%m-%d') || '-' || {base}, 300)"


def relevant(floor: str, a: str = "") -> str:
    p = f"{a}." if a else ""
    return (
        f"(CASE WHEN NOT {p}all_day AND {p}ends_at IS NOT NULL THEN {p}ends_at > {floor} "
        f"ELSE coalesce({p}ends_at, {p}starts_at) >= date_trunc('day', {floor}) END)"
    )


_SEG = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'bildung' WHEN 'BUILDING' THEN 'kunst' WHEN 'AUTOMOBILE' THEN 'markt' WHEN 'FURNITURE' THEN 'familie' ELSE 'sonstiges' END"

#: ids of second listings begin here
SECOND = 1_000_000_000_000

OCC = f"""first_listing AS (
  SELECT o_orderkey AS id,
    coalesce(p_name, 'Ohne Titel') || CASE (o_orderkey // 20) % 3 WHEN 1 THEN ' - Eintritt frei' WHEN 2 THEN ' (Open Air)' ELSE '' END AS title,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate ELSE o_orderdate + to_hours(8 + o_orderkey % 12) END AS starts_at,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 5 AS INT))
      ELSE o_orderdate + to_days(CAST(o_orderkey % 2 AS INT)) + to_hours(10 + o_orderkey % 12) END AS ends_at,
    o_orderkey % 4 = 0 AS all_day,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE repeat(p_type, o_orderkey % 5) END AS description,
    CASE o_orderkey % 4 WHEN 1 THEN 'Kurz: ' || p_brand WHEN 3 THEN '' END AS summary,
    CASE WHEN o_orderkey % 7 <> 0 THEN s_suppkey END AS venue_id,
    CASE WHEN o_orderkey % 7 <> 0 THEN s_name END AS venue_name,
    n_name AS city,
    CASE WHEN o_orderkey % 14 = 0 THEN 'Saal ' || p_brand END AS location_text,
    CAST(n_regionkey AS BIGINT) AS region_id, CAST(c_nationkey AS BIGINT) AS source_id,
    CASE WHEN o_orderkey % 8 <> 0 THEN 'https://' || lower(c_mktsegment) || '.example/e/' || o_orderkey END AS source_url,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://img.example/' || o_orderkey || '.jpg' END AS image_url,
    CASE o_orderkey % 4 WHEN 1 THEN 'Eintritt frei' WHEN 2 THEN (o_orderkey % 50) || ',50 €' END AS price,
    CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 3 <> 1 THEN c_name END AS organizer,
    CASE WHEN o_orderkey % 10 = 5 THEN 'manual:' || o_orderkey WHEN o_orderkey % 10 <> 0 THEN 'ext-' || o_orderkey END AS external_id,
    CASE WHEN o_orderkey % 13 = 0 THEN 'hidden' WHEN o_orderstatus = 'F' THEN 'duplicate' ELSE 'published' END AS status,
    o_orderkey % 6 = 0 AS is_course,
    CASE WHEN o_orderkey % 23 = 0 THEN 'cancelled' WHEN o_orderkey % 19 = 0 THEN 'full' END AS booking_status,
    CASE WHEN o_orderpriority = '1-URGENT' THEN [{_SEG}, 'musik'] ELSE [{_SEG}] END AS category_slugs
  FROM orders JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT l_orderkey, min({{'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}}) AS l FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    LEFT JOIN part ON p_partkey = l.p LEFT JOIN supplier ON s_suppkey = l.s JOIN nation ON n_nationkey = coalesce(s_nationkey, c_nationkey)),
occ AS (
  SELECT * FROM first_listing UNION ALL
  SELECT * REPLACE (id + {SECOND} AS id, (source_id + 5) % 25 AS source_id, 'https://zweit.example/e/' || id AS source_url,
    CASE WHEN id % 3 = 0 THEN image_url ELSE 'https://zweit.example/' || id || '.jpg' END AS image_url, CASE WHEN id % 4 <> 1 THEN description END AS description,
    CASE WHEN id % 7 <> 2 THEN price END AS price, 'zweit-' || id AS external_id, CASE status WHEN 'duplicate' THEN 'published' ELSE status END AS status)
  FROM first_listing WHERE id % 5 = 3)"""

EV = f"""ev AS (
  SELECT id, title, {slug('starts_at', 'title')} AS slug, description, summary, starts_at, ends_at, all_day, venue_id, location_text,
    region_id, source_id, source_url, image_url, price, organizer, external_id, {content_hash()} AS content_hash,
    {dedup_key('title', 'starts_at', 'all_day', 'city')} AS dedup_key,
    CASE WHEN status = 'duplicate' AND id % 11 <> 0 THEN CASE WHEN id % 17 = 0 THEN id + 1 ELSE id - 1 END END AS duplicate_of,
    status, CASE WHEN status = 'hidden' AND id % 2 = 0 THEN {T_NOW} - INTERVAL 3 DAY END AS pruned_at, is_course, booking_status,
    list_filter([CASE WHEN id % 29 = 0 THEN 'title' END, CASE WHEN id % 31 = 0 THEN 'imageUrl' END, CASE WHEN id % 31 = 0 THEN 'description' END,
      CASE WHEN id % 12 = 0 THEN 'categories' END, CASE WHEN id % 37 = 0 THEN 'datum' END, CASE WHEN id % 41 = 0 THEN 'organizer' END], lambda x: x IS NOT NULL) AS locked_fields,
    {T_NOW} - INTERVAL 40 DAY AS first_seen_at, {T_NOW} - to_days(CAST(id % 15 AS INT)) AS last_seen_at
  FROM occ)"""

VEN = f"""ven AS (
  SELECT s_suppkey AS id, CAST(n_regionkey AS BIGINT) AS region_id, s_name AS name,
    CASE WHEN s_suppkey % 3 <> 0 THEN 'Weg ' || s_suppkey END AS street,
    CASE WHEN s_suppkey % 4 <> 0 THEN lpad(CAST(s_suppkey * 37 % 100000 AS VARCHAR), 5, '0') END AS postal_code, n_name AS city,
    {strip('s_name')} || '|' || {strip('n_name')} AS dedup_key
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""

SRC = """src AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS region_id, lower(n_name) AS key, 'Quelle ' || n_name AS name,
    CASE WHEN n_nationkey % 5 = 4 THEN 'manual' ELSE 'feed' END AS type, 'https://www.' || lower(n_name) || '.example/feed?x=1' AS url,
    'ics' AS importer, n_nationkey % 9 <> 0 AS enabled, n_nationkey % 4 = 0 AS facts_only,
    CASE WHEN n_nationkey % 3 <> 0 THEN TIMESTAMP '1998-01-01 00:00:00' END AS approved_at, n_name AS config_city
  FROM nation)"""

REG = """reg AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, lower(replace(r_name, ' ', '-')) AS key, r_name AS site_name, 'Raum ' || r_name AS area_name,
    lower(replace(r_name, ' ', '-')) || '.example' AS canonical_host,
    (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey LIMIT 1) AS default_city
  FROM region)"""

CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    f"(CAST({i + 1} AS BIGINT), '{s}', {i + 1})" for i, s in enumerate(CATEGORY_SLUGS)
) + ") AS t(id, slug, sort_order))"

EVCAT = "evcat AS (SELECT o.id AS event_id, cat.id AS category_id FROM (SELECT id, unnest(category_slugs) AS slug FROM occ) o JOIN cat ON cat.slug = o.slug)"

DEC = f"""dec AS (
  SELECT id, CAST(starts_at AS DATE) AS day, id AS duplicate_event_id, duplicate_of AS canonical_event_id, 'gleich ' || id AS reason,
    id % 7 <> 0 AS active, CASE WHEN id % 35 = 0 THEN {T_NOW} - INTERVAL 1 DAY END AS undone_by_admin_at,
    {T_NOW} - to_days(CAST(id % 30 AS INT)) AS created_at
  FROM ev WHERE status = 'duplicate' AND duplicate_of IS NOT NULL AND id % 5 = 0)"""

CDEC = f"""cdec AS (
  SELECT id, id AS event_id, CASE WHEN id % 8 = 2 THEN 'fill' ELSE 'opinion' END AS mode,
    CASE id % 12 WHEN 2 THEN 'applied' WHEN 6 THEN 'pending' ELSE 'agreed' END AS status,
    ['sonstiges'] AS previous_slugs, ['musik', 'party'] AS proposed_slugs,
    {T_NOW} - to_minutes(id % 100 + 1) AS created_at
  FROM ev WHERE id % 4 = 2)"""

RUNS = """runs AS (
  SELECT event_id AS id, user_id % 25 AS source_id, date_trunc('second', ts) AS started_at,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' WHEN 'click' THEN 'running' ELSE 'ok' END AS status,
    CAST(json_extract_string(props, '$.k') AS INT) % 4 AS seen, event_id % 21 = 0 AS dry_run,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Fehler ' || json_extract_string(props, '$.k') END AS message
  FROM events)"""

VISITS = """vis AS (
  SELECT ts, CAST(user_id % 5 AS BIGINT) AS bucket,
    CASE event_type WHEN 'view' THEN 'event_show' WHEN 'error' THEN '_error' WHEN 'signup' THEN 'admin_home' ELSE event_type END AS route,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS event_id, CASE WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS status,
    CAST(user_id AS VARCHAR) AS client_ip,
    CASE WHEN event_id % 11 = 0 THEN 'SomeBot/1.0' WHEN event_id % 13 = 0 THEN '' ELSE 'Mozilla ' || (user_id % 7) END AS user_agent
  FROM events)"""

INC = f"""inc0 AS (
  SELECT source_id, id AS position, CASE WHEN id % 97 = 0 THEN '' WHEN id % 3 = 2 AND id < {SECOND} THEN 'Neu ' || title ELSE title END AS title, starts_at, ends_at, all_day,
    CASE WHEN id % 3 = 1 THEN coalesce(description, '') || ' neu' ELSE description END AS description, venue_name,
    CASE WHEN id % 9 = 0 THEN lower(city) WHEN id % 9 = 1 THEN 'Ort ' || region_id ELSE city END AS city, location_text, category_slugs, source_url, image_url,
    price, organizer, CASE WHEN id % 3 = 2 AND id % 10 = 0 THEN NULL WHEN id % 3 = 2 THEN 'neu-' || id ELSE external_id END AS external_id, is_course, booking_status
  FROM occ)"""

INCALL = """inc AS (SELECT * FROM inc0 UNION ALL SELECT * REPLACE (position + 10000000000 AS position, title || ' II' AS title, 'zweiter Stand' AS description) FROM inc0 WHERE position % 20 = 7)"""

TOWNS = f"""towns AS (SELECT CAST(n_regionkey AS BIGINT) AS region_id, n_nationkey AS ord, n_name AS name, {norm('n_name')} AS key FROM nation)"""


def canonical_city(raw: str, region: str) -> str:
    key = norm(raw)
    alias = f"CASE WHEN {key} = 'ort' || {region} THEN (SELECT name FROM towns t WHERE t.region_id = {region} ORDER BY ord LIMIT 1 OFFSET 1) END"
    prefix = f"(SELECT name FROM towns t WHERE t.region_id = {region} AND starts_with({key}, t.key) ORDER BY ord LIMIT 1)"
    return f"coalesce({alias}, {prefix}, {raw})"


INCN = f"""incn AS MATERIALIZED (
  SELECT *, {dedup_key('title', 'starts_at', 'all_day', 'coalesce(city, venue_name, location_text, ' + chr(39) * 2 + ')')} AS dedup_key, {content_hash()} AS content_hash
  FROM (SELECT inc.* REPLACE ({canonical_city('inc.city', 's.region_id')} AS city), s.region_id FROM inc JOIN src s ON s.id = inc.source_id WHERE title <> ''))"""

STEPS = """steps AS MATERIALIZED (
  SELECT *, lag(content_hash) OVER w AS before_hash, lag(description) OVER w AS before_text FROM (
    SELECT *, CASE WHEN matched_id IS NULL THEN run_key ELSE 'ev:' || matched_id END AS entity FROM (
      SELECT n.*, CASE WHEN coalesce(n.external_id, '') <> '' THEN 'id:' || n.external_id ELSE 'key:' || n.dedup_key END AS run_key,
        CASE WHEN coalesce(n.external_id, '') <> '' THEN a.id ELSE b.id END AS matched_id FROM incn n
      LEFT JOIN (SELECT source_id, external_id, min(id) AS id FROM ev WHERE coalesce(external_id, '') <> '' GROUP BY ALL) a ON a.source_id = n.source_id AND a.external_id = n.external_id
      LEFT JOIN (SELECT source_id, dedup_key, min(id) AS id FROM ev GROUP BY ALL) b ON b.source_id = n.source_id AND b.dedup_key = n.dedup_key))
  WINDOW w AS (PARTITION BY source_id, entity ORDER BY position))"""

ACTED = """acted AS (
  SELECT s.*, CASE WHEN matched_id IS NOT NULL AND s.content_hash = coalesce(before_hash, e.content_hash) THEN 'unchanged' WHEN matched_id IS NOT NULL THEN 'updated'
      WHEN before_hash IS NULL THEN 'created' ELSE 'unchanged' END AS action,
    matched_id IS NOT NULL AND s.content_hash <> coalesce(before_hash, e.content_hash)
      AND s.description IS DISTINCT FROM CASE WHEN before_hash IS NULL THEN e.description ELSE before_text END AS new_text
  FROM steps s LEFT JOIN ev e ON e.id = matched_id)"""

HEADS = """heads AS MATERIALIZED (
  SELECT * FROM (SELECT *, max(CASE WHEN action = 'updated' THEN 1 ELSE 0 END) OVER p = 1 AS changed, max(CASE WHEN new_text THEN 1 ELSE 0 END) OVER p = 1 AS cleared,
    row_number() OVER (PARTITION BY source_id, entity ORDER BY CASE WHEN matched_id IS NULL THEN position ELSE -position END) AS rn FROM acted
    WINDOW p AS (PARTITION BY source_id, entity)) WHERE rn = 1)"""

CREATED = """created AS (
  SELECT h.*, (SELECT max(id) FROM ev) + row_number() OVER (ORDER BY left(md5(h.source_id || '|' || run_key), 3), h.source_id || '|' || run_key) AS id, m.matched_id AS canonical_id
  FROM heads h LEFT JOIN (SELECT x.source_id, x.run_key, min(e.id) AS matched_id FROM heads x JOIN ev e ON e.dedup_key = x.dedup_key AND e.region_id = x.region_id AND e.source_id <> x.source_id
    AND e.status = 'published' JOIN src ON src.id = e.source_id AND enabled WHERE x.matched_id IS NULL GROUP BY ALL) m USING (source_id, run_key)
  WHERE h.matched_id IS NULL)"""

VENUED = f"""vw AS (
  SELECT region_id, dk AS dedup_key, first(name ORDER BY source_id, position) AS name, first(c ORDER BY source_id, position) AS city FROM (
    SELECT h.region_id, h.source_id, h.position, h.venue_name AS name, coalesce(h.city, r.default_city) AS c, {strip('h.venue_name')} || '|' || {strip('coalesce(h.city, r.default_city)')} AS dk
    FROM heads h JOIN reg r ON r.id = h.region_id WHERE (matched_id IS NULL OR changed) AND venue_name IS NOT NULL) GROUP BY region_id, dk),
ven2 AS (
  SELECT id, region_id, name, city, dedup_key FROM ven UNION ALL
  SELECT (SELECT max(id) FROM ven) + row_number() OVER (ORDER BY left(md5(region_id || '|' || dedup_key), 3), region_id || '|' || dedup_key), region_id, name, city, dedup_key
  FROM vw WHERE NOT EXISTS (SELECT 1 FROM ven v WHERE v.region_id = vw.region_id AND v.dedup_key = vw.dedup_key))"""

CTES = {"inc0": INC, "inc": INCALL, "towns": TOWNS, "incn": INCN, "steps": STEPS, "acted": ACTED, "heads": HEADS, "created": CREATED, "ven2": VENUED, "occ": OCC, "ev": EV, "ven": VEN, "src": SRC, "reg": REG, "cat": CAT, "evcat": EVCAT, "dec": DEC, "cdec": CDEC, "runs": RUNS, "vis": VISITS}
NEEDS = {"inc0": ["occ"], "inc": ["inc0"], "incn": ["inc", "src", "towns"], "steps": ["incn", "ev"], "acted": ["steps"], "heads": ["acted"], "created": ["heads"], "ven2": ["heads", "reg", "ven"], "ev": ["occ"], "evcat": ["occ", "cat"], "dec": ["ev"], "cdec": ["ev"]}

VISIBLE = """vi AS (
  SELECT e.*, s.key AS source_key, s.name AS source_name, s.type AS source_type, s.facts_only, s.approved_at, s.enabled, s.url AS source_home,
    v.name AS venue_name, v.city AS venue_city, v.street, v.postal_code
  FROM ev e JOIN src s ON s.id = e.source_id LEFT JOIN ven v ON v.id = e.venue_id WHERE e.status = 'published' AND s.enabled)"""
CTES["vi"] = VISIBLE
NEEDS["vi"] = ["ev", "src", "ven"]

ENRICHED = VISIBLE.replace("vi AS (", "en AS (").replace(" WHERE e.status = 'published' AND s.enabled", "")
CTES["en"] = ENRICHED
NEEDS["en"] = NEEDS["vi"]


def with_tables(names: str, body: str, recursive: bool = False, **more: str) -> str:
    """``body`` after the named tables and everything they build on; ``more`` adds further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = [CTES[n] for n in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
