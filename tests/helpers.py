"""Small-table builders for literal tests."""

import datetime as dt

from kalendarium import model


def at(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def table(spark, ddl, rows, **defaults):
    """Rows as dicts over a schema; missing columns take the default or null."""
    names = [part.split()[0] for part in ddl.replace("map<string,string>", "map").split(", ")]
    return spark.createDataFrame([tuple(r.get(n, defaults.get(n)) for n in names) for r in rows], ddl)


def events(spark, rows):
    base = dict(all_day=False, region_id=1, source_id=1, status="published", locked_fields=[], is_course=False, slug="s", first_seen_at=at("2026-01-01"),
                last_seen_at=at("2026-06-01"), title="T", starts_at=at("2026-07-01 20:00"))
    return table(spark, model.EVENTS, rows, **base)


def sources(spark, rows=({"id": 1},)):
    base = dict(region_id=1, key="k", name="Quelle", type="feed", url="https://q.example/feed", importer="ics", enabled=True, facts_only=False, config={})
    return table(spark, model.SOURCES, rows, **base)


def regions(spark, rows=({"id": 1},)):
    base = dict(key="guetersloh", site_name="R", area_name="R", canonical_host="r.example", default_city="Kreis Gütersloh", host_aliases=[], cities=[], city_aliases={}, enabled=True)
    return table(spark, model.REGIONS, rows, **base)


def incoming(spark, rows):
    base = dict(source_id=1, position=0, title="T", starts_at=at("2026-07-01 20:00"), all_day=False, category_slugs=[], is_course=False)
    return table(spark, model.INCOMING, [{**base, "position": i, **r} for i, r in enumerate(rows)])


def rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()], key=repr)
