"""Identity keys: normalized names, cross-source key, content hash, slugs, visitor tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kalendarium.functions.text import trim_edges
from kalendarium.functions.times import iso_berlin
from kalendarium.model import CAPS, VENUE_KEY_CAP

# Spellings that count as equal in keys.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss", "ẞ": "ss"}


def transliterate(c: Column) -> Column:
    for letter, plain in UMLAUTS.items():
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return c


def strip_to_ascii(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim_edges(c)), "[^a-z0-9]+", "")


def normalize(c: Column) -> Column:
    return strip_to_ascii(transliterate(c))


def undecorated_title(c: Column) -> Column:
    """Lower case, cut at the first spaced dash, parentheticals dropped."""
    low = F.lower(trim_edges(c))
    return F.regexp_replace(F.regexp_replace(low, r"(?U)\s+[–—-]\s+.*$", ""), r"\([^)]*\)", "")


def normalize_title(c: Column) -> Column:
    return normalize(undecorated_title(c))


def when_part(starts_at: Column, all_day: Column) -> Column:
    return F.when(all_day, F.date_format(starts_at, "yyyy-MM-dd")).otherwise(F.date_format(starts_at, "yyyy-MM-dd HHmm"))


def dedup_key(title: Column, starts_at: Column, all_day: Column, *places: Column) -> Column:
    """``title|day[ HHmm]|place`` with the first non-null place."""
    place = F.coalesce(*places, F.lit(""))
    return F.left(
        F.concat_ws("|", normalize_title(title), when_part(starts_at, all_day), normalize(place)),
        F.lit(CAPS["dedup_key"]),
    )


def content_hash(fields: dict[str, Column]) -> Column:
    """sha1 over the fifteen compared fields, nulls as empty text."""
    flag = lambda c: F.when(c, "1").otherwise("0")
    parts = [
        fields["title"],
        iso_berlin(fields["starts_at"]),
        iso_berlin(fields["ends_at"]),
        flag(fields["all_day"]),
        *[fields[n] for n in ("venue_name", "city", "location_text", "description", "source_url", "image_url", "price", "organizer")],
        F.array_join(fields["category_slugs"], ","),
        flag(fields["is_course"]),
        fields["booking_status"],
    ]
    return F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def venue_key(name: Column, city: Column) -> Column:
    return F.left(F.concat_ws("|", strip_to_ascii(name), strip_to_ascii(city)), F.lit(VENUE_KEY_CAP))


def city_key(c: Column) -> Column:
    return strip_to_ascii(transliterate(F.lower(c)))


def slug(starts_at: Column, title: Column) -> Column:
    """``date-ascii-title``: accents folded, other runs to one hyphen."""
    head = F.left(title, F.lit(80))
    for letter, plain in {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o"}.items():
        head = F.replace(F.lower(head), F.lit(letter), F.lit(plain))
    folded = F.translate(head, "äàáâãåöòóôõüùúûéèêëíìîïçñýÿ", "aaaaaaooooouuuueeeeiiiicnyy")
    base = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.left(F.concat_ws("-", F.date_format(starts_at, "yyyy-MM-dd"), base), F.lit(CAPS["slug"]))


def location_tokens(c: Column) -> Column:
    """Distinct lower-case tokens of at least four letters or digits."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9äöüß]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))


def visitor_token(secret: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def run_key(external_id: Column, dedup: Column) -> Column:
    """Identity within one source: the external id, else the cross-source key; the prefixes keep them apart."""
    has_id = F.coalesce(external_id, F.lit("")) != ""
    return F.when(has_id, F.concat(F.lit("id:"), external_id)).otherwise(F.concat(F.lit("key:"), dedup))


def all_slugs(*parts: Column) -> Column:
    """Primary slug and extras: non-empty, distinct, in order."""
    arrays = [F.coalesce(p, F.array().cast("array<string>")) for p in parts]
    return F.array_distinct(F.filter(F.concat(*arrays), lambda s: s.isNotNull() & (s != "")))
