"""City normalization against region configuration, and the region membership filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium.functions.keys import city_key, normalize, transliterate
from kalendarium.functions.places import BUILT_IN_REGION, LOCALITY_TOWN, TOWN_PREFIXES
from kalendarium.functions.text import blank_to_null, squeeze, trim_edges


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _region_config(regions: DataFrame) -> DataFrame:
    """One row per region: alias map, (key, name) list and default, keys computed once."""
    return regions.select(
        F.col("id").alias("region_id"), F.col("key").alias("_region_key"), F.col("city_aliases").alias("_aliases"),
        F.transform("cities", lambda c: F.struct(city_key(c).alias("key"), c.alias("name"))).alias("_cities"),
        F.col("default_city").alias("_default_city"), city_key(F.col("default_city")).alias("_default_key"),
    )


def _resolved(raw: Column, key: Column) -> Column:
    """Exact alias, else the first configured city whose key is a prefix, else the default itself;
    built-in tables only for their own region (or none); anything else stays as given."""
    by_prefix = F.get(F.filter("_cities", lambda c: F.startswith(key, c["key"])), F.lit(0))["name"]
    by_default = F.when(key == F.col("_default_key"), F.col("_default_city"))
    towns = F.array(*[F.struct(F.lit(town).alias("name"), F.lit(prefix).alias("key")) for town, prefix in TOWN_PREFIXES.items()])
    town = F.get(F.filter(towns, lambda t: F.startswith(key, t["key"])), F.lit(0))["name"]
    built_in = F.coalesce(F.element_at(_literal_map(LOCALITY_TOWN), key), town)
    use_built_in = F.coalesce(F.col("_region_key"), F.lit(BUILT_IN_REGION)) == BUILT_IN_REGION
    return F.coalesce(F.element_at(F.col("_aliases"), key), by_prefix, by_default, F.when(use_built_in, built_in), raw)


def normalize_city(df: DataFrame, regions: DataFrame, city: str = "city") -> DataFrame:
    """``city`` replaced by its canonical name for the row's ``region_id`` (which may be null)."""
    raw = blank_to_null(trim_edges(F.col(city)))
    joined = df.join(_region_config(regions), "region_id", "left").withColumn("_key", city_key(raw))
    return joined.withColumn(city, _resolved(raw, F.col("_key"))).select(*df.columns)


def place_tokens(c: Column) -> Column:
    return F.split(F.regexp_replace(transliterate(F.lower(c)), "[^a-z0-9]+", " "), " ")


def _mentions(place: Column, tokens: Column, compact: Column) -> Column:
    """Short keys must be a whole token, longer ones may be part of the run-together text."""
    return (place != "") & (F.array_contains(tokens, place) | ((F.length(place) > 5) & F.contains(compact, place)))


def region_match(rows: DataFrame, regions: DataFrame, postal_prefixes: Column) -> DataFrame:
    """Adds ``matched_city`` (null: outside the region). ``rows`` needs region_id, title, venue_name,
    address, city and zip; ``postal_prefixes`` is the source's configured prefix array."""
    config = _region_config(regions)
    raw_city = F.regexp_replace(trim_edges(squeeze(F.coalesce("city", F.lit("")))), r"^\d{5}\s+", "")
    joined = rows.join(config, "region_id").withColumn("_key", city_key(raw_city))
    digits = F.regexp_replace(F.coalesce("zip", F.lit("")), r"\D+", "")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "venue_name", "address")]
    text = F.concat_ws(" ", *parts, raw_city, F.coalesce("zip", F.lit("")))
    known = (
        joined.withColumn("_norm", F.when(raw_city != "", _resolved(raw_city, F.col("_key"))))
        .withColumn("_tokens", place_tokens(text)).withColumn("_compact", city_key(text))
    )
    default = F.col("_default_city")
    in_region = F.exists("_cities", lambda c: c["name"] == F.col("_norm")) & (F.col("_norm") != default)
    by_zip = F.when((digits != "") & F.exists(postal_prefixes, lambda p: F.startswith(digits, p)), default)
    other_aliases = F.filter(F.map_entries("_aliases"), lambda e: (e["value"] != default) & _mentions(e["key"], F.col("_tokens"), F.col("_compact")))
    other_cities = F.filter("_cities", lambda c: (c["name"] != default) & _mentions(c["key"], F.col("_tokens"), F.col("_compact")))
    matched = F.coalesce(
        F.when(in_region, F.col("_norm")), by_zip, F.get(other_aliases, F.lit(0))["value"], F.get(other_cities, F.lit(0))["name"]
    )
    return known.withColumn("matched_city", matched).select(*rows.columns, "matched_city")


def in_allowed_area(city: Column, zip_code: Column, allowed_cities: Column, postal_prefixes: Column) -> Column:
    """True without configuration; else by postal prefix or equal normalized city."""
    cities = F.coalesce(allowed_cities, F.array().cast("array<string>"))
    prefixes = F.coalesce(postal_prefixes, F.array().cast("array<string>"))
    code = F.trim(F.coalesce(zip_code, F.lit("")))
    by_zip = F.exists(prefixes, lambda p: (p != "") & F.startswith(code, p))
    by_city = F.exists(cities, lambda c: normalize(c) == normalize(F.coalesce(city, F.lit(""))))
    return ((F.size(cities) == 0) & (F.size(prefixes) == 0)) | by_zip | by_city
