"""Dimension seeding and configuration patches; small display projections; rights masking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium.functions.text import blank_to_null
from kalendarium.operators.resolve import can_show_image


def seed_dimension(current: DataFrame, definitions: DataFrame, key: Sequence[str], keep: Sequence[str] = (), merge: Sequence[str] = (), forced: dict[str, Column] | None = None) -> DataFrame:
    """Idempotent create-or-update. ``keep`` columns are only set on creation (operator choices
    survive), ``merge`` map columns are merged key-wise, ``forced`` values apply on every run."""
    mine = current.select(*key, F.struct(*[c for c in current.columns if c not in key]).alias("_old"))
    given = definitions.select(*key, F.struct(*[c for c in definitions.columns if c not in key]).alias("_def"))
    joined = mine.join(given, list(key), "full")
    fields = {f.name: f.dataType for f in current.schema.fields}

    def value(name: str) -> Column:
        old = F.col("_old")[name]
        if name not in definitions.columns:
            new = old
        elif name in merge:
            empty = F.create_map().cast(fields[name])
            new = F.when(F.col("_def").isNull(), old).otherwise(merged_map(F.coalesce(old, empty), F.coalesce(F.col("_def")[name], empty)))
        elif name in keep:
            new = F.when(F.col("_old").isNotNull(), old).otherwise(F.col("_def")[name])
        else:
            new = F.when(F.col("_def").isNull(), old).otherwise(F.col("_def")[name])
        return new

    rows = joined.select(*[F.col(c) if c in key else value(c).alias(c) for c in current.columns])
    return rows.withColumns(forced or {})


def merged_map(base: Column, patch: Column) -> Column:
    """``base || patch``: the patch wins, whatever the session's duplicate-key policy."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(patch), k)), patch)


def patch_config(sources: DataFrame, patches: DataFrame) -> DataFrame:
    """``config = coalesce(config, {}) || patch`` for the listed sources (id, patch as JSON text)."""
    text_map = "map<string,string>"
    delta = patches.select("id", F.from_json("patch", text_map).alias("_patch"))
    config = F.coalesce("config", F.create_map().cast(text_map))
    patched = F.when(F.col("_patch").isNotNull(), merged_map(config, F.col("_patch"))).otherwise(F.col("config"))
    return sources.join(delta, "id", "left").withColumn("config", patched).select(*sources.columns)


def mask_rights(enriched: DataFrame) -> DataFrame:
    """Facts-only sources show no description, summary or image; images also need the publishing right."""
    own = ~F.col("source_facts_only")
    return enriched.withColumns({
        "description": F.when(own, F.col("description")), "summary": F.when(own, F.col("summary")), "image_url": F.when(can_show_image(), F.col("image_url")),
    })


def full_address() -> Column:
    place = blank_to_null(F.trim(F.concat_ws(" ", "venue_postal_code", "venue_city")))
    return F.concat_ws(", ", blank_to_null(F.col("venue_street")), place)
