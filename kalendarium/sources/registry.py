"""Importer key to extraction job: the extension point of the import.

A job takes ``(bodies, sources)`` and returns incoming rows and error rows; a dated job also takes the time
of the import.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendarium.model import INCOMING_COLUMNS
from kalendarium.sources import feeds, ics, jsonld, pages, payloads

Job = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _no_errors(bodies: DataFrame) -> DataFrame:
    return bodies.select("source_id", "url", F.lit("").alias("message")).filter(F.lit(False))


def job(extract: Callable[[DataFrame, DataFrame], DataFrame]) -> Job:
    return lambda bodies, sources: (extract(bodies, sources), _no_errors(bodies))


#: the opening tag of an element that is an event
EVENT_CONTAINER = r"""<[a-z][a-z0-9]*\b[^>]*\bitemtype\s*=\s*["']https?://schema\.org/[a-z]*event["']"""

JOBS: dict[str, Job] = {
    "ics": job(ics.extract_ics),
    "rss": feeds.extract_feed_items,
    "jsonld": job(jsonld.extract_jsonld),
    "tribe_events": job(payloads.extract_tribe),
    "tribe_national": job(lambda bodies, sources: payloads.extract_tribe(bodies, sources, national=True)),
    "flat_json": job(payloads.extract_flat_json),
    "microdata": job(lambda bodies, sources: pages.extract_microdata(bodies, sources, EVENT_CONTAINER)),
}

DATED_JOBS: dict[str, Callable[[DataFrame, DataFrame, str], tuple[DataFrame, DataFrame]]] = {
    "intervals": lambda bodies, sources, now: (payloads.extract_intervals(bodies, sources, now), _no_errors(bodies)),
}


def register(key: str, extraction: Job) -> None:
    JOBS[key] = extraction


def _run(key: str, bodies: DataFrame, sources: DataFrame, now: str | None) -> tuple[DataFrame, DataFrame]:
    if key in DATED_JOBS:
        if now is None:
            raise ValueError(f"importer {key} needs the time of the import")
        return DATED_JOBS[key](bodies, sources, now)
    return JOBS[key](bodies, sources)


def extract_all(bodies: DataFrame, sources: DataFrame, keys: list[str], now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All named importers over their sources' bodies, as one plan."""
    importer = sources.select(F.col("id").alias("source_id"), "importer")
    tagged = bodies.join(importer, "source_id")
    parts = [_run(key, tagged.filter(F.col("importer") == key).drop("importer"), sources, now) for key in keys]
    rows = reduce(DataFrame.unionByName, [p[0].select(*INCOMING_COLUMNS) for p in parts])
    return rows, reduce(DataFrame.unionByName, [p[1] for p in parts])
