"""Registered queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib

FAMILIES = ["listing", "health", "merge", "resolve", "extract"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        part = getattr(importlib.import_module(f"kalendarium.catalog.{family}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
