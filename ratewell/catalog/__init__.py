"""Runnable queries over the star-schema tables and their check SQL."""

from __future__ import annotations

from importlib import import_module

from ratewell.catalog.base import ORACLES, QUERIES

MODULES = ("ingest", "metrics", "rating", "history", "scans", "audit", "scenarios")


def load():
    for name in MODULES:
        import_module(f"ratewell.catalog.{name}")
    return QUERIES, ORACLES
