"""Registered queries, grouped by area."""

import importlib

GROUPS = ("ingest", "selection", "valuing", "scanning", "backtesting", "planning", "risking",
          "reconciling", "filing", "reading", "stateful")


def load() -> dict:
    from tidemark.plans import registry

    for group in GROUPS:
        importlib.import_module(f"tidemark.plans.{group}")
    return dict(registry.QUERIES)
