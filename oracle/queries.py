"""SQL counterpart of every registered query that SQL can express."""

from __future__ import annotations

import importlib

GROUPS = ("ingest", "selection", "valuing", "scanning", "backtesting", "planning", "risking",
          "reconciling", "filing", "reading", "stateful")


def load() -> dict[str, str]:
    out: dict[str, str] = {}
    for group in GROUPS:
        out.update(importlib.import_module(f"oracle.{group}").SQL)
    return out
