"""The library's queries, each a plan over the driver's tables."""

from __future__ import annotations

import importlib

from orbweave.plans.registry import ORACLES, QUERIES, Query

MODULES = ("vector_queries", "evaluation_queries", "upkeep_queries", "program_queries", "metric_queries", "report_queries", "evt_queries", "bank_queries", "grid_queries", "image_queries", "stream_queries")


def queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"orbweave.plans.{name}")
    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLES
