"""All registered queries."""

from __future__ import annotations

import importlib

from logtide.plans.registry import ORACLES, QUERIES, Query

MODULES = ["ingest_queries", "search_queries", "alert_queries", "model_queries", "rule_queries", "stream_queries", "table_queries"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"logtide.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
