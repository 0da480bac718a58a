"""Registry of the engine's queries: name -> callable, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

MODULES = ("events_q", "series_q", "text_q", "graph_q", "ledger_q", "stream_q", "insight_q", "knowledge_q", "feeds_q", "digest_q", "filters_q", "lookups_q", "reports_q", "rules_q", "records_q", "impacts_q", "relations_q", "paths_q", "ranking_q", "store_q")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) as a query."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")
