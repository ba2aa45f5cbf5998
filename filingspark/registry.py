"""All queries of the library, by name, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from . import queries_features, queries_joins, queries_labels, queries_market, queries_metrics, queries_models, queries_panel, queries_sourcing
from .views import portable

_MODULES = (queries_market, queries_panel, queries_metrics, queries_joins, queries_labels, queries_features, queries_models, queries_sourcing)


def queries() -> dict[str, Callable]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: portable(sql) for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
