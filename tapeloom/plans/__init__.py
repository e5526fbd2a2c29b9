"""Named queries: operators bound to tables, each beside the SQL it must equal."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

_MODULES = (
    "tape_checks",
    "asof_queries",
    "book_queries",
    "state_queries",
    "summary_queries",
    "bar_queries",
    "chain_queries",
    "inference_queries",
    "order_queries",
    "panel_queries",
    "stream_queries",
    "feature_queries",
    "study_queries",
    "resampling_queries",
    "learning_queries",
    "ranktest_queries",
    "gram_queries",
    "exit_queries",
    "response_queries",
    "observation_queries",
)


def load_all() -> tuple[dict, dict]:
    """Import every query module once and return the registry."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
