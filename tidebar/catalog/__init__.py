"""Registered queries with the SQL they must agree with."""

from importlib import import_module

AREAS = ("source_queries", "indicator_queries", "signal_queries", "regime_queries", "replay_queries", "ledger_queries", "equity_queries", "sweep_queries", "context_queries", "stream_queries")


def load() -> None:
    for area in AREAS:
        import_module(f"tidebar.catalog.{area}")
