"""Registry of the engine's own queries."""

from __future__ import annotations

from .plans import capability, dialogue, graph, journal, logs, more, retrieval, sources, streams, structure, telemetry  # noqa: F401
from .plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
