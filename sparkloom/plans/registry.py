"""Every registered query of the engine, by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from sparkloom.plans import journeys, models, parts, relational, retrieval, review, streams, texts
from sparkloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "journeys", "models", "parts", "relational", "retrieval", "review", "streams", "texts"]
