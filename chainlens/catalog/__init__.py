"""Registered queries: each operator over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from chainlens.catalog import chains, comparing, convergence, draws, event_samples, prediction, shapes
from chainlens.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "chains", "comparing", "convergence", "draws", "event_samples", "prediction", "shapes"]
