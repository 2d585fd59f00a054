"""The registered queries and, for each that SQL can express, its SQL."""

from __future__ import annotations

from . import audits, climatology, forecasts, modelling, quality_control, run_logs, series, spatial  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
