"""All queries of the telemetry engine; importing a module registers its queries."""

from . import catalogue_queries, dashboard_queries, ingest_queries, intake_queries, merge_queries, series_queries, session_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue_queries", "dashboard_queries", "ingest_queries", "intake_queries", "merge_queries", "series_queries", "session_queries"]
