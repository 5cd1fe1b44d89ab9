"""All registered queries with their oracle texts."""

from joulegrid.catalog import anomalies, core, forecasts, jobs, reports, sources  # noqa: F401
from joulegrid.catalog.registry import BUILDERS, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "BUILDERS"]
