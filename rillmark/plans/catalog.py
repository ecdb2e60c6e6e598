"""All registered queries, and SQL for DuckDB that gives the same rows."""

from rillmark.plans import exposure, learning, rasters, reports
from rillmark.plans.sql import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "exposure", "learning", "rasters", "reports"]
