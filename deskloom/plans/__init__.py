"""Queries over the driver's tables, one or more for each operator."""

from deskloom.plans import aggregates_and_joins, oracles, text_and_pages, windows_and_time
from deskloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "text_and_pages", "aggregates_and_joins", "windows_and_time", "oracles"]
