"""All registered queries."""

from policylake.registry import (
    coverage_reports, extracts, retrieval_queries, scores, stores, texts, versions, webpages, whole_flows,
)  # noqa: F401
from policylake.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
