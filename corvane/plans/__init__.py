"""Registered queries: compositions of the operators over the driver's tables."""

from . import extra_queries, geometry_queries, lining_queries, merge_queries, model_queries, report_queries, scan_queries, spatial_queries, stream_queries, structure_queries  # noqa: F401
from .registry import COVERS, ORACLE_SQL, QUERIES

__all__ = ["COVERS", "ORACLE_SQL", "QUERIES"]
