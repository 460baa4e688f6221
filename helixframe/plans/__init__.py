"""Registered queries over the driver tables, with SQL that gives the same rows."""

from helixframe.plans import contact_queries, feature_queries, geometry_queries, records, source_queries, streaming_queries, structure_queries
from helixframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "contact_queries", "feature_queries", "geometry_queries", "records", "source_queries", "streaming_queries", "structure_queries"]
