"""Queries over the given tables, each with the SQL an oracle runs on the same tables."""

from claimsift.plans import (  # noqa: F401  (importing registers the queries)
    cleaning_queries,
    profile_queries,
    reply_queries,
    report_queries,
    rule_queries,
    source_queries,
    vector_queries,
)
from claimsift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
