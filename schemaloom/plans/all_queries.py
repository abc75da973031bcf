"""Importing this module registers every query."""

from __future__ import annotations

from schemaloom.plans import (  # noqa: F401
    catalogue_queries,
    history_queries,
    result_queries,
    retrieval_queries,
    rule_queries,
    source_queries,
)
from schemaloom.plans.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
