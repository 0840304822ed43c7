"""Queries over the test tables, one or more per operator, with checking SQL."""

from usetrail.queries import (
    classify_q,
    code_q,
    graph_q,
    rules_q,
    sources_q,
    structure_q,
    symbols_q,
    time_q,
)  # noqa: F401
from usetrail.queries.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
