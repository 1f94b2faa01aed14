"""Registered queries over the given tables, and their SQL twins."""

from registry import q_dedup, q_filters, q_functions, q_mappings, q_match, q_report, q_run, q_sources, q_streaming, q_verify  # noqa: F401
from registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
