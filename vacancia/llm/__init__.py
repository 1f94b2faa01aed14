"""Operators of a training-data pipeline and their registered queries."""

from vacancia.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
