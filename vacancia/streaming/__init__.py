"""Incremental versions of the landing scan and its counters."""
