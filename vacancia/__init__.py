"""Listing matching on Spark: land, map, filter, deduplicate, verify, score and report."""
