"""Candlewick: market bars, indicators, rules and decisions as Spark jobs."""
