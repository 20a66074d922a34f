"""Queries by name: how the operators fit together over the tables, and their DuckDB SQL."""
