"""Operators on bars, signals, rules and dimensions."""
