"""Operators that prepare training text: dedup, joins, scoring, extraction, packing."""
