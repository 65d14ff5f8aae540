"""Keyed stream state as Spark DataFrames: counts, key-groups, hand-off and reconciliation."""
