"""Statements carried out on DataFrames and snapshots."""
