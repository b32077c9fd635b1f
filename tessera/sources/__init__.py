"""Catalog, snapshots and registered files."""
