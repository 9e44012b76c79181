"""Registered queries on rasters, samples and paths derived from tables."""
