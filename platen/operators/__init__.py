"""Labelling, instances, votes and crop geometry as DataFrame operations."""
