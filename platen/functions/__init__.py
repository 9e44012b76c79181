"""Column functions: orientations and raster arithmetic."""
