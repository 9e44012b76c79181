"""Image files, formats and output paths."""
