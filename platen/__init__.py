"""A Spark engine for scan digitisation: images to objects, geometry, angles and crop plans, as DataFrames."""
