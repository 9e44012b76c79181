"""Crop windows: bounds of rotated pixels, padding, trimming, compositing and sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotated_bounds(labelled: DataFrame, degrees: float) -> DataFrame:
    """Least and greatest coordinates of all pixel corners of an object turned about the origin."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    corners = [(F.col("x") + a, F.col("y") + b) for a in (0, 1) for b in (0, 1)]
    xs, ys = [x * c - y * s for x, y in corners], [x * s + y * c for x, y in corners]
    return labelled.groupBy("img", "label").agg(F.min(F.least(*xs)).alias("min_x"), F.min(F.least(*ys)).alias("min_y"), F.max(F.greatest(*xs)).alias("max_x"), F.max(F.greatest(*ys)).alias("max_y"))


def corner_bounds(corners: Column, off_x: Column, off_y: Column, theta: Column) -> Column:
    """Bounds of a fitted rectangle's corners (array of x, y within an object's bounds), moved to the image and turned by theta about its origin."""
    c, s = F.cos(theta.cast("double")), F.sin(theta.cast("double"))
    at = lambda p: (p["x"] + off_x, p["y"] + off_y)
    xs = F.transform(corners, lambda p: at(p)[0] * c - at(p)[1] * s)
    ys = F.transform(corners, lambda p: at(p)[0] * s + at(p)[1] * c)
    return F.when(corners.isNotNull(), F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")))


def run_bounds(runs: Column, theta: Column) -> Column:
    """Bounds of all pixel corners of an object's runs (array of y, left, right), turned by theta about the image's origin: those of the runs' own four corners."""
    c, s = F.cos(theta.cast("double")), F.sin(theta.cast("double"))
    ends = F.flatten(F.transform(runs, lambda r: F.array(*(F.struct((x + F.lit(0.0)).alias("x"), (r["y"] + F.lit(float(d))).alias("y")) for x in (r["left"], r["right"] + 1) for d in (0, 1)))))
    xs, ys = F.transform(ends, lambda p: p["x"] * c - p["y"] * s), F.transform(ends, lambda p: p["x"] * s + p["y"] * c)
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def crop_bounds(corners: Column, runs: Column, off_x: Column, off_y: Column, theta: Column) -> Column:
    """The fitted rectangle's bounds if there is one, else those of the object's pixels."""
    return F.coalesce(corner_bounds(corners, off_x, off_y, theta), run_bounds(runs, theta))


def expanded(bounds: Column, percent: Column) -> Column:
    """Each side moved out by the percent of the extent (at least 1)."""
    side = lambda a: F.greatest(bounds[f"max_{a}"] - bounds[f"min_{a}"], F.lit(1.0)) * F.greatest(percent, F.lit(0.0)) / 100
    return F.struct(*((bounds[f"{end}_{a}"] + (1 if end == "max" else -1) * side(a)).alias(f"{end}_{a}") for end in ("min", "max") for a in "xy"))


def padded(bounds: DataFrame, percent: float) -> DataFrame:
    """Each side moved out by the percent of its extent (at least 1), and the size in whole pixels (at least 1)."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    px, py = F.greatest(w, F.lit(1.0)) * (max(percent, 0.0) / 100), F.greatest(h, F.lit(1.0)) * (max(percent, 0.0) / 100)
    moved = bounds.select("img", "label", (F.col("min_x") - px).alias("min_x"), (F.col("min_y") - py).alias("min_y"), (F.col("max_x") + px).alias("max_x"), (F.col("max_y") + py).alias("max_y"))
    size = lambda a: F.greatest(F.ceil(F.round(F.col(f"max_{a}") - F.col(f"min_{a}"), 6)), F.lit(1)).cast("long")
    return moved.withColumn("out_w", size("x")).withColumn("out_h", size("y"))


def over_white(colour: Column, alpha: Column) -> Column:
    """A colour of 0 to 255 with alpha of 0 to 255, laid over white."""
    a = alpha / 255.0
    return F.round(colour * a + 255.0 * (1.0 - a)).cast("long")


def clipped_sides(objects: DataFrame, width: int, height: int) -> DataFrame:
    """How many sides of an object's bounds lie on the image's border."""
    at = [F.col("min_x") == 0, F.col("min_y") == 0, F.col("max_x") == width - 1, F.col("max_y") == height - 1]
    return objects.select("img", "obj_idx", sum((x.cast("long") for x in at[1:]), at[0].cast("long")).alias("clipped"))


def detector_size(width: Column, height: Column, limit: int = 960) -> list[Column]:
    """Width and height for the detector: the longer side at most the limit, each a multiple of 32 and at least 32."""
    ratio = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(width, height))
    return [F.greatest(F.round(side * ratio / 32) * 32, F.lit(32.0)).cast("long") for side in (width, height)]
