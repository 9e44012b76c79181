"""Angle estimates from text lines, and votes on turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.angles import orientation_distance, wrap_orientation


def robust_text_angle(samples: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Samples (obj, pos, angle, length) to (obj, angle_deg, anchor, agreement, inliers, total).

    The anchor is the angle of the longest sample (of ties the last); inliers lie within the tolerance of it, and their
    deltas are averaged by squared length. Objects whose lengths add up to nothing have no row.
    """
    anchors = samples.groupBy("obj").agg(F.max_by("angle", F.struct("length", "pos")).alias("anchor"))
    inside = orientation_distance(F.col("angle"), F.col("anchor")) <= tolerance
    weight = F.when(inside, F.col("length") * F.col("length"))
    each = samples.join(anchors, "obj")
    sums = each.groupBy("obj", "anchor").agg(F.sum(weight * wrap_orientation(F.col("angle") - F.col("anchor"))).alias("d"), F.sum(weight).alias("w"), F.sum(F.when(inside, F.col("length"))).alias("own"), F.sum("length").alias("of"), F.sum(inside.cast("long")).alias("inliers"), F.count("*").alias("total"))
    return sums.where("of > 0").select("obj", wrap_orientation(F.col("anchor") + F.col("d") / F.col("w")).alias("angle_deg"), "anchor", (F.col("own") / F.col("of")).alias("agreement"), "inliers", "total")


def sample_lines(samples: DataFrame) -> DataFrame:
    """At most five lines of each object by length: ranks 0, 1, n / 2, n - 2 and n - 1 (ties keep their order)."""
    w = Window.partitionBy("obj")
    ranked = samples.withColumn("rank", F.row_number().over(w.orderBy(F.desc("length"), "pos")) - 1).withColumn("n", F.count("*").over(w))
    return ranked.where("n <= 5 or rank in (0, 1, floor(n / 2), n - 2, n - 1)").select("obj", "pos", F.col("rank").cast("long").alias("rank"), "angle", "length")


def flip_votes(lines: DataFrame, theta: Column | None = None, most_skew: float = 45.0) -> DataFrame:
    """Sampled lines (obj, angle in degrees, flipped) to (obj, flip): whether most are upside down; a tie: no, no line to ask: null.

    Only lines count that come out within most_skew degrees of horizontal once turned by theta (radians; 0 without one), and whose classifier gave an answer.
    """
    turned = F.col("angle") if theta is None else F.col("angle") + F.degrees(theta.cast("double"))
    usable = (orientation_distance(turned, F.lit(0.0)) <= most_skew) & F.col("flipped").isNotNull()
    count = lambda which: F.sum(F.when(usable & which, 1).otherwise(0))
    counted = lines.groupBy("obj").agg(count(F.col("flipped")).alias("down"), count(~F.col("flipped")).alias("up"))
    return counted.select("obj", F.when(F.col("down") + F.col("up") > 0, F.col("down") > F.col("up")).alias("flip"))


def angle_note(angle: Column, source: Column, inliers: Column, total: Column, agreement: Column, turns: Column) -> Column:
    """What is said of an object's angle: degrees and where they come from, and an added turn."""
    signed = F.format_string("%+.2f\u00b0", angle.cast("double"))
    by_text = F.concat(signed, F.lit(" (text, "), inliers.cast("string"), F.lit("/"), total.cast("string"), F.lit(" boxes, agree "), F.format_string("%.0f", agreement.cast("double") * 100), F.lit("%)"))
    base = F.when(angle.isNull(), "n/a").when(source == "text", by_text).when(source == "mask", F.concat(signed, F.lit(" (mask geometry)"))).otherwise("n/a")
    return F.when(turns == 0, base).otherwise(F.concat(base, F.lit(" + "), (turns * 90).cast("string"), F.lit("\u00b0 turn (orientation cls)")))


def best_class(scores: DataFrame) -> DataFrame:
    """(img, s0..s3) to the softmax's greatest class (of ties the last), its chance, and quarter turns clockwise that undo it."""
    s = [F.col(f"s{i}") for i in range(4)]
    top = F.greatest(*s)
    best = F.when(s[3] == top, 3).when(s[2] == top, 2).when(s[1] == top, 1).otherwise(0)
    total = sum((F.exp(x - top) for x in s[1:]), F.exp(s[0] - top))
    return scores.select("img", best.cast("long").alias("cls"), (1 / total).alias("chance"), ((4 - best) % 4).cast("long").alias("turns"))


def decide(found: DataFrame, *, text: bool = False, force_rectangular: bool = False, safezone: bool = False, no_deskew: bool = False, no_doc_orient: bool = False, rect_threshold: float = 0.30) -> DataFrame:
    """The decision on each object: (obj, use_text, fit, padded, source, angle_deg, theta, turns).

    found: obj, rectangularity, clipped, holes, text_angle, mask_angle, flip (null: no vote), doc_turns (null: no model).
    A text angle counts only where text is used, and goes before the mask's; theta is a single-precision angle in radians. Null
    clipped and holes count as none, a null rectangularity as rectangular.
    """
    odd = F.lit(False) if force_rectangular else F.coalesce(F.col("rectangularity") < rect_threshold, F.lit(False))
    use_text = F.lit(True) if text else odd | (F.coalesce("clipped", F.lit(0)) >= 2)
    text_angle = F.when(use_text, F.col("text_angle"))
    angle = F.coalesce(text_angle, F.col("mask_angle"))
    theta = F.lit(0.0) if no_deskew else F.coalesce(-F.radians(angle.cast("float")), F.lit(0.0))
    by_model = F.lit(0) if no_doc_orient else F.coalesce("doc_turns", F.lit(0))
    turns = F.lit(0) if no_deskew else F.when(use_text, F.when(F.col("flip"), 2).otherwise(0)).otherwise(by_model)
    source = F.when(text_angle.isNotNull(), "text").when(F.col("mask_angle").isNotNull(), "mask").otherwise("none")
    fit = F.lit("max") if safezone else F.when(odd, "max").otherwise("min")
    return found.select("obj", use_text.alias("use_text"), fit.alias("fit"), (odd | (F.coalesce("holes", F.lit(0)) > 0)).alias("padded"), source.alias("source"), angle.alias("angle_deg"), theta.cast("float").alias("theta"), turns.cast("long").alias("turns"))
