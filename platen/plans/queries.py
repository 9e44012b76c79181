"""Queries on rasters, text samples, instance masks and paths derived from the tables, with their DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.functions.angles import long_axis_degrees, orientation_distance, wrap_orientation
from platen.operators import crops, objects, raster, rectangles, votes
from platen.options import Options
from platen.plans import digitise
from platen.sources import codecs, images, outputs
from platen.sources.scratch import kept

Query = Callable[[SparkSession, str], DataFrame]

#: An image of the raster: 8 x 8. Foreground from this alpha; lowest alpha of components.
SIDE, CUTOFF = 8, 153
#: Instances merge over this overlap.
MERGE = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alpha_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, alpha): each embedding as an image, its values stretched to 0..255; 0 if they are all the same."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.transform("embedding", lambda e: e.cast("double")).alias("e"))
    each = rows.select("img", F.array_min("e").alias("low"), F.array_max("e").alias("high"), F.posexplode("e").alias("p", "v"))
    alpha = F.coalesce(F.round(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * 255), F.lit(0)).cast("int")
    return each.select("img", F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).cast("int").alias("x"), alpha.alias("alpha"))


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha_raster(spark, sf_dir).where(F.col("alpha") >= CUTOFF)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.label_components(foreground(spark, sf_dir), SIDE)


def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obj, pos, angle, length): the lines of an order as text lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    angle = (F.col("l_orderkey") % 180 - 89) + (F.col("l_quantity") - 25) / 2
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obj"), (F.row_number().over(w) - 1).alias("pos"), angle.alias("a"), (F.col("l_extendedprice") / 100).alias("length"))
    return rows.select("obj", "pos", wrap_orientation(F.col("a")).alias("angle"), "length")


def instance_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, inst, y, x): days and hours of a user's events, an image for each type."""
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("img"), F.col("user_id").alias("inst"), (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")).distinct()


def scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, w, h): a scan's file for each page."""
    kind = F.array(*(F.lit(e) for e in (".jpg", ".jpeg", ".png", ".tiff", ".bmp", ".webp", ".avif", "")))
    return _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("scans/scan_"), F.col("page_id").cast("string"), F.element_at(kind, (F.col("page_id") % 8 + 1).cast("int"))).alias("path"), (100 + (37 * F.col("page_id")) % 5000).alias("w"), (100 + (53 * F.col("page_id")) % 4000).alias("h"))


def component_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.objects(labelled(spark, sf_dir))


def min_side_filter(spark: SparkSession, sf_dir: str, percent: float = 30.0) -> DataFrame:
    longer = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) + 1
    return component_objects(spark, sf_dir).where(longer >= percent / 100 * SIDE).select("img", "obj_idx", "area")


def orientation_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text_samples(spark, sf_dir)
    return s.select("obj", "pos", F.round(wrap_orientation(F.col("angle") * 3), 6).alias("wrapped"), F.round(orientation_distance(F.col("angle"), F.col("length")), 6).alias("distance"))


def robust_text_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = votes.robust_text_angle(text_samples(spark, sf_dir))
    return found.select("obj", F.round("angle_deg", 4).alias("angle_deg"), F.round("agreement", 4).alias("agreement"), "inliers", "total")


def rounded(df: DataFrame, names: list[str], places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if c in names else c for c in df.columns))


def flip_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an object's sampled lines that come out within 45 degrees once it is deskewed by its text angle, flipped ones (odd parts) against upright ones."""
    samples = text_samples(spark, sf_dir)
    lines = votes.sample_lines(samples).withColumn("flipped", F.col("pos") % 2 == 1)
    found = votes.robust_text_angle(samples).select("obj", (-F.radians(F.round("angle_deg", 4).cast("float"))).cast("float").alias("theta"))
    return votes.flip_votes(lines.join(found, "obj", "left"), F.coalesce("theta", F.lit(0.0)))


def doc_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    scores = e.select(F.col("vec_id").alias("img"), *(F.col("embedding")[i].cast("double").alias(f"s{i}") for i in range(4)))
    return rounded(votes.best_class(scores), ["chance"], 6)


def background_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects that are left if every component of an image counts as a mask of the background: (img, y, x, label)."""
    masks = labelled(spark, sf_dir).select("img", F.col("label").alias("inst"), "y", "x")
    grid = alpha_raster(spark, sf_dir).select("img", "y", "x")
    return objects.label_components(objects.background(grid, masks), SIDE)


def rotated_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crops.rotated_bounds(labelled(spark, sf_dir), 30.0), ["min_x", "min_y", "max_x", "max_y"])


def crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at 30 degrees: bounds of the least rectangle's corners where an object has one, else of its pixels; 5 percent wider on each side."""
    theta = F.lit(math.radians(30.0))
    known = kept(objects.label_runs(foreground(spark, sf_dir), SIDE, outlines=True), "labelled-runs")
    runs = known.groupBy("img", "label").agg(F.collect_list(F.struct("y", "left", "right")).alias("runs"))
    edge = known.select((F.col("img") * SIDE * SIDE + F.col("label")).alias("obj"), F.explode("edge").alias("x"), "y")
    fitted = rectangles.least_rectangles(edge).select("obj", rectangles.corners().alias("q"))
    each = runs.withColumn("obj", F.col("img") * SIDE * SIDE + F.col("label")).join(fitted, "obj", "left")
    bounds = each.select("img", "label", crops.crop_bounds(F.col("q"), F.col("runs"), F.lit(0), F.lit(0), theta).alias("b")).select("img", "label", "b.*")
    return rounded(crops.padded(bounds, 5.0), ["min_x", "min_y", "max_x", "max_y"])


def output_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = scan_paths(spark, sf_dir)
    sniffed = F.when(F.col("page_id") % 16 == 7, "jpeg").otherwise("tiff")  # files without an extension
    planned = outputs.plan(F.col("path"), F.coalesce(outputs.format_of(F.col("path")), sniffed), F.col("page_id") % 3 == 0, F.col("page_id") % 5 == 0)
    return paths.select("page_id", planned["format"].alias("format"), outputs.object_path(planned["base"], F.lit(0)).alias("out_path"))


def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = scan_paths(spark, sf_dir)
    done = paths.where("page_id % 3 = 0").select(F.concat(F.lit("scan_"), F.col("page_id").cast("string"), F.lit("_0.png")).alias("name"))
    return outputs.not_done(paths.select("page_id", "path"), done)


def composite_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = alpha_raster(spark, sf_dir)
    return r.select("img", "y", "x", crops.over_white(F.pmod(F.col("img") * 7 + F.col("x"), F.lit(256)), F.col("alpha")).alias("value"))


def trim_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of pixels that aren't transparent (of all, if none is seen), and the padding of 5 percent of each side."""
    seen = lambda c: F.when(F.col("alpha") != 0, F.col(c))
    low, high = lambda c: F.coalesce(F.min(seen(c)), F.min(c)), lambda c: F.coalesce(F.max(seen(c)), F.max(c))
    cut = alpha_raster(spark, sf_dir).groupBy("img").agg(*(low(c).alias(f"min_{c}") for c in "xy"), *(high(c).alias(f"max_{c}") for c in "xy"))
    pad = lambda a: F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}") + 1) * 0.05).cast("long").alias(f"pad_{a}")
    return cut.select("img", "min_x", "min_y", "max_x", "max_y", pad("x"), pad("y"))


def detector_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = crops.detector_size(F.col("w"), F.col("h"))
    return scan_paths(spark, sf_dir).select("page_id", w.alias("out_w"), h.alias("out_h"))


#: Cosine and sine of a Pythagorean turn, times its scale, by the remainder of the object's number: exact in whole numbers.
TURNS = [(1, 0), (4, 3), (12, 5), (24, 7)]


def turned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obj, x, y long): the quantities and discounts of a supplier as points of a turned object."""
    p = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("obj"), F.col("l_quantity").cast("long").alias("px"), F.round(F.col("l_discount") * 100).cast("long").alias("py")).distinct()
    c, s = (F.element_at(F.array(*(F.lit(t[k]) for t in TURNS)), (F.col("obj") % 4 + 1).cast("int")) for k in (0, 1))
    return p.select("obj", (c * F.col("px") - s * F.col("py")).alias("x"), (s * F.col("px") + c * F.col("py")).alias("y"))


def min_area_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rectangles.least_rectangles(turned_points(spark, sf_dir))
    degrees = long_axis_degrees(F.col("w"), F.col("h"), F.atan2("uy", "ux"))
    return r.select("obj", F.round(F.col("w") * F.col("h"), 4).alias("area"), F.round(F.greatest("w", "h"), 4).alias("long_side"), F.round(F.least("w", "h"), 4).alias("short_side"), F.round(degrees, 4).alias("long_axis"))


def body_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = turned_points(spark, sf_dir)
    found = rectangles.body_rectangles(points, rectangles.least_rectangles(points))
    return found.select("obj", *(F.round(c, 4).alias(c) for c in ("u0", "v0", "w", "h")))


def rectangularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = turned_points(spark, sf_dir)
    return rounded(rectangles.rectangularity(points, rectangles.least_rectangles(points)), ["side_support", "rectangularity"])


def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    area, perimeter = rectangles.polygon_measures(F.col("q"))
    r = rectangles.least_rectangles(turned_points(spark, sf_dir)).select("obj", rectangles.corners().alias("q"))
    return r.select("obj", F.round(area, 4).alias("area"), F.round(perimeter, 4).alias("perimeter"))


def unclip_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rectangles.unclipped(rectangles.least_rectangles(turned_points(spark, sf_dir)))
    return r.select("obj", F.round(F.greatest("w", "h"), 4).alias("long_side"), F.round(F.least("w", "h"), 4).alias("short_side"))


def box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of a fixed quad of each image."""
    p = alpha_raster(spark, sf_dir).select("img", "y", "x", (F.col("alpha") / 255).alias("p"))
    quad = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(1, 1), (6, 2), (5, 6), (0, 5)]))
    quads = p.select("img").distinct().select("img", F.lit(0).alias("box"), quad.alias("q"))
    return rounded(rectangles.box_scores(p, quads), ["score"], 6)


def angle_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on each supplier's object: text angles from its lines as an order, flips by the parity of these, turns by its number."""
    points = kept(turned_points(spark, sf_dir), "points")
    r = kept(rectangles.least_rectangles(points), "rectangles")
    shape = rectangles.rectangularity(points, r)
    mask = r.select("obj", long_axis_degrees(F.col("w"), F.col("h"), F.atan2("uy", "ux")).alias("mask_angle"))
    text = robust_text_angle(spark, sf_dir).select("obj", F.col("angle_deg").alias("text_angle"))
    all_of = shape.join(mask, "obj").join(text, "obj", "left").join(flip_vote(spark, sf_dir), "obj", "left")
    found = votes.decide(all_of.withColumn("clipped", F.col("obj") % 3).withColumn("holes", F.col("obj") % 2).withColumn("doc_turns", F.col("obj") % 4), rect_threshold=0.8)
    return found.select("obj", "use_text", "fit", "padded", "source", F.round("angle_deg", 3).alias("angle_deg"), "turns")


def raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, format): the rasters as grey images in files, PNG and TIFF in turn."""
    pixels = alpha_raster(spark, sf_dir).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "alpha"))), lambda p: p["alpha"]).alias("values"))
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("format", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for img, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                form = ("png", "tiff")[img % 2]
                rows.append({"path": f"x1/{img}.{form}", "content": codecs.encode(np.array(values, np.uint8).reshape(SIDE, SIDE, 1), form), "format": form})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pixels.mapInArrow(run, "path string, content binary, format string")


def image_of(path: Column) -> Column:
    return F.regexp_extract(path, r"/(\d+)\.", 1).cast("long")


def decode_encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (img, y, x, value) that come back from files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, width, height, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y, x = np.divmod(np.arange(width * height), width)
                yield pa.RecordBatch.from_arrays([pa.array([img] * len(y), pa.int64()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(np.frombuffer(data, np.uint8), pa.int32())], ["img", "y", "x", "value"])

    return images.decode_images(raster_files(spark, sf_dir)).select(image_of(F.col("path")).alias("img"), "width", "height", "data").mapInArrow(run, "img long, y int, x int, value int")


def deskew_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (img, y, x, value) of the rasters turned by 30 degrees, on the window of all their corners."""
    theta = math.radians(30.0)
    c, s = math.cos(theta), math.sin(theta)
    bounds = (-SIDE * s, 0.0, SIDE * c, SIDE * (c + s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, width, height, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = raster.deskewed(images.pixels_of(data, width, height, 1, 8), bounds, theta)[:, :, 0]
                y, x = np.divmod(np.arange(out.size), out.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([img] * len(y), pa.int64()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(out.reshape(-1), pa.int32())], ["img", "y", "x", "value"])

    return images.decode_images(raster_files(spark, sf_dir)).select(image_of(F.col("path")).alias("img"), "width", "height", "data").mapInArrow(run, "img long, y int, x int, value int")


def scan_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to crops: the rasters are their own masks."""
    pixels = images.decode_images(raster_files(spark, sf_dir))
    found = pixels.select("path", F.lit(0).alias("mask_no"), "width", "height", "data")
    done = digitise.digitise(pixels, found, Options(threshold=60.0, min_side_percent=30.0), output_dir="crops")
    return done.select(image_of(F.col("path")).alias("img"), "obj_idx", "area", F.round("angle_deg", 2).alias("angle_deg"), "source", "out_w", "out_h", "out_path", F.sha2("content", 256).alias("content_sha256"), "error")


QUERIES: dict[str, Query] = {
    "decode_encode_roundtrip": decode_encode_roundtrip,
    "deskew_pixels": deskew_pixels,
    "scan_crops": scan_crops,
    "min_area_rect": min_area_rect,
    "body_rect": body_rect,
    "rectangularity": rectangularity,
    "polygon_measures": polygon_measures,
    "unclip_rect": unclip_rect,
    "box_score": box_score,
    "angle_decision": angle_decision,
    "hole_count": lambda s, d: objects.run_hole_counts(objects.label_runs(foreground(s, d), SIDE), 1),
    "iou_merge": lambda s, d: objects.merged_instances(instance_masks(s, d), MERGE),
    "component_objects": component_objects,
    "alpha_foreground": foreground,
    "min_side_filter": min_side_filter,
    "clipped_sides": lambda s, d: crops.clipped_sides(component_objects(s, d), SIDE, SIDE),
    "contour_points": lambda s, d: objects.outline_pixels(foreground(s, d), SIDE),
    "orientation_math": orientation_math,
    "robust_text_angle": robust_text_angle,
    "line_sample_ranks": lambda s, d: votes.sample_lines(text_samples(s, d)),
    "flip_vote": flip_vote,
    "doc_turns": doc_turns,
    "instance_iou": lambda s, d: objects.instance_iou(instance_masks(s, d), places=6),
    "instance_objects": lambda s, d: objects.instance_objects(instance_masks(s, d)),
    "background_inversion": background_inversion,
    "rotated_bounds": rotated_bounds,
    "crop_window": crop_window,
    "output_plan": output_plan,
    "skip_existing": skip_existing,
    "composite_white": composite_white,
    "trim_bounds": trim_bounds,
    "detector_resize": detector_resize,
}

_WRAP = "CASE WHEN ((({0}) % 180) + 180) % 180 > 90 THEN ((({0}) % 180) + 180) % 180 - 180 ELSE ((({0}) % 180) + 180) % 180 END"
_DIST = "least(((({0}) % 180) + 180) % 180, 180 - ((({0}) % 180) + 180) % 180)"
_X1 = f"""x1 AS (
    SELECT img, CAST(p // {SIDE} AS INTEGER) AS y, CAST(p % {SIDE} AS INTEGER) AS x, CAST(coalesce(round((CAST(v AS DOUBLE) - low) / nullif(high - low, 0) * 255), 0) AS INTEGER) AS alpha
    FROM (SELECT vec_id AS img, CAST(list_min(embedding) AS DOUBLE) AS low, CAST(list_max(embedding) AS DOUBLE) AS high, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings))"""
_LABELS = f"""{_X1},
fg AS (SELECT img, y, x FROM x1 WHERE alpha >= {CUTOFF}),
reach(img, y, x, l) AS (
    SELECT img, y, x, y * {SIDE} + x FROM fg
    UNION
    SELECT fg.img, fg.y, fg.x, reach.l FROM reach JOIN fg ON fg.img = reach.img AND abs(fg.y - reach.y) <= 1 AND abs(fg.x - reach.x) <= 1),
labelled AS (SELECT img, y, x, CAST(min(l) AS BIGINT) AS label FROM reach GROUP BY img, y, x),
objects AS (
    SELECT img, row_number() OVER (PARTITION BY img ORDER BY area DESC, label) - 1 AS obj_idx, *EXCLUDE (img)
    FROM (SELECT img, label, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM labelled GROUP BY img, label))"""
_X4 = f"""x4 AS (
    SELECT obj, pos, {_WRAP.format("a")} AS angle, length
    FROM (SELECT l_orderkey AS obj, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS pos,
                 (l_orderkey % 180 - 89) + (l_quantity - 25) / 2 AS a, l_extendedprice / 100 AS length FROM lineitem)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY length DESC, pos) - 1 AS rank, count(*) OVER (PARTITION BY obj) AS n FROM x4),
lines AS (SELECT obj, pos, rank, angle, length FROM ranked WHERE n <= 5 OR rank IN (0, 1, n // 2, n - 2, n - 1))"""
_X5 = "x5 AS (SELECT DISTINCT event_type AS img, user_id AS inst, CAST(day(ts) - 1 AS INTEGER) AS y, CAST(hour(ts) AS INTEGER) AS x FROM events)"
_X8 = "x8 AS (SELECT page_id, 'scans/scan_' || page_id || (['.jpg', '.jpeg', '.png', '.tiff', '.bmp', '.webp', '.avif', ''])[CAST(page_id % 8 + 1 AS INTEGER)] AS path, 100 + (37 * page_id) % 5000 AS w, 100 + (53 * page_id) % 4000 AS h FROM pages)"
_BOUNDS = """turned AS (
    SELECT img, label, (x + a) * cos(radians(30)) - (y + b) * sin(radians(30)) AS u, (x + a) * sin(radians(30)) + (y + b) * cos(radians(30)) AS v
    FROM labelled, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)),
bounds AS (SELECT img, label, min(u) AS min_x, min(v) AS min_y, max(u) AS max_x, max(v) AS max_y FROM turned GROUP BY img, label)"""
_SIZE = "CAST(greatest(round({0} * least(1.0::DOUBLE, 960.0::DOUBLE / greatest(w, h)) / 32) * 32, 32) AS BIGINT)"

_TEXT_ANGLE = f"""a AS (SELECT obj, arg_max(angle, struct_pack(l := length, p := pos)) AS anchor FROM x4 GROUP BY obj),
t AS (
    SELECT x4.obj, anchor, sum(length * length * ({_WRAP.format("angle - anchor")})) FILTER ({_DIST.format("angle - anchor")} <= 10) / sum(length * length) FILTER ({_DIST.format("angle - anchor")} <= 10) AS d
    FROM x4 JOIN a ON x4.obj = a.obj GROUP BY x4.obj, anchor HAVING sum(length) > 0)"""
#: How far a line is from horizontal once its object is turned by its text angle deg.
_TURNED = _DIST.format("angle + degrees(CAST(CAST(-radians(CAST(CAST(coalesce(deg, 0) AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE))")

_RECTS = f"""x3 AS (
    SELECT obj, c * px - s * py AS x, s * px + c * py AS y, py = min(py) OVER (PARTITION BY obj, px) OR py = max(py) OVER (PARTITION BY obj, px) AS outer_point
    FROM (SELECT DISTINCT l_suppkey AS obj, CAST(l_quantity AS BIGINT) AS px, CAST(round(l_discount * 100) AS BIGINT) AS py,
                 ({[t[0] for t in TURNS]})[CAST(l_suppkey % 4 + 1 AS INTEGER)] AS c, ({[t[1] for t in TURNS]})[CAST(l_suppkey % 4 + 1 AS INTEGER)] AS s FROM lineitem)),
e AS (SELECT obj, x, y FROM x3 WHERE outer_point),
edges AS (
    SELECT a.obj, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM e a JOIN e b ON a.obj = b.obj AND (a.x <> b.x OR a.y <> b.y) JOIN e c ON a.obj = c.obj
    GROUP BY ALL HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0 AND max((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) > 0),
directions AS (SELECT DISTINCT obj, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM edges),
fits AS (
    SELECT d.obj, ux, uy, min(x * ux + y * uy) AS u0, max(x * ux + y * uy) AS u1, min(y * ux - x * uy) AS v0, max(y * ux - x * uy) AS v1
    FROM directions d JOIN e ON d.obj = e.obj GROUP BY d.obj, ux, uy),
rects AS (
    SELECT obj, ux, uy, round(u0, 9) AS u0, round(v0, 9) AS v0, round(u1 - u0, 9) AS w, round(v1 - v0, 9) AS h FROM fits
    QUALIFY row_number() OVER (PARTITION BY obj ORDER BY round((u1 - u0) * (v1 - v0), 6), 270 - (((270 - degrees(atan2(uy, ux))) % 360) + 360) % 360) = 1)"""
_AXIS = _WRAP.format("degrees(atan2(uy, ux)) + CASE WHEN w >= h THEN 0 ELSE 90 END")
_SUPPORT = """near AS (
    SELECT r.*, round(x * ux + y * uy - u0, 6) AS u, round(y * ux - x * uy - v0, 6) AS v, least(greatest(least(w, h) * 0.03, 1.0::DOUBLE), 4.0::DOUBLE) AS eps,
           least(greatest(ceil(w / 8), 4), 64) AS nw, least(greatest(ceil(h / 8), 4), 64) AS nh FROM x3 JOIN rects r ON x3.obj = r.obj),
places AS (
    SELECT *, least(floor(least(greatest(u / w, 0.0::DOUBLE), 1.0::DOUBLE) * nw), nw - 1) AS pu, least(floor(least(greatest(v / h, 0.0::DOUBLE), 1.0::DOUBLE) * nh), nh - 1) AS pv,
           u BETWEEN -eps AND w + eps AS in_u, v BETWEEN -eps AND h + eps AS in_v FROM near),
support AS (
    SELECT obj, count(*) AS area, any_value(w) AS w, any_value(h) AS h,
           CASE WHEN any_value(w) < 1 OR any_value(h) < 1 THEN 0 ELSE (count(DISTINCT pu) FILTER (in_u AND abs(v) <= eps) / any_value(nw) + count(DISTINCT pu) FILTER (in_u AND abs(h - v) <= eps) / any_value(nw)
           + count(DISTINCT pv) FILTER (in_v AND abs(u) <= eps) / any_value(nh) + count(DISTINCT pv) FILTER (in_v AND abs(w - u) <= eps) / any_value(nh)) / 4 END AS support
    FROM places GROUP BY obj),
shape AS (SELECT obj, support AS side_support, 0.25::DOUBLE * least(area / ((w + 1) * (h + 1)), 1.0::DOUBLE) + 0.75::DOUBLE * support AS rectangularity FROM support)"""

ORACLES: dict[str, str] = {
    "min_area_rect": f"WITH {_RECTS} SELECT obj, round(w * h, 4) AS area, round(greatest(w, h), 4) AS long_side, round(least(w, h), 4) AS short_side, round({_AXIS}, 4) AS long_axis FROM rects",
    "body_rect": f"""WITH {_RECTS},
        p AS (SELECT x3.obj, round(x * ux + y * uy, 6) AS u, round(y * ux - x * uy, 6) AS v FROM x3 JOIN rects r ON x3.obj = r.obj),
        slices AS (SELECT obj, 'v' AS axis, round(u) AS key, min(v) AS low, max(v) AS high FROM p GROUP BY ALL UNION ALL SELECT obj, 'u', round(v) AS key, min(u), max(u) FROM p GROUP BY ALL),
        ends AS (SELECT obj, axis, -1 AS sign, round(low) AS place, greatest(high - low, 1) AS weight FROM slices UNION ALL SELECT obj, axis, 1, round(high), greatest(high - low, 1) FROM slices),
        best AS (SELECT obj, axis, sign, place, round(sum(weight), 9) AS votes FROM ends GROUP BY obj, axis, sign, place QUALIFY row_number() OVER (PARTITION BY obj, axis, sign ORDER BY round(sum(weight), 9) DESC, place * sign DESC) = 1),
        sides AS (SELECT obj, max(place) FILTER (axis = 'u' AND sign < 0) AS ul, max(place) FILTER (axis = 'u' AND sign > 0) AS uh, max(place) FILTER (axis = 'v' AND sign < 0) AS vl, max(place) FILTER (axis = 'v' AND sign > 0) AS vh FROM best GROUP BY obj)
        SELECT r.obj, round(CASE WHEN uh > ul THEN ul ELSE u0 END, 4) AS u0, round(CASE WHEN vh > vl THEN vl ELSE v0 END, 4) AS v0,
               round(CASE WHEN uh > ul THEN uh - ul ELSE w END, 4) AS w, round(CASE WHEN vh > vl THEN vh - vl ELSE h END, 4) AS h FROM rects r JOIN sides s ON r.obj = s.obj""",
    "rectangularity": f"WITH {_RECTS}, {_SUPPORT} SELECT obj, round(side_support, 4) AS side_support, round(rectangularity, 4) AS rectangularity FROM shape",
    "polygon_measures": f"WITH {_RECTS} SELECT obj, round(w * h, 4) AS area, round(2 * (w + h), 4) AS perimeter FROM rects",
    "unclip_rect": f"WITH {_RECTS}, d AS (SELECT obj, w, h, w * h * 1.4::DOUBLE / (w + h) AS d FROM rects) SELECT obj, round(greatest(w, h) + d, 4) AS long_side, round(least(w, h) + d, 4) AS short_side FROM d",
    "box_score": f"""WITH {_X1} SELECT img, 0 AS box, round(avg(alpha / 255.0::DOUBLE), 6) AS score FROM x1
        WHERE 5 * (y - 1) - (x - 1) >= 0 AND -(y - 2) - 4 * (x - 6) >= 0 AND -5 * (y - 6) + (x - 5) >= 0 AND (y - 5) + 4 * x >= 0 GROUP BY img""",
    "hole_count": f"""WITH RECURSIVE {_LABELS},
        free AS (SELECT o.img, o.label, o.min_x, o.max_x, o.min_y, o.max_y, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x FROM objects o, range({SIDE}) a(y), range({SIDE}) b(x)
                 WHERE a.y BETWEEN min_y AND max_y AND b.x BETWEEN min_x AND max_x AND NOT EXISTS (SELECT 1 FROM labelled l WHERE l.img = o.img AND l.label = o.label AND l.y = a.y AND l.x = b.x)),
        spread(img, label, y, x, s) AS (
            SELECT img, label, y, x, y * {SIDE} + x FROM free
            UNION
            SELECT f.img, f.label, f.y, f.x, s.s FROM spread s JOIN free f ON f.img = s.img AND f.label = s.label AND abs(f.y - s.y) + abs(f.x - s.x) = 1),
        regions AS (SELECT img, label, y, x, min(s) AS s FROM spread GROUP BY img, label, y, x),
        inner_ones AS (SELECT r.img, r.label, r.s FROM regions r JOIN free f USING (img, label, y, x) GROUP BY ALL HAVING NOT bool_or(y IN (min_y, max_y) OR x IN (min_x, max_x)))
        SELECT o.img, o.label, count(i.s) AS holes FROM objects o LEFT JOIN inner_ones i ON i.img = o.img AND i.label = o.label GROUP BY o.img, o.label""",
    "iou_merge": f"""WITH RECURSIVE {_X5}, n AS (SELECT img, inst, count(*) AS n FROM x5 GROUP BY img, inst),
        i AS (SELECT p.img, p.inst AS a, q.inst AS b, count(*) AS i FROM x5 p JOIN x5 q ON p.img = q.img AND p.y = q.y AND p.x = q.x AND p.inst <> q.inst GROUP BY ALL),
        near AS (SELECT i.img, a, b FROM i JOIN n p ON p.img = i.img AND p.inst = a JOIN n q ON q.img = i.img AND q.inst = b WHERE i / (p.n + q.n - i) > {MERGE}),
        spread(img, inst, root) AS (SELECT img, inst, inst FROM n UNION SELECT s.img, near.b, s.root FROM spread s JOIN near ON near.img = s.img AND near.a = s.inst)
        SELECT img, inst, min(root) AS root FROM spread GROUP BY img, inst""",
    "angle_decision": f"""WITH {_RECTS}, {_SUPPORT}, {_X4},
        {_TEXT_ANGLE},
        f AS (SELECT l.obj, count(*) FILTER (pos % 2 = 1 AND {_TURNED} <= 45) > count(*) FILTER (pos % 2 = 0 AND {_TURNED} <= 45) AS flip
              FROM lines l LEFT JOIN (SELECT obj, round({_WRAP.format("anchor + d")}, 4) AS deg FROM t) t ON l.obj = t.obj GROUP BY l.obj),
        g AS (SELECT s.obj, rectangularity < 0.8 AS odd, rectangularity < 0.8 OR s.obj % 3 >= 2 AS use_text, round({_WRAP.format("anchor + d")}, 4) AS text_angle, {_AXIS} AS mask_angle, coalesce(flip, false) AS flip
              FROM shape s JOIN rects r ON r.obj = s.obj LEFT JOIN t ON t.obj = s.obj LEFT JOIN f ON f.obj = s.obj)
        SELECT obj, use_text, CASE WHEN odd THEN 'max' ELSE 'min' END AS fit, odd OR obj % 2 > 0 AS padded, CASE WHEN use_text AND text_angle IS NOT NULL THEN 'text' ELSE 'mask' END AS source,
               round(CASE WHEN use_text THEN coalesce(text_angle, mask_angle) ELSE mask_angle END, 3) AS angle_deg, CAST(CASE WHEN NOT use_text THEN obj % 4 WHEN flip THEN 2 ELSE 0 END AS BIGINT) AS turns FROM g""",
    "decode_encode_roundtrip": f"WITH {_X1} SELECT img, y, x, alpha AS value FROM x1",
    "deskew_pixels": f"""WITH {_X1},
        g AS (SELECT img, CAST(b.y AS INTEGER) AS y, CAST(a.x AS INTEGER) AS x, round((a.x - {SIDE} * sin(radians(30))) * cos(radians(30)) + b.y * sin(radians(30)), 6) AS u, round(b.y * cos(radians(30)) - (a.x - {SIDE} * sin(radians(30))) * sin(radians(30)), 6) AS v
              FROM (SELECT DISTINCT img FROM x1), range(11) a(x), range(11) b(y)),
        c AS (SELECT img, y, x, u, v, CAST(floor(u) AS INTEGER) + i AS cx, CAST(floor(v) AS INTEGER) + j AS cy FROM g, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j)
              WHERE u BETWEEN 0 AND {SIDE - 1} AND v BETWEEN 0 AND {SIDE - 1}),
        n AS (SELECT c.img, c.y, c.x, sum(alpha * (1 - abs(u - cx)) * (1 - abs(v - cy))) AS value FROM c JOIN x1 ON c.img = x1.img AND c.cx = x1.x AND c.cy = x1.y GROUP BY ALL)
        SELECT g.img, g.y, g.x, CAST(coalesce(floor(n.value + 0.5), 255) AS INTEGER) AS value FROM g LEFT JOIN n ON g.img = n.img AND g.y = n.y AND g.x = n.x""",
    "component_objects": f"WITH RECURSIVE {_LABELS} SELECT img, obj_idx, label, area, min_x, min_y, max_x, max_y FROM objects",
    "alpha_foreground": f"WITH {_X1} SELECT img, y, x, alpha FROM x1 WHERE alpha >= {CUTOFF}",
    "min_side_filter": f"WITH RECURSIVE {_LABELS} SELECT img, obj_idx, area FROM objects WHERE greatest(max_x - min_x, max_y - min_y) + 1 >= 0.3 * {SIDE}",
    "clipped_sides": f"WITH RECURSIVE {_LABELS} SELECT img, obj_idx, CAST((min_x = 0)::INT + (min_y = 0)::INT + (max_x = {SIDE - 1})::INT + (max_y = {SIDE - 1})::INT AS BIGINT) AS clipped FROM objects",
    "contour_points": f"WITH RECURSIVE {_LABELS} SELECT a.img, a.label, a.y, a.x FROM labelled a JOIN labelled b ON a.img = b.img AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.img, a.label, a.y, a.x HAVING count(*) < 9",
    "orientation_math": f"WITH {_X4} SELECT obj, pos, round({_WRAP.format('angle * 3')}, 6) AS wrapped, round({_DIST.format('angle - length')}, 6) AS distance FROM x4",
    "robust_text_angle": f"""WITH {_X4},
        a AS (SELECT obj, arg_max(angle, struct_pack(l := length, p := pos)) AS anchor FROM x4 GROUP BY obj),
        e AS (SELECT x4.*, anchor, {_DIST.format("angle - anchor")} <= 10 AS inside, {_WRAP.format("angle - anchor")} AS d FROM x4 JOIN a ON x4.obj = a.obj),
        s AS (SELECT obj, anchor, sum(length * length * d) FILTER (inside) / sum(length * length) FILTER (inside) AS d, sum(length) FILTER (inside) / sum(length) AS agreement, count(*) FILTER (inside) AS inliers, count(*) AS total FROM e GROUP BY obj, anchor HAVING sum(length) > 0)
        SELECT obj, round({_WRAP.format("anchor + d")}, 4) AS angle_deg, round(agreement, 4) AS agreement, inliers, total FROM s""",
    "line_sample_ranks": f"WITH {_X4} SELECT obj, pos, rank, angle, length FROM lines",
    "flip_vote": f"""WITH {_X4}, {_TEXT_ANGLE},
        v AS (SELECT l.obj, count(*) FILTER (pos % 2 = 1 AND {_TURNED} <= 45) AS f, count(*) FILTER (pos % 2 = 0 AND {_TURNED} <= 45) AS u
              FROM lines l LEFT JOIN (SELECT obj, round({_WRAP.format("anchor + d")}, 4) AS deg FROM t) t ON l.obj = t.obj GROUP BY l.obj)
        SELECT obj, CASE WHEN f + u > 0 THEN f > u END AS flip FROM v""",
    "doc_turns": """WITH s AS (SELECT vec_id AS img, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings),
        m AS (SELECT *, greatest(a, b, c, d) AS top FROM s), k AS (SELECT *, CAST(CASE WHEN d = top THEN 3 WHEN c = top THEN 2 WHEN b = top THEN 1 ELSE 0 END AS BIGINT) AS cls FROM m)
        SELECT img, cls, round(1 / (exp(a - top) + exp(b - top) + exp(c - top) + exp(d - top)), 6) AS chance, CAST((4 - cls) % 4 AS BIGINT) AS turns FROM k""",
    "instance_iou": f"""WITH {_X5}, n AS (SELECT img, inst, count(*) AS n FROM x5 GROUP BY img, inst),
        i AS (SELECT p.img, p.inst AS a, q.inst AS b, count(*) AS i FROM x5 p JOIN x5 q ON p.img = q.img AND p.y = q.y AND p.x = q.x AND p.inst < q.inst GROUP BY ALL)
        SELECT i.img, a, b, round(i / (p.n + q.n - i), 6) AS iou FROM i JOIN n p ON p.img = i.img AND p.inst = a JOIN n q ON q.img = i.img AND q.inst = b""",
    "instance_objects": f"WITH {_X5}, o AS (SELECT img, y, x, min(inst) AS inst FROM x5 GROUP BY ALL) SELECT img, inst, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM o GROUP BY img, inst",
    "background_inversion": f"""WITH RECURSIVE {_X1}, dark AS (SELECT img, y, x FROM x1 WHERE alpha < {CUTOFF}),
        reach(img, y, x, l) AS (
            SELECT img, y, x, y * {SIDE} + x FROM dark
            UNION
            SELECT d.img, d.y, d.x, r.l FROM reach r JOIN dark d ON d.img = r.img AND abs(d.y - r.y) <= 1 AND abs(d.x - r.x) <= 1)
        SELECT img, y, x, CAST(min(l) AS BIGINT) AS label FROM reach GROUP BY img, y, x""",
    "rotated_bounds": f"WITH RECURSIVE {_LABELS}, {_BOUNDS} SELECT img, label, round(min_x, 4) AS min_x, round(min_y, 4) AS min_y, round(max_x, 4) AS max_x, round(max_y, 4) AS max_y FROM bounds",
    "crop_window": f"""WITH RECURSIVE {_LABELS}, {_BOUNDS},
        x3 AS (SELECT img * {SIDE * SIDE} + label AS obj, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, y = min(y) OVER (PARTITION BY img, label, x) OR y = max(y) OVER (PARTITION BY img, label, x) AS outer_point FROM labelled),
        {_RECTS[_RECTS.index("e AS (SELECT obj, x, y FROM x3"):]},
        corners AS (SELECT obj, (u0 + a * w) * ux - (v0 + b * h) * uy AS x, (u0 + a * w) * uy + (v0 + b * h) * ux AS y FROM rects, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)),
        fitted AS (SELECT obj, min(x * cos(radians(30)) - y * sin(radians(30))) AS min_x, min(x * sin(radians(30)) + y * cos(radians(30))) AS min_y, max(x * cos(radians(30)) - y * sin(radians(30))) AS max_x, max(x * sin(radians(30)) + y * cos(radians(30))) AS max_y FROM corners GROUP BY obj),
        c AS (SELECT b.img, b.label, coalesce(f.min_x, b.min_x) AS min_x, coalesce(f.min_y, b.min_y) AS min_y, coalesce(f.max_x, b.max_x) AS max_x, coalesce(f.max_y, b.max_y) AS max_y FROM bounds b LEFT JOIN fitted f ON f.obj = b.img * {SIDE * SIDE} + b.label),
        p AS (SELECT *, greatest(max_x - min_x, 1.0) * 0.05 AS px, greatest(max_y - min_y, 1.0) * 0.05 AS py FROM c),
        m AS (SELECT img, label, min_x - px AS min_x, min_y - py AS min_y, max_x + px AS max_x, max_y + py AS max_y FROM p)
        SELECT img, label, round(min_x, 4) AS min_x, round(min_y, 4) AS min_y, round(max_x, 4) AS max_x, round(max_y, 4) AS max_y,
               CAST(greatest(ceil(round(max_x - min_x, 6)), 1) AS BIGINT) AS out_w, CAST(greatest(ceil(round(max_y - min_y, 6)), 1) AS BIGINT) AS out_h FROM m""",
    "output_plan": f"""WITH {_X8}, g AS (SELECT *, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM x8),
        f AS (SELECT *, CASE ext WHEN 'jpg' THEN 'jpeg' WHEN '' THEN CASE WHEN page_id % 16 = 7 THEN 'jpeg' ELSE 'tiff' END ELSE ext END AS given FROM g),
        o AS (SELECT *, (page_id % 3 = 0 AND given IN ('jpeg', 'bmp')) OR (page_id % 5 <> 0 AND given IN ('jpeg', 'avif')) AS became FROM f)
        SELECT page_id, CASE WHEN became THEN 'png' ELSE given END AS format,
               regexp_replace(path, '\\.[^./]*$', '') || '_0.' || CASE WHEN became THEN 'png' WHEN ext <> '' THEN ext WHEN given = 'jpeg' THEN 'jpg' ELSE given END AS out_path FROM o""",
    "skip_existing": f"WITH {_X8} SELECT page_id, path FROM x8 WHERE page_id % 3 <> 0",
    "composite_white": f"WITH {_X1} SELECT img, y, x, CAST(round(((img * 7 + x) % 256) * (alpha / 255.0::DOUBLE) + 255.0 * (1.0 - alpha / 255.0::DOUBLE)) AS BIGINT) AS value FROM x1",
    "trim_bounds": f"""WITH {_X1}, t AS (SELECT img, min(x) FILTER (alpha <> 0) AS min_x, min(y) FILTER (alpha <> 0) AS min_y, max(x) FILTER (alpha <> 0) AS max_x, max(y) FILTER (alpha <> 0) AS max_y FROM x1 GROUP BY img),
        f AS (SELECT img, coalesce(min_x, 0) AS min_x, coalesce(min_y, 0) AS min_y, coalesce(max_x, {SIDE - 1}) AS max_x, coalesce(max_y, {SIDE - 1}) AS max_y FROM t)
        SELECT *, CAST(ceil((max_x - min_x + 1) * 0.05) AS BIGINT) AS pad_x, CAST(ceil((max_y - min_y + 1) * 0.05) AS BIGINT) AS pad_y FROM f""",
    "detector_resize": f"WITH {_X8} SELECT page_id, {_SIZE.format('w')} AS out_w, {_SIZE.format('h')} AS out_h FROM x8",
}
