"""Queries on files of more formats, and on images that are cut into tiles, with their DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.operators import objects, rectangles, textboxes, tiles
from platen.operators.grouped import by_group
from platen.plans import queries
from platen.plans.queries import CUTOFF, SIDE, alpha_raster, image_of, raster_files
from platen.sources import images, jpeg

#: Side of the tiles that rasters are cut into: pictures of 8 x 8 have nine, of which five are no squares.
TILE = 3
#: How often a raster's pixel is repeated in both directions in the larger of its JPEG files.
ENLARGED = 8


def jpeg_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, format): each raster as two JPEG files of best quality, one enlarged so that a block has one value; baseline and progressive in turn."""
    pixels = alpha_raster(spark, sf_dir).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "alpha"))), lambda p: p["alpha"]).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for img, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array(values, np.uint8).reshape(SIDE, SIDE, 1)
                for kind, picture in (("fine", own), ("large", np.repeat(np.repeat(own, ENLARGED, axis=0), ENLARGED, axis=1))):
                    rows.append({"path": f"{kind}/{img}.jpg", "content": jpeg.encode_jpeg(picture, 100, progressive=img % 2 == 1), "format": "jpeg"})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary()), ("format", pa.string())]))

    return pixels.mapInArrow(run, "path string, content binary, format string")


def jpeg_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back from JPEG files: (img, y, x, value, flat, near): value of the enlarged pixel, whether all of it has that value, and whether the plain file is within 1 of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, large, fine in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = np.frombuffer(large, np.uint8).reshape(SIDE, ENLARGED, SIDE, ENLARGED)
                low, high, plain = blocks.min(axis=(1, 3)).reshape(-1), blocks.max(axis=(1, 3)).reshape(-1), np.frombuffer(fine, np.uint8)
                y, x = np.divmod(np.arange(SIDE * SIDE), SIDE)
                columns = [pa.array([img] * len(y), pa.int64()), *(pa.array(v.astype(np.int32)) for v in (y, x, low)), pa.array(low == high), pa.array(np.abs(plain.astype(int) - low) <= 1)]
                yield pa.RecordBatch.from_arrays(columns, ["img", "y", "x", "value", "flat", "near"])

    read = images.decode_images(jpeg_files(spark, sf_dir)).select(image_of(F.col("path")).alias("img"), F.col("path").startswith("large").alias("large"), "data")
    both = read.groupBy("img").agg(F.max(F.when(F.col("large"), F.col("data"))).alias("large"), F.max(F.when(~F.col("large"), F.col("data"))).alias("fine"))
    return both.mapInArrow(run, "img long, y int, x int, value int, flat boolean, near boolean")


def raster_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.cut_files(raster_files(spark, sf_dir), TILE)


def tiled_deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (img, y, x, value) of the rasters turned by 30 degrees, tile by tile: as of whole images."""
    theta = math.radians(30.0)
    cut = raster_tiles(spark, sf_dir)
    bounds = F.struct(*(F.lit(v).alias(n) for n, v in zip(("min_x", "min_y", "max_x", "max_y"), tiles.theta_window(SIDE, SIDE, theta), strict=True)))
    planned = cut.where("ty = 0 and tx = 0").select("path", F.lit(0).alias("obj_idx"), bounds.alias("bounds"), F.lit(theta).alias("theta"), F.lit(0).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, oy, ox, h, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grey = np.frombuffer(data, np.uint8).reshape(h, w, 3)[:, :, 0]
                y, x = np.divmod(np.arange(h * w), w)
                yield pa.RecordBatch.from_arrays([pa.array([img] * len(y), pa.int64()), pa.array((y + oy * TILE).astype(np.int32)), pa.array((x + ox * TILE).astype(np.int32)), pa.array(grey.reshape(-1).astype(np.int32))], ["img", "y", "x", "value"])

    done = tiles.render(cut, planned, TILE)
    return done.select(image_of(F.col("path")).alias("img"), "oy", "ox", "h", "w", "data").mapInArrow(run, "img long, y int, x int, value int")


def tiled_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of each raster, told across its tiles: as of whole images."""
    found = tiles.objects(tiles.label_tiles(raster_tiles(spark, sf_dir), CUTOFF, TILE))
    return found.select(image_of(F.col("path")).alias("img"), "obj_idx", "label", "area", "min_x", "min_y", "max_x", "max_y")


def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of each supplier's turned object, and how many it has."""
    found = rectangles.convex_hulls(queries.turned_points(spark, sf_dir))
    n = F.count("*").over(Window.partitionBy("obj"))
    return found.select("obj", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), n.alias("n"))


def text_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the borders of each raster's regions (img, label, hole, y, x): label is the first pixel of the region; hole: its border with a hole, or the outer one."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        bitmap = np.zeros((SIDE, SIDE), bool)
        for y, left, right in zip(frame["y"], frame["left"], frame["right"], strict=True):
            bitmap[y, left : right + 1] = True
        found = textboxes.border_tree(bitmap)
        first = [int(b.points[0, 1]) * SIDE + int(b.points[0, 0]) for b in found]
        label = [first[b.parent] if b.hole else n for b, n in zip(found, first, strict=True)]
        size = [len(b.points) for b in found]
        x, y = np.concatenate([b.points for b in found]).astype(int).T
        return pd.DataFrame({"img": frame["img"].iloc[0], "label": np.repeat(label, size), "hole": np.repeat([b.hole for b in found], size), "y": y, "x": x})

    runs = objects.pixel_runs(queries.foreground(spark, sf_dir))
    return by_group(runs, ["img"], one, "img long, label long, hole boolean, y int, x int")


def scan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of scan_crops' way what SQL can say: the objects of each raster, where their angles come from, and the crops' paths."""
    done = queries.scan_crops(spark, sf_dir)
    return done.where("error is null").select("img", "obj_idx", "area", "angle_deg", "source", "out_path")


QUERIES: dict[str, queries.Query] = {"jpeg_pixels": jpeg_pixels, "tiled_deskew": tiled_deskew, "tiled_objects": tiled_objects, "convex_hull": convex_hull, "text_borders": text_borders, "scan_plan": scan_plan}

ORACLES: dict[str, str] = {
    "jpeg_pixels": f"WITH {queries._X1} SELECT img, y, x, alpha AS value, true AS flat, true AS near FROM x1",
    "tiled_deskew": queries.ORACLES["deskew_pixels"],
    "tiled_objects": queries.ORACLES["component_objects"],
    "convex_hull": f"""WITH {queries._RECTS},
        sides AS (SELECT obj, ax, ay, dx // gcd(abs(dx), abs(dy)) AS sx, dy // gcd(abs(dx), abs(dy)) AS sy FROM edges),
        c AS (SELECT obj, sx, sy, arg_min(struct_pack(x := ax, y := ay), ax * sx + ay * sy) AS p FROM sides GROUP BY obj, sx, sy)
        SELECT obj, CAST(p.x AS BIGINT) AS x, CAST(p.y AS BIGINT) AS y, count(*) OVER (PARTITION BY obj) AS n FROM c""",
    "scan_plan": f"""WITH RECURSIVE {queries._LABELS},
        large AS (SELECT *, img * {SIDE * SIDE} + label AS obj, row_number() OVER (PARTITION BY img ORDER BY obj_idx) - 1 AS idx FROM objects WHERE greatest(max_x - min_x, max_y - min_y) + 1 >= 0.3 * {SIDE}),
        x3 AS (SELECT img * {SIDE * SIDE} + label AS obj, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, y = min(y) OVER (PARTITION BY img, label, x) OR y = max(y) OVER (PARTITION BY img, label, x) AS outer_point FROM labelled),
        {queries._RECTS[queries._RECTS.index("e AS (SELECT obj, x, y FROM x3"):]}
        SELECT img, CAST(idx AS INTEGER) AS obj_idx, area, round(CAST({queries._AXIS} AS FLOAT), 2) AS angle_deg, CASE WHEN r.obj IS NULL THEN 'none' ELSE 'mask' END AS source,
               'crops/' || img || '_' || idx || (['.png', '.tiff'])[CAST(img % 2 + 1 AS INTEGER)] AS out_path
        FROM large LEFT JOIN rects r ON r.obj = large.obj""",
    "text_borders": f"""WITH RECURSIVE {queries._LABELS},
        free AS (SELECT i.img, CAST(a.y AS INTEGER) - 1 AS y, CAST(b.x AS INTEGER) - 1 AS x FROM (SELECT DISTINCT img FROM labelled) i, range({SIDE + 2}) a(y), range({SIDE + 2}) b(x)
                 WHERE NOT EXISTS (SELECT 1 FROM labelled l WHERE l.img = i.img AND l.y = a.y - 1 AND l.x = b.x - 1)),
        spread(img, y, x, g) AS (
            SELECT img, y, x, (y + 1) * {SIDE + 2} + x + 1 FROM free
            UNION
            SELECT f.img, f.y, f.x, s.g FROM spread s JOIN free f ON f.img = s.img AND abs(f.y - s.y) + abs(f.x - s.x) = 1),
        ground AS (SELECT img, y, x, min(g) AS g FROM spread GROUP BY img, y, x),
        around AS (SELECT o.img, o.label, g.g FROM (SELECT DISTINCT img, label FROM labelled) o JOIN ground g ON g.img = o.img AND g.y = o.label // {SIDE} AND g.x = o.label % {SIDE} - 1),
        beside AS (SELECT DISTINCT l.img, l.label, g.g, l.y, l.x FROM labelled l JOIN ground g ON g.img = l.img AND abs(g.y - l.y) + abs(g.x - l.x) = 1)
        SELECT b.img, b.label, b.g <> a.g AS hole, b.y, b.x FROM beside b JOIN around a ON a.img = b.img AND a.label = b.label""",
}
