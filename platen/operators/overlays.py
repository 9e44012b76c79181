"""Pictures that show how an object was understood: its mask, rectangles, text boxes and angle drawn over its pixels."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.operators import masks, raster
from platen.operators.models import eight_bits
from platen.sources import codecs
from platen.sources.images import pixels_of

# Colours of the drawing, and the share of a mask's colour in its tint.
MASK, ANGLE, FIT, SAFE, CHOSEN, LEVEL, TINT = (0, 200, 0), (220, 0, 0), (0, 90, 255), (0, 200, 200), (230, 0, 230), (150, 150, 150), 0.4


@dataclass(frozen=True)
class Line:
    """A line of text: its box's corners, direction in degrees, length and score."""

    corners: np.ndarray
    angle: float
    length: float
    score: float


def draw_line(image: np.ndarray, start: tuple[float, float], end: tuple[float, float], colour: tuple[int, int, int]) -> None:
    """A line a pixel wide between the pixels that hold start and end (x, y): one pixel for each step along its longer direction. What lies outside is left out."""
    (x0, y0), (x1, y1) = ((math.floor(x + 0.5), math.floor(y + 0.5)) for x, y in (start, end))
    n = max(abs(x1 - x0), abs(y1 - y0))
    h, w = image.shape[:2]
    # only the steps that may be inside, so that a long line costs no more than the picture
    low, high = 0, n
    for a, b, top in ((x0, x1, w - 1), (y0, y1, h - 1)):
        if a != b:
            reach = sorted(((0 - 0.5 - a) * n / (b - a), (top + 0.5 - a) * n / (b - a)))
            low, high = max(low, math.floor(reach[0])), min(high, math.ceil(reach[1]))
    t = np.arange(low, high + 1)
    x, y = (np.floor(a + (b - a) * t / max(n, 1) + 0.5).astype(int) for a, b in ((x0, x1), (y0, y1)))
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    image[y[inside], x[inside]] = colour


def draw_outline(image: np.ndarray, corners: np.ndarray, colour: tuple[int, int, int]) -> None:
    """The sides of a polygon."""
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        draw_line(image, tuple(a), tuple(b), colour)


def overlay(rgba: np.ndarray, mask: np.ndarray, lines: Iterable[Line] = (), fit: np.ndarray | None = None, safe: np.ndarray | None = None, degrees: float | None = None) -> np.ndarray:
    """The cutout over white, its mask tinted; then the widest rectangle if it isn't the fitted one, the fitted one, boxes of text (greener the surer) with their directions, and the angle chosen, through the middle."""
    out = raster.over_white(rgba)
    tint = np.floor(out[mask] * (1 - TINT) + np.array(MASK) * TINT + 0.5).astype(np.uint8)
    out[mask] = tint
    for corners, colour in ((safe, SAFE), (fit, FIT)):
        if corners is not None:
            draw_outline(out, corners, colour)
    for line in lines:
        draw_outline(out, line.corners, (int(min(max(1 - line.score, 0), 1) * 220), 170, 0))
        through(out, *line.corners.mean(axis=0), line.angle, line.length / 2, ANGLE)
    if degrees is not None:
        h, w = out.shape[:2]
        through(out, w / 2, h / 2, degrees, max(w, h), CHOSEN)
    return out


def through(image: np.ndarray, x: float, y: float, degrees: float, reach: float, colour: tuple[int, int, int]) -> None:
    c, s = math.cos(math.radians(degrees)) * reach, math.sin(math.radians(degrees)) * reach
    draw_line(image, (x - c, y - s), (x + c, y + s), colour)


def deskewed(picture: np.ndarray, theta: float) -> np.ndarray:
    """An overlay turned as its object is, with a level line through the middle, on which the chosen angle should lie."""
    out = raster.rotated(picture, theta, 255)
    h, w = out.shape[:2]
    draw_line(out, (0, h / 2), (w, h / 2), LEVEL)
    return out


def overlays(images: DataFrame, objects: DataFrame, shown: DataFrame) -> DataFrame:
    """Images of pixels, their objects and what is shown of each (obj, out_path, fit, safe, angle_deg, theta, lines) to files: (path, obj_idx, out_path, content).

    Two for each object that has an out_path, ``.debug`` and ``.deskewed`` before its extension, as PNG. An image's pixels meet all of its objects once.
    """
    what = ("out_path", "fit", "safe", "angle_deg", "theta", "lines")
    joined = objects.where("error is null").select("path", "obj_idx", "obj", "min_x", "min_y", "max_x", "max_y", "runs").join(shown.select("obj", *what).where("out_path is not null"), "obj")
    rows = joined.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("obj_idx", "min_x", "min_y", "max_x", "max_y", "runs", *what))).alias("things"))
    schema = pa.schema([("path", pa.string()), ("obj_idx", pa.int32()), ("out_path", pa.string()), ("content", pa.binary())])
    corners = lambda q: None if q is None else np.array([[p["x"], p["y"]] for p in q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(n)[i].as_py() for n, c in enumerate(batch.schema.names)}
                image = eight_bits(pixels_of(r["data"], r["width"], r["height"], r["channels"], r["depth"]))
                for t in r["things"]:
                    mask = masks.local_mask(masks.Found(0, 0, t["min_x"], t["min_y"], t["max_x"], t["max_y"], masks.Runs(*(np.array([x[c] for x in t["runs"]]) for c in ("y", "left", "right")))))
                    lines = [Line(corners(b["corners"]), b["angle"], b["length"], b["score"]) for b in t["lines"] or []]
                    plain = overlay(raster.cutout(image, mask, t["min_x"], t["min_y"]), mask, lines, corners(t["fit"]), corners(t["safe"]), t["angle_deg"])
                    for kind, picture in ((".debug", plain), (".deskewed", deskewed(plain, t["theta"]))):
                        place = f"{t['out_path'].rpartition('.')[0]}{kind}.png"
                        yield pa.RecordBatch.from_pylist([{"path": r["path"], "obj_idx": t["obj_idx"], "out_path": place, "content": codecs.encode(picture, "png")}], schema)

    return images.where("error is null").select("path", "width", "height", "channels", "depth", "data").join(rows, "path").mapInArrow(run, "path string, obj_idx int, out_path string, content binary")
