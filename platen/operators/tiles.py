"""Images beyond one task: cut into tiles, labelled and rendered tile by tile."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.operators import graph, masks, raster
from platen.operators.grouped import by_group
from platen.sources import codecs
from platen.sources.batches import batched
from platen.sources.scratch import kept

#: Side of a tile.
SIDE = 512
#: An image's size stands in each of its tiles; data: row by row, 16 bits little-endian. A failed image is one row with an error.
TILES = "path string, ty int, tx int, width int, height int, channels int, depth int, data binary, error string"
_TILE_SCHEMA = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("ty", "tx", "width", "height", "channels", "depth")), ("data", pa.binary()), ("error", pa.string())])


def cut_files(files: DataFrame, side: int = SIDE) -> DataFrame:
    """Files (path, content, format) to TILES of so many pixels a side, fewer at the right and below.

    A file's rows are unpacked as they are cut (PNG, TIFF; others are decoded whole), so a task holds a row of tiles beside the file. A file that can't be decoded has
    a row with an error and no pixels, after such tiles as came before the fault; null content is such a file.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, form = (batch.column(c)[i].as_py() for c in range(3))
                try:
                    width, height = codecs.size_of(content or b"", form)
                    for ty, band in enumerate(codecs.bands(content, form, side)):
                        for tx in range(-(-width // side)):
                            part = band[:, tx * side : (tx + 1) * side]
                            yield {"path": path, "ty": ty, "tx": tx, "width": width, "height": height, "channels": part.shape[2], "depth": 8 * part.itemsize, "data": part.astype(f"<u{part.itemsize}").tobytes()}
                except codecs.Unsupported as e:
                    yield {"path": path, "error": str(e)}

    return files.select("path", "content", "format").mapInArrow(lambda batches: batched(cut(batches), _TILE_SCHEMA), TILES)


def tile_of(row: dict, side: int) -> np.ndarray:
    """A tile's pixels."""
    h, w = min(side, row["height"] - row["ty"] * side), min(side, row["width"] - row["tx"] * side)
    return np.frombuffer(row["data"], np.uint8 if row["depth"] == 8 else "<u2").reshape(h, w, row["channels"])


# --- rendering ---


def _span(values: list[Column]) -> tuple[Column, Column]:
    return F.floor(F.least(*values)), F.ceil(F.greatest(*values))


def output_tiles(planned: DataFrame, side: int = SIDE) -> DataFrame:
    """Crops (path, obj_idx, bounds, theta, turns) to the tiles of their pictures: (path, obj_idx, out_w, out_h, oy, ox, first_x, first_y, w, h, turns, theta, bounds).

    oy and ox count tiles of the picture as it is written; first_x, first_y, w and h say what of the window before its quarter turns a tile holds.
    """
    extent = lambda a: F.greatest(F.ceil(F.round(F.col(f"bounds.max_{a}") - F.col(f"bounds.min_{a}"), 6)), F.lit(1)).cast("int")
    turns = F.pmod(F.col("turns").cast("int"), F.lit(4))
    crop = planned.select("path", "obj_idx", F.struct(*(F.col(f"bounds.{c}").cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y"))).alias("bounds"), F.col("theta").cast("double").alias("theta"), turns.alias("turns"), extent("x").alias("wide"), extent("y").alias("high"))
    lying = F.col("turns") % 2 == 1
    crop = crop.select("*", F.when(lying, F.col("high")).otherwise(F.col("wide")).alias("out_w"), F.when(lying, F.col("wide")).otherwise(F.col("high")).alias("out_h"))
    grid = crop.withColumn("oy", F.explode(F.sequence(F.lit(0), F.floor((F.col("out_h") - 1) / side).cast("int")))).withColumn("ox", F.explode(F.sequence(F.lit(0), F.floor((F.col("out_w") - 1) / side).cast("int"))))
    x, y = F.col("ox") * side, F.col("oy") * side
    w, h = F.least(F.lit(side), F.col("out_w") - x), F.least(F.lit(side), F.col("out_h") - y)
    back = lambda zero, one, two, three: F.when(F.col("turns") == 0, zero).when(F.col("turns") == 1, one).when(F.col("turns") == 2, two).otherwise(three)
    first_x, first_y = back(x, y, F.col("wide") - x - w, F.col("wide") - y - h), back(y, F.col("high") - x - w, F.col("high") - y - h, x)
    return grid.select("path", "obj_idx", "out_w", "out_h", "oy", "ox", first_x.cast("int").alias("first_x"), first_y.cast("int").alias("first_y"), F.when(lying, h).otherwise(w).alias("w"), F.when(lying, w).otherwise(h).alias("h"), "turns", "theta", "bounds")


def needed(outputs: DataFrame, sizes: DataFrame, side: int = SIDE) -> DataFrame:
    """Output tiles with ty and tx of each tile of the image (sizes: path, width, height) that lies under them, a pixel around included; null where none does."""
    c, s = F.cos("theta"), F.sin("theta")
    xs, ys = [], []
    for a in (F.lit(0), F.col("w") - 1):
        for b in (F.lit(0), F.col("h") - 1):
            px, py = F.col("first_x") + a + F.col("bounds.min_x"), F.col("first_y") + b + F.col("bounds.min_y")
            xs.append(px * c + py * s)
            ys.append(py * c - px * s)
    tile = lambda v: F.floor(v / side).cast("int")
    (x0, x1), (y0, y1) = _span(xs), _span(ys)
    lie = outputs.join(sizes, "path").select("*", F.greatest(x0 - 1, F.lit(0)).alias("x0"), F.least(x1 + 1, F.col("width") - 1).alias("x1"), F.greatest(y0 - 1, F.lit(0)).alias("y0"), F.least(y1 + 1, F.col("height") - 1).alias("y1"))
    under = (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    span = lambda a: F.explode(F.when(under, F.sequence(tile(F.col(f"{a}0")), tile(F.col(f"{a}1")))).otherwise(F.array(F.lit(None).cast("int"))))
    return lie.withColumn("ty", span("y")).withColumn("tx", span("x")).drop("x0", "x1", "y0", "y1")


_DONE = "path string, obj_idx int, out_w int, out_h int, oy int, ox int, h int, w int, channels int, depth int, data binary"


def render(tiles: DataFrame, planned: DataFrame, side: int = SIDE) -> DataFrame:
    """Crops (path, obj_idx, bounds, theta, turns) of tiled images to tiles of pictures: (path, obj_idx, out_w, out_h, oy, ox, h, w, channels, depth, data).

    A tile meets those tiles of its image that lie under it, some nine at most, in one task, whatever the image's and the crop's sizes; pixels are those of the kernel for
    whole images. Outside the image is white. Images with an error, and crops with a null bound or angle, give no tiles.
    """
    good = tiles.where("error is null")
    sizes = good.where("ty = 0 and tx = 0").select("path", "width", "height", "channels", "depth")
    asked = needed(output_tiles(planned.where("bounds is not null and theta is not null and turns is not null"), side), sizes, side)
    keys = ["path", "obj_idx", "out_w", "out_h", "oy", "ox", "first_x", "first_y", "w", "h", "turns", "theta", "bounds", "width", "height", "channels", "depth"]
    joined = asked.join(good.select("path", "ty", "tx", "data"), ["path", "ty", "tx"], "left")
    rows = joined.groupBy(*keys).agg(F.collect_list(F.when(F.col("ty").isNotNull() & F.col("data").isNotNull(), F.struct("ty", "tx", "data"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(n)[i].as_py() for n, c in enumerate(batch.schema.names)}
                out = raster.quarter_turns(_tile(r, side), r["turns"])
                done = {k: r[k] for k in ("path", "obj_idx", "out_w", "out_h", "oy", "ox")} | {"h": out.shape[0], "w": out.shape[1], "channels": out.shape[2], "depth": 8 * out.itemsize, "data": out.astype(f"<u{out.itemsize}").tobytes()}
                yield pa.RecordBatch.from_pylist([done], _DONE_SCHEMA)

    return rows.mapInArrow(run, _DONE)


_DONE_SCHEMA = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("obj_idx", "out_w", "out_h", "oy", "ox", "h", "w", "channels", "depth")), ("data", pa.binary())])


def _tile(r: dict, side: int) -> np.ndarray:
    """The picture of one tile, from the parts of the image under it put together."""
    kind, channels = np.uint8 if r["depth"] == 8 else np.uint16, r["channels"]
    white = int(np.iinfo(kind).max)
    size = (r["width"], r["height"])
    if not r["parts"]:
        return np.full((r["h"], r["w"], 3), white, kind)
    top, left = min(p["ty"] for p in r["parts"]), min(p["tx"] for p in r["parts"])
    down, across = (max(p[k] for p in r["parts"]) + 1 - low for k, low in (("ty", top), ("tx", left)))
    whole = np.zeros((min(down * side, size[1] - top * side), min(across * side, size[0] - left * side), channels), kind)
    for p in r["parts"]:
        own = tile_of({**r, **p}, side)
        y, x = (p["ty"] - top) * side, (p["tx"] - left) * side
        whole[y : y + len(own), x : x + own.shape[1]] = own
    b = r["bounds"]
    return raster.warped(raster.to_rgb(whole), r["theta"], b["min_x"], b["min_y"], r["w"], r["h"], white, (r["first_x"], r["first_y"]), (left * side, top * side), size)


def tiff_files(pictures: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of pictures to files (path, obj_idx, out_w, out_h, content): TIFFs of deflated tiles. Tiles are packed where they are; a file's packed tiles meet in one row.

    side: of the tiles, a multiple of 16.
    """
    if side % 16:
        raise ValueError("tiles of a TIFF need a side that is a multiple of 16")
    schema = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("obj_idx", "out_w", "out_h", "oy", "ox", "channels", "depth")), ("packed", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                part = np.frombuffer(r["data"], np.uint8 if r["depth"] == 8 else "<u2").reshape(r["h"], r["w"], r["channels"])
                full = np.pad(part, ((0, side - r["h"]), (0, side - r["w"]), (0, 0)))
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names if k != "packed"} | {"packed": codecs.deflated(full)}], schema)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, idx, w, h, channels, depth, parts = (batch.column(k)[i].as_py() for k in range(7))
                content = codecs.tiff_file((h, w, channels, depth // 8), (p["packed"] for p in parts), tile=side)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([idx], pa.int32()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([content], pa.binary())], ["path", "obj_idx", "out_w", "out_h", "content"])

    packed = pictures.mapInArrow(pack, "path string, obj_idx int, out_w int, out_h int, oy int, ox int, channels int, depth int, packed binary")
    whole = packed.groupBy("path", "obj_idx", "out_w", "out_h", "channels", "depth").agg(F.array_sort(F.collect_list(F.struct("oy", "ox", "packed"))).alias("parts"))
    return whole.mapInArrow(put, "path string, obj_idx int, out_w int, out_h int, content binary")


# --- labelling ---

#: Runs of tiles beyond which a batch is handed on.
RUNS = 50_000
_RUNS = "path string, ty int, tx int, y int, left int, right int, label long"


def local_runs(tiles: DataFrame, cutoff: int, side: int = SIDE) -> DataFrame:
    """Tiles of masks (TILES, the first channel counts) to runs of pixels of cutoff and more: (path, ty, tx, y, left, right, label), places in the image.

    Runs that touch within the tile have one label: y * width + x of the first pixel of their component there, so no two components of an image have the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                r = {c: batch.column(n)[i].as_py() for n, c in enumerate(batch.schema.names)}
                own = masks.runs_of(tile_of(r, side)[:, :, 0] >= cutoff)
                first = masks.components(own)
                y, left, right = own.y + r["ty"] * side, own.left + r["tx"] * side, own.right + r["tx"] * side
                label = (y[first] * r["width"] + left[first]).astype(np.int64)
                for held, v in zip(done, ([r["path"]] * len(y), *(np.full(len(y), r[k], np.int32) for k in ("ty", "tx")), *(v.astype(np.int32) for v in (y, left, right)), label), strict=True):
                    held.append(v)
                if i + 1 == batch.num_rows or sum(map(len, done[0])) > RUNS:
                    columns = [pa.array([p for own in done[0] for p in own], pa.string()), *(pa.array(np.concatenate(v)) for v in done[1:])]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "ty", "tx", "y", "left", "right", "label"])
                    done = [[] for _ in range(7)]

    good = tiles.where("error is null and data is not null").select("path", "ty", "tx", "width", "height", "channels", "depth", "data")
    return good.mapInArrow(run, _RUNS)


def seams(runs: DataFrame, side: int = SIDE) -> DataFrame:
    """Pairs of local labels (path, a, b) whose pixels touch over a border of tiles, over corners too.

    Only runs at borders take part: each meets by equal keys the runs that begin or end at the border's other side (left and right), or lie in the row beyond (above and below),
    where a row's runs are a list of one tile's width, and met in order.
    """
    x0, x1, y = F.col("tx") * side, (F.col("tx") + 1) * side - 1, F.col("y")
    # left and right: a run that ends at its tile's last column, and one in the next tile that begins in its first, a row up or down at most
    ends = runs.where(F.col("right") == x1).select("path", (F.col("tx") + 1).alias("tx"), F.explode(F.array(y - 1, y, y + 1)).alias("y"), F.col("label").alias("a"))
    begins = runs.where(F.col("left") == x0).select("path", "tx", "y", F.col("label").alias("b"))
    beside = ends.join(begins, ["path", "tx", "y"]).select("path", "a", "b")
    # above and below: the last row of a tile and the first of the one below, runs of both in one small group
    last, first = y == (F.col("ty") + 1) * side - 1, y == F.col("ty") * side
    border = runs.where(last | first).select("path", F.explode(F.array(F.when(last, F.col("ty") + 1), F.when(first, F.col("ty")))).alias("edge"), "tx", "ty", "left", "right", "label").where("edge is not null")
    lists = border.withColumn("below", (F.col("edge") == F.col("ty")).cast("int")).select("path", "edge", "tx", "below", "left", "right", "label")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        up, low = (frame[frame["below"] == k].sort_values("left") for k in (0, 1))
        above, below = (masks.Runs(np.zeros(len(f), np.int64), f["left"].to_numpy(np.int64), f["right"].to_numpy(np.int64)) for f in (up, low))
        i, j = masks.touching(above, below, 0, 1)
        return pd.DataFrame({"path": [frame["path"].iloc[0]] * len(i), "a": up["label"].to_numpy()[i], "b": low["label"].to_numpy()[j]})

    upon = by_group(lists, ["path", "edge", "tx"], one, "path string, a long, b long")
    return beside.unionByName(upon).distinct()


def label_tiles(tiles: DataFrame, cutoff: int, side: int = SIDE) -> DataFrame:
    """Tiles of masks to labelled runs (path, ty, tx, y, left, right, label) of 8-connected components across tiles; label: y * width + x of a component's first pixel.

    Components are told within each tile first; those that touch over a seam are joined by Spark steps on pairs of local labels, which are few beside the pixels. No task holds
    more of an image than a tile, or the runs along one border.
    """
    runs = kept(local_runs(tiles, cutoff, side), "runs")
    node = lambda c: F.struct("path", F.col(c).alias("label"))
    roots = graph.connected(seams(runs, side).select(node("a").alias("a"), node("b").alias("b"))).select("node.path", F.col("node.label").alias("label"), F.col("root.label").alias("root"))
    return runs.join(roots, ["path", "label"], "left").select("path", "ty", "tx", "y", "left", "right", F.coalesce("root", "label").alias("label"))


def objects(runs: DataFrame, min_area: int = 1) -> DataFrame:
    """Labelled runs to (path, obj_idx, label, area, bounds), the largest first, of equal ones the first in row order; sums of runs meet, not pixels."""
    area = F.sum((F.col("right") - F.col("left") + 1).cast("long"))
    stats = runs.groupBy("path", "label").agg(area.alias("area"), F.min("left").alias("min_x"), F.min("y").alias("min_y"), F.max("right").alias("max_x"), F.max("y").alias("max_y")).where(F.col("area") >= max(min_area, 1))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("area"), "label")) - 1
    return stats.select("path", rank.cast("long").alias("obj_idx"), "label", "area", "min_x", "min_y", "max_x", "max_y")


def theta_window(width: int, height: int, theta: float) -> tuple[float, float, float, float]:
    """Bounds of a whole image turned by theta."""
    c, s = math.cos(theta), math.sin(theta)
    xs, ys = [x * c - y * s for x in (0, width) for y in (0, height)], [x * s + y * c for x in (0, width) for y in (0, height)]
    return min(xs), min(ys), max(xs), max(ys)
