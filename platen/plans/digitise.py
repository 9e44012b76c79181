"""Images in, crops out: decoded scans and the masks of a model to objects, their geometry, a plan of crops, and rendered files.

Scores of models are inputs, or models are callables: masks for the extractor, probability maps of text, answers of the line and document classifiers. What is missing
degrades: without text the mask's angle holds, without classifiers nothing is turned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.operators import crops, masks, overlays, raster, rectangles, textboxes, votes
from platen.operators.models import Models, ask_orientation, detect_text, extract_masks
from platen.options import Options
from platen.sources import codecs, outputs
from platen.sources.batches import batched
from platen.sources.images import pixels_of
from platen.sources.scratch import broadcast_if, kept

OBJECTS = (
    "path string, obj_idx int, obj long, label int, area long, min_x int, min_y int, max_x int, max_y int, width int, height int, clipped int, holes int, "
    "outline array<struct<x:int,y:int>>, runs array<struct<y:int,left:int,right:int>>, error string"
)
_POINT, _RUN = pa.struct([("x", pa.int32()), ("y", pa.int32())]), pa.struct([("y", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])
_OBJECT_SCHEMA = pa.schema([("path", pa.string()), ("obj_idx", pa.int32()), ("label", pa.int32()), ("area", pa.int64()), *((c, pa.int32()) for c in ("min_x", "min_y", "max_x", "max_y", "width", "height", "clipped", "holes")), ("outline", pa.list_(_POINT)), ("runs", pa.list_(_RUN)), ("error", pa.string())])


def _structs(columns: dict[str, np.ndarray], kind: pa.StructType) -> list[dict[str, int]]:
    names = [f.name for f in kind]
    return [dict(zip(names, row, strict=True)) for row in zip(*(columns[n].tolist() for n in names), strict=True)]


def foreground_objects(found: list[np.ndarray], width: int, height: int, options: Options) -> list[masks.Found]:
    """The objects of an image by its masks (arrays of grey values), read as the options' extractor says."""
    if options.extractor == "alpha":
        if not found:
            raise ValueError("model returned no mask")
        if found[0].shape != (height, width):
            raise ValueError(f"mask size ({found[0].size}) does not match image size ({width}x{height})")
        return masks.connected_objects(found[0] >= options.cutoff, options.min_area)
    fitted = [masks.foreground_of(m, width, height) for m in found]
    if options.extractor == "background":
        return masks.background_objects(fitted, (height, width), options.min_area)
    return masks.claimed_objects(masks.merged_instances(fitted, options.overlap), options.min_area)


def objects_of_images(images: DataFrame, mask_rows: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Images (path, width, height, error) and masks (path, mask_no, width, height, data: 8-bit grey) to OBJECTS: a row for each object, the largest first, or one with an error.

    Pixels of the images stay where they are: sizes alone meet the masks. An image's masks are one group, as many as a model finds in it. Small objects are dropped
    before anything else is computed of them; holes are counted from a thousandth of the object's pixels on, 64 at least.
    """
    grouped = mask_rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("mask_no", "width", "height", "data"))).alias("masks"))
    joined = images.select("path", "width", "height", "error").join(grouped, "path", "left")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, width, height, error, given = (batch.column(c)[i].as_py() for c in range(5))
                rows = []
                try:
                    if error is None:
                        if any(m["data"] is None or m["width"] is None or m["height"] is None for m in given or []):
                            raise ValueError("a mask has no pixels")
                        arrays = [np.frombuffer(m["data"], np.uint8).reshape(m["height"], m["width"]) for m in given or []]
                        least = options.min_side_percent / 100 * min(width, height)
                        kept = [o for o in foreground_objects(arrays, width, height, options) if options.min_side_percent <= 0 or max(o.size) >= least]
                        if not kept:
                            error = "no foreground objects found"
                        for n, o in enumerate(kept):
                            edge = masks.outline_points(o).astype(np.int32)
                            clipped = (o.min_x == 0) + (o.min_y == 0) + (o.max_x == width - 1) + (o.max_y == height - 1)
                            rows.append({"path": path, "obj_idx": n, "label": o.label, "area": o.area, "min_x": o.min_x, "min_y": o.min_y, "max_x": o.max_x, "max_y": o.max_y, "width": width, "height": height, "clipped": int(clipped), "holes": masks.hole_count(o.runs, max(o.area // 1000, 64)), "outline": _structs({"x": edge[:, 0], "y": edge[:, 1]}, _POINT), "runs": _structs({"y": o.runs.y, "left": o.runs.left, "right": o.runs.right}, _RUN), "error": None})
                except ValueError as e:
                    error = str(e)
                if error is not None:
                    rows = [{"path": path, "error": error}]
                yield from rows

    found = joined.mapInArrow(lambda batches: batched(told(batches), _OBJECT_SCHEMA), OBJECTS.replace(" obj long,", ""))
    return found.withColumn("obj", F.xxhash64("path", "obj_idx")).select(*(c.split(" ")[0] for c in OBJECTS.replace("struct<x:int,y:int>", "").replace("struct<y:int,left:int,right:int>", "").split(", ")))


def text_lines(objects: DataFrame, chances: DataFrame) -> DataFrame:
    """Objects and probability maps (path, obj_idx, height, width, data: 32-bit floats) of their cutouts to (obj, pos, angle, length, score, corners)."""
    size = objects.select("obj", "path", "obj_idx", (F.col("max_x") - F.col("min_x") + 1).alias("w"), (F.col("max_y") - F.col("min_y") + 1).alias("h"))
    joined = size.join(chances, ["path", "obj_idx"]).select("obj", "w", "h", "width", "height", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chance = np.frombuffer(row["data"], "<f4").reshape(row["height"], row["width"])
                found = textboxes.text_boxes(chance, row["w"], row["h"])
                columns = [[row["obj"]] * len(found), list(range(len(found))), [b.angle for b in found], [float(b.length) for b in found], [b.score for b in found], [[{"x": float(x), "y": float(y)} for x, y in b.corners] for b in found]]
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["obj", "pos", "angle", "length", "score", "corners"])

    return joined.mapInArrow(run, "obj long, pos int, angle double, length double, score double, corners array<struct<x:double,y:double>>")


_CORNERS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_SHAPE_SCHEMA = pa.schema([("obj", pa.int64()), ("clipped", pa.int32()), ("holes", pa.int32()), ("rectangularity", pa.float64()), ("mask_angle", pa.float64()), ("safe", _CORNERS), ("body", _CORNERS)])


def geometry(objects: DataFrame) -> DataFrame:
    """What an object's outline says: (obj, clipped, holes, rectangularity, mask_angle, safe, body), the last two the corners of its least rectangle and of its body's.

    An outline stands in its object's row, so its shape is told from that row alone, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ends = batch.column(4).offsets.to_numpy()
            x, y = (batch.column(4).values.field(k).to_numpy() for k in range(2))
            for i, (obj, clipped, holes, area) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                shape = rectangles.shape_of(np.stack([x[ends[i] : ends[i + 1]], y[ends[i] : ends[i + 1]]], axis=1).astype(float), area)
                row = {"obj": obj, "clipped": clipped, "holes": holes}
                if shape is not None:
                    row |= {"rectangularity": shape.rectangularity, "mask_angle": shape.degrees, "safe": _points(shape.corners), "body": _points(shape.body)}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, _SHAPE_SCHEMA)

    good = objects.where("error is null").select("obj", "clipped", "holes", "area", "outline")
    return good.mapInArrow(run, "obj long, clipped int, holes int, rectangularity double, mask_angle double, safe array<struct<x:double,y:double>>, body array<struct<x:double,y:double>>")


def _points(corners: np.ndarray) -> list[dict[str, float]]:
    return [{"x": x, "y": y} for x, y in corners.tolist()]


def decisions(shapes: DataFrame, options: Options, text: DataFrame | None = None, flips: DataFrame | None = None, doc_turns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Shapes with what is said of their text and turns, and the decision on each."""
    all_of = shapes
    if text is None:
        all_of = all_of.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("text_angle", "double"), ("inliers", "long"), ("total", "long"), ("agreement", "double"))))
    else:
        said = votes.robust_text_angle(text, options.angle_tolerance)
        all_of = all_of.join(said.select("obj", F.col("angle_deg").cast("float").cast("double").alias("text_angle"), "inliers", "total", "agreement"), "obj", "left")
    for extra, name, kind in ((flips, "flip", "boolean"), (doc_turns, "doc_turns", "int")):
        all_of = all_of.withColumn(name, F.lit(None).cast(kind)) if extra is None else all_of.join(extra.select("obj", name), "obj", "left")
    decided = votes.decide(all_of, text=options.text, force_rectangular=options.force_rectangular, safezone=options.safezone, no_deskew=options.no_deskew, no_doc_orient=options.no_doc_orient, rect_threshold=options.rectangle_threshold)
    return all_of, decided


def plan_crops(objects: DataFrame, options: Options = Options(), text: DataFrame | None = None, flips: DataFrame | None = None, doc_turns: DataFrame | None = None, shapes: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Objects to the decision on each and its crop's bounds. text: (obj, pos, angle, length); flips: (obj, flip); doc_turns: (obj, doc_turns); each may be missing.
    shapes: their geometry(), if it is at hand.

    The least rectangle around the outline says the angle and how rectangular the object is; around its body it says the crop of rectangular objects. Bounds are those of
    that rectangle, or of the object's pixels if text said the angle. Rows with an error pass through.
    """
    all_of, decided = decisions(geometry(objects) if shapes is None else shapes, options, text, flips, doc_turns)
    each = objects.join(decided, "obj", "left").join(all_of.select("obj", "rectangularity", "safe", "body", "inliers", "total", "agreement"), "obj", "left")
    corners = F.when(F.col("source") != "text", F.when(F.col("fit") == "max", F.col("safe")).otherwise(F.coalesce("body", "safe")))
    padding = F.when(F.col("padded"), options.padding).otherwise(0.0)
    bounds = crops.expanded(crops.crop_bounds(corners, F.col("runs"), F.col("min_x"), F.col("min_y"), F.col("theta")), padding)
    note = votes.angle_note(F.col("angle_deg"), F.col("source"), F.col("inliers"), F.col("total"), F.col("agreement"), F.col("turns"))
    return each.select(
        "path", "obj_idx", "label", "area", "min_x", "min_y", "max_x", "max_y", "rectangularity", "clipped", "holes", "fit", F.when(F.col("error").isNull(), padding).alias("padding"), F.col("angle_deg").cast("float").alias("angle_deg"), "source",
        "inliers", "total", F.col("agreement").cast("float").alias("agreement"), "turns", "theta", F.when(F.col("error").isNull(), bounds).alias("bounds"), F.when(F.col("error").isNull(), note).alias("angle_note"), "runs", "error",
    )


def render(images: DataFrame, planned: DataFrame, options: Options = Options(), output: str | None = None, output_dir: str | None = None) -> DataFrame:  # noqa: B008
    """Images of pixels and planned crops to (path, obj_idx, out_path, format, out_w, out_h, content, error) and the plan's columns; a row with an error for each image or crop that failed.

    The plan's rows of an image meet its pixels once, as an array: pixels are shuffled once an image, not once an object.
    """
    given = outputs.plan(F.col("path"), F.col("format"), F.lit(options.alpha), F.lit(options.allow_lossy), None if output is None else F.lit(output), None if output_dir is None else F.lit(output_dir), output_dir is not None)
    rows = planned.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*(c for c in ("obj_idx", "min_x", "min_y", "max_x", "max_y", "padding", "turns", "theta", "bounds", "runs", "error"))))).alias("crops"))
    joined = images.select("path", "format", "width", "height", "channels", "depth", "data", F.col("error").alias("failed"), given["format"].alias("out_format"), given["error"].alias("refused")).join(rows, "path")
    schema = pa.schema([("path", pa.string()), ("obj_idx", pa.int32()), ("out_w", pa.int32()), ("out_h", pa.int32()), ("content", pa.binary()), ("failure", pa.string())])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(n)[i].as_py() for n, c in enumerate(batch.schema.names)}
                image = None if row["data"] is None else pixels_of(row["data"], row["width"], row["height"], row["channels"], row["depth"])
                for crop in row["crops"]:
                    out: dict[str, object] = {"path": row["path"], "obj_idx": crop["obj_idx"], "failure": crop["error"] or row["failed"] or row["refused"]}
                    if out["failure"] is None:
                        try:
                            done = _rendered(image, crop, options.alpha)
                            out |= {"out_w": done.shape[1], "out_h": done.shape[0], "content": codecs.encode(done, row["out_format"])}
                        except (codecs.Unsupported, ValueError) as e:
                            out["failure"] = str(e)
                    yield out

    done = joined.mapInArrow(lambda batches: batched(drawn(batches), schema), "path string, obj_idx int, out_w int, out_h int, content binary, failure string").withColumnRenamed("path", "own_path").withColumnRenamed("obj_idx", "own_idx")
    paths = images.select("path", outputs.plan(F.col("path"), F.col("format"), F.lit(options.alpha), F.lit(options.allow_lossy), None if output is None else F.lit(output), None if output_dir is None else F.lit(output_dir), output_dir is not None)["base"].alias("base"), given["format"].alias("format"))
    both = planned.drop("runs").join(done, (F.col("path") == F.col("own_path")) & F.col("obj_idx").eqNullSafe(F.col("own_idx"))).drop("own_path", "own_idx").join(paths, "path")
    failed = F.coalesce("error", "failure")
    return both.withColumn("error", failed).withColumn("out_path", F.when(failed.isNull(), outputs.object_path(F.col("base"), F.col("obj_idx")))).drop("base", "failure")


def _rendered(image: np.ndarray, crop: dict, alpha: bool) -> np.ndarray:
    raster.depth_of(image)
    if not alpha:
        b = crop["bounds"]
        return raster.rgb_output(image, (b["min_x"], b["min_y"], b["max_x"], b["max_y"]), crop["theta"], crop["turns"])
    runs = masks.Runs(*(np.array([r[c] for r in crop["runs"]]) for c in ("y", "left", "right")))
    found = masks.Found(0, 0, crop["min_x"], crop["min_y"], crop["max_x"], crop["max_y"], runs)
    return raster.alpha_output(image, masks.local_mask(found), crop["min_x"], crop["min_y"], crop["theta"], crop["padding"], crop["turns"])


def digitise(images: DataFrame, mask_rows: DataFrame | None = None, options: Options = Options(), **more: object) -> DataFrame:  # noqa: B008
    """The whole way, to crops: the first of what digitised() gives."""
    return digitised(images, mask_rows, options, **more)[0]


def digitised(
    images: DataFrame, mask_rows: DataFrame | None = None, options: Options = Options(), *, models: Models = Models(), chances: DataFrame | None = None, flips: DataFrame | None = None,  # noqa: B008
    doc_turns: DataFrame | None = None, output: str | None = None, output_dir: str | None = None, fail_fast: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """Crops of images, and with options.debug the pictures that show how each object was understood. With fail_fast, as for a single input, a failed image is an error of the job; otherwise it is a row with the reason.

    Masks, chances of text, flips and turns are given, or asked of models: text only of objects whose angle is sought in it. Pixels, objects, shapes and plans are written once
    each and read from there, so an image is decoded and labelled once. A path stands for one image: of rows with one path one counts, the others are rows with an error.
    """
    pixels = kept(images.select("path", "format", "width", "height", "channels", "depth", "data", "error", F.monotonically_increasing_id().alias("row")), "pixels")
    order = F.row_number().over(Window.partitionBy("path").orderBy("row"))
    again = kept(pixels.select("path", "row").withColumn("n", order).where("n > 1").select("path", "row"), "repeated-paths")
    own = pixels.join(broadcast_if(again.select("row"), 1_000_000), "row", "left_anti").drop("row")
    if mask_rows is None:
        if models.extractor is None:
            raise ValueError("masks, or a model that finds them, must be given")
        mask_rows = extract_masks(own, models.extractor, options.object_prompts())
    objects = kept(objects_of_images(own, mask_rows, options), "objects")
    shapes = kept(geometry(objects), "shapes")
    text = None if chances is None else kept(text_lines(objects, chances), "text-lines")
    good = objects.where("error is null")
    if text is None and models.detector is not None:
        asked = decisions(shapes, options)[1].where("use_text").select("obj")
        text = kept(detect_text(own, good.join(asked, "obj", "left_semi"), models.detector, required=options.text), "text-lines")
    if (flips is None and models.lines is not None) or (doc_turns is None and models.document is not None):
        answers = kept(ask_orientation(own, good, decisions(shapes, options, text)[1], text, models), "orientations")
        flips, doc_turns = (answers if flips is None else flips), (answers if doc_turns is None else doc_turns)
    planned = kept(plan_crops(objects, options, text, flips, doc_turns, shapes), "plan")
    crops_of = render(own, planned, options, output, output_dir)
    shown = _shown(own, objects, shapes, decisions(shapes, options, text, flips, doc_turns)[1], text, options, output, output_dir) if options.debug else None
    crops_of = crops_of.unionByName(again.select("path", F.lit("the path comes more than once").alias("error")), allowMissingColumns=True)
    if fail_fast:
        crops_of = crops_of.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error")).isNotNull()).otherwise(True))
    return crops_of, shown


def _shown(images: DataFrame, objects: DataFrame, shapes: DataFrame, decided: DataFrame, text: DataFrame | None, options: Options, output: str | None, output_dir: str | None) -> DataFrame:
    """Pictures of what was decided on each object, named after its crop."""
    given = outputs.plan(F.col("path"), F.col("format"), F.lit(options.alpha), F.lit(options.allow_lossy), None if output is None else F.lit(output), None if output_dir is None else F.lit(output_dir), output_dir is not None)
    bases = images.where("error is null").select("path", given["base"].alias("base"))
    named = objects.where("error is null").select("path", "obj_idx", "obj").join(bases, "path").select("obj", outputs.object_path(F.col("base"), F.col("obj_idx")).alias("out_path"))
    fit = F.when(F.col("fit") == "max", F.col("safe")).otherwise(F.coalesce("body", "safe"))
    each = named.join(decided.select("obj", "fit", "angle_deg", F.col("theta").cast("double").alias("theta")), "obj").join(shapes.select("obj", "safe", "body"), "obj")
    each = each.select("obj", "out_path", fit.alias("fit"), F.when(F.col("fit") != "max", F.col("safe")).alias("safe"), F.col("angle_deg").cast("double").alias("angle_deg"), "theta")
    if text is None or not {"corners", "score"} <= set(text.columns):
        each = each.withColumn("lines", F.lit(None).cast("array<struct<pos:int,angle:double,length:double,score:double,corners:array<struct<x:double,y:double>>>>"))
    else:
        each = each.join(text.groupBy("obj").agg(F.array_sort(F.collect_list(F.struct("pos", "angle", "length", "score", "corners"))).alias("lines")), "obj", "left")
    return overlays.overlays(images, objects, each)


def summary(crops_of: DataFrame) -> DataFrame:
    """(path, objects, error): objects found in each image, whether or not their crops could be made, or why there are none."""
    return crops_of.groupBy("path").agg(F.count("obj_idx").alias("objects"), F.min("error").alias("error"))


def theta_of(degrees: float) -> float:
    """The single-precision turn that brings a direction to horizontal."""
    return float(np.float32(-math.radians(float(np.float32(degrees)))))
