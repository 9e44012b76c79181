"""Models as callables: loaded in a worker when first asked for, kept for its lifetime, and asked for masks, text and orientation of images' objects."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.operators import masks, raster, textboxes
from platen.sources.images import pixels_of

#: By name what a worker has loaded, or None for what couldn't be: tried once, warned of once.
_LOADED: dict[str, Callable | None] = {}
#: Where a network may run, in order. Fixed values.
PROVIDERS = ("CUDAExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider")


@dataclass(frozen=True)
class Model:
    """A name, and how a worker gets the callable that goes by it."""

    name: str
    load: Callable[[], Callable]

    def ready(self, required: bool = False) -> Callable | None:
        """The callable. Without it, an error if it is required, else None from then on."""
        if self.name not in _LOADED:
            try:
                _LOADED[self.name] = self.load()
            except Exception as e:  # whatever a loader raises, the model isn't there
                logging.getLogger(__name__).warning("model %s is not available: %s", self.name, e)
                _LOADED[self.name] = None
        if required and _LOADED[self.name] is None:
            raise RuntimeError(f"model {self.name} is not available")
        return _LOADED[self.name]


@dataclass(frozen=True)
class Models:
    """What a run may ask; each may be missing.

    extractor: (h x w x 4 of 8 bits, prompts) to a list of masks (h x w, grey); detector: (n x 3 x h x w) to chances of text (n x h x w);
    lines: a line's tensor to scores of upright and upside down; document: an object's tensor to scores of four turns.
    """

    extractor: Model | None = None
    detector: Model | None = None
    lines: Model | None = None
    document: Model | None = None


def onnx_model(name: str, path: str) -> Model:
    """A network in a file that workers can open, on the first device that takes it; it has one input and its first output counts."""

    def load() -> Callable:
        import onnxruntime

        failed: Exception | None = None
        for provider in PROVIDERS:
            try:
                session = onnxruntime.InferenceSession(path, providers=[provider])
                given = session.get_inputs()[0].name
                return lambda batch: session.run(None, {given: np.asarray(batch, np.float32)})[0]
            except Exception as e:
                failed = e
        raise RuntimeError(f"no device takes {path}: {failed}")

    return Model(name, load)


def eight_bits(image: np.ndarray) -> np.ndarray:
    return image if image.dtype == np.uint8 else (image >> 8).astype(np.uint8)


def extract_masks(images: DataFrame, model: Model, prompts: Sequence[str] = ()) -> DataFrame:
    """Images of pixels to mask rows (path, mask_no, width, height, data) by an extractor; an image that it fails on has one mask without data. Failed images have none."""
    schema = pa.schema([("path", pa.string()), ("mask_no", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ask = model.ready(required=True)
            for i in range(batch.num_rows):
                path, width, height, channels, depth, data = (batch.column(k)[i].as_py() for k in range(6))
                try:
                    found = ask(raster.to_rgba(eight_bits(pixels_of(data, width, height, channels, depth))), tuple(prompts))
                    rows = [{"path": path, "mask_no": n, "width": m.shape[1], "height": m.shape[0], "data": np.asarray(m, np.uint8).tobytes()} for n, m in enumerate(found)]
                except Exception as e:  # a fault of the model is one of its image
                    logging.getLogger(__name__).warning("model %s failed on %s: %s", model.name, path, e)
                    rows = [{"path": path, "mask_no": 0}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return images.where("error is null").select("path", "width", "height", "channels", "depth", "data").mapInArrow(run, "path string, mask_no int, width int, height int, data binary")


def _with_pixels(images: DataFrame, objects: DataFrame, *more: str) -> DataFrame:
    """An image's pixels once, with its objects."""
    own = objects.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("obj_idx", "obj", "min_x", "min_y", "max_x", "max_y", "runs", *more))).alias("things"))
    return images.where("error is null").select("path", "width", "height", "channels", "depth", "data").join(own, "path")


def _cutout(image: np.ndarray, thing: dict) -> np.ndarray:
    runs = masks.Runs(*(np.array([r[c] for r in thing["runs"]]) for c in ("y", "left", "right")))
    mask = masks.local_mask(masks.Found(0, 0, thing["min_x"], thing["min_y"], thing["max_x"], thing["max_y"], runs))
    return raster.cutout(image, mask, thing["min_x"], thing["min_y"])


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[dict]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(n)[i].as_py() for n, c in enumerate(batch.schema.names)}
            yield eight_bits(pixels_of(r["data"], r["width"], r["height"], r["channels"], r["depth"])), r["things"]


def detect_text(images: DataFrame, objects: DataFrame, model: Model, required: bool = False) -> DataFrame:
    """Objects to the lines of text in their cutouts, by a detector: (obj, pos, angle, length, score, corners). Tensors of one size are asked together; without the model there are none."""
    kind = pa.schema([("obj", pa.int64()), ("pos", pa.int32()), ("angle", pa.float64()), ("length", pa.float64()), ("score", pa.float64()), ("corners", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, things in _images(batches):
            if (ask := model.ready(required)) is None:
                continue
            sizes: dict[tuple[int, ...], list[tuple[dict, np.ndarray]]] = {}
            for thing in things:
                tensor = raster.detector_input(_cutout(image, thing))
                sizes.setdefault(tensor.shape, []).append((thing, tensor))
            rows = []
            for own in sizes.values():
                for at in range(0, len(own), 8):
                    part = own[at : at + 8]
                    for (thing, _), chance in zip(part, np.asarray(ask(np.stack([t for _, t in part]))), strict=True):
                        width, height = thing["max_x"] - thing["min_x"] + 1, thing["max_y"] - thing["min_y"] + 1
                        for pos, b in enumerate(textboxes.text_boxes(chance.reshape(chance.shape[-2:]), width, height)):
                            rows.append({"obj": thing["obj"], "pos": pos, "angle": b.angle, "length": float(b.length), "score": b.score, "corners": [{"x": float(x), "y": float(y)} for x, y in b.corners]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)

    return _with_pixels(images, objects).mapInArrow(run, "obj long, pos int, angle double, length double, score double, corners array<struct<x:double,y:double>>")


def ask_orientation(images: DataFrame, objects: DataFrame, decided: DataFrame, lines: DataFrame | None, models: Models) -> DataFrame:
    """Objects with the decision on each (obj, use_text, theta) to (obj, flip, doc_turns).

    An object whose angle is sought in its text is asked line by line whether it is upside down, once it lies as its angle says; any other as a document, which of
    four turns sets it upright. What isn't asked, or has no model, is null.
    """
    found = objects.join(decided.select("obj", "use_text", "theta"), "obj")
    if lines is None:
        found = found.withColumn("boxes", F.lit(None).cast("array<struct<pos:int,angle:double,length:double,score:double,corners:array<struct<x:double,y:double>>>>"))
    else:
        found = found.join(lines.groupBy("obj").agg(F.array_sort(F.collect_list(F.struct("pos", "angle", "length", "score", "corners"))).alias("boxes")), "obj", "left")
    kind = pa.schema([("obj", pa.int64()), ("flip", pa.bool_()), ("doc_turns", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, things in _images(batches):
            rows = []
            for thing in things:
                row: dict[str, object] = {"obj": thing["obj"]}
                model = models.lines if thing["use_text"] else models.document
                if model is not None and (thing["boxes"] or not thing["use_text"]) and (ask := model.ready()) is not None:
                    rgba = _cutout(image, thing)
                    if thing["use_text"]:
                        boxes = [textboxes.TextBox(np.array([[p["x"], p["y"]] for p in b["corners"]]), b["angle"], b["length"], b["score"]) for b in thing["boxes"]]
                        row["flip"] = textboxes.vote_flip(rgba, boxes, thing["theta"], ask)
                    else:
                        row["doc_turns"] = textboxes.document_turns(rgba, thing["theta"], ask)[0]
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)

    return _with_pixels(images, found, "use_text", "theta", "boxes").mapInArrow(run, "obj long, flip boolean, doc_turns int")
