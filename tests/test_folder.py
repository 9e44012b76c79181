"""Runs over folders and files, models within them, the data source, and repeated or broken inputs."""

import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from platen.operators import models
from platen.options import Options
from platen.plans import digitise, folder
from platen.sources import codecs, images, storage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no tests to import
RNG = np.random.default_rng(8)


def sheet(h=60, w=80, boxes=((8, 10, 30, 40), (40, 50, 55, 75))):
    """A scan with dark rectangles on white."""
    out = np.full((h, w, 3), 255, np.uint8)
    for y0, x0, y1, x1 in boxes:
        out[y0:y1, x0:x1] = RNG.integers(0, 120, (y1 - y0, x1 - x0, 3))
    return out


def dark(rgba, prompts):
    """A stand-in for an extractor: what is dark is an object."""
    return [np.where(rgba[:, :, :3].mean(axis=2) < 200, 255, 0).astype(np.uint8)]


EXTRACTOR = models.Model("dark", lambda: dark)


def put(folder_, name, image, form="png"):
    os.makedirs(folder_, exist_ok=True)
    with open(f"{folder_}/{name}", "wb") as f:
        f.write(codecs.encode(image, form) if isinstance(image, np.ndarray) else image)


def test_folder_runs_read_only_what_is_due(spark, tmp_path):
    scans, out = str(tmp_path / "scans[1]"), str(tmp_path / "out")
    put(scans, "a.png", sheet())
    put(scans, "b.jpg", sheet(), "jpeg")
    put(scans, "broken.tif", b"II*\0nothing")
    put(scans, "notes.txt", b"none")
    put(scans, "done.png", b"this would be an error if it were read")
    put(f"{scans}/below", "c.png", sheet())
    put(out, "done_0.png", b"x")
    result, figures = folder.run(spark, [scans], Options(), models=models.Models(extractor=EXTRACTOR), output_dir=out)
    rows = result.collect()
    assert (figures.found, figures.done, figures.read, figures.failed, figures.objects, figures.crops) == (4, 1, 3, 1, 4, 4)
    assert sorted(os.listdir(out)) == ["a_0.png", "a_1.png", "b_0.png", "b_1.png", "done_0.png"]
    assert {r.path.rsplit("/", 1)[1] for r in rows if r.error} == {"broken.tif"}
    assert {r.path.rsplit("/", 1)[1]: r.objects for r in digitise.summary(result).collect()} == {"a.png": 2, "b.jpg": 2, "broken.tif": 0}
    crop = codecs.decode(open(f"{out}/a_0.png", "rb").read(), "png")
    assert abs(crop.shape[0] - 22) <= 2 and abs(crop.shape[1] - 30) <= 2
    again, figures = folder.run(spark, [scans], Options(), models=models.Models(extractor=EXTRACTOR), output_dir=out)
    assert (figures.done, figures.read, figures.failed) == (3, 1, 1) and again.count() == 1
    _, figures = folder.run(spark, [scans], Options(overwrite=True), models=models.Models(extractor=EXTRACTOR), output_dir=out)
    assert (figures.done, figures.read, figures.failed, figures.crops) == (0, 4, 2, 4)


def test_single_files_and_arguments(spark, tmp_path):
    scans = str(tmp_path / "s")
    put(scans, "a.png", sheet())
    put(scans, "bad.png", b"no image")
    own = models.Models(extractor=EXTRACTOR)
    result, _ = folder.run(spark, [], single=f"{scans}/a.png", models=own, output=f"{scans}/x.tiff")
    assert sorted(r.out_path.rsplit("/", 1)[1] for r in result.collect()) == ["x_0.tiff", "x_1.tiff"] and os.path.exists(f"{scans}/x_1.tiff")
    with pytest.raises(Exception, match="bad.png"):
        folder.run(spark, [f"{scans}/bad.png"], models=own)
    result, figures = folder.run(spark, [f"{scans}/bad.png", f"{scans}/a.png"], models=own, output_dir=str(tmp_path / "o"))
    assert figures.failed == 1 and figures.crops == 2
    for wrong in ({"paths": [scans], "single": scans}, {"paths": []}, {"paths": [scans], "output": "x.png"}, {"paths": [f"{scans}/a.png"], "output": "x.png", "output_dir": "o"}):
        with pytest.raises(ValueError):
            folder.run(spark, wrong.pop("paths"), models=own, **wrong)
    with pytest.raises(FileNotFoundError):
        folder.run(spark, [str(tmp_path / "none")], models=own)


def test_debug_pictures(spark, tmp_path):
    scans, out = str(tmp_path / "s"), str(tmp_path / "o")
    put(scans, "a.png", sheet(boxes=((8, 10, 30, 40),)))
    folder.run(spark, [scans], Options(debug=True), models=models.Models(extractor=EXTRACTOR), output_dir=out)
    assert sorted(os.listdir(out)) == ["a_0.debug.png", "a_0.deskewed.png", "a_0.png"]
    picture = codecs.decode(open(f"{out}/a_0.debug.png", "rb").read(), "png")
    assert picture.shape == (22, 30, 3) and picture[0, 15].tolist() == [0, 90, 255] and picture[11, 15].tolist() == [230, 0, 230]


def pixels_of(spark, tmp_path, pictures):
    for name, picture in pictures.items():
        put(str(tmp_path / "in"), name, picture)
    return images.decode_images(images.read_images(spark, str(tmp_path / "in")))


def test_repeated_paths_and_masks_without_data(spark, tmp_path):
    pixels = pixels_of(spark, tmp_path, {"a.png": sheet(), "b.png": sheet()})
    masks = models.extract_masks(pixels, EXTRACTOR)
    masks = masks.withColumn("data", F.when(~F.col("path").endswith("b.png"), F.col("data")))
    rows = digitise.digitise(pixels.unionByName(pixels), masks, Options(), output_dir="o").collect()
    own = [r for r in rows if r.path.endswith("a.png")]
    assert sorted((r.obj_idx is None, r.error) for r in own) == [(False, None), (False, None), (True, "the path comes more than once")]
    assert {r.error for r in rows if r.path.endswith("b.png")} == {"a mask has no pixels", "the path comes more than once"}


def test_models_go_through_the_whole_flow(spark, tmp_path):
    """Text tilts the crop, lines vote that it is upside down; objects that aren't asked for text are set upright as documents."""
    tilted = np.full((240, 240, 3), 255, np.uint8)
    y, x = np.mgrid[:240, :240]
    tilted[(abs(x - 120 + (y - 120) * 0.2) < 60) & (abs(y - 120 - (x - 120) * 0.2) < 60) | ((x - 120) ** 2 + (y - 60) ** 2 < 900)] = 40
    pixels = pixels_of(spark, tmp_path, {"odd.png": tilted, "plain.png": sheet(120, 160, ((20, 30, 90, 130),))})
    asked = str(tmp_path / "asked")

    def detector():
        open(f"{asked}-{os.getpid()}-{os.urandom(4).hex()}", "w").close()  # loaded once in a worker

        def ask(batch):
            n, _, h, w = batch.shape
            chance = np.zeros((n, h, w), np.float32)
            v, u = np.mgrid[:h, :w]
            chance[:, (abs((v - h / 2) - (u - w / 2) * 0.2) < 6) & (abs(u - w / 2) < w / 3)] = 0.9
            return chance

        return ask

    def broken():
        raise OSError("no such file")

    full = models.Models(extractor=EXTRACTOR, detector=models.Model(f"text-{tmp_path}", detector), lines=models.Model(f"lines-{tmp_path}", lambda: lambda t: (0.0, 1.0)), document=models.Model(f"doc-{tmp_path}", lambda: lambda t: (0.0, 0.0, 0.0, 1.0)))
    rows = {r.path.rsplit("/", 1)[1]: r for r in digitise.digitise(pixels, None, Options(rectangularity=0.9), models=full).collect()}
    assert rows["odd.png"].source == "text" and abs(rows["odd.png"].angle_deg - np.degrees(np.arctan(0.2))) < 3 and rows["odd.png"].turns == 2
    assert rows["plain.png"].source == "mask" and rows["plain.png"].turns == 1
    missing = models.Models(extractor=EXTRACTOR, detector=models.Model(f"no-{tmp_path}", broken), lines=models.Model(f"no2-{tmp_path}", broken), document=models.Model(f"no3-{tmp_path}", broken))
    rows = {r.path.rsplit("/", 1)[1]: r for r in digitise.digitise(pixels, None, Options(rectangularity=0.9), models=missing).collect()}
    assert rows["odd.png"].source == "mask" and rows["odd.png"].turns == rows["plain.png"].turns == 0
    with pytest.raises(Exception, match="not available"):
        digitise.digitise(pixels, None, Options(text=True), models=missing).collect()
    with pytest.raises(ValueError):
        digitise.digitise(pixels, None)


def test_a_model_is_loaded_once_and_its_failure_remembered():
    calls = []

    def load():
        calls.append(1)
        raise RuntimeError("gone")

    own = models.Model("remembered", load)
    assert own.ready() is None and own.ready() is None and len(calls) == 1
    with pytest.raises(RuntimeError, match="remembered"):
        own.ready(required=True)


def test_files_are_read_by_a_budget(spark, tmp_path):
    storage.register(spark)
    for i in range(10):
        put(str(tmp_path), f"{i}.png", bytes(100 * (i + 1)))
    put(str(tmp_path), "other.txt", b"x")
    read = spark.read.format("scans").option("bytes", 1000).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == len(storage.parts_of([("", 100 * (i + 1)) for i in range(10)], 1000)) > 4
    assert sorted((r.path.rsplit("/", 1)[1], r.length, len(r.content)) for r in read.collect()) == [(f"{i}.png", 100 * (i + 1), 100 * (i + 1)) for i in range(10)]
    assert spark.read.format("scans").load(f"file://{tmp_path}/other.txt").count() == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    storage.register(spark)
    out = str(tmp_path / "files")
    rows = spark.range(40).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("string").cast("binary").alias("content")).repartition(4)
    rows.write.format("scans").mode("append").save(out)
    assert sorted(os.listdir(out)) == ["d"] and {open(f"{out}/d/{n}").read() for n in os.listdir(f"{out}/d")} == {str(i) for i in range(40)}
    fails = rows.where(F.when(F.col("path") == "d/7", F.raise_error(F.lit("killed")).isNull()).otherwise(True))
    with pytest.raises(Exception, match="killed"):
        fails.write.format("scans").mode("append").save(str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or os.listdir(tmp_path / "none") == []
    with pytest.raises(Exception, match="below the folder"):
        rows.select(F.lit("../x").alias("path"), "content").write.format("scans").mode("append").save(out)
