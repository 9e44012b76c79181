"""Images in, crops out: files of several formats, deskewing, errors, plans and options."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen import options as opts
from platen.operators import masks, objects, raster, textboxes, votes
from platen.operators.rectangles import least_rectangle
from platen.options import Options
from platen.plans import digitise
from platen.sources import codecs, images, outputs


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_codecs_round_trip(kind, channels):
    image = np.random.default_rng(channels).integers(0, np.iinfo(kind).max + 1, (37, 21, channels)).astype(kind)
    for form in ("png", "tiff"):
        back = codecs.decode(codecs.encode(image, form), form)
        assert back.dtype == image.dtype and np.array_equal(back, image)
    assert codecs.tiff_fields(codecs.encode(image, "tiff"))[1][259] == (8,)
    if channels in (1, 3):
        assert np.array_equal(codecs.decode(codecs.encode(image, "pnm"), "pnm"), image)


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    rows, above, data = image.reshape(5, 18).astype(int), np.zeros(18, int), b""
    for y, row in enumerate(rows):
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        paeth = [a if abs(e - a) <= abs(e - b) and abs(e - a) <= abs(e - c) else b if abs(e - b) <= abs(e - c) else c for a, b, c, e in zip(left, above, corner, p)]
        guess = [np.zeros(18, int), left, above, (left + above) // 2, np.array(paeth)][y]
        data += bytes([y]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = codecs.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")
    assert np.array_equal(codecs.decode_png(png), image)


def scan(theta=math.radians(12), depth=np.uint8):
    """A grey scan with a turned dark card and its alpha mask."""
    y, x = np.mgrid[0:160, 0:220].astype(float)
    c, s = math.cos(theta), math.sin(theta)
    u, v = (x - 110) * c + (y - 80) * s, (y - 80) * c - (x - 110) * s
    inside = (abs(u) <= 70) & (abs(v) <= 35)
    top = np.iinfo(depth).max
    image = np.full((160, 220, 3), top // 2, depth)
    image[inside] = (top // 4, top // 8, 0)
    image[(abs(u) <= 60) & (abs(v) <= 3)] = top
    return image, np.where(inside, 255, 0).astype(np.uint8)


def written(folder, spark, named):
    folder.mkdir()
    rows = []
    for name, (image, mask) in named.items():
        form = {"png": "png", "tif": "tiff", "ppm": "pnm"}[name.rsplit(".", 1)[1].lower()]
        (folder / name).write_bytes(codecs.encode(image, form))
        if mask is not None:
            rows.append((f"file:{folder / name}", 0, mask.shape[1], mask.shape[0], bytearray(mask.tobytes())))
    return spark.createDataFrame(rows, "path string, mask_no int, width int, height int, data binary")


def test_from_files_to_files(spark, tmp_path):
    image, mask = scan()
    deep, _ = scan(depth=np.uint16)
    found = written(tmp_path / "in", spark, {"a.png": (image, mask), "b.TIF": (deep, mask), "c.ppm": (image, None), "empty.png": (image, mask * 0)})
    (tmp_path / "in/broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    (tmp_path / "in/notes.txt").write_text("no image")
    files = images.read_images(spark, str(tmp_path / "in"))
    assert {r.path.rsplit("/", 1)[1]: r.format for r in files.collect()} == {"a.png": "png", "b.TIF": "tiff", "c.ppm": "pnm", "empty.png": "png", "broken.png": "png"}
    pixels = images.decode_images(files)
    done = digitise.digitise(pixels, found, output_dir=str(tmp_path / "out")).cache()
    rows = {r.path.rsplit("/", 1)[1]: r for r in done.collect()}
    assert {n: r.error for n, r in rows.items() if r.error} == {"c.ppm": "model returned no mask", "empty.png": "no foreground objects found", "broken.png": "Unsupported: png: no header or no pixels"}
    images.write_files(done)
    for name, out in (("a.png", "a_0.png"), ("b.TIF", "b_0.TIF")):
        r = rows[name]
        assert r.out_path == str(tmp_path / "out" / out) and abs(r.angle_deg - 12) < 1 and r.source == "mask" and r.angle_note.endswith("(mask geometry)")
        crop = codecs.decode((tmp_path / "out" / out).read_bytes(), r.format)
        assert crop.shape[:2] == (r.out_h, r.out_w) and abs(r.out_w - 140) <= 3 and abs(r.out_h - 70) <= 3 and crop.dtype == (image if name == "a.png" else deep).dtype
        line = np.argwhere(crop[5:-5, 20:-20, 2] > np.iinfo(crop.dtype).max * 0.9)
        assert abs(np.degrees(np.arctan(np.polyfit(line[:, 1], line[:, 0], 1)[0]))) < 2  # the card's line is level
    assert {(r.path.rsplit("/", 1)[1], r.objects) for r in digitise.summary(done).collect()} == {("a.png", 1), ("b.TIF", 1), ("c.ppm", 0), ("empty.png", 0), ("broken.png", 0)}
    with pytest.raises(Exception, match="no mask|no foreground|no pixels"):
        digitise.digitise(pixels, found, fail_fast=True, output_dir="x").collect()
    single = images.read_images(spark, str(tmp_path / "in/a.png"))
    assert single.count() == 1


def test_alpha_output_and_turns(spark, tmp_path):
    image, mask = scan(0.0)
    found = written(tmp_path / "in", spark, {"a.png": (image, mask)})
    pixels = images.decode_images(images.read_images(spark, str(tmp_path / "in")))
    obj = digitise.objects_of_images(pixels, found)
    turns = obj.select("obj", F.lit(1).alias("doc_turns"))
    (row,) = digitise.digitise(pixels, found, Options(alpha=True), doc_turns=turns).collect()
    out = codecs.decode(bytes(row.content), "png")
    assert row.turns == 1 and (row.out_h, row.out_w) == (141, 71) and (out[:, :, 3] == 255).all() and "+ 90° turn" in row.angle_note
    assert np.array_equal(np.rot90(out[:, :, :3]), image[45:116, 40:181])


def test_text_drives_the_angle_and_bounds(spark, tmp_path):
    image, mask = scan(0.0)
    found = written(tmp_path / "in", spark, {"a.png": (image, mask)})
    pixels = images.decode_images(images.read_images(spark, str(tmp_path / "in")))
    chance = np.zeros((96, 160), np.float32)
    y, x = np.mgrid[0:96, 0:160]
    chance[(abs(y - 48 - 0.2 * (x - 80)) < 5) & (abs(x - 80) < 60)] = 0.9
    (o,) = digitise.objects_of_images(pixels, found).collect()
    chances = spark.createDataFrame([(o.path, 0, 96, 160, bytearray(chance.tobytes()))], "path string, obj_idx int, height int, width int, data binary")
    flips = spark.createDataFrame([(o.obj, True)], "obj long, flip boolean")
    (row,) = digitise.digitise(pixels, found, Options(text=True), chances=chances, flips=flips).collect()
    slope = math.degrees(math.atan(0.2 * (71 / 96) / (141 / 160)))
    assert row.source == "text" and abs(row.angle_deg - slope) < 1.5 and row.turns == 2 and row.inliers == 1 and "text, 1/1 boxes, agree 100%" in row.angle_note
    (plain,) = digitise.digitise(pixels, found, Options(text=True)).collect()
    assert plain.source == "mask" and plain.turns == 0


def test_extractors():
    a, b, c = (np.zeros((6, 8), np.uint8) for _ in range(3))
    a[1:3, 1:4], b[1:3, 3:6], c[4:6, 6:8] = 255, 255, 255
    back = digitise.foreground_objects([a, c], 8, 6, Options(extractor="background"))
    assert [o.area for o in back] == [48 - 6 - 4]
    merged = digitise.foreground_objects([a, b, c], 8, 6, Options(extractor="instances", overlap=0.1))
    assert [o.area for o in merged] == [10, 4]
    apart = digitise.foreground_objects([a, b, c], 8, 6, Options(extractor="instances", overlap=0.5))
    assert [o.area for o in apart] == [6, 4, 4]
    assert [o.area for o in masks.claimed_objects([a > 0, b > 0, (a | b) > 0], 5)] == [6]
    assert digitise.foreground_objects([], 8, 6, Options(extractor="background"))[0].area == 48
    with pytest.raises(ValueError, match="does not match"):
        digitise.foreground_objects([a], 9, 6, Options())
    assert masks.foreground_of(np.array([[0, 128]], np.uint8), 4, 2).tolist() == [[False, False, True, True]] * 2


def test_claims_with_a_least_area(spark):
    rows = [(0, 0, 0, x) for x in range(4)] + [(0, 1, 0, x) for x in (3, 4)] + [(0, 2, 0, x) for x in range(3, 7)]
    df = spark.createDataFrame(rows, "img long, inst long, y int, x int")
    one, two = ({r.inst: r.area for r in objects.instance_objects(df, n).collect()} for n in (1, 2))
    assert one == {0: 4, 1: 1, 2: 2} and two == {0: 4, 2: 3}


def test_labels_of_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, None, 3), (None, 1, 1), (1, 1, 1)], "img long, y int, x int")
    (row,) = objects.objects(objects.label_components(df, 8)).collect()
    assert (row.area, row.label) == (2, 0)


def test_raster_pieces():
    rgba = np.zeros((5, 6, 4), np.uint8)
    rgba[1, 2], rgba[3, 4] = (10, 20, 30, 255), (40, 50, 60, 128)
    assert raster.trimmed(rgba).shape == (3, 3, 4) and raster.trimmed(rgba * 0) is None
    wide = np.zeros((10, 20, 4), np.uint8)
    wide[0, 0] = 9
    assert raster.padded(wide, 5.0).shape == (12, 22, 4) and (raster.padded(wide, 5.0)[1, 1] == 9).all() and raster.padded(wide, 0) is wide
    assert np.array_equal(raster.quarter_turns(wide, 1), np.rot90(wide, -1)) and raster.quarter_turns(wide, 4).shape == wide.shape
    deep = np.array([[[0x1234, 0x8000, 0xFFFF]]], np.uint16)
    assert np.array_equal(raster.rgb_output(deep, (0, 0, 1, 1), 0.0, 0), deep) and raster.cutout(deep, np.ones((1, 1), bool), 0, 0)[0, 0].tolist() == [0x1234, 0x8000, 0xFFFF, 65535]
    with pytest.raises(ValueError, match="precision"):
        raster.depth_of(deep.astype(np.float32))
    flat = np.full((300, 500, 4), 255, np.uint8)
    assert raster.detector_input(np.pad(flat, ((0, 0), (0, 1500), (0, 0)))).shape == (3, 160, 960) and raster.document_input(flat, 0.3).shape == (3, 224, 224) and raster.line_input(flat[:, :, :3]).shape == (3, 80, 160)
    ramp = np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], 4, axis=0)
    assert abs(raster.resized(ramp, 50, 2)[0, :, 0].astype(int) - np.arange(1, 200, 4)).max() <= 1
    assert raster.line_crop(flat[:, :, :3], np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), 0.0) is None


def test_text_boxes_and_votes():
    chance = np.zeros((64, 96), np.float32)
    chance[20:30, 10:70], chance[50:52, 5:60], chance[40:46, 80:90] = 0.9, 0.9, 0.3
    (box,) = textboxes.text_boxes(chance, 192, 64)  # the others are too thin and too faint
    assert abs(box.angle) < 1e-9 and box.length > 118 and abs(box.score - 0.9) < 1e-6
    rgba = np.full((64, 192, 4), 255, np.uint8)
    answers = iter([(0, 1), (0, 1), (1, 0)])
    assert textboxes.vote_flip(rgba, [box] * 3, 0.0, lambda _: next(answers)) is True
    assert textboxes.vote_flip(rgba, [box], math.radians(80), lambda _: (0, 1)) is None and textboxes.vote_flip(rgba, [], 0.0, lambda _: (0, 1)) is None
    assert textboxes.document_turns(rgba, 0.0, lambda _: (0, 1, 1, 0))[0] == 2
    for degrees in (0, 12.5, 33, -20, 80):
        a = math.radians(degrees)
        quad = np.array([[0, 0], [40, 0], [40, 10], [0, 10.0]]) @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
        grown = least_rectangle(textboxes.unclipped(quad[::-1]))
        assert sorted(grown[4:]) == pytest.approx([21.2, 51.2])
    assert textboxes.line_intersection(*np.array([[0, 0], [1, 0], [0, 1], [1, 1.0]])) is None
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8], ring[3:6, 3:6] = True, False
    assert sorted(len(b) for b in textboxes.borders(ring)) == [12, 24]


@pytest.mark.parametrize(
    ("path", "given", "alpha", "lossy", "output", "folder", "index", "expected"),
    [
        ("fixtures/photo.jpeg", "jpeg", False, False, None, None, 3, ("fixtures/photo_3.png", "png")),
        ("fixtures/photo.jpeg", "jpeg", False, True, None, None, 3, ("fixtures/photo_3.jpeg", "jpeg")),
        ("scan.tiff", "tiff", False, False, None, None, 0, ("scan_0.tiff", "tiff")),
        ("photo.jpg", "jpeg", True, False, None, None, 0, ("photo_0.png", "png")),
        ("photo.tiff", "tiff", True, False, None, None, 0, ("photo_0.tiff", "tiff")),
        ("inputs/photo.jpg", "jpeg", False, True, None, "out", 2, ("out/photo_2.jpg", "jpeg")),
        ("inputs/photo.jpg", "jpeg", False, False, None, "out/", 2, ("out/photo_2.png", "png")),
        ("a/photo", "jpeg", False, True, None, None, 1, ("a/photo_1.jpg", "jpeg")),
        ("a/.photo", "png", False, True, None, None, 1, ("a/.photo_1.png", "png")),
        ("a.png", "png", False, False, "b/c.TIF", None, 1, ("b/c_1.TIF", "tiff")),
        ("a.dds", "dds", False, False, None, None, 1, (None, "dds")),
    ],
)
def test_output_plans(spark, path, given, alpha, lossy, output, folder, index, expected):
    lit = lambda v: None if v is None else F.lit(v)
    p = outputs.plan(F.lit(path), F.lit(given), F.lit(alpha), F.lit(lossy), lit(output), lit(folder), folder is not None)
    row = spark.range(1).select(outputs.object_path(p["base"], F.lit(index)).alias("path"), p["format"].alias("format"), p["error"].alias("error")).first()
    assert (row.path, row.format) == expected and (row.error is None) == (expected[0] is not None)


def test_output_plan_errors(spark):
    none, some = F.lit(None).cast("string"), F.lit("x")
    plans = [outputs.plan(F.lit("a.png"), F.lit("png"), F.lit(False), F.lit(False), o, d, i) for o, d, i in ((none, none, True), (some, some, True), (none, some, False))]
    assert all(v is not None for v in spark.range(1).select(*(p["error"].alias(f"e{i}") for i, p in enumerate(plans))).first())


def test_options():
    assert Options().cutoff == 242 and Options(threshold=0).cutoff == 0 and Options(force_rectangular=True).rectangle_threshold == 0 and Options().rectangle_threshold == 0.30
    assert Options().object_prompts()[0] == "photo" and Options(doc_model="m.onnx").doc_model_path("/opt/x") == "/opt/x/m.onnx" and Options(doc_model="/m.onnx").doc_model_path("/y") == "/m.onnx"
    for wrong in ({"threshold": 101}, {"overlap": -0.1}, {"rectangularity": 2}, {"padding": 101}, {"min_side_percent": -1}, {"text": True, "force_rectangular": True}, {"extractor": "x"}):
        with pytest.raises(ValueError, match="."):
            Options(**wrong)
    assert opts.inputs_of(["a"], None) == ["a"] and opts.inputs_of([], "b") == ["b"]
    for paths, single in (([], None), (["a"], "b")):
        with pytest.raises(ValueError, match="input"):
            opts.inputs_of(paths, single)
    opts.check_output("o", None, ["a"], True)
    for output_dir, inputs, is_file in (("d", ["a"], True), (None, ["a", "b"], True), (None, ["a"], False)):
        with pytest.raises(ValueError, match="output"):
            opts.check_output("o", output_dir, inputs, is_file)


def test_flip_votes_need_lines_near_the_horizontal(spark):
    rows = [(1, 0.0, True), (1, 80.0, False), (1, 85.0, False), (2, 90.0, True), (3, 0.0, True), (3, 1.0, False), (4, 0.0, None)]
    df = spark.createDataFrame(rows, "obj long, angle double, flipped boolean")
    assert {r.obj: r.flip for r in votes.flip_votes(df).collect()} == {1: True, 2: None, 3: False, 4: None}
    assert {r.obj: r.flip for r in votes.flip_votes(df, F.lit(math.radians(90))).collect()} == {1: False, 2: True, 3: None, 4: None}
