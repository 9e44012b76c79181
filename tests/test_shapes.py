"""Borders, hulls, calipers, shapes in one row, overlaps by prefixes, overlays, and radians."""

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platen.functions.angles import normalize_orientation
from platen.operators import masks, objects, overlays, raster, rectangles, textboxes

RNG = np.random.default_rng(12)


def borders_by_flooding(bitmap):
    """Each region alone on its own ground: what lies beside each part of the ground."""
    out = []
    runs = masks.runs_of(bitmap)
    for o in masks.objects_of(runs, masks.components(runs)):
        own = np.pad(masks.local_mask(o), 1)
        left = {(int(y), int(x)) for y, x in zip(*np.nonzero(~own), strict=True)}
        while left:
            start = min(left)
            part, todo = {start}, [start]
            left.discard(start)
            while todo:
                y, x = todo.pop()
                for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if p in left:
                        left.discard(p)
                        part.add(p)
                        todo.append(p)
            near = sorted((y, x) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(own)), strict=True) if part & {(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)})
            out.append([(x + o.min_x - 1, y + o.min_y - 1) for y, x in near])
    return out


def test_borders_of_all_regions_and_holes():
    for _ in range(80):
        bitmap = RNG.random((int(RNG.integers(1, 18)), int(RNG.integers(1, 18)))) < RNG.choice([0.3, 0.5, 0.7, 0.9])
        assert [[tuple(map(int, p)) for p in b] for b in textboxes.borders(bitmap)] == borders_by_flooding(bitmap)
    assert textboxes.border_tree(np.zeros((4, 4), bool)) == []


def test_borders_within_borders():
    nested = np.zeros((19, 19), bool)
    for k, v in ((1, True), (3, False), (5, True), (7, False)):
        nested[k : 19 - k, k : 19 - k] = v
    assert [(b.hole, b.parent) for b in textboxes.border_tree(nested)] == [(False, -1), (True, 0), (False, 1), (True, 2)]
    holes = np.ones((960, 960), bool)
    holes[6::12, 6::12] = False
    found = textboxes.border_tree(holes)
    assert len(found) == 6401 and {b.parent for b in found} == {-1, 0} and all(len(b.points) == 4 for b in found if b.hole)


def left_turns(hull):
    a, b = np.roll(hull, -1, axis=0) - hull, np.roll(hull, -2, axis=0) - np.roll(hull, -1, axis=0)
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def test_hulls():
    for _ in range(100):
        points = RNG.integers(-6, 7, (int(RNG.integers(1, 30)), 2)).astype(float)
        hull = rectangles.hull_of(np.concatenate([points, [[np.nan, 1.0]]]))
        own = {tuple(p) for p in points}
        assert {tuple(p) for p in hull} <= own and tuple(hull[0]) == min(own) and len({tuple(p) for p in hull}) == len(hull)
        if len(hull) > 2:
            assert (left_turns(hull) > 0).all()
            side = np.roll(hull, -1, axis=0) - hull
            assert min(min(s[0] * (p[1] - h[1]) - s[1] * (p[0] - h[0]) for h, s in zip(hull, side, strict=True)) for p in points) >= 0
        else:
            assert len(hull) == min(2, len(own)) and {tuple(p) for p in hull} == {min(own), max(own)}


def test_hulls_of_hulls(spark):
    rows = [(int(RNG.integers(0, 4)), float(x), float(y)) for x, y in RNG.normal(size=(2000, 2)).round(2)]
    rows += [(7, 1.0, 1.0)] * 3 + [(8, float(i), 2.0 * i) for i in range(5)] + [(8, None, 1.0), (8, float("nan"), 1.0), (None, 1.0, 2.0)]
    table = spark.createDataFrame(rows, "obj long, x double, y double").repartition(7)
    found: dict[int, list] = {}
    for r in rectangles.convex_hulls(table).orderBy("obj", "pos").collect():
        found.setdefault(r.obj, []).append((r.x, r.y))
    for obj in range(4):
        assert found[obj] == [tuple(p) for p in rectangles.hull_of(np.array([r[1:] for r in rows if r[0] == obj]))]
    assert found[7] == [(1.0, 1.0)] and found[8] == [(0.0, 0.0), (4.0, 8.0)] and set(found) == {0, 1, 2, 3, 7, 8}
    assert rectangles.convex_hulls(table.where("false")).collect() == []


def test_hulls_meet_columns_of_points_in_order(spark, monkeypatch):
    rows = [(obj, float(x), float(y)) for y in range(30) for x in range(3) for obj in range(200)]
    plan = rectangles.convex_hulls(spark.createDataFrame(rows, "obj long, x double, y double"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.rindex("MapInPandas") < plan.index("rangepartitioning") < plan.index("partial_min")  # points don't reach Python, only their columns
    made = []
    monkeypatch.setattr(rectangles, "hull_of", lambda points, own=rectangles.hull_of: made.append(len(points)) or own(points))
    columns = pd.DataFrame({"obj": np.repeat(np.arange(50), 40), "x": np.tile(np.arange(40.0), 50), "low": np.tile(np.arange(40.0) ** 2, 50), "high": 2000.0})
    done = pd.concat(list(rectangles._streamed_hulls(iter([columns[:60], columns[:0], columns[60:1990], columns[1990:]]))))
    assert len(made) == 52 and max(made) < 160  # one each, and one more where an object goes on in the next batch
    for obj in range(50):
        own = done[done["obj"] == obj]
        assert own["pos"].tolist() == list(range(42)) and own["x"].tolist() == [*range(40), 39, 0]
    assert not len(pd.concat(list(rectangles._streamed_hulls(iter([columns[:0]])))))


def test_calipers_reach_what_all_corners_reach():
    for n in (3, 4, 5, 40):
        for _ in range(30):
            hull = rectangles.hull_of(np.round(RNG.normal(size=(n, 2)) * 20, 1))
            if len(hull) < 3:
                continue
            edge = np.roll(hull, -1, axis=0) - hull
            u = edge / np.hypot(*edge.T)[:, None]
            along, across = hull @ u.T, hull @ np.stack([-u[:, 1], u[:, 0]])
            for got, wanted in zip(rectangles._extents(hull, u), (along.min(0), along.max(0), across.min(0), across.max(0)), strict=True):
                assert np.allclose(got, wanted, atol=1e-9)


def test_shapes_of_rows_of_points_and_of_one_row_agree(spark):
    clouds = {}
    for obj in range(25):
        y, x = np.mgrid[: int(RNG.integers(2, 14)), : int(RNG.integers(2, 30))]
        a = RNG.uniform(0, 3)
        points = np.unique(np.round(np.stack([x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)], -1).reshape(-1, 2)), axis=0)
        clouds[obj] = points[RNG.random(len(points)) < 0.9] if obj % 2 else points
    table = spark.createDataFrame([(o, float(x), float(y)) for o, p in clouds.items() for x, y in p], "obj long, x double, y double")
    whole = rectangles.least_rectangles(table)
    said = {r.obj: r.rectangularity for r in rectangles.rectangularity(table, whole).collect()}
    body = {r.obj: (r.u0, r.v0, r.w, r.h) for r in rectangles.body_rectangles(table, whole).collect()}
    assert len(said) > 20
    for obj in said:
        rect = rectangles.least_rectangle(clouds[obj])
        assert abs(rectangles.shape_of(clouds[obj], len(clouds[obj])).rectangularity - said[obj]) < 1e-6
        assert np.allclose(rectangles._body(rect, clouds[obj])[2:], body[obj], atol=1e-6)


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.3, 0.8])
def test_overlaps_over_a_threshold_are_all_found(spark, threshold, monkeypatch):
    monkeypatch.setattr(objects, "CELL", 8)  # pixels that many masks hold are dealt to cells
    own = {}
    for i in range(60):
        y, x, h, w = (int(v) for v in (RNG.integers(0, 12), RNG.integers(0, 12), RNG.integers(1, 9), RNG.integers(1, 9)))
        own["a" if i % 3 else "b", i] = {(y + j, x + k) for j in range(h) for k in range(w)} | ({(5, 5)} if i % 2 else set())
    table = spark.createDataFrame([(img, i, y, x) for (img, i), pixels in own.items() for y, x in pixels] * 2, "img string, inst long, y int, x int")
    wanted = {}
    for p, a in own.items():
        for q, b in own.items():
            if p[0] == q[0] and p[1] < q[1] and a & b and len(a & b) / len(a | b) > threshold:
                wanted[p[0], p[1], q[1]] = len(a & b) / len(a | b)
    found = {(r.img, r.a, r.b): r.iou for r in objects.instance_iou(table, threshold).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-12 for k in wanted)
    if threshold == 0.0:
        assert {(r.img, r.a, r.b) for r in objects.instance_iou(table).collect()} == wanted.keys()
    root = {k: k[1] for k in own}
    for _ in own:
        for img, a, b in wanted:
            root[img, a] = root[img, b] = min(root[img, a], root[img, b])
    assert {(r.img, r.inst): r.root for r in objects.merged_instances(table, threshold).collect()} == root


def test_lines_and_tints():
    picture = np.zeros((5, 7, 3), np.uint8)
    overlays.draw_line(picture, (0, 0), (6, 3), (1, 1, 1))
    assert [np.flatnonzero(row[:, 0]).tolist() for row in picture] == [[0], [1, 2], [3, 4], [5, 6], []]
    overlays.draw_line(picture, (-1000, 4), (1000, 4), (2, 2, 2))
    assert (picture[4] == 2).all()
    overlays.draw_line(picture, (20, 20), (30, 25), (9, 9, 9))
    assert not (picture == 9).any()
    rgba = np.full((4, 4, 4), 100, np.uint8)
    rgba[:, :, 3] = 255
    mask = np.eye(4, dtype=bool)
    out = overlays.overlay(rgba, mask)
    assert out[1, 1].tolist() == [60, 140, 60] and out[0, 1].tolist() == [100] * 3
    out = overlays.overlay(rgba, mask, [overlays.Line(np.array([[0, 0], [3, 0], [3, 3], [0, 3.0]]), 0.0, 2.0, 0.5)])
    assert out[0, 1].tolist() == [110, 170, 0] and out[2, 2].tolist() == [220, 0, 0]


def test_radians(spark):
    values = [0.0, math.pi / 2, -math.pi / 2, math.pi, 3.0, -3.0, 10.0]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "a double").select(normalize_orientation(F.col("a"))).collect()]
    for v, got in zip(values, found, strict=True):
        assert -math.pi / 2 < got <= math.pi / 2 + 1e-12 and abs(math.sin(got - v)) < 1e-9


def test_turned_values_at_a_half_are_sums_in_row_order():
    """Where a place lies midway between two columns and columns are equal, values are at a half: they come out as the sum over rows of pixels, tile by tile too."""
    theta = math.radians(30)
    u, v = raster.places(theta, np.arange(11) - 8 * math.sin(theta), np.arange(11.0)[:, None])
    for a in range(0, 250, 3):
        image = np.tile(np.array([a, a + 1], np.uint8), (8, 4))[..., None]
        out = raster.warped(image, theta, -8 * math.sin(theta), 0.0, 11, 11, 255)[:, :, 0]
        for y in (1, 3, 5, 7):
            p, q = float(u[y, 4]), float(v[y, 4])
            cells = [(cy, cx) for cy in (int(q), int(q) + 1) for cx in (int(p), int(p) + 1)]
            assert out[y, 4] == math.floor(reduce(add, (float(image[cy, cx, 0]) * (1 - abs(p - cx)) * (1 - abs(q - cy)) for cy, cx in cells)) + 0.5)  # sum() would correct its rounding


def test_overlaps_in_strips_and_parts(spark, monkeypatch):
    monkeypatch.setattr(objects, "COUNTED", 50)
    monkeypatch.setattr(objects, "LAID_OUT", 7)
    for _ in range(30):
        n = int(RNG.integers(2, 30))
        own = RNG.random((n, 5, 9)) < 0.4
        parts = [masks.runs_of(m) for m in own]
        of = np.repeat(np.arange(n), [len(p.y) for p in parts])
        whole = masks.Runs(*(np.concatenate([getattr(p, c) for p in parts]).astype(np.int64) for c in ("y", "left", "right")))
        for rows in {n, n // 2}:
            found = {(int(a), int(b)): int(c) for parts_ in objects._overlaps(whole, of, n, rows) for a, b, c in zip(*parts_, strict=True)}
            assert found == {(a, b): int((own[a] & own[b]).sum()) for a in range(rows) for b in (range(a + 1, n) if rows == n else range(rows, n)) if (own[a] & own[b]).any()}
    table = spark.createDataFrame([("a", i, 0, i % 3) for i in range(50)], "img string, inst long, y int, x int")
    plan = objects.instance_iou(table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")] and "Exchange" not in plan[: plan.index("MapInArrow")]  # pairs are neither joined nor shuffled


def test_overlaps_of_crowded_pieces_are_added_up(spark, monkeypatch):
    import duckdb

    called, added = [], objects._added
    monkeypatch.setattr(objects, "_added", lambda *a: called.append(a[0].dtype) or added(*a))
    for wide, kind in ((30, np.uint8), (400, np.uint16)):
        n = 40
        own = np.zeros((n, 3, wide), bool)
        for m in own:
            for y in range(3):
                low = int(RNG.integers(0, wide))
                m[y, low : low + int(RNG.integers(1, wide))] = True
        parts = [masks.runs_of(m) for m in own]
        of = np.repeat(np.arange(n), [len(p.y) for p in parts])
        whole = masks.Runs(*(np.concatenate([getattr(p, c) for p in parts]).astype(np.int64) for c in ("y", "left", "right")))
        for rows in (n, n // 2, 1):
            wanted = {(a, b): int((own[a] & own[b]).sum()) for a in range(rows) for b in (range(a + 1, n) if rows == n else range(rows, n)) if (own[a] & own[b]).any()}
            for laid_out, bound in ((1 << 20, 1 << 20), (100, 1 << 20), (1 << 20, 0)):  # in one strip, in several, laid out
                monkeypatch.setattr(objects, "LAID_OUT", laid_out)
                monkeypatch.setattr(objects, "ADDED", bound)
                before = len(called)
                found = {(int(a), int(b)): int(c) for parts_ in objects._overlaps(whole, of, n, rows) for a, b, c in zip(*parts_, strict=True)}
                assert found == wanted and called[before:] == [kind] * (bound > 0)
    monkeypatch.undo()
    monkeypatch.setattr(objects, "CELL", 8)
    table = spark.createDataFrame([("a", i, 0, x) for i in range(60) for x in range(i % 7, i % 7 + 1 + i % 5)], "img string, inst long, y int, x int")
    pairs = objects.instance_iou(table, places=6)
    assert pairs.rdd.getNumPartitions() == 2 * 8 * 9 / 2  # the cells of eight blocks aren't put together for being small
    said = duckdb.sql("SELECT i, u, round(i / u, 6) AS iou FROM range(1, 130) a(i), range(1, 700) b(u) WHERE i <= u").fetchall()
    assert objects._rounded(np.array([i / u for i, u, _ in said]), 6).tolist() == [r for _, _, r in said]
    pixels = {i: set(range(i % 7, i % 7 + 1 + i % 5)) for i in range(60)}
    round_of = {(i, u): r for i, u, r in said}
    assert {(r.a, r.b): r.iou for r in pairs.collect()} == {(a, b): round_of[len(pixels[a] & pixels[b]), len(pixels[a] | pixels[b])] for a in pixels for b in pixels if a < b and pixels[a] & pixels[b]}
