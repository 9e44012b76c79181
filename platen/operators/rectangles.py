"""Least rectangles around objects, how well points support their sides, polygon measures and box scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.operators.grouped import by_group

#: Share of the filled area in the rectangularity; the support of the sides has the rest.
FILL_SHARE = 0.25
#: Decimals that projections are rounded to, so that equal rectangles of several edges tie.
PLACES = 9


def _lower(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Corners of the lower outline of points with ascending, distinct x."""
    kept: list[int] = []
    x, y = x.tolist(), y.tolist()  # single values are met faster than in an array
    for i in range(len(x)):
        while len(kept) > 1 and (x[kept[-1]] - x[kept[-2]]) * (y[i] - y[kept[-2]]) <= (y[kept[-1]] - y[kept[-2]]) * (x[i] - x[kept[-2]]):
            kept.pop()
        kept.append(i)
    return kept


def _hull(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Corners of the hull of columns with ascending, distinct x, anticlockwise from the least x and of these the least y; one or two for points on one line."""
    under, over = _lower(x, low), _lower(x, -high)[::-1]
    hull = np.concatenate([np.stack([x[under], low[under]], 1), np.stack([x[over], high[over]], 1)])
    apart = np.any(hull != np.roll(hull, -1, axis=0), axis=1)
    return hull[apart] if apart.any() else hull[:1]


def _columns(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, least and greatest y of each column of (n x 2) points."""
    x, y = points[np.lexsort((points[:, 1], points[:, 0]))].T
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    return x[first], y[first], y[np.append(first[1:], len(x))[: len(first)] - 1]


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of (n x 2) points, anticlockwise; points inside its sides and repeated ones are none. Points with a NaN are left out."""
    points = points[~np.isnan(points).any(axis=1)]
    return _hull(*_columns(points)) if len(points) else points


def _extents(hull: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest projections of a hull along and across each of its sides' directions u.

    The corner that is furthest in a direction is where the sides' directions pass the one a quarter turn on; as the calipers turn from side to side it walks around once. Its
    neighbours are looked at too, for sides that are all but parallel.
    """
    turn = np.arctan2(u[:, 1], u[:, 0])
    turn = turn[0] + np.mod(turn - turn[0], 2 * np.pi)  # ascending, for the hull is convex

    def furthest(quarters: int, axis: np.ndarray) -> np.ndarray:
        wanted = turn[0] + np.mod(turn + (quarters + 1) * np.pi / 2 - turn[0], 2 * np.pi)
        at = np.searchsorted(turn, wanted - 1e-9)
        return np.max([np.einsum("ij,ij->i", hull[(at + k) % len(hull)], axis) for k in (-1, 0, 1)], axis=0)

    across = np.stack([-u[:, 1], u[:, 0]], axis=1)
    return -furthest(2, -u), furthest(0, u), -furthest(3, -across), furthest(1, across)


def _least(columns: pd.DataFrame) -> tuple[float, ...] | None:
    """(ux, uy, u0, v0, w, h) of the least rectangle from columns (x, low, high); none for points on one line."""
    columns = columns.sort_values("x")
    hull = _hull(*(columns[c].to_numpy(float) for c in ("x", "low", "high")))
    if len(hull) < 3:
        return None
    edge = np.roll(hull, -1, axis=0) - hull
    u = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    u0, u1, v0, v1 = _extents(hull, u)
    w, h = u1 - u0, v1 - v0
    turn = 270 - np.mod(270 - np.degrees(np.arctan2(u[:, 1], u[:, 0])), 360)
    i = np.lexsort((turn, np.round(w * h, 6)))[0]
    return (*u[i], *np.round([u0[i], v0[i], w[i], h[i]], PLACES))


def least_rectangle(points: np.ndarray) -> tuple[float, ...] | None:
    """(ux, uy, u0, v0, w, h) of the least rectangle around (n x 2) points; none for points on one line."""
    x, low, high = _columns(points)
    return _least(pd.DataFrame({"x": x, "low": low, "high": high})) if len(x) > 1 else None


def rectangle_corners(rect: tuple[float, ...]) -> np.ndarray:
    """The four corners (4 x 2) of (ux, uy, u0, v0, w, h)."""
    ux, uy, u0, v0, w, h = rect
    u, v = np.array([u0, u0 + w, u0 + w, u0]), np.array([v0, v0, v0 + h, v0 + h])
    return np.stack([u * ux - v * uy, u * uy + v * ux], axis=1)


def least_rectangles(points: DataFrame) -> DataFrame:
    """Points (obj, x, y) to (obj, ux, uy, u0, v0, w, h): the rectangle of least area on an edge of the hull, of ties the first edge.

    (ux, uy) is the direction of the w side; u0 and v0 are the least projections along and across it. Only the least and greatest
    y of each x reach an object's group, summed up before the shuffle: a group has at most an image's width of rows. Objects whose points
    lie on one line have no row; null and NaN coordinates are left out.
    """
    columns = points.where("x is not null and y is not null and not isnan(cast(x as double)) and not isnan(cast(y as double))").groupBy("obj", "x").agg(F.min("y").alias("low"), F.max("y").alias("high"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        found = _least(frame)
        rows = [] if found is None else [(frame["obj"].iloc[0], *found)]
        return pd.DataFrame(rows, columns=["obj", "ux", "uy", "u0", "v0", "w", "h"])

    return by_group(columns, ["obj"], one, "obj long, ux double, uy double, u0 double, v0 double, w double, h double")


def _away(v: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves away from zero."""
    return np.trunc(v + np.copysign(0.5, v))


def _body(rect: tuple[float, ...], points: np.ndarray) -> tuple[float, ...]:
    """body_rectangles() of one object."""
    ux, uy, u0, v0, w, h = rect
    x, y = points.T
    own = {"u": np.round(x * ux + y * uy, 6), "v": np.round(y * ux - x * uy, 6)}
    out = {}
    for axis, across, low0, extent in (("u", "v", u0, w), ("v", "u", v0, h)):
        key, at = np.unique(_away(own[across]), return_inverse=True)
        low, high = np.full(len(key), np.inf), np.full(len(key), -np.inf)
        np.minimum.at(low, at, own[axis])
        np.maximum.at(high, at, own[axis])
        weight, ends = np.maximum(high - low, 1), []
        for sign, end in ((-1, low), (1, high)):
            place, of = np.unique(_away(end), return_inverse=True)
            votes = np.round(np.bincount(of, weight), PLACES)
            ends.append(place[np.lexsort((place * sign, votes))[-1]])
        out[axis] = (ends[0], ends[1] - ends[0]) if ends[1] > ends[0] else (low0, extent)
    return (ux, uy, out["u"][0], out["v"][0], out["u"][1], out["v"][1])


def _side_support(rect: tuple[float, ...], points: np.ndarray) -> float:
    """The side_support of rectangularity() of one object."""
    ux, uy, u0, v0, w, h = rect
    if w < 1 or h < 1:
        return 0.0
    x, y = points.T
    u, v = np.round(x * ux + y * uy - u0, 6), np.round(y * ux - x * uy - v0, 6)
    near, total = min(max(min(w, h) * 0.03, 1.0), 4.0), 0.0
    for along, length, off in ((u, w, v), (u, w, h - v), (v, h, u), (v, h, w - u)):
        n = int(min(max(np.ceil(length / 8.0), 4), 64))
        touched = (np.abs(off) <= near) & (along >= -near) & (along <= length + near)
        place = np.minimum(np.floor(np.clip(along / length, 0.0, 1.0) * n).astype(int), n - 1)
        total += len(np.unique(place[touched])) / n
    return total / 4


@dataclass(frozen=True)
class Shape:
    """Of one object: corners of its least rectangle and of its body's, the direction of the longer side, and how rectangular it is."""

    corners: np.ndarray
    body: np.ndarray
    degrees: float
    rectangularity: float


def shape_of(points: np.ndarray, area: int) -> Shape | None:
    """The shape of an object by the points of its outline and its pixels; none for points on one line. As the operators on rows of points tell it."""
    rect = least_rectangle(points)
    if rect is None:
        return None
    ux, uy, _, _, w, h = rect
    turn = np.degrees(np.arctan2(uy, ux)) + (0 if w >= h else 90)
    turn = np.mod(turn, 180.0)
    fill = min(area / ((w + 1) * (h + 1)), 1.0)
    return Shape(rectangle_corners(rect), rectangle_corners(_body(rect, points)), float(turn - 180 if turn > 90 else turn), float(FILL_SHARE * fill + (1 - FILL_SHARE) * _side_support(rect, points)))


def _streamed_hulls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Columns (obj, x, low, high), an object's rows together, to (obj, pos, x, y): the hull of each run of rows of one object. Of an object that goes on in the next batch its corners are held."""
    held: tuple[int, np.ndarray] | None = None

    def rows_of(hulls: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        n = [len(h) for _, h in hulls]
        xy = np.concatenate([np.zeros((0, 2)), *(h for _, h in hulls)])
        pos = np.arange(len(xy)) - np.repeat(np.cumsum(n) - n, n) if hulls else np.zeros(0, int)
        return pd.DataFrame({"obj": np.repeat(np.array([obj for obj, _ in hulls], np.int64), n), "pos": pos, "x": xy[:, 0], "y": xy[:, 1]})

    for frame in frames:
        if not len(frame):
            continue
        objs, x, low, high = (frame[c].to_numpy() for c in ("obj", "x", "low", "high"))
        cuts = [0, *(np.flatnonzero(objs[1:] != objs[:-1]) + 1).tolist(), len(objs)]
        done = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = np.stack([np.concatenate([x[i:j]] * 2), np.concatenate([low[i:j], high[i:j]])], axis=1)
            if held is not None and held[0] == objs[i]:
                own = np.concatenate([held[1], own])
            elif held is not None:
                done.append(held)
            held = (int(objs[i]), hull_of(own))
        yield rows_of(done)
    yield rows_of([] if held is None else [held])


def convex_hulls(points: DataFrame) -> DataFrame:
    """Points (obj, x, y) to (obj, pos, x, y): the corners of each object's hull, anticlockwise from the least x and of these the least y.

    Only the least and greatest y of each x can be corners, and a hull of hulls is the hull: columns are dealt out by ranges of object and x, each task hands on the corners of
    what it has read alone, and these meet. So a large object is spread over tasks, a small one is whole in one, and none holds more than a batch of columns beside the corners of one object.
    Points on one line have two corners, a single one has one; nulls and NaNs are left out.
    """
    known = points.where("obj is not null and x is not null and y is not null").select(F.col("obj").cast("long").alias("obj"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    columns = known.where("not isnan(x) and not isnan(y)").groupBy("obj", "x").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    hulls = "obj long, pos int, x double, y double"
    parts = columns.repartitionByRange("obj", "x").sortWithinPartitions("obj", "x").mapInPandas(_streamed_hulls, hulls)
    meet = parts.select("obj", "x", F.col("y").alias("low"), F.col("y").alias("high"))
    return meet.repartition("obj").sortWithinPartitions("obj", "x").mapInPandas(_streamed_hulls, hulls)


def corners(x: str = "ux", y: str = "uy") -> Column:
    """The four corners of a rectangle row, as an array of (x, y)."""
    at = lambda u, v: F.struct((u * F.col(x) - v * F.col(y)).alias("x"), (u * F.col(y) + v * F.col(x)).alias("y"))
    u0, v0, w, h = (F.col(c) for c in ("u0", "v0", "w", "h"))
    return F.array(at(u0, v0), at(u0 + w, v0), at(u0 + w, v0 + h), at(u0, v0 + h))


def polygon_measures(polygon: Column) -> tuple[Column, Column]:
    """Signed area (positive if anticlockwise) and perimeter of an array of (x, y)."""
    following = lambda i: F.element_at(polygon, (i + 1) % F.size(polygon) + 1)
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    area = total(F.transform(polygon, lambda p, i: p["x"] * following(i)["y"] - following(i)["x"] * p["y"])) / 2
    return area, total(F.transform(polygon, lambda p, i: F.hypot(following(i)["x"] - p["x"], following(i)["y"] - p["y"])))


def body_rectangles(points: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Rectangles at the same angle around an object's body: thin parts that stick out don't count. For objects that are rectangular.

    In the rectangle's frame, each whole column has a least and a greatest place across, each whole row one along. A slice
    votes for its two places, rounded, with its extent as weight (1 at least); a side goes where the votes for it are most, of ties
    outwards. An axis without extent keeps the rectangle's own. Votes are sums by object, slice and place,
    joined before each shuffle; sums are rounded, so that their order doesn't matter.
    """
    framed = points.join(rectangles, "obj").select("obj", F.round(F.col("x") * F.col("ux") + F.col("y") * F.col("uy"), 6).alias("u"), F.round(F.col("y") * F.col("ux") - F.col("x") * F.col("uy"), 6).alias("v"))
    cut = F.explode(F.array(*(F.struct(F.lit(axis).alias("axis"), F.round(F.col(key)).cast("long").alias("key"), F.col(axis).alias("at")) for axis, key in (("u", "v"), ("v", "u")))))
    slices = framed.select("obj", cut.alias("c")).groupBy("obj", "c.axis", "c.key").agg(F.min("c.at").alias("low"), F.max("c.at").alias("high"))
    weight = F.greatest(F.col("high") - F.col("low"), F.lit(1.0))
    ends = F.explode(F.array(*(F.struct(F.lit(sign).alias("sign"), F.round(F.col(end)).cast("long").alias("place")) for sign, end in ((-1, "low"), (1, "high")))))
    voted = slices.select("obj", "axis", weight.alias("weight"), ends.alias("e")).groupBy("obj", "axis", "e.sign", "e.place").agg(F.round(F.sum("weight"), PLACES).alias("votes"))
    best = lambda axis, sign: F.max(F.when((F.col("axis") == axis) & (F.col("sign") == sign), F.struct("votes", (F.col("place") * F.col("sign")).alias("out"))))["out"] * sign
    sides = voted.groupBy("obj").agg(*(best(axis, sign).alias(f"{axis}{'low' if sign < 0 else 'high'}") for axis in "uv" for sign in (-1, 1)))

    def side(axis: str, length: str) -> list[Column]:
        low, extent = F.col(f"{axis}low").cast("double"), (F.col(f"{axis}high") - F.col(f"{axis}low")).cast("double")
        return [F.when(extent > 0, low).otherwise(F.col(f"{axis}0")).alias(f"{axis}0"), F.when(extent > 0, extent).otherwise(F.col(length)).alias(length)]

    (u0, w), (v0, h) = side("u", "w"), side("v", "h")
    return rectangles.join(sides, "obj", "left").select("obj", "ux", "uy", u0, v0, w, h)


def side_bins(length: Column) -> Column:
    return F.least(F.greatest(F.ceil(length / 8.0), F.lit(4)), F.lit(64)).cast("int")


def rectangularity(points: DataFrame, rectangles: DataFrame) -> DataFrame:
    """(obj, side_support, rectangularity) of objects with a rectangle; points: an object's outline, area: its pixels if that column exists.

    A side's bins of some 8 pixels are hit by points within a small distance of it. As a side has at most 64 bins, the hits are
    bits that bit_or() joins before the shuffle.
    """
    area = F.max("area") if "area" in points.columns else F.count("*")
    r = points.join(rectangles, "obj")
    r = r.withColumn("u", F.round(F.col("x") * F.col("ux") + F.col("y") * F.col("uy") - F.col("u0"), 6)).withColumn("v", F.round(F.col("y") * F.col("ux") - F.col("x") * F.col("uy") - F.col("v0"), 6))
    u, v, w, h = (F.col(c) for c in "uvwh")
    near = F.least(F.greatest(F.least(w, h) * 0.03, F.lit(1.0)), F.lit(4.0))

    def hits(along: Column, length: Column, off: Column) -> Column:
        n = side_bins(length)
        place = F.least(F.floor(F.least(F.greatest(along / length, F.lit(0.0)), F.lit(1.0)) * n).cast("int"), n - 1)
        touched = (F.abs(off) <= near) & along.between(-near, length + near)
        return F.coalesce(F.bit_or(F.when(touched, F.call_function("shiftleft", F.lit(1).cast("long"), place))), F.lit(0).cast("long"))

    sides = [(u, w, v), (u, w, h - v), (v, h, u), (v, h, w - u)]
    found = r.groupBy("obj").agg(area.alias("area"), F.first("w").alias("w"), F.first("h").alias("h"), *(hits(*s).alias(f"side{i}") for i, s in enumerate(sides)))
    shares = [F.bit_count(f"side{i}") / side_bins(s[1]) for i, s in enumerate(sides)]
    support = F.when((w < 1) | (h < 1), 0.0).otherwise((shares[0] + shares[1] + shares[2] + shares[3]) / 4)
    fill = F.least(F.col("area") / ((w + 1) * (h + 1)), F.lit(1.0))
    return found.select("obj", support.alias("side_support"), (FILL_SHARE * fill + (1 - FILL_SHARE) * support).alias("rectangularity"))


def unclipped(rectangles: DataFrame, ratio: float = 1.4) -> DataFrame:
    """Rectangles with each side moved out by area * ratio / perimeter; the angle stays."""
    d = F.col("w") * F.col("h") * ratio / (2 * (F.col("w") + F.col("h")))
    return rectangles.select("obj", "ux", "uy", (F.col("u0") - d).alias("u0"), (F.col("v0") - d).alias("v0"), (F.col("w") + 2 * d).alias("w"), (F.col("h") + 2 * d).alias("h"))


def box_scores(probabilities: DataFrame, quads: DataFrame) -> DataFrame:
    """Probabilities (img, y, x, p) and quads (img, box, q: array of four (x, y)) to (img, box, score): the mean over the pixels in the quad, border included; 0 without any.

    Each quad is spread over the pixels of its bounds and meets them by an equi-join.
    """
    low, high = (lambda a: F.ceil(F.array_min(F.transform("q", lambda p: p[a]))).cast("int")), (lambda a: F.floor(F.array_max(F.transform("q", lambda p: p[a]))).cast("int"))
    span = lambda a: F.when(low(a) <= high(a), F.sequence(low(a), high(a)))
    cells = quads.withColumn("y", F.explode(span("y"))).withColumn("x", F.explode(span("x")))
    q = lambda i: F.col("q")[i % 4]
    cross = [(q(i + 1)["x"] - q(i)["x"]) * (F.col("y") - q(i)["y"]) - (q(i + 1)["y"] - q(i)["y"]) * (F.col("x") - q(i)["x"]) for i in range(4)]
    inside = cells.where((F.least(*cross) >= 0) | (F.greatest(*cross) <= 0)).select("img", "box", "y", "x")
    means = inside.join(probabilities, ["img", "y", "x"]).groupBy("img", "box").agg(F.avg("p").alias("score"))
    return quads.select("img", "box").join(means, ["img", "box"], "left").select("img", "box", F.coalesce("score", F.lit(0.0)).alias("score"))
