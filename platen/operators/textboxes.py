"""Text boxes of one object from a detector's probability map, and the votes of line and document classifiers. They run inside Spark tasks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from platen.operators import masks, raster
from platen.operators.rectangles import least_rectangle, rectangle_corners

# Binarisation, least score, least short side, unclip ratio, most lines asked, most skew of a line.
CORE, LEAST_SCORE, LEAST_SIDE, RATIO, MOST_LINES, MOST_SKEW = 0.2, 0.45, 3.0, 1.4, 5, 45.0


@dataclass(frozen=True)
class TextBox:
    corners: np.ndarray
    angle: float
    length: float
    score: float


def wrapped(degrees: float) -> float:
    """To (-90, 90]."""
    d = degrees % 180.0
    return d - 180.0 if d > 90 else d


@dataclass(frozen=True)
class Border:
    """Points (x, y), in row order, of a region's pixels with a side neighbour in one part of the background: an outer border, or one around a hole.

    parent: place of the border around it, a region's outer border for a hole, the border of the hole that it lies in for a region; -1 if there is none.
    """

    points: np.ndarray
    hole: bool
    parent: int


def border_tree(bitmap: np.ndarray) -> list[Border]:
    """All borders of a bitmap, the largest region's first, its outer one before those of its holes in row order.

    Regions are joined over corners, the background over sides, both told from runs once. A region's pixel belongs to the border with each part of the background that lies beside it, so pixels
    are gone through once, however many regions and holes there are.
    """
    wide = np.pad(bitmap, 1)
    h, w = wide.shape
    runs, free = masks.runs_of(wide), masks.runs_of(~wide)
    region, ground = masks.components(runs), masks.components(free, eight=False)
    if not len(runs.y):
        return []
    place = np.empty(h * w, np.int32)  # of each pixel, its component's first run among those of its kind
    for own, label in ((runs, region), (free, ground)):
        at = np.repeat(own.y * w + own.left - (np.cumsum(own.sizes) - own.sizes), own.sizes) + np.arange(own.sizes.sum())
        place[at] = np.repeat(label, own.sizes)
    flat = wide.reshape(-1)
    set_at = np.flatnonzero(flat)
    keys, pixels = [], []
    for step in (-w, -1, 1, w):
        edge = set_at[~flat[set_at + step]]
        keys.append(place[edge].astype(np.int64) * len(free.y) + place[edge + step])
        pixels.append(edge)
    key, pixel = np.concatenate(keys), np.concatenate(pixels)
    order = np.lexsort((pixel, key))
    key, pixel = key[order], pixel[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (pixel[1:] != pixel[:-1])])
    key, pixel = key[new], pixel[new]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    inside, outside = np.divmod(key[cuts], len(free.y))
    area = np.bincount(region, runs.sizes, len(region))[inside]
    around = place[runs.y[inside] * w + runs.left[inside] - 1]  # what lies before a region's first pixel
    hole = around != outside
    rank = np.lexsort((outside, inside, -area))
    number = np.empty(len(rank), np.int64)
    number[rank] = np.arange(len(rank))
    outer_of = dict(zip(inside[~hole].tolist(), number[~hole].tolist(), strict=True))
    hole_of = dict(zip(outside[hole].tolist(), number[hole].tolist(), strict=True))
    ends = np.append(cuts[1:], len(pixel))
    out = []
    for i in rank.tolist():
        y, x = np.divmod(pixel[cuts[i] : ends[i]], w)
        parent = outer_of[int(inside[i])] if hole[i] else hole_of.get(int(outside[i]), -1)
        out.append(Border(np.stack([x - 1, y - 1], axis=1).astype(float), bool(hole[i]), parent))
    return out


def borders(bitmap: np.ndarray) -> list[np.ndarray]:
    """Points (x, y) of the border of each 8-connected region, and of the border around each of its holes."""
    return [b.points for b in border_tree(bitmap)]


def signed_area(polygon: np.ndarray) -> float:
    x, y = polygon.T
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def line_intersection(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray | None:
    """Where the lines through p, q and through r, s meet; none if they are parallel."""
    u, v = q - p, s - r
    cross = u[0] * v[1] - u[1] * v[0]
    if abs(cross) < 1e-9:
        return None
    t = ((r[0] - p[0]) * v[1] - (r[1] - p[1]) * v[0]) / cross
    return p + t * u


def unclipped(polygon: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """A convex polygon with each side moved out by area * ratio / perimeter; sides meet where their lines do."""
    n = len(polygon)
    perimeter = float(np.hypot(*(np.roll(polygon, -1, axis=0) - polygon).T).sum())
    if n < 3 or perimeter < 1e-9:
        return polygon
    area = signed_area(polygon)
    p = polygon if area >= 0 else polygon[::-1]
    step = np.roll(p, -1, axis=0) - p
    length = np.hypot(*step.T)
    some = length >= 1e-9
    normal = np.stack([step[some, 1], -step[some, 0]], axis=1) / length[some, None] * (abs(area) * ratio / perimeter)
    a, b = p[some] + normal, np.roll(p, -1, axis=0)[some] + normal
    meets = [line_intersection(a[i - 1], b[i - 1], a[i], b[i]) for i in range(len(a))]
    return np.array([a[i] if m is None else m for i, m in enumerate(meets)])


def in_quad(x: np.ndarray, y: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """Whether points lie in a convex quad, border included."""
    sides = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(quad, np.roll(quad, -1, axis=0), strict=True)]
    return (np.min(sides, axis=0) >= 0) | (np.max(sides, axis=0) <= 0)


def box_score(chance: np.ndarray, quad: np.ndarray) -> float:
    """The mean chance over the pixels in a quad; 0 without any."""
    h, w = chance.shape
    x0, x1 = (int(np.clip(v, 0, w - 1)) for v in (math.floor(quad[:, 0].min()), math.ceil(quad[:, 0].max())))
    y0, y1 = (int(np.clip(v, 0, h - 1)) for v in (math.floor(quad[:, 1].min()), math.ceil(quad[:, 1].max())))
    y, x = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    inside = in_quad(x, y, quad)
    return float(chance[y0 : y1 + 1, x0 : x1 + 1][inside].mean()) if inside.any() else 0.0


def text_boxes(chance: np.ndarray, width: int, height: int) -> list[TextBox]:
    """Boxes of a probability map (h x w), in the pixels of a crop of width x height: the scales of both axes differ, so each box is fitted again after scaling."""
    scale, out = np.array([width / chance.shape[1], height / chance.shape[0]]), []
    for points in borders(chance > CORE):
        rect = least_rectangle(points) if len(points) >= 3 else None
        if rect is None or min(rect[4:]) < LEAST_SIDE:
            continue
        quad = rectangle_corners(rect)
        score = box_score(chance, quad)
        grown = least_rectangle(unclipped(quad)) if score >= LEAST_SCORE else None
        rect = None if grown is None else least_rectangle(rectangle_corners(grown) * scale)
        if rect is not None:
            w, h = rect[4:]
            angle = math.degrees(math.atan2(rect[1], rect[0])) + (0 if w >= h else 90)
            out.append(TextBox(rectangle_corners(rect), wrapped(angle), max(w, h), score))
    return out


def sampled_lines(boxes: list[TextBox]) -> list[TextBox]:
    """The two longest, the median and the two shortest."""
    order = sorted(boxes, key=lambda b: -b.length)
    n = len(order)
    return order if n <= MOST_LINES else [order[i] for i in sorted({0, 1, n // 2, n - 2, n - 1})]


def vote_flip(rgba: np.ndarray, boxes: list[TextBox], theta: float, classify: Callable[[np.ndarray], np.ndarray]) -> bool | None:
    """Whether most of the sampled lines are upside down by a classifier of two scores; none if there is nothing to vote on."""
    white, votes = raster.over_white(rgba), []
    for box in sampled_lines(boxes):
        if abs(wrapped(box.angle + math.degrees(theta))) > MOST_SKEW:
            continue
        line = raster.line_crop(white, box.corners, theta)
        if line is not None:
            upright, flipped = raster.softmax(np.asarray(classify(raster.line_input(line)), float))
            votes.append(flipped > upright)
    return None if not votes else bool(2 * sum(votes) > len(votes))


def document_turns(rgba: np.ndarray, theta: float, classify: Callable[[np.ndarray], np.ndarray]) -> tuple[int, float]:
    """Quarter turns clockwise that set a deskewed object upright by a classifier of four scores (of ties the last), and its chance."""
    chance = raster.softmax(np.asarray(classify(raster.document_input(rgba, theta)), float))
    best = int(len(chance) - 1 - np.argmax(chance[::-1]))
    return (4 - best) % 4, float(chance[best])
