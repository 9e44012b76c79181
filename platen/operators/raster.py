"""Pixel transforms of one image (h x w x channels, 8 or 16 bits), for use inside Spark tasks: turns, warps, trims, pads, tensors."""

from __future__ import annotations

import math

import numpy as np

# Channel means and deviations of the tensors, sizes, and limits.
MEAN, STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
DETECTOR_SIDE, LINE_SIZE, DOC_SHORT, DOC_CROP, DOC_LONG = 960, (160, 80), 256, 224, 768

Bounds = tuple[float, float, float, float]


def depth_of(image: np.ndarray) -> int:
    """8 or 16; other pixels are refused rather than narrowed."""
    if image.dtype not in (np.uint8, np.uint16) or not 1 <= image.shape[2] <= 4:
        raise ValueError(f"unsupported pixels {image.dtype} x {image.shape[2]}: precision would be lost")
    return 8 * image.itemsize


def top_of(image: np.ndarray) -> int:
    return int(np.iinfo(image.dtype).max)


def to_rgb(image: np.ndarray) -> np.ndarray:
    return image[:, :, :3] if image.shape[2] > 2 else np.repeat(image[:, :, :1], 3, axis=2)


def to_rgba(image: np.ndarray) -> np.ndarray:
    alpha = image[:, :, -1:] if image.shape[2] in (2, 4) else np.full((*image.shape[:2], 1), top_of(image), image.dtype)
    return np.concatenate([to_rgb(image), alpha], axis=2)


def over_white(image: np.ndarray) -> np.ndarray:
    """8-bit colour with its alpha laid over white."""
    a = image[:, :, 3:].astype(np.float32) / 255
    return np.floor(image[:, :, :3] * a + 255 * (1 - a) + 0.5).astype(np.uint8)


def quarter_turns(image: np.ndarray, turns: int) -> np.ndarray:
    """Turned clockwise by so many quarters."""
    return np.ascontiguousarray(np.rot90(image, -turns % 4))


def trimmed(image: np.ndarray) -> np.ndarray | None:
    """Cut to the pixels whose alpha isn't 0; none if there are none."""
    seen = image[:, :, 3] != 0
    if not seen.any():
        return None
    ys, xs = np.flatnonzero(seen.any(axis=1)), np.flatnonzero(seen.any(axis=0))
    return image[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]


def padded(image: np.ndarray, percent: float) -> np.ndarray:
    """Transparent pixels on each side: the percent of the side's length, rounded up."""
    if percent <= 0:
        return image
    h, w = image.shape[:2]
    y, x = math.ceil(h * percent / 100), math.ceil(w * percent / 100)
    return np.pad(image, ((y, y), (x, x), (0, 0)))


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray, border: int, origin: tuple[int, int] = (0, 0), size: tuple[int, int] | None = None) -> np.ndarray:
    """Bilinear values at x, y, pixel centres being whole numbers; the border where the place is outside.

    A value is the sum of the pixels around it times their nearness along and across, in row order, so that sums just at a half come out as those of rows of pixels do.
    The image may be a part of one of some size (width, height) that begins at origin (x, y) and holds all that is asked for: places are those of the whole.
    """
    w, h = size or image.shape[1::-1]
    ox, oy = origin
    left, top = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    near = [((1 - (x - left))[..., None], (1 - (y - top))[..., None]), ((1 - (left + 1 - x))[..., None], (1 - (top + 1 - y))[..., None])]
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x0, y0 = np.clip(left, 0, w - 1), np.clip(top, 0, h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1) - ox, np.minimum(y0 + 1, h - 1) - oy
    x0, y0 = x0 - ox, y0 - oy
    if size:  # what isn't inside needn't be in the part
        x0, x1, y0, y1 = (np.clip(v, 0, n - 1) for v, n in ((x0, image.shape[1]), (x1, image.shape[1]), (y0, image.shape[0]), (y1, image.shape[0])))
    (left_x, top_y), (right_x, below_y) = near
    value = image[y0, x0] * left_x * top_y + image[y0, x1] * right_x * top_y + image[y1, x0] * left_x * below_y + image[y1, x1] * right_x * below_y
    return np.where(inside[..., None], np.floor(value + 0.5), border).astype(image.dtype)


def places(theta: float, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where places of the turned image are in the image. What rounding takes off whole places must not push them over an edge."""
    c, s = math.cos(theta), math.sin(theta)
    return np.round(px * c + py * s, 6), np.round(py * c - px * s, 6)


def warped(image: np.ndarray, theta: float, min_x: float, min_y: float, width: int, height: int, border: int, first: tuple[int, int] = (0, 0), origin: tuple[int, int] = (0, 0), size: tuple[int, int] | None = None) -> np.ndarray:
    """The window at min_x, min_y of the image turned by theta about its origin; rows in bands, to bound memory. first: column and row of the window that are begun with."""
    out = np.empty((height, width, image.shape[2]), image.dtype)
    px = np.arange(first[0], first[0] + width) + min_x
    for at in range(0, height, step := max(1, (1 << 20) // max(1, width))):
        py = (np.arange(first[1] + at, first[1] + min(at + step, height)) + min_y)[:, None]
        out[at : at + step] = sampled(image, *places(theta, px, py), border, origin, size)
    return out


def deskewed(image: np.ndarray, bounds: Bounds, theta: float) -> np.ndarray:
    """The bounds of the turned source; real pixels around an object stay, white is only outside the source."""
    rgb = to_rgb(image)
    width, height = (max(1, math.ceil(round(b - a, 6))) for a, b in ((bounds[0], bounds[2]), (bounds[1], bounds[3])))
    return warped(rgb, theta, bounds[0], bounds[1], width, height, top_of(image))


def line_crop(white: np.ndarray, corners: np.ndarray, theta: float) -> np.ndarray | None:
    """A text line (4 x 2 corners), turned like the output; none under two pixels."""
    c, s = math.cos(theta), math.sin(theta)
    x, y = corners[:, 0] * c - corners[:, 1] * s, corners[:, 0] * s + corners[:, 1] * c
    width, height = (max(1, math.floor(np.ptp(v) + 0.5)) for v in (x, y))
    return None if width < 2 or height < 2 else warped(white, theta, x.min(), y.min(), width, height, 255)


def rotated(image: np.ndarray, theta: float, border: int) -> np.ndarray:
    """Turned about its centre on a canvas that holds all of it."""
    h, w = image.shape[:2]
    c, s = math.cos(theta), math.sin(theta)
    width, height = math.ceil(round(abs(w * c) + abs(h * s), 6)), math.ceil(round(abs(w * s) + abs(h * c), 6))
    cx, cy = (w - 1) / 2 * c - (h - 1) / 2 * s, (w - 1) / 2 * s + (h - 1) / 2 * c
    return warped(image, theta, cx - (width - 1) / 2, cy - (height - 1) / 2, width, height, border)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By a triangle filter, widened where the image shrinks."""

    def along(rows: np.ndarray, n: int) -> np.ndarray:
        ratio = len(rows) / n
        reach, out = max(ratio, 1.0), np.empty((n, *rows.shape[1:]), np.float32)
        for i in range(n):
            centre = (i + 0.5) * ratio
            low, high = max(0, math.floor(centre - reach)), min(len(rows), math.ceil(centre + reach))
            weight = np.maximum(1 - np.abs(np.arange(low, high) + 0.5 - centre) / reach, 0).astype(np.float32)
            out[i] = np.tensordot(weight / weight.sum(), rows[low:high], 1)
        return out

    if image.shape[:2] == (height, width):
        return image
    value = along(along(image.astype(np.float32), height).swapaxes(0, 1), width).swapaxes(0, 1)
    return np.clip(np.floor(value + 0.5), 0, top_of(image)).astype(image.dtype)


def tensor(rgb: np.ndarray, order: tuple[int, int, int] = (0, 1, 2)) -> np.ndarray:
    """Channels first, normalised; the means go by place, whichever channel stands there."""
    return ((rgb[:, :, list(order)] / 255 - MEAN) / STD).astype(np.float32).transpose(2, 0, 1)


def detector_input(rgba: np.ndarray) -> np.ndarray:
    """A cutout for the text detector: over white, the long side capped, both sides multiples of 32, blue first."""
    h, w = rgba.shape[:2]
    ratio = min(1.0, DETECTOR_SIDE / max(w, h))
    width, height = (max(32, math.floor(side * ratio / 32 + 0.5) * 32) for side in (w, h))
    return tensor(resized(over_white(rgba), width, height), (2, 1, 0))


def line_input(line: np.ndarray) -> np.ndarray:
    return tensor(resized(line, *LINE_SIZE))


def short_side_crop(rgb: np.ndarray, short: int, crop: int) -> np.ndarray:
    """Resized to a short side, then the square in the middle."""
    h, w = rgb.shape[:2]
    scale = short / max(1, min(w, h))
    width, height = (max(crop, math.floor(side * scale + 0.5)) for side in (w, h))
    x, y = (width - crop) // 2, (height - crop) // 2
    return resized(rgb, width, height)[y : y + crop, x : x + crop]


def document_input(rgba: np.ndarray, theta: float) -> np.ndarray:
    """A deskewed cutout for the document classifier."""
    white = over_white(rgba)
    h, w = white.shape[:2]
    if max(w, h) > DOC_LONG:
        scale = DOC_LONG / max(w, h)
        white = resized(white, max(1, math.floor(w * scale + 0.5)), max(1, math.floor(h * scale + 0.5)))
    if abs(theta) >= 1e-6:
        white = rotated(white, theta, 255)
    return tensor(short_side_crop(white, DOC_SHORT, DOC_CROP))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def cutout(image: np.ndarray, mask: np.ndarray, min_x: int, min_y: int) -> np.ndarray:
    """The part under an object's local mask, opaque there; all else is 0."""
    h, w = mask.shape
    part = to_rgba(image)[min_y : min_y + h, min_x : min_x + w].copy()
    part[:, :, 3] = top_of(image)
    part[~mask] = 0
    return part


def alpha_output(image: np.ndarray, mask: np.ndarray, min_x: int, min_y: int, theta: float, padding: float, turns: int) -> np.ndarray:
    """Cutout, turned, trimmed, padded and set upright, in this order."""
    out = cutout(image, mask, min_x, min_y)
    if theta:
        out = rotated(out, theta, 0)
    found = trimmed(out)
    return quarter_turns(padded(out if found is None else found, padding), turns)


def rgb_output(image: np.ndarray, bounds: Bounds, theta: float, turns: int) -> np.ndarray:
    return quarter_turns(deskewed(image, bounds, theta), turns)
