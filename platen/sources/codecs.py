"""Image files as arrays (h x w x channels, 8 or 16 bits) and back: PNG, JPEG, TIFF, BMP, PNM, farbfeld, GIF (read), TGA, ICO and QOI, by numpy and zlib alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from platen.sources import palettes
from platen.sources.jpeg import decode_jpeg, encode_jpeg

PNG, FARBFELD = b"\x89PNG\r\n\x1a\n", b"farbfeld"
#: Rows of a PNG that are undone together at most.
SLANTED = 1024
#: Greatest number of pixels of a file that is taken.
MOST_PIXELS = 1 << 30


class Unsupported(ValueError):
    """A file that can't be decoded, or pixels that a format can't hold."""


def _slanted(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undo filters of rows (h x pixels x bytes of a pixel), each with its kind, by anti-diagonals: pixels with equal sums of row and column depend on the two diagonals before alone.

    A diagonal is a row of an array that has the pixel of row y and column x at (x + y, y), so that all it takes is contiguous.
    """
    h, w, back = rows.shape
    turned = np.zeros((w + h + 1, h + 1, back), np.int16)
    down, right, _ = turned.strides
    pixels = np.lib.stride_tricks.as_strided(turned[2:, 1:], (h, w, back), (down + right, down, turned.itemsize))
    pixels[:] = rows
    turned[1 : w + 1, 0] = above
    kind, paeth = kinds.astype(np.int16)[:, None], bool((kinds == 4).all())
    for t in range(h + w - 1):
        y0, y1 = max(0, t - w + 1), min(h, t + 1)  # rows that the diagonal crosses
        a, b, c, own = turned[t + 1, y0 + 1 : y1 + 1], turned[t + 1, y0:y1], turned[t, y0:y1], turned[t + 2, y0 + 1 : y1 + 1]
        bc, ac = b - c, a - c
        pa, pb, pc = np.abs(bc), np.abs(ac), np.abs(bc + ac)
        guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        if not paeth:
            k = kind[y0:y1]
            guess = np.where(k == 4, guess, np.where(k == 3, (a + b) >> 1, np.where(k == 2, b, np.where(k == 1, a, 0))))
        own += guess
        own &= 255
    return pixels.astype(np.uint8)


def _png_rows(data: bytes, width: int, height: int, bits: int, above: np.ndarray | None = None) -> np.ndarray:
    """Undo the filters of PNG rows, below a row that is known or none; bits: of a pixel."""
    size, back = (width * bits + 7) // 8, max(1, bits // 8)
    if len(data) < height * (size + 1):
        raise Unsupported("png: pixel data is cut off")
    rows = np.frombuffer(data, np.uint8, height * (size + 1)).reshape(height, size + 1)
    kinds, rows = rows[:, 0], rows[:, 1:]
    if (kinds > 4).any():
        raise Unsupported(f"png: filter {kinds.max()}")
    out, above = np.empty((height, size), np.uint8), np.zeros(size, np.uint8) if above is None else above
    # stretches of rows that are undone together: by sums along rows, by sums down columns, or slantwise
    way = np.where(kinds <= 1, kinds, np.where(kinds == 2, 2, 3))
    cuts = sorted({*range(0, height, SLANTED), *(np.flatnonzero(np.diff(way)) + 1).tolist(), height})
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = rows[a:b]
        if way[a] == 0:
            out[a:b] = own
        elif way[a] == 1:
            out[a:b] = np.cumsum(own.reshape(b - a, -1, back), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif way[a] == 2:
            out[a:b] = np.cumsum(np.concatenate([above[None], own]), axis=0, dtype=np.uint8)[1:]
        else:
            out[a:b] = _slanted(kinds[a:b], np.ascontiguousarray(own).reshape(b - a, -1, back), above.reshape(-1, back)).reshape(b - a, -1)
        above = out[b - 1]
    return out


def _png_samples(rows: np.ndarray, width: int, depth: int, colour: int) -> np.ndarray:
    """Bytes of unfiltered rows to samples (h x w x channels); grey of less than 8 bits is stretched."""
    height, channels = len(rows), {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth == 16:
        return rows.view(">u2").astype(np.uint16).reshape(height, width, channels)
    if depth < 8:
        each = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (each * (1 << np.arange(depth - 1, -1, -1, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)[:, :width]
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    return rows.reshape(height, width, channels)


# First column and row, and steps, of the seven passes of an interlaced PNG.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _interlaced(raw: bytes, width: int, height: int, depth: int, colour: int) -> np.ndarray:
    channels, at = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour], 0
    out = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8)
    for x, y, across, down in PASSES:
        w, h = -(-(width - x) // across), -(-(height - y) // down)
        if w > 0 and h > 0:
            rows = _png_rows(raw[at:], w, h, depth * channels)
            out[y::down, x::across] = _png_samples(rows, w, depth, colour)
            at += h * ((w * depth * channels + 7) // 8 + 1)
    return out


@dataclass
class _Png:
    """What a PNG's chunks say; the compressed pixels chunk by chunk."""

    width: int
    height: int
    depth: int
    colour: int
    interlaced: int
    table: np.ndarray | None
    parts: list[bytes]

    @property
    def bits(self) -> int:
        return self.depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[self.colour]

    def coloured(self, samples: np.ndarray) -> np.ndarray:
        if self.colour != 3:
            return samples
        if self.table is None:
            raise Unsupported("png: no palette")
        return self.table[np.minimum(samples[:, :, 0], len(self.table) - 1)]


def _png_chunks(data: bytes) -> _Png:
    at, parts, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if head is None or not parts:
        raise Unsupported("png: no header or no pixels")
    width, height, depth, colour, _, _, interlaced = head
    if colour not in (0, 2, 3, 4, 6) or depth not in (1, 2, 4, 8, 16) or (depth < 8 and colour not in (0, 3)) or not width or not height or width * height > MOST_PIXELS:
        raise Unsupported("png: pixel type or size")
    table = palette
    if palette is not None and clear:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        table = np.concatenate([palette, alpha[:, None]], axis=1)
    return _Png(width, height, depth, colour, interlaced, table, parts)


def png_bands(data: bytes, rows: int) -> Iterator[np.ndarray]:
    """The rows of a PNG from the top, so many at a time; only an interlaced one is held whole."""
    png = _png_chunks(data)
    size, unpack, held, above = (png.width * png.bits + 7) // 8 + 1, zlib.decompressobj(), b"", None
    if png.interlaced:
        try:
            raw = zlib.decompress(b"".join(png.parts))
        except zlib.error as e:
            raise Unsupported(f"png: {e}") from e
        yield png.coloured(_interlaced(raw, png.width, png.height, png.depth, png.colour))
        return
    waiting, y = b"".join(png.parts), 0
    while y < png.height:
        n = min(rows, png.height - y)
        while len(held) < n * size:
            try:
                more = unpack.decompress(waiting, n * size - len(held))
            except zlib.error as e:
                raise Unsupported(f"png: {e}") from e
            waiting = unpack.unconsumed_tail
            if not more:
                raise Unsupported("png: pixel data is cut off")
            held += more
        out = _png_rows(held, png.width, n, png.bits, above)
        above, held, y = out[-1].copy(), held[n * size :], y + n
        yield png.coloured(_png_samples(out, png.width, png.depth, png.colour))


def decode_png(data: bytes) -> np.ndarray:
    parts = list(png_bands(data, max(SLANTED, 1)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode_png(image: np.ndarray) -> bytes:
    """Rows with the Up filter, which a cumulative sum undoes."""
    h, w, c = image.shape
    wide = image.astype(">u2").view(np.uint8) if image.dtype == np.uint16 else image
    rows = np.ascontiguousarray(wide).view(np.uint8).reshape(h, -1)
    filtered = np.concatenate([np.full((h, 1), 2, np.uint8), rows - np.concatenate([np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]])], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 16 if image.dtype == np.uint16 else 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + chunk(b"IEND", b"")


# TIFF tags, and struct codes of its field types.
TIFF_TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "offsets": 273, "samples": 277, "rows": 278, "counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325, "extra": 338, "format": 339}
TIFF_TYPES = {1: "B", 3: "H", 4: "I"}


def tiff_fields(data: bytes) -> tuple[str, dict[int, tuple[int, ...]]]:
    """Byte order and the whole-number fields of the first image of a TIFF file."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise Unsupported("tiff: header")
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TIFF_TYPES:
                size = struct.calcsize(TIFF_TYPES[kind]) * count
                place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                fields[tag] = struct.unpack_from(f"{order}{count}{TIFF_TYPES[kind]}", data, place)
    except struct.error as e:
        raise Unsupported(f"tiff: {e}") from e
    return order, fields


def _tiff_part(data: bytes, order: str, fields: dict[int, tuple[int, ...]], at: int, size: int, w: int, h: int) -> np.ndarray:
    """A strip or a tile as samples; rows that it lacks are an error."""
    get = lambda name, default: fields.get(TIFF_TAGS[name], (default,))[0]
    part, compression, depth, samples = data[at : at + size], get("compression", 1), get("bits", 1), get("samples", 1)
    if compression in (8, 32946):
        try:
            part = zlib.decompress(part)
        except zlib.error as e:
            raise Unsupported(f"tiff: {e}") from e
    elif compression != 1:
        raise Unsupported(f"tiff: compression {compression}")
    if len(part) < w * h * samples * depth // 8:
        raise Unsupported("tiff: pixel data is cut off")
    pixels = np.frombuffer(part, np.uint8 if depth == 8 else np.dtype(f"{order}u2"), w * h * samples).reshape(h, w, samples)
    pixels = pixels.astype(np.uint8 if depth == 8 else np.uint16)
    if get("predictor", 1) == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=pixels.dtype)
    return ~pixels if get("photometric", 1) == 0 else pixels[:, :, : min(samples, 4)]


def tiff_bands(data: bytes) -> Iterator[np.ndarray]:
    """The rows of a TIFF from the top, a strip or a row of tiles at a time."""
    order, fields = tiff_fields(data)
    get = lambda name, default=None: fields.get(TIFF_TAGS[name], default)
    (w,), (h,), bits = get("width"), get("height"), get("bits", (1,))
    if set(bits) not in ({8}, {16}) or get("planar", (1,))[0] != 1 or set(get("format", (1,))) != {1} or w * h > MOST_PIXELS:
        raise Unsupported("tiff: pixel type or size")
    if get("tile_width"):
        (tw,), (th,) = get("tile_width"), get("tile_height")
        across, parts = -(-w // tw), list(zip(get("tile_offsets", ()), get("tile_counts", ()), strict=True))
        for y in range(0, h, th):
            row = parts[y // th * across : (y // th + 1) * across]
            if len(row) < across:
                raise Unsupported("tiff: pixel data is cut off")
            yield np.concatenate([_tiff_part(data, order, fields, at, size, tw, th) for at, size in row], axis=1)[: h - y, :w]
        return
    y, rows = 0, min(get("rows", (h,))[0], h)
    for at, size in zip(get("offsets", ()), get("counts", ()), strict=True):
        if y < h:
            yield _tiff_part(data, order, fields, at, size, w, min(rows, h - y))
            y += rows
    if y < h:
        raise Unsupported("tiff: pixel data is cut off")


def decode_tiff(data: bytes) -> np.ndarray:
    return np.concatenate(list(tiff_bands(data)))


def tiff_file(image: tuple[int, int, int, int], parts: Iterable[bytes], rows: int = 0, tile: int = 0) -> bytes:
    """A little-endian file of deflated strips of so many rows, or of square tiles, in order. image: height, width, channels and bytes of a sample."""
    h, w, c, depth = image
    parts = list(parts)
    offsets = np.cumsum([8, *(len(s) + len(s) % 2 for s in parts)]).tolist()
    where = [("tile_width", "I", [tile]), ("tile_height", "I", [tile]), ("tile_offsets", "I", offsets[:-1]), ("tile_counts", "I", [len(s) for s in parts])] if tile else [("offsets", "I", offsets[:-1]), ("rows", "I", [rows]), ("counts", "I", [len(s) for s in parts])]
    fields = [("width", "I", [w]), ("height", "I", [h]), ("bits", "H", [8 * depth] * c), ("compression", "H", [8]), ("photometric", "H", [2 if c > 2 else 1]), ("samples", "H", [c]), ("planar", "H", [1]), *where]
    if c in (2, 4):
        fields.append(("extra", "H", [2]))
    fields.sort(key=lambda f: TIFF_TAGS[f[0]])
    body = b"".join(s + b"\0" * (len(s) % 2) for s in parts)
    table, beyond, free = b"", b"", offsets[-1] + 2 + 12 * len(fields) + 4
    for name, code, values in fields:
        value = struct.pack(f"<{len(values)}{code}", *values)
        table += struct.pack("<HHI", TIFF_TAGS[name], 3 if code == "H" else 4, len(values))
        if len(value) <= 4:
            table += value.ljust(4, b"\0")
        else:
            table += struct.pack("<I", free + len(beyond))
            beyond += value + b"\0" * (len(value) % 2)
    return b"II*\0" + struct.pack("<I", offsets[-1]) + body + struct.pack("<H", len(fields)) + table + b"\0\0\0\0" + beyond


def deflated(part: np.ndarray) -> bytes:
    """Samples of a TIFF strip or tile."""
    return zlib.compress(np.ascontiguousarray(part).astype(f"<u{part.itemsize}").tobytes(), 6)


def encode_tiff(image: np.ndarray) -> bytes:
    """Little-endian, one deflated strip per some 256 KiB."""
    h, w, c = image.shape
    rows = max(1, (256 << 10) // max(1, w * c * image.itemsize))
    return tiff_file((h, w, c, image.itemsize), (deflated(image[at : at + rows]) for at in range(0, h, rows)), rows=rows)


def decode_bmp(data: bytes) -> np.ndarray:
    try:
        start, _, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    except struct.error as e:
        raise Unsupported(f"bmp: {e}") from e
    if bits not in (24, 32) or packed not in (0, 3):
        raise Unsupported("bmp: pixel type")
    stride = (w * bits // 8 + 3) // 4 * 4
    if len(data) < start + stride * abs(h):
        raise Unsupported("bmp: pixel data is cut off")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (rows[::-1] if h > 0 else rows)[:, :, [2, 1, 0]].copy()


def encode_bmp(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    rows = np.pad(image[::-1, :, 2::-1].reshape(h, -1), ((0, 0), (0, -3 * w % 4)))
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + rows.size, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_pnm(data: bytes) -> np.ndarray:
    """Binary grey and colour maps (P5, P6)."""
    at, numbers = 2, []
    while len(numbers) < 3 and at < len(data):
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while end < len(data) and data[end : end + 1].isdigit():
                end += 1
            if end == at:
                break
            numbers.append(int(data[at:end]))
            at = end
    if data[:2] not in (b"P5", b"P6") or len(numbers) < 3:
        raise Unsupported("pnm: only P5 and P6")
    (w, h, top), c = numbers, 1 if data[:2] == b"P5" else 3
    kind = np.dtype(np.uint8 if top < 256 else ">u2")
    if len(data) < at + 1 + w * h * c * kind.itemsize:
        raise Unsupported("pnm: pixel data is cut off")
    return np.frombuffer(data, kind, w * h * c, at + 1).reshape(h, w, c).astype(np.uint8 if top < 256 else np.uint16)


def encode_pnm(image: np.ndarray) -> bytes:
    h, w, c = image.shape
    head = f"P{5 if c == 1 else 6}\n{w} {h}\n{255 if image.dtype == np.uint8 else 65535}\n".encode()
    return head + image[:, :, : 3 if c > 1 else 1].astype(np.uint8 if image.dtype == np.uint8 else ">u2").tobytes()


def decode_farbfeld(data: bytes) -> np.ndarray:
    w, h = struct.unpack_from(">II", data, 8)
    if len(data) < 16 + 8 * w * h:
        raise Unsupported("farbfeld: pixel data is cut off")
    return np.frombuffer(data, ">u2", 4 * w * h, 16).reshape(h, w, 4).astype(np.uint16)


def encode_farbfeld(image: np.ndarray) -> bytes:
    h, w, c = image.shape
    wide = image.astype(np.uint16) * (257 if image.dtype == np.uint8 else 1)
    wide = wide if c == 4 else np.concatenate([np.repeat(wide, 3, axis=2) if c == 1 else wide, np.full((h, w, 1), 65535, np.uint16)], axis=2)
    return FARBFELD + struct.pack(">II", w, h) + wide.astype(">u2").tobytes()


def bands(data: bytes, form: str | None, rows: int) -> Iterator[np.ndarray]:
    """An image's rows from the top, so many at a time, the last fewer: PNG and TIFF unpacked as they go, others whole."""
    if form not in ("png", "tiff"):
        image = decode(data, form)
        yield from (image[at : at + rows] for at in range(0, len(image), rows))
        return
    held: list[np.ndarray] = []
    try:
        for part in png_bands(data, rows) if form == "png" else tiff_bands(data):
            held.append(part)
            if sum(map(len, held)) >= rows:
                whole = np.concatenate(held)
                cut = len(whole) // rows * rows
                yield from (whole[at : at + rows] for at in range(0, cut, rows))
                held = [whole[cut:]] if cut < len(whole) else []
    except (struct.error, TypeError, ValueError, LookupError, ArithmeticError, zlib.error, MemoryError) as e:
        raise e if isinstance(e, Unsupported) else Unsupported(f"{form}: {e}") from e
    if held:
        yield np.concatenate(held)


def size_of(data: bytes, form: str | None) -> tuple[int, int]:
    """Width and height by a file's head, without unpacking a PNG or TIFF."""
    try:
        if form == "png":
            png = _png_chunks(data)
            return png.width, png.height
        if form == "tiff":
            _, fields = tiff_fields(data)
            return fields[TIFF_TAGS["width"]][0], fields[TIFF_TAGS["height"]][0]
    except (struct.error, TypeError, ValueError, LookupError) as e:
        raise e if isinstance(e, Unsupported) else Unsupported(f"{form}: {e}") from e
    image = decode(data, form)
    return image.shape[1], image.shape[0]


DECODERS = {"png": decode_png, "jpeg": decode_jpeg, "tiff": decode_tiff, "bmp": decode_bmp, "pnm": decode_pnm, "farbfeld": decode_farbfeld, "gif": palettes.decode_gif, "tga": palettes.decode_tga, "ico": lambda data: palettes.decode_ico(data, decode_png), "qoi": palettes.decode_qoi}
ENCODERS = {"png": encode_png, "jpeg": encode_jpeg, "tiff": encode_tiff, "bmp": encode_bmp, "pnm": encode_pnm, "farbfeld": encode_farbfeld, "tga": palettes.encode_tga, "ico": lambda image: palettes.encode_ico(image, encode_png(image)), "qoi": palettes.encode_qoi}


def decode(data: bytes, form: str | None) -> np.ndarray:
    if form not in DECODERS:
        raise Unsupported(f"no decoder for {form}")
    try:
        image = DECODERS[form](data)
    except (struct.error, TypeError, ValueError, LookupError, ArithmeticError, zlib.error, MemoryError) as e:
        raise e if isinstance(e, Unsupported) else Unsupported(f"{form}: {e}" if not str(e).startswith(form) else str(e)) from e
    if image.ndim != 3 or not image.size:
        raise Unsupported(f"{form}: no pixels")
    return image


def encode(image: np.ndarray, form: str) -> bytes:
    if form not in ENCODERS:
        raise Unsupported(f"output format {form} is not enabled for writing")
    if form == "jpeg" and (image.dtype != np.uint8 or image.shape[2] in (2, 4)):
        raise Unsupported("jpeg: only 8-bit grey or colour")
    if form == "tga" and (image.dtype != np.uint8 or image.shape[2] == 2):
        raise Unsupported("tga: only 8-bit grey, colour or colour with alpha")
    if form == "qoi" and (image.dtype != np.uint8 or image.shape[2] < 3):
        raise Unsupported("qoi: only 8-bit colour")
    if form == "ico" and max(image.shape[:2]) > 256:
        raise Unsupported("ico: more than 256 pixels a side")
    if form == "bmp" and (image.dtype != np.uint8 or image.shape[2] != 3):
        raise Unsupported("bmp: only 8-bit colour")
    return ENCODERS[form](image)
