"""Small formats as arrays and back: GIF (read), TGA, ICO and QOI."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

#: Greatest number of pixels of a file that is taken.
MOST_PIXELS = 1 << 28
# First row and step of the passes of an interlaced GIF.
ROWS = ((0, 8), (4, 8), (2, 4), (1, 2))


def _lzw(data: bytes, least: int, wanted: int) -> bytes:
    """So many colour numbers from codes of growing width, the lowest bits of a byte first."""
    clear = 1 << least
    first = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    table, width, last = list(first), least + 1, b""
    out, total, bits, have = [], 0, 0, 0
    for byte in data:
        bits |= byte << have
        have += 8
        while have >= width:
            code, bits, have = bits & ((1 << width) - 1), bits >> width, have - width
            if code == clear:
                table, width, last = list(first), least + 1, b""
                continue
            if code == clear + 1 or total >= wanted:
                return b"".join(out)
            if code < len(table):
                now = table[code]
            elif code == len(table) and last:
                now = last + last[:1]
            else:
                raise ValueError("gif: no such code")
            if last and len(table) < 4096:
                table.append(last + now[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = now
            out.append(now)
            total += len(now)
    return b"".join(out)


def decode_gif(data: bytes) -> np.ndarray:
    """The first picture of a GIF on its canvas: height x width x 4, clear where it draws nothing."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("gif: header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, common, clear = 13, None, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        common, at = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size
    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                clear = data[at + 6]
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
        elif kind == 0x2C:
            return _gif_picture(data, at + 1, (width, height), common, clear)
        else:
            break
    raise ValueError("gif: no picture")


def _gif_picture(data: bytes, at: int, canvas: tuple[int, int], palette: np.ndarray | None, clear: int | None) -> np.ndarray:
    left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
    at += 9
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        palette, at = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size
    if palette is None or not w or not h or not canvas[0] or not canvas[1] or max(w * h, canvas[0] * canvas[1]) > MOST_PIXELS:
        raise ValueError("gif: no palette or size")
    least, at, parts = data[at], at + 1, []
    if not 1 <= least <= 11:
        raise ValueError("gif: code size")
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    numbers = np.frombuffer(_lzw(b"".join(parts), least, w * h), np.uint8)
    if len(numbers) < w * h:
        raise ValueError("gif: pixel data is cut off")
    rows = numbers[: w * h].reshape(h, w)
    if flags & 0x40:
        order = np.concatenate([np.arange(first, h, step) for first, step in ROWS])
        ordered = np.empty_like(rows)
        ordered[order] = rows
        rows = ordered
    if rows.max() >= len(palette):
        raise ValueError("gif: no such colour")
    picture = np.concatenate([palette[rows], np.where(rows == clear, 0, 255).astype(np.uint8)[:, :, None] if clear is not None else np.full((h, w, 1), 255, np.uint8)], axis=2)
    out = np.zeros((canvas[1], canvas[0], 4), np.uint8)
    part = picture[: max(0, canvas[1] - top), : max(0, canvas[0] - left)]
    out[top : top + part.shape[0], left : left + part.shape[1]] = part
    return out


def decode_tga(data: bytes) -> np.ndarray:
    """Grey and true colours (8, 24 and 32 bits), plain or in runs, from either corner."""
    skip, mapped, kind, _, _, _, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    channels = bits // 8
    if mapped or kind not in (2, 3, 10, 11) or bits not in ((8,) if kind in (3, 11) else (24, 32)) or not w or not h or w * h > MOST_PIXELS:
        raise ValueError("tga: pixel type or size")
    body, wanted = data[18 + skip :], w * h * channels
    if kind >= 10:
        parts, at, total = [], 0, 0
        while total < wanted:
            n = (body[at] & 127) + 1
            if body[at] & 128:
                parts.append(body[at + 1 : at + 1 + channels] * n)
                at += 1 + channels
            else:
                parts.append(body[at + 1 : at + 1 + n * channels])
                at += 1 + n * channels
            total += n * channels
        body = b"".join(parts)
    if len(body) < wanted:
        raise ValueError("tga: pixel data is cut off")
    rows = np.frombuffer(body, np.uint8, wanted).reshape(h, w, channels)
    rows = rows if flags & 0x20 else rows[::-1]
    rows = rows[:, ::-1] if flags & 0x10 else rows
    return np.ascontiguousarray(rows if channels == 1 else rows[:, :, [2, 1, 0, 3][:channels]])


def encode_tga(image: np.ndarray) -> bytes:
    """Plain rows from the top."""
    h, w, c = image.shape
    if image.dtype != np.uint8 or c == 2 or max(h, w) > 65535:
        raise ValueError("tga: only 8-bit grey, colour or colour with alpha")
    rows = image if c == 1 else image[:, :, [2, 1, 0, 3][:c]]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if c == 1 else 2, 0, 0, 0, 0, 0, w, h, 8 * c, 0x20 | (8 if c == 4 else 0)) + np.ascontiguousarray(rows).tobytes()


def decode_ico(data: bytes, decode_png: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """The largest picture of an icon, of equal ones the one of most bits: a PNG, or rows of 24 or 32 bits with a mask below."""
    zero, kind, n = struct.unpack_from("<HHH", data)
    if zero or kind != 1 or not n:
        raise ValueError("ico: header")
    found = [struct.unpack_from("<BBBBHHII", data, 6 + 16 * i) for i in range(n)]
    *_, size, at = max(found, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[5]))
    body = data[at : at + size]
    if body[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(body)
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", body)
    h //= 2  # the mask counts as well
    if bits not in (24, 32) or packed or w <= 0 or h <= 0 or w * h > MOST_PIXELS:
        raise ValueError("ico: pixel type")
    stride, mask_stride = (w * bits // 8 + 3) // 4 * 4, (w + 31) // 32 * 4
    rows = np.frombuffer(body, np.uint8, stride * h, head).reshape(h, stride)[::-1, : w * bits // 8].reshape(h, w, bits // 8)
    if bits == 32:
        return rows[:, :, [2, 1, 0, 3]].copy()
    mask = np.unpackbits(np.frombuffer(body, np.uint8, mask_stride * h, head + stride * h).reshape(h, mask_stride), axis=1)[::-1, :w]
    return np.concatenate([rows[:, :, [2, 1, 0]], np.where(mask, 0, 255).astype(np.uint8)[:, :, None]], axis=2)


def encode_ico(image: np.ndarray, png: bytes) -> bytes:
    """One picture, as PNG, of 256 pixels a side at most."""
    h, w, c = image.shape
    if max(h, w) > 256:
        raise ValueError("ico: more than 256 pixels a side")
    return struct.pack("<HHHBBBBHHII", 0, 1, 1, w % 256, h % 256, 0, 0, 1, 8 * c * image.itemsize, len(png), 22) + png


def decode_qoi(data: bytes) -> np.ndarray:
    """Height x width x 3 or 4."""
    magic, w, h, channels, _ = struct.unpack_from(">4sIIBB", data)
    if magic != b"qoif" or channels not in (3, 4) or not w or not h or w * h > MOST_PIXELS:
        raise ValueError("qoi: header")
    seen, last, at, out, left = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, [], w * h
    while left > 0:
        op = data[at]
        at += 1
        run = 1
        if op == 0xFE:
            last = (data[at], data[at + 1], data[at + 2], last[3])
            at += 3
        elif op == 0xFF:
            last = (data[at], data[at + 1], data[at + 2], data[at + 3])
            at += 4
        elif op < 0x40:
            last = seen[op]
        elif op < 0x80:
            r, g, b, a = last
            last = ((r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (b + (op & 3) - 2) & 255, a)
        elif op < 0xC0:
            r, g, b, a = last
            green, more = (op & 63) - 32, data[at]
            at += 1
            last = ((r + green - 8 + (more >> 4)) & 255, (g + green) & 255, (b + green - 8 + (more & 15)) & 255, a)
        else:
            run = (op & 63) + 1
        seen[(last[0] * 3 + last[1] * 5 + last[2] * 7 + last[3] * 11) % 64] = last
        out.append(bytes(last) * min(run, left))
        left -= run
    return np.frombuffer(b"".join(out), np.uint8).reshape(h, w, 4)[:, :, :channels].copy()


def encode_qoi(image: np.ndarray) -> bytes:
    """Whole colours and runs of equal ones, up to 62 each."""
    h, w, c = image.shape
    if image.dtype != np.uint8 or c not in (3, 4):
        raise ValueError("qoi: only 8-bit colour")
    flat = image.reshape(-1, c)
    starts = np.flatnonzero(np.concatenate([[True], np.any(flat[1:] != flat[:-1], axis=1)]))
    out = [struct.pack(">4sIIBB", b"qoif", w, h, c, 0)]
    for colour, n in zip(flat[starts], np.diff(np.append(starts, len(flat))).tolist(), strict=True):
        out.append((b"\xfe" if c == 3 else b"\xff") + colour.tobytes())
        whole, rest = divmod(n - 1, 62)
        out.append(b"\xfd" * whole + (bytes([0xC0 | rest - 1]) if rest else b""))
    return b"".join(out) + bytes(7) + b"\1"
