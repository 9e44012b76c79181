"""JPEG files: baseline, extended and progressive ones of 8 bits and Huffman codes, by numpy.

What a code at each bit of a scan would mean is looked up for all bits at once. Jumps over 2, 4, .. 32 codes are joined from
jumps over fewer, so that the end of a block's codes is known for each bit at which a block may start; blocks are then hops from end to end, and
all blocks' coefficients are read side by side. Only scans that refine coefficients, whose codes depend on what is there, go block by block.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# The order of coefficients, row by row of the block, as scans have them.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Bytes of a scan whose bits are looked up at once, and what a block's codes may take beyond.
WINDOW, BEYOND = 1 << 16, 1 << 9
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
#: 64 coefficients (rows by columns) to 64 pixels, as one matrix.
INVERSE = np.kron(_COSINES, _COSINES).T
#: Greatest number of pixels of a file that is taken.
MOST_PIXELS = 1 << 30


class Broken(ValueError):
    """A file that isn't such a JPEG, or breaks off."""


@dataclass
class Component:
    number: int
    across: int
    down: int
    table: int
    #: blocks a row and rows of blocks: whole units of a scan of all components, and those that hold pixels
    wide: int = 0
    high: int = 0
    own_wide: int = 0
    own_high: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


def code_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: length of the code they start with << 8 | its symbol; 0 if they start with none."""
    out, at, first = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            span = 1 << (16 - length)
            if first + span > 1 << 16:
                raise Broken("jpeg: codes overflow")
            out[first : first + span] = length << 8 | symbol
            first += span
        at += n
    return out


def unstuffed(data: bytes) -> tuple[list[bytes], int]:
    """The entropy-coded stretches between restart markers, stuffing taken out, and where the next other marker begins."""
    raw = np.frombuffer(data, np.uint8)
    after = np.append(raw[1:], 0)
    marks = np.flatnonzero((raw == 0xFF) & (after != 0) & (after != 0xFF))
    cuts = []
    for m in marks.tolist():
        if m + 1 >= len(data):
            break
        if 0xD0 <= data[m + 1] <= 0xD7:
            cuts.append(m)
        else:
            end = m
            break
    else:
        end = len(data)
    starts, ends = [0, *(c + 2 for c in cuts)], [*cuts, end]
    return [data[a:b].rstrip(b"\xff").replace(b"\xff\x00", b"\xff") for a, b in zip(starts, ends, strict=True)], end


class Bits:
    """A stretch as bits; past its end come ones."""

    def __init__(self, data: bytes) -> None:
        self.size = 8 * len(data)
        self.data = data + b"\xff" * (BEYOND + 8)

    def windows(self, at: int, n: int) -> np.ndarray:
        """For each of n bits from at on, it and the 31 that follow, as numbers."""
        first = at >> 3
        raw = np.frombuffer(self.data[first : first + (n >> 3) + 10].ljust((n >> 3) + 10, b"\xff"), np.uint8).astype(np.uint64)
        word = raw[:-5] << np.uint64(32) | raw[1:-4] << np.uint64(24) | raw[2:-3] << np.uint64(16) | raw[3:-2] << np.uint64(8) | raw[4:-1]
        offset = np.arange(at - 8 * first, at - 8 * first + n)
        return (word[offset >> 3] >> (np.uint64(8) - (offset & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of so many bits as the format reads them: those with a leading 0 are negative."""
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits) * (size > 0)


@dataclass
class Looked:
    """Codes at each bit of a window: bits with what follows them, coefficients passed over before the value, bits of the value, the value, and for ends of a band how many blocks end."""

    step: np.ndarray
    skip: np.ndarray
    size: np.ndarray
    value: np.ndarray
    ends: np.ndarray
    bad: np.ndarray


def look_up(windows: np.ndarray, table: np.ndarray, runs: bool) -> Looked:
    """runs: in progressive scans an end of band may stand for several blocks."""
    found = table[windows >> 16]
    length, symbol = found >> 8, (found & 255).astype(np.int64)
    skip, size = symbol >> 4, symbol & 15
    end = (size == 0) & (skip < 15)
    more = np.where(end & runs, skip, size)
    rest = windows & ((1 << (32 - length.astype(np.int64))) - 1)
    bits = rest >> np.maximum(32 - length - more, 0)
    ends = np.where(end, np.where(runs, (1 << skip) + bits, 1), 0)
    return Looked((length + more).astype(np.int32), np.where(end, 64, skip), size, signed(bits, size), ends, length == 0)


class Walk:
    """A scan's stretch, window by window: where the block that starts at a bit ends."""

    def __init__(self, bits: Bits, dc: dict[int, np.ndarray], ac: dict[int, np.ndarray], band: int, runs: bool) -> None:
        self.bits, self.dc_tables, self.ac_tables, self.band, self.runs = bits, dc, ac, band, runs
        self.start = self.stop = 0

    def at(self, place: int) -> None:
        """Look up the window that begins at a bit."""
        wide = min(8 * WINDOW, max(8, self.bits.size - place))
        n = wide + 8 * BEYOND
        self.start, self.stop = place, place + wide
        windows = self.bits.windows(place, n)
        found = {k: t[windows >> 16] for k, t in self.dc_tables.items()}
        self.after_dc = {k: np.minimum(np.arange(n) + (x >> 8) + (x & 15), n - 1) for k, x in found.items()}
        self.ac = {k: look_up(windows, t, self.runs) for k, t in self.ac_tables.items()}
        self.next, self.after_ac, self.ending = {}, {}, {}
        for k, x in self.ac.items():
            jump, gain = [np.minimum(np.arange(n, dtype=np.int32) + x.step, n - 1)], [np.minimum(x.skip + 1, 64).astype(np.uint8)]
            for _ in range(5):
                j, g = jump[-1], gain[-1]
                jump.append(j[j])
                gain.append(np.minimum(g.astype(np.int16) + g[j], 64).astype(np.uint8))
            place_, passed = np.arange(n, dtype=np.int32), np.zeros(n, np.int16)
            for j, g in zip(reversed(jump), reversed(gain), strict=True):
                further = passed + g[place_]
                go = further < self.band
                passed = np.where(go, further, passed)
                place_ = np.where(go, j[place_], place_)
            self.next[k], self.after_ac[k], self.ending[k] = jump[0], jump[0][place_], x.ends[place_]

    def means(self, table: int, at: np.ndarray) -> np.ndarray:
        """The differences of means whose codes start at these bits of the window."""
        if not len(at):
            return np.zeros(0, np.int64)
        windows = self.bits.windows(self.start, int(at.max()) + 1)[at]
        found = self.dc_tables[table][windows >> 16].astype(np.int64)
        length, size = found >> 8, found & 255
        if not length.all() or (size > 11).any():
            raise Broken("jpeg: no such code")
        return signed((windows & ((1 << (32 - length)) - 1)) >> (32 - length - size), size)


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    progressive: bool


def _segments(data: bytes) -> tuple[Frame, dict, int | None]:
    """Read markers and scans; every component's coefficients stand in its blocks."""
    if data[:2] != b"\xff\xd8":
        raise Broken("jpeg: no start")
    at, tables, codes, frame, restart, adobe = 2, {}, {}, None, 0, None
    scanned = ended = False
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            at += 1  # what lies between segments is passed over
            continue
        kind = data[at + 1]
        if kind in (0xFF, 0x00, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind == 0xD9:
            ended = True
            break
        if at + 4 > len(data):
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if len(body) != size - 2:
            raise Broken("jpeg: a segment is cut off")
        if kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                tables[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = code_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1, 0xC2):
            if frame is not None:
                raise Broken("jpeg: several frames")
            frame = _frame(body, kind == 0xC2)
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8:
            raise Broken(f"jpeg: frame of kind {kind - 0xC0} is not decoded")
        elif kind == 0xDD:
            (restart,) = struct.unpack_from(">H", body)
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif kind == 0xDA:
            if frame is None:
                raise Broken("jpeg: scan before frame")
            stretches, length = unstuffed(data[at:])
            _scan(frame, body, codes, stretches, restart)
            at += length
            scanned = True
    if frame is None or not scanned:
        raise Broken("jpeg: no frame or no scan")
    if not ended:
        raise Broken("jpeg: the file is cut off")
    return frame, tables, adobe


def _frame(body: bytes, progressive: bool) -> Frame:
    depth, height, width, n = struct.unpack_from(">BHHB", body)
    if depth != 8:
        raise Broken(f"jpeg: {depth} bits")
    if not width or not height or n not in (1, 3, 4) or width * height > MOST_PIXELS:
        raise Broken("jpeg: size or components")
    found = [Component(*(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i])) for i in range(n)]
    if any(not (1 <= c.across <= 4 and 1 <= c.down <= 4) for c in found):
        raise Broken("jpeg: sampling")
    across, down = max(c.across for c in found), max(c.down for c in found)
    for c in found:
        c.wide, c.high = -(-width // (8 * across)) * c.across, -(-height // (8 * down)) * c.down
        c.own_wide, c.own_high = -(-(-(-width * c.across // across)) // 8), -(-(-(-height * c.down // down)) // 8)
        c.blocks = np.zeros((c.wide * c.high, 64), np.int32)
    return Frame(width, height, found, progressive)


def _places(frame: Frame, own: list[Component]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the scan's blocks in order: component (its place in own) and block; and how many make a unit."""
    if len(own) == 1:
        c = own[0]
        y, x = np.divmod(np.arange(c.own_wide * c.own_high), c.own_wide)
        return np.zeros(len(y), np.int64), y * c.wide + x, 1
    units_wide, units_high = own[0].wide // own[0].across, own[0].high // own[0].down
    uy, ux = np.divmod(np.arange(units_wide * units_high), units_wide)
    which, where = [], []
    for i, c in enumerate(own):
        for v in range(c.down):
            for h in range(c.across):
                which.append(np.full(len(uy), i))
                where.append((uy * c.down + v) * c.wide + ux * c.across + h)
    return np.stack(which, 1).reshape(-1), np.stack(where, 1).reshape(-1), len(which)


def _scan(frame: Frame, head: bytes, codes: dict[int, np.ndarray], stretches: list[bytes], restart: int) -> None:
    n = head[0]
    own, tables = [], []
    for i in range(n):
        own.append(next((c for c in frame.components if c.number == head[1 + 2 * i]), None))
        tables.append((head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15))
    if None in own or not own:
        raise Broken("jpeg: scan of no component")
    low, high, former, shift = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if not frame.progressive:
        low, high, former, shift = 0, 63, 0, 0
    if high > 63 or low > high or shift > 13 or (low and n > 1):
        raise Broken("jpeg: band of the scan")
    which, where, unit = _places(frame, own)
    per = restart * unit if restart else len(which)
    if frame.progressive and former:
        decode = _refine_dc if low == 0 else _refine_ac
    else:
        decode = _first
    for k, at in enumerate(range(0, len(which), per)):
        if k >= len(stretches):
            raise Broken("jpeg: pixel data is cut off")
        decode(own, tables, codes, Bits(stretches[k]), which[at : at + per], where[at : at + per], low, high, shift, frame.progressive)


def _first(own: list[Component], tables: list[tuple[int, int]], codes: dict[int, np.ndarray], bits: Bits, which: np.ndarray, where: np.ndarray, low: int, high: int, shift: int, progressive: bool) -> None:
    """Blocks of a baseline scan, or of the first scan of a band."""
    with_dc, with_ac = low == 0, high > 0 and not (progressive and low == 0)
    try:
        dc = {t[0]: codes[t[0]] for t in tables} if with_dc else {}
        ac = {t[1]: codes[0x10 | t[1]] for t in tables} if with_ac else {}
    except KeyError as e:
        raise Broken("jpeg: no code table") from e
    first = max(low, 1)
    walk = Walk(bits, dc, ac, high - first + 1 if with_ac else 1, progressive)
    place, n, done = 0, len(which), 0
    order = which.tolist()
    before = np.zeros(len(own), np.int64)
    while done < n:
        walk.at(place)
        starts, begun = [], []
        here, limit = 0, walk.stop - walk.start
        after_dc, after_ac, ending = ({k: memoryview(np.ascontiguousarray(v)) for k, v in x.items()} for x in (walk.after_dc, walk.after_ac, walk.ending))
        i = done
        while i < n and here < limit:
            if walk.start + here >= bits.size:
                raise Broken("jpeg: pixel data is cut off")
            starts.append(here)
            begun.append(i)
            d, a = tables[order[i]]
            if with_dc:
                here = after_dc[d][here]
            i += 1
            if with_ac:
                i += ending[a][here] - 1 if progressive and ending[a][here] > 1 else 0
                here = after_ac[a][here]
        starts_, begun_ = np.array(starts, np.int64), np.array(begun, np.int64)
        for c, (d, a) in enumerate(tables):
            mine = which[begun_] == c
            at, blocks = starts_[mine], own[c].blocks
            to = where[begun_[mine]]
            if with_dc:
                total = before[c] + np.cumsum(walk.means(d, at))
                blocks[to, 0] = total << shift
                before[c] = total[-1] if len(total) else before[c]
                at = walk.after_dc[d][at]
            if with_ac:
                x, k = walk.ac[a], np.full(len(at), first)
                while len(at):
                    if x.bad[at].any():
                        raise Broken("jpeg: no such code")
                    k = k + x.skip[at]
                    kept = (x.size[at] > 0) & (k <= high)
                    blocks[to[kept], ZIGZAG[k[kept]]] = x.value[at[kept]] << shift
                    k = k + 1
                    going = k <= high
                    at, to, k = walk.next[a][at[going]], to[going], k[going]
        place, done = walk.start + here, i
    if place > bits.size:
        raise Broken("jpeg: pixel data is cut off")


def _refine_dc(own: list[Component], tables: list[tuple[int, int]], codes: dict[int, np.ndarray], bits: Bits, which: np.ndarray, where: np.ndarray, low: int, high: int, shift: int, progressive: bool) -> None:
    """One more bit of each block's mean."""
    if len(which) > bits.size:
        raise Broken("jpeg: pixel data is cut off")
    more = np.unpackbits(np.frombuffer(bits.data, np.uint8))[: len(which)].astype(np.int32)
    for c, component in enumerate(own):
        mine = which == c
        component.blocks[where[mine], 0] |= more[mine] << shift


def _refine_ac(own: list[Component], tables: list[tuple[int, int]], codes: dict[int, np.ndarray], bits: Bits, which: np.ndarray, where: np.ndarray, low: int, high: int, shift: int, progressive: bool) -> None:
    """One more bit of each coefficient of a band that is there, and new ones of that size."""
    if (key := 0x10 | tables[0][1]) not in codes:
        raise Broken("jpeg: no code table")
    blocks, table, band = own[0].blocks, codes[key].tolist(), ZIGZAG[low : high + 1]
    flags = np.unpackbits(np.frombuffer(bits.data, np.uint8))
    data, place, run, bit = bits.data, 0, 0, 1 << shift
    held = blocks[where][:, band]
    signs = np.sign(held).astype(np.int32)
    known = held != 0
    for b in range(len(where)):
        there, values = np.flatnonzero(known[b]), held[b]
        k, seen = 0, 0  # next coefficient; those there that are behind
        fresh: list[tuple[int, int]] = []
        grown: list[tuple[int, int, int]] = []  # first and last of those there, and where their bits are
        if run == 0:
            absent = np.flatnonzero(~known[b])
            passed = 0
            while k < len(band):
                if place >= bits.size:
                    raise Broken("jpeg: pixel data is cut off")
                at = place >> 3
                found = table[(int.from_bytes(data[at : at + 3], "big") >> (8 - (place & 7))) & 0xFFFF]
                if not found:
                    raise Broken("jpeg: no such code")
                place += found >> 8
                skip, size = (found & 255) >> 4, found & 15
                value = 0
                if size:
                    value = bit if flags[place] else -bit
                    place += 1
                elif skip < 15:
                    run = 1 << skip
                    for _ in range(skip):
                        run += int(flags[place]) << (skip := skip - 1)
                        place += 1
                    break
                # over so many absent ones, to the absent one that follows; those there in between get a bit each
                target = passed + skip
                end = int(absent[target]) if target < len(absent) else len(band)
                upto = int(np.searchsorted(there, end))
                if upto > seen:
                    grown.append((seen, upto, place))
                    place += upto - seen
                    seen = upto
                if size and end < len(band):
                    fresh.append((end, value))
                passed, k = target + 1, end + 1
        if run > 0:
            if len(there) > seen:
                grown.append((seen, len(there), place))
                place += len(there) - seen
            run -= 1
        for a, z, at in grown:
            spots = there[a:z]
            values[spots] += flags[at : at + z - a] * bit * signs[b, spots]
        for spot, value in fresh:
            values[spot] = value
    blocks[where[:, None], band] = held


def _pixels(c: Component, table: np.ndarray) -> np.ndarray:
    """A component's samples from its coefficients."""
    scale = np.zeros(64)
    scale[ZIGZAG] = table
    out = np.empty((c.wide * c.high, 64), np.uint8)
    for at in range(0, len(out), 1 << 14):
        out[at : at + (1 << 14)] = np.clip(np.floor((c.blocks[at : at + (1 << 14)] * scale) @ INVERSE + 128.5), 0, 255)
    return out.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)


def _doubled(x: np.ndarray) -> np.ndarray:
    """Rows twice as long: three quarters of the nearer and a quarter of the further neighbour, in quarters that aren't divided yet."""
    x = x.astype(np.int32)
    before, after = np.concatenate([x[:, :1], x[:, :-1]], axis=1), np.concatenate([x[:, 1:], x[:, -1:]], axis=1)
    return np.stack([3 * x + before, 3 * x + after], axis=2).reshape(len(x), -1)


def widened(plane: np.ndarray, across: int, down: int, width: int, height: int) -> np.ndarray:
    """Samples of a component as many as pixels: doubled by a triangle filter, for other factors repeated."""
    if across == 2 and down in (1, 2):
        own = plane[: -(-height // down), : -(-width // 2)]
        wide = _doubled(own)  # in quarters
        odd = np.arange(wide.shape[1]) % 2
        if down == 2:
            tall = _doubled(wide.T).T  # in sixteenths
            return ((tall + np.where(odd, 7, 8)) >> 4)[:height, :width].astype(np.uint8)
        wide = (wide + np.where(odd, 2, 1)) >> 2
        wide[:, 0] = own[:, 0]
        return wide[:height, :width].astype(np.uint8)
    return np.repeat(np.repeat(plane, down, axis=0), across, axis=1)[:height, :width]


def _coloured(planes: list[np.ndarray], adobe: int | None, numbers: list[int]) -> np.ndarray:
    if len(planes) == 1:
        return planes[0][:, :, None]
    stacked = np.stack(planes, axis=2)
    plain = adobe == 0 or (adobe is None and len(planes) == 3 and numbers == [82, 71, 66]) or (adobe is None and len(planes) == 4)
    if not plain:
        out = np.empty(stacked.shape, np.uint8)
        for at in range(0, len(stacked), 256):
            y, cb, cr = (stacked[at : at + 256, :, k].astype(np.float64) - (128 if k else 0) for k in range(3))
            rgb = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], axis=2)
            out[at : at + 256, :, :3] = np.clip(np.floor(rgb + 0.5), 0, 255)
        out[:, :, 3:] = stacked[:, :, 3:]
        stacked = out
    if len(planes) == 4:  # inks as Adobe writes them, inverted
        ink, black = stacked[:, :, :3].astype(np.uint16), stacked[:, :, 3:].astype(np.uint16)
        stacked = ((ink * black + 127) // 255).astype(np.uint8)
    return stacked


# The usual quantisers of brightness and colour at half quality, row by row.
QUANTISERS = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
     18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99],
    [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32,
])


def quantisers(quality: int) -> np.ndarray:
    """Both tables at a quality of 1 to 100, row by row."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((QUANTISERS * scale + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray) -> tuple[bytes, bytes]:
    """How many codes of each length of 1 to 16 bits, and symbols from the shortest on, for symbols that come so often; no code is all ones."""
    import heapq

    known = np.flatnonzero(counts).tolist()
    heap = [(int(counts[s]), s, [s]) for s in known] + [(0, 256, [256])]
    heapq.heapify(heap)
    depth = dict.fromkeys([*known, 256], 0)
    while len(heap) > 1:
        (n, a, x), (m, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (n + m, max(a, b), x + y))
    room = [0] * (max(depth.values()) + 2)
    for d in depth.values():
        room[max(d, 1)] += 1
    for d in range(len(room) - 1, 16, -1):  # too long ones move up in pairs
        while room[d] > 0:
            up = next(i for i in range(d - 2, 0, -1) if room[i])
            for place, more in ((d, -2), (d - 1, 1), (up, -1), (up + 1, 2)):
                room[place] += more
    longest = max(i for i, n in enumerate(room) if n)
    room[longest] -= 1  # the code of all ones
    order = sorted(known, key=lambda s: (depth[s], s))
    return bytes((room + [0] * 17)[1:17]), bytes(order)


def codes_of(lengths: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By symbol its code and the code's length."""
    code, size, n, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for length, many in enumerate(lengths, 1):
        for s in symbols[at : at + many]:
            code[s], size[s] = n, length
            n += 1
        at, n = at + many, n << 1
    return code, size


def _sizes(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _tokens(blocks: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks (zigzag order) to their symbols in order: table (component << 1, and 1 for what isn't a mean), symbol, value, bits of the value."""
    means = blocks[:, 0].copy()
    for c in np.unique(component):
        own = np.flatnonzero(component == c)
        means[own] = np.diff(blocks[own, 0], prepend=0)
    b, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    first = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
    run = k - np.where(first, 0, np.concatenate([[0], k[:-1]])) - 1 if len(b) else np.zeros(0, np.int64)
    value, size = blocks[b, k], _sizes(blocks[b, k])
    long = run >> 4
    last = np.zeros(len(blocks), np.int64)
    np.maximum.at(last, b, k)
    n = np.arange(len(blocks))
    over = np.repeat(np.arange(len(b)), long)  # sixteen zeros each
    short = n[last < 63]
    parts = [
        (n * 256, component << 1, _sizes(means), means, _sizes(means)),
        (b[over] * 256 + 4 * k[over] - 3 + np.zeros(len(over), np.int64), component[b[over]] << 1 | 1, np.full(len(over), 0xF0), over * 0, over * 0),
        (b * 256 + 4 * k, component[b] << 1 | 1, (run & 15) << 4 | size, value, size),
        (short * 256 + 255, component[short] << 1 | 1, short * 0, short * 0, short * 0),
    ]
    key, table, symbol, value, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    return table[order], symbol[order], value[order], size[order]


def _packed(code: np.ndarray, length: np.ndarray) -> bytes:
    """Codes one after the other, filled up with ones, 0xFF stuffed."""
    upto = np.cumsum(length)
    total = int(upto[-1]) if len(upto) else 0
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    each = np.repeat(np.arange(len(code)), length)
    bits[:total] = code[each] >> (upto[each] - 1 - np.arange(total)) & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def encode_jpeg(image: np.ndarray, quality: int = 75, progressive: bool = False) -> bytes:
    """A baseline file of 8-bit grey or colour pixels, colours not thinned out, with codes fitted to the image; of more channels the first are taken.

    A progressive one has a scan of the means, then one of each channel's other coefficients.
    """
    if image.dtype != np.uint8:
        raise ValueError("jpeg: only 8 bits")
    h, w = image.shape[:2]
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise ValueError("jpeg: size")
    planes = image[:, :, :1] if image.shape[2] < 3 else image[:, :, :3]
    full = np.pad(planes, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    if planes.shape[2] == 3:
        r, g, b = full.transpose(2, 0, 1)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        full = np.stack([y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128], axis=2)
    n, tables = full.shape[2], quantisers(quality)
    cut = (full - 128).reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8, n).transpose(0, 2, 4, 1, 3).reshape(-1, n, 64)
    steps = np.stack([tables[min(c, 1)] for c in range(n)])
    blocks = np.round(cut @ INVERSE.T / steps).astype(np.int64)[:, :, ZIGZAG].reshape(-1, 64)
    component = np.tile(np.arange(n), len(cut))
    table, symbol, value, size = _tokens(blocks, component)
    of, mean = table >> 1, table % 2 == 0
    table = np.where(table > 3, table - 2, table)  # both colours share theirs
    head, length, code = b"", np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
    for t in range(4 if n > 1 else 2):
        own = table == t
        counts, symbols = code_lengths(np.bincount(symbol[own], minlength=256))
        bits, sizes = codes_of(counts, symbols)
        code[own], length[own] = bits[symbol[own]], sizes[symbol[own]]
        head += b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), (t & 1) << 4 | t >> 1) + counts + symbols
    extra = np.where(value < 0, value + (1 << size) - 1, value)
    code, length = code << size | extra, length + size
    for t in range(min(n, 2)):
        head += b"\xff\xdb" + struct.pack(">HB", 67, t) + tables[t][ZIGZAG].astype(np.uint8).tobytes()
    frame = struct.pack(">HBHHB", 8 + 3 * n, 8, h, w, n) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(n))

    def scan(which: list[int], own: np.ndarray | slice, low: int, high: int) -> bytes:
        start = struct.pack(">HB", 6 + 2 * len(which), len(which)) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in which) + bytes([low, high, 0])
        return b"\xff\xda" + start + _packed(code[own], length[own])

    if progressive:
        scans = scan([*range(n)], mean, 0, 0) + b"".join(scan([c], (of == c) & ~mean, 1, 63) for c in range(n))
    else:
        scans = scan([*range(n)], slice(None), 0, 63)
    jfif = b"\xff\xe0" + struct.pack(">H5sHBHHBB", 16, b"JFIF\0", 0x0101, 0, 1, 1, 0, 0)
    return b"\xff\xd8" + jfif + head + (b"\xff\xc2" if progressive else b"\xff\xc0") + frame + scans + b"\xff\xd9"


def decode_jpeg(data: bytes) -> np.ndarray:
    """Height x width x 1 or 3, 8 bits."""
    frame, tables, adobe = _segments(data)
    across, down = max(c.across for c in frame.components), max(c.down for c in frame.components)
    planes = []
    for c in frame.components:
        if c.table not in tables or len(tables[c.table]) != 64:
            raise Broken("jpeg: no quantiser")
        if across % c.across or down % c.down:
            raise Broken("jpeg: sampling")
        planes.append(widened(_pixels(c, tables[c.table]), across // c.across, down // c.down, frame.width, frame.height))
        c.blocks = np.zeros((0, 64), np.int32)
    return _coloured(planes, adobe, [c.number for c in frame.components])
