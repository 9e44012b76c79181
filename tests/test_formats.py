"""JPEG, interlaced and filtered PNG, tiled TIFF, reading in bands, and files that are broken."""

import struct
import zlib

import numpy as np
import pytest

from platen.sources import codecs, images, jpeg

RNG = np.random.default_rng(5)


def picture(h, w, c, step=6):
    base = RNG.integers(0, 256, (h // step + 2, w // step + 2, c))
    return np.repeat(np.repeat(base, step, axis=0), step, axis=1)[:h, :w].astype(np.uint8)


class Jdk:
    """The decoder and encoder of the Java library, as a second opinion."""

    def __init__(self, spark):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway

    def write(self, image, progressive, quality):
        h, w, c = image.shape
        picture = self.jvm.java.awt.image.BufferedImage(w, h, 10 if c == 1 else 1)
        wide = image.astype(int)
        flat = (wide[:, :, 0] if c == 1 else wide[:, :, 0] << 16 | wide[:, :, 1] << 8 | wide[:, :, 2]).reshape(-1).tolist()
        values = self.gateway.new_array(self.jvm.int, len(flat))
        for i, v in enumerate(flat):
            values[i] = v
        if c == 1:
            picture.getRaster().setPixels(0, 0, w, h, values)
        else:
            picture.setRGB(0, 0, w, h, values, 0, w)
        writer = self.jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
        settings = writer.getDefaultWriteParam()
        settings.setCompressionMode(2)
        settings.setCompressionQuality(quality)
        settings.setProgressiveMode(int(progressive))
        out = self.jvm.java.io.ByteArrayOutputStream()
        stream = self.jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, self.jvm.javax.imageio.IIOImage(picture, None, None), settings)
        stream.close()
        return bytes(out.toByteArray())

    def read(self, data):
        found = self.jvm.javax.imageio.ImageIO.read(self.jvm.java.io.ByteArrayInputStream(bytearray(data)))
        w, h, c = found.getWidth(), found.getHeight(), found.getRaster().getNumBands()
        return np.array(list(found.getRaster().getPixels(0, 0, w, h, self.gateway.new_array(self.jvm.int, w * h * c)))).reshape(h, w, c)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("shape", [(8, 8, 1), (33, 50, 1), (40, 61, 3), (17, 16, 3)])
def test_jpeg_as_another_decoder_reads_it(spark, shape, progressive):
    """Files of another encoder: colours thinned out in both directions, coefficients refined in several scans."""
    jdk, own = Jdk(spark), picture(*shape)
    for quality in (0.95, 0.5):
        data = jdk.write(own, progressive, quality)
        gap = np.abs(jdk.read(data) - codecs.decode(data, "jpeg").astype(int))
        assert gap.max() <= 3 and gap.mean() < 0.1
    data = codecs.encode(own, "jpeg")
    assert np.abs(jdk.read(data) - codecs.decode(data, "jpeg").astype(int)).max() <= 3


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_known_pixels(progressive):
    own = np.repeat(np.repeat(RNG.integers(0, 256, (5, 7, 1)).astype(np.uint8), 8, axis=0), 8, axis=1)
    assert np.array_equal(jpeg.decode_jpeg(jpeg.encode_jpeg(own, 100, progressive)), own)
    colour = picture(30, 41, 3)
    assert np.abs(jpeg.decode_jpeg(jpeg.encode_jpeg(colour, 100, progressive)).astype(int) - colour).max() <= 3


def test_jpeg_of_several_windows():
    """More than a window of codes is looked up in turns; codes longer than 16 bits are shortened."""
    own = RNG.integers(0, 256, (300, 400, 1)).astype(np.uint8)
    data = jpeg.encode_jpeg(own, 100)
    assert len(data) > 1.5 * jpeg.WINDOW
    assert np.abs(jpeg.decode_jpeg(data).astype(int) - own).max() <= 2


def test_jpeg_restarts():
    """Markers between stretches, each of one row of blocks, give the same pixels."""
    own = picture(24, 40, 1)
    parts = [jpeg.encode_jpeg(own[y : y + 8], 90) for y in (0, 8, 16)]
    split = [(d[: d.index(b"\xff\xda") + 10], d[d.index(b"\xff\xda") + 10 : -2]) for d in parts]
    tables = {h[h.index(b"\xff\xc4") : h.index(b"\xff\xdb")] for h, _ in split}
    if len(tables) > 1:  # codes are fitted to each part: take those of one for all
        blank = [jpeg.encode_jpeg(own[:8], 90)] * 3
        split = [(d[: d.index(b"\xff\xda") + 10], d[d.index(b"\xff\xda") + 10 : -2]) for d in blank]
        own = np.concatenate([own[:8]] * 3)
    head = bytearray(split[0][0])
    at = head.index(b"\xff\xc0") + 5
    head[at : at + 2] = struct.pack(">H", 24)
    head[at - 5 : at - 5] = b"\xff\xdd" + struct.pack(">HH", 4, 5)
    data = bytes(head) + b"\xff\xd0".join([split[0][1], split[1][1]]) + b"\xff\xd1" + split[2][1] + b"\xff\xd9"
    assert np.array_equal(jpeg.decode_jpeg(data), np.concatenate([jpeg.decode_jpeg(jpeg.encode_jpeg(own[y : y + 8], 90)) for y in (0, 8, 16)]))


def test_cut_off_jpegs_are_refused():
    for progressive in (False, True):
        data = jpeg.encode_jpeg(picture(37, 53, 3), 60, progressive)
        for cut in range(0, len(data) - 2, 11):
            with pytest.raises(codecs.Unsupported):
                codecs.decode(data[:cut], "jpeg")


def test_gif_as_another_encoder_writes_it(spark):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    for h, w, step in ((9, 14, 3), (60, 80, 1), (150, 150, 1)):
        grey = picture(h, w, 1, step)
        own = jvm.java.awt.image.BufferedImage(w, h, 10)
        values = gateway.new_array(jvm.int, h * w)
        for i, v in enumerate(grey.reshape(-1).tolist()):
            values[i] = v
        own.getRaster().setPixels(0, 0, w, h, values)
        out = jvm.java.io.ByteArrayOutputStream()
        assert jvm.javax.imageio.ImageIO.write(own, "gif", out)
        data = bytes(out.toByteArray())
        found = codecs.decode(data, "gif")
        assert np.array_equal(found[:, :, :3], np.repeat(grey, 3, axis=2)) and (found[:, :, 3] == 255).all()
        for cut in range(0, len(data) - 2, max(1, len(data) // 40)):
            with pytest.raises(codecs.Unsupported):
                codecs.decode(data[:cut], "gif")


def test_interlaced_and_clear_gif():
    """Three colours, five rows in passes, the first colour clear, on a larger canvas."""
    numbers = RNG.integers(0, 3, (5, 3))
    order = [0, 4, 2, 1, 3]
    bits = "".join(f"{c:03b}"[::-1] for c in [n for v in numbers[order].reshape(-1).tolist() for n in (4, v)] + [5])  # a clear code before each keeps codes short
    codes = np.packbits(np.array(list(bits), np.uint8), bitorder="little").tobytes()
    data = b"GIF89a" + struct.pack("<HHBBB", 6, 8, 0xA1, 0, 0) + bytes([1, 2, 3, 40, 50, 60, 70, 80, 90, 0, 0, 0]) + b"\x21\xf9\x04\x01\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 1, 2, 3, 5, 0x40) + bytes([2, len(codes)]) + codes + b"\0\x3b"
    found = codecs.decode(data, "gif")
    assert found.shape == (8, 6, 4) and not found[:2].any() and not found[:, 0].any() and not found[7].any()
    colours = np.array([[1, 2, 3, 0], [40, 50, 60, 255], [70, 80, 90, 255]])
    assert np.array_equal(found[2:7, 1:4], colours[numbers])


def test_tga_plain_and_in_runs():
    for c in (1, 3, 4):
        own = picture(13, 21, c, 4)
        assert np.array_equal(codecs.decode(codecs.encode(own, "tga"), "tga"), own)
        body = b""
        for row in own[::-1]:
            for p in (row if c == 1 else row[:, [2, 1, 0, 3][:c]]):
                body += b"\x80" + bytes(p.tolist()) if RNG.random() < 0.5 else b"\x00" + bytes(p.tolist())
        assert np.array_equal(codecs.decode(struct.pack("<BBBHHBHHHHBB", 0, 0, 11 if c == 1 else 10, 0, 0, 0, 0, 0, 21, 13, 8 * c, 0) + body, "tga"), own)
    with pytest.raises(codecs.Unsupported):
        codecs.encode(np.zeros((2, 2, 2), np.uint8), "tga")


def test_icons():
    own = picture(17, 9, 4, 3)
    assert np.array_equal(codecs.decode(codecs.encode(own, "ico"), "ico"), own)
    with pytest.raises(codecs.Unsupported):
        codecs.encode(picture(300, 9, 3), "ico")
    rows = own[::-1, :, [2, 1, 0]].reshape(17, -1)
    mask = np.packbits(np.pad(own[::-1, :, 3] < 128, ((0, 0), (0, 23))), axis=1).tobytes()
    body = struct.pack("<IiiHHIIiiII", 40, 9, 34, 1, 24, 0, 0, 0, 0, 0, 0) + np.pad(rows, ((0, 0), (0, 1))).tobytes() + mask
    small = codecs.encode(own[:4, :4], "png")
    data = struct.pack("<HHH", 0, 1, 2) + struct.pack("<BBBBHHII", 4, 4, 0, 0, 1, 32, len(small), 38) + struct.pack("<BBBBHHII", 9, 17, 0, 0, 1, 24, len(body), 38 + len(small)) + small + body
    found = codecs.decode(data, "ico")
    assert np.array_equal(found[:, :, :3], own[:, :, :3]) and np.array_equal(found[:, :, 3], np.where(own[:, :, 3] < 128, 0, 255))


def test_qoi():
    for c in (3, 4):
        own = np.concatenate([picture(13, 21, c, 4), np.full((5, 21, c), 9, np.uint8)])
        assert np.array_equal(codecs.decode(codecs.encode(own, "qoi"), "qoi"), own)
    steps = bytes([0xFE, 10, 20, 30, 0x40 | 3 << 4 | 2 << 2 | 1, 0x80 | 40, 0x9F, 0xC1, 0xFF, 1, 2, 3, 4, (10 * 3 + 20 * 5 + 30 * 7 + 255 * 11) % 64])
    data = struct.pack(">4sIIBB", b"qoif", 7, 1, 4, 0) + steps + bytes(7) + b"\1"
    assert codecs.decode(data, "qoi")[0].tolist() == [[10, 20, 30, 255], [11, 20, 29, 255], [20, 28, 44, 255], [20, 28, 44, 255], [20, 28, 44, 255], [1, 2, 3, 4], [10, 20, 30, 255]]


def filtered(rows, kinds, back):
    """Rows with each one's filter, pixel by pixel as the format says."""
    out, above = b"", [0] * rows.shape[1]
    for kind, row in zip(kinds, rows.tolist(), strict=True):
        line = []
        for i, v in enumerate(row):
            a, b, c = (row[i - back] if i >= back else 0), above[i], (above[i - back] if i >= back else 0)
            near = min(((abs(a + b - c - v_), n, v_) for n, v_ in enumerate((a, b, c))))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out, above = out + bytes([kind, *line]), row
    return out


def png(image, depth=8, interlaced=False, kinds=None):
    h, w, c = image.shape
    back = max(1, c * depth // 8)

    def lines(part):
        if depth < 8:
            return np.packbits(np.unpackbits(part.reshape(len(part), -1, 1), axis=2)[:, :, 8 - depth :].reshape(len(part), -1), axis=1)
        return np.ascontiguousarray(part.astype(">u2") if depth == 16 else part).view(np.uint8).reshape(len(part), -1)

    raw = b""
    for x, y, across, down in codecs.PASSES if interlaced else [(0, 0, 1, 1)]:
        part = np.ascontiguousarray(image[y::down, x::across])
        if part.size:
            raw += filtered(lines(part), RNG.integers(0, 5, len(part)) if kinds is None else kinds, back)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return codecs.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, int(interlaced))) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
def test_png_filters_and_passes(interlaced):
    for _ in range(60):
        h, w, c = (int(v) for v in (RNG.integers(1, 20), RNG.integers(1, 20), RNG.integers(1, 5)))
        depth = int(RNG.choice([1, 2, 4, 8, 16])) if c == 1 else int(RNG.choice([8, 16]))
        own = RNG.integers(0, 1 << depth, (h, w, c)).astype(np.uint16 if depth == 16 else np.uint8)
        wanted = own * (255 // ((1 << depth) - 1)) if depth < 8 else own
        assert np.array_equal(codecs.decode(png(own, depth, interlaced), "png"), wanted)


def test_files_in_bands():
    own = RNG.integers(0, 256, (45, 13, 3)).astype(np.uint8)
    tiled = codecs.tiff_file((45, 13, 3, 1), [codecs.deflated(np.pad(own, ((0, 3), (0, 3), (0, 0)))[y : y + 16, :16]) for y in (0, 16, 32)], tile=16)
    for data, form in ((png(own), "png"), (png(own, interlaced=True), "png"), (codecs.encode(own, "tiff"), "tiff"), (tiled, "tiff"), (codecs.encode(own, "bmp"), "bmp")):
        for rows in (1, 7, 16, 100):
            parts = list(codecs.bands(data, form, rows))
            assert all(len(p) == rows for p in parts[:-1]) and np.array_equal(np.concatenate(parts), own)
        assert codecs.size_of(data, form) == (13, 45)
        assert np.array_equal(codecs.decode(data, form), own)


def test_broken_files_are_refused_and_keep_their_rows(spark):
    own, rows = RNG.integers(0, 256, (20, 20, 3)).astype(np.uint8), []
    good = {form: codecs.encode(own, form) for form in codecs.ENCODERS}
    for form, data in good.items():
        for n in range(400):
            spoilt = bytearray(data)
            for _ in range(RNG.integers(1, 4)):
                spoilt[RNG.integers(0, min(len(spoilt), 200 if n % 2 else len(spoilt)))] = RNG.integers(0, 256)
            if n % 3 == 0:
                spoilt = spoilt[: RNG.integers(0, len(spoilt))]
            try:
                assert codecs.decode(bytes(spoilt), form).ndim == 3
            except codecs.Unsupported:
                if len(rows) < 200:
                    rows.append((f"{form}{n}", spoilt, form))
    files = spark.createDataFrame([*rows, ("none", None, "png"), ("odd", bytearray(b"x"), None)], "path string, content binary, format string")
    read = images.decode_images(files).collect()
    assert len(read) == len(rows) + 2 and all(r.error and r.data is None for r in read)
