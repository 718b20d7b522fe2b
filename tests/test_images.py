"""Decoders of images against pixels that are known, by an encoder of the plainest JPEG."""

import struct
import zlib

import numpy as np
import pytest

from kindred.sources import images, parsers

AC = [run << 4 | size for run in range(16) for size in range(1, 11)] + [0x00, 0xF0]


def jpeg(pixels, sampling=(1, 1), restart=0, exif=b"", grey=False, apart=False, frame=0xC0):
    """Baseline JPEG of nearly no loss; apart: a scan for each component, otherwise one for all."""
    height, width, _ = pixels.shape
    r, g, b = (pixels[:, :, k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y] if grey else [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    across, down = (1, 1) if grey else sampling
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    shapes = [(across, down), (1, 1), (1, 1)][: len(planes)]
    grids = []
    for plane, (h, v) in zip(planes, shapes, strict=True):
        plane = np.pad(plane, ((0, rows * down * 8 - height), (0, columns * across * 8 - width)), "edge")
        plane = plane.reshape(plane.shape[0] // (down // v), down // v, plane.shape[1] // (across // h), across // h).mean((1, 3)) - 128
        blocks = plane.reshape(rows * v, 8, columns * h, 8).swapaxes(1, 2)
        grids.append(np.rint(images.COSINES @ blocks @ images.COSINES.T).astype(int).reshape(rows * v, columns * h, 64)[:, :, images.ZIGZAG])

    def encoded(order):
        out, last = [], {}
        number = lambda v, size: format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""
        for k, row, column in order:
            block = grids[k][row, column].tolist()
            change, last[k] = block[0] - last.get(k, 0), block[0]
            out.append(format(abs(change).bit_length(), "04b") + number(change, abs(change).bit_length()))
            zeros = 0
            for v in block[1:]:
                if v:
                    out += ["{:08b}".format(AC.index(0xF0))] * (zeros // 16)
                    size = abs(v).bit_length()
                    out.append("{:08b}".format(AC.index(zeros % 16 << 4 | size)) + number(v, size))
                    zeros = -1
                zeros += 1
            if zeros:
                out.append("{:08b}".format(AC.index(0)))
        bits = "".join(out)
        bits += "1" * (-len(bits) % 8)
        return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0")

    part = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + (part(0xE1, b"Exif\0\0" + exif) if exif else b"") + part(0xDB, b"\0" + b"\1" * 64)
    out += part(frame, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(shapes)))
    out += part(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\x10" + bytes([0] * 7 + [len(AC)] + [0] * 8) + bytes(AC))
    out += part(0xDD, struct.pack(">H", restart)) if restart else b""
    units = []
    for y_ in range(rows):
        for x_ in range(columns):
            units.append([(k, y_ * v + j, x_ * h + i) for k, (h, v) in enumerate(shapes) for j in range(v) for i in range(h)])
    scans = [(list(range(len(planes))), units)]
    if apart:  # only blocks that hold pixels
        scans = [([k], [[(k, a, b)] for a in range(-(-(-(-height * v // down)) // 8)) for b in range(-(-(-(-width * h // across)) // 8))]) for k, (h, v) in enumerate(shapes)]
    for names, given in scans:
        out += part(0xDA, bytes([len(names)]) + b"".join(bytes([k + 1, 0]) for k in names) + b"\0\x3f\0")
        step = restart or len(given)
        runs = [encoded([x for unit in given[i : i + step] for x in unit]) for i in range(0, len(given), step)]
        out += runs[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + run for i, run in enumerate(runs[1:]))
    return out + b"\xff\xd9"


def png(pixels, exif=b""):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    height, width, _ = pixels.shape
    rows = b"".join(b"\0" + line.tobytes() for line in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tiff(turn, order="<"):
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, turn, 0, 0)


@pytest.fixture(scope="module")
def picture():
    y, x = np.mgrid[:45, :61]
    return np.stack([(x * 4) % 256, (y * 5 + x) % 256, (x * y) // 11 % 256], 2).astype(np.uint8)


@pytest.fixture(scope="module")
def smooth():
    """Colours that change slowly, light that does not: of a picture without texture most bits of the hash are rounding."""
    y, x = np.mgrid[:45, :61] / 60
    light = np.random.default_rng(3).integers(-50, 50, (12, 16)).repeat(4, 0).repeat(4, 1)[:45, :61, None]
    return (np.stack([60 + 130 * x, 100 * y + 70, 120 + 60 * np.sin(5 * x + 3 * y)], 2) + light).clip(0, 255).astype(np.uint8)


def bits(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


@pytest.mark.parametrize("given", [{}, {"restart": 3}, {"apart": True}, {"apart": True, "restart": 5}])
def test_jpeg_of_full_sampling_is_the_picture(picture, given):
    found = images.pixels(jpeg(picture, **given))
    assert found.shape == picture.shape and np.abs(found.astype(int) - picture).max() <= 4
    assert bits(parsers.perceptual_hash(found), parsers.perceptual_hash(picture)) <= 2


@pytest.mark.parametrize("sampling", [(2, 1), (1, 2), (2, 2)])
@pytest.mark.parametrize("given", [{}, {"restart": 2}, {"apart": True}])
def test_jpeg_of_fewer_colour_samples(smooth, sampling, given):
    found = images.pixels(jpeg(smooth, sampling, **given))
    assert found.shape == smooth.shape and np.abs(found.astype(int) - smooth).mean() < 3
    assert bits(parsers.perceptual_hash(found), parsers.perceptual_hash(images.pixels(png(smooth)))) <= 2


def test_grey_jpeg(picture):
    found = images.pixels(jpeg(picture, grey=True))
    assert (found[:, :, 0] == found[:, :, 2]).all() and np.abs(found[:, :, 0] - picture @ np.array([0.299, 0.587, 0.114])).max() < 3


@pytest.mark.parametrize("order", "<>")
def test_upright(smooth, order):
    """Each orientation is undone: how a viewer would have to hold the stored pixels."""
    stored = {1: smooth, 2: smooth[:, ::-1], 3: smooth[::-1, ::-1], 4: smooth[::-1], 5: smooth.swapaxes(0, 1), 6: np.rot90(smooth), 7: smooth[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(smooth, -1), 9: smooth}
    for turn, p in stored.items():
        p = np.ascontiguousarray(p)
        assert (images.pixels(png(p, tiff(turn, order))) == smooth).all(), turn
        assert np.abs(images.pixels(jpeg(p, exif=tiff(turn, order))).astype(int) - smooth).max() <= 4, turn


def test_bmp(picture):
    height, width, _ = picture.shape
    for bits_, up in ((24, True), (32, False)):
        raw = np.zeros((height, -(-width * bits_ // 32) * 4), np.uint8)
        raw[:, : width * bits_ // 8].reshape(height, width, bits_ // 8)[:, :, :3] = picture[:, :, ::-1]
        body = (raw[::-1] if up else raw).tobytes()
        data = b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(body), 0, 54, 40, width, height if up else -height, 1, bits_, 0, 0, 0, 0, 0, 0) + body
        assert (images.pixels(data) == picture).all()
        assert images.pixels(data[:-5]) is None


def test_what_has_no_pixels(picture):
    data = jpeg(picture)
    broken = [b"", b"x", b"\xff\xd8\xff", data[:40], data[: len(data) // 2], jpeg(picture, frame=0xC2), jpeg(picture, restart=3)[:-600], b"GIF89a" + bytes(40), b"BM" + bytes(60), data.replace(b"\xff\xda\0\x0c\3", b"\xff\xda\0\x0c\x09")]
    assert [images.pixels(x) for x in broken] == [None] * len(broken)
    assert images.orientation(b"II*\0\xff\xff\0\0") == images.orientation(b"") == images.orientation(b"??") == 1


def test_udf(spark, picture):
    rows = [(1, jpeg(picture)), (2, png(picture)), (3, b"no"), (4, None)]
    found = {r.id: r.i for r in spark.createDataFrame(rows, "id int, content binary").select("id", images.image_udf("content").alias("i")).collect()}
    assert bits(found[1].perceptual_hash, found[2].perceptual_hash) <= 2 and (found[1].width, found[1].height) == (61, 45)
    assert found[3].perceptual_hash is None and found[3].width is None and (found[4] is None or found[4].width is None)
