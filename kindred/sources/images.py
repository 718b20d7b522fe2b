"""Pixels of images, from the public formats: PNG, baseline JPEG and plain BMP, turned upright as their EXIF data ask.

What cannot be decoded (other formats, progressive or four-colour JPEG, broken or cut-off files, more than MOST_PIXELS) has no pixels.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd

from kindred.sources import parsers

MOST_PIXELS = 178_956_970

#: Where the k-th coefficient of a block belongs: along its diagonals, each in the other direction than the one before.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else -(i // 8))))
#: Row u: the u-th cosine of eight samples.
COSINES = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(8) + 1) / 16) * np.where(np.arange(8)[:, None], 0.5, np.sqrt(0.125))

#: How to turn pixels by the EXIF orientation.
UPRIGHT = {
    2: lambda p: p[:, ::-1],
    3: lambda p: p[::-1, ::-1],
    4: lambda p: p[::-1],
    5: lambda p: p.swapaxes(0, 1),
    6: lambda p: np.rot90(p, -1),
    7: lambda p: p[::-1, ::-1].swapaxes(0, 1),
    8: lambda p: np.rot90(p),
}


def orientation(tiff: bytes) -> int:
    """The EXIF orientation in a TIFF header's first directory; 1 if none is there."""
    try:
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        at = struct.unpack_from(order + "I", tiff, 4)[0]
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
            if tag == 0x0112 and kind == 3:
                return value
    except (KeyError, struct.error):
        pass
    return 1


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """Of any 16 bits: length << 8 | symbol of the code that they begin with; 0 if with none."""
    lengths = np.repeat(np.arange(1, 17), list(counts))
    known = np.repeat(lengths << 8 | np.frombuffer(symbols[: len(lengths)], np.uint8), 1 << (16 - lengths))
    return np.pad(known, (0, (1 << 16) - len(known))).tolist()


def _coefficients(data: bytes, blocks) -> tuple[list[int], list[int]]:
    """Places and values in a run of blocks: (where it begins, tables of its first and its other values, component)."""
    places, values, last = [], [], {}
    held = bits = at = 0
    for begin, first, others, component in blocks:
        i = 0
        while i < 64:
            while bits < 32:  # a code and its value take 31 at most
                held, at, bits = held << 8 | (data[at] if at < len(data) else 0), at + 1, bits + 8
            code = (others if i else first)[held >> (bits - 16) & 0xFFFF]
            bits -= code >> 8
            run, size = (code >> 4 & 15, code & 15) if i else (0, code & 255)
            if not code or size > 15:
                raise ValueError("no code")
            if i and not size:
                held &= (1 << bits) - 1
                if run < 15:
                    break
                i += 16
                continue
            i, bits = i + run, bits - size
            value = held >> bits & (1 << size) - 1
            if size and value < 1 << size - 1:
                value -= (1 << size) - 1
            held &= (1 << bits) - 1
            if i == 0:
                value = last[component] = last.get(component, 0) + value
            elif i > 63:
                raise ValueError("a run beyond its block")
            places.append(begin + i)
            values.append(value)
            i += 1
    if at - bits // 8 > len(data):
        raise ValueError("cut off")
    return places, values


class _Jpeg:
    def __init__(self, data: bytes):
        self.data, self.tables, self.weights, self.restart, self.turn, self.adobe, self.parts = data, {}, {}, 0, 1, None, []

    def pixels(self) -> np.ndarray | None:
        data, at = self.data, 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("no marker")
            mark = data[at + 1]
            if mark == 0xFF or mark == 1 or 0xD0 <= mark <= 0xD7:
                at += 1 if mark == 0xFF else 2
                continue
            if mark == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if mark == 0xC4:
                self._huffman(body)
            elif mark == 0xDB:
                self._quantities(body)
            elif mark in (0xC0, 0xC1):
                if not self._frame(body):
                    return None
            elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
                return None  # progressive, lossless or arithmetic
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark == 0xE1 and body[:6] == b"Exif\0\0":
                self.turn = orientation(body[6:])
            elif mark == 0xEE and body[:5] == b"Adobe":
                self.adobe = body[11]
            elif mark == 0xDA:
                end = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]").search(data, at)
                self._scan(body, data[at : end.start() if end else len(data)])
                at = end.start() if end else len(data)
        return self._picture() if self.parts else None

    def _huffman(self, body: bytes):
        while body:
            n = sum(body[1:17])
            self.tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _quantities(self, body: bytes):
        while body:
            wide, at = body[0] >> 4, body[0] & 15
            self.weights[at] = np.frombuffer(body[1:], ">u2" if wide else "u1", 64).astype(np.int32)
            body = body[1 + 64 * (2 if wide else 1) :]

    def _frame(self, body: bytes) -> bool:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or n not in (1, 3) or not 0 < self.height * self.width <= MOST_PIXELS:
            return False
        every = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.across, self.down = max(h for _, h, _, _ in every), max(v for _, _, v, _ in every)
        self.columns, self.rows = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        begin = 0
        for name, h, v, weights in every:
            self.parts.append((name, h, v, weights, begin))
            begin += self.columns * h * self.rows * v * 64
        self.values = np.zeros(begin, np.int32)
        return True

    def _blocks(self, chosen: list, first: int, last: int, wide: int):
        """Blocks of the units from first to before last; a scan of one component has a block a unit, without padding."""
        for unit in range(first, last):
            y, x = divmod(unit, wide)
            for (_, h, v, _, begin), dc, ac, k in chosen:
                h_, v_ = (1, 1) if len(chosen) == 1 else (h, v)
                for row in range(y * v_, (y + 1) * v_):
                    for column in range(x * h_, (x + 1) * h_):
                        yield begin + (row * self.columns * h + column) * 64, dc, ac, k

    def _scan(self, body: bytes, data: bytes):
        chosen = []
        for j in range(body[0]):
            name, which = body[1 + 2 * j : 3 + 2 * j]
            k = [p[0] for p in self.parts].index(name)
            chosen.append((self.parts[k], self.tables[which >> 4], self.tables[0x10 | which & 15], k))
        wide, high = self.columns, self.rows
        if len(chosen) == 1:
            (_, h, v, _, _), *_ = chosen[0]
            wide, high = -(-(-(-self.width * h // self.across)) // 8), -(-(-(-self.height * v // self.down)) // 8)
        step = self.restart or wide * high
        runs = re.split(rb"\xff[\xd0-\xd7]", data)
        if len(runs) < -(-wide * high // step):
            raise ValueError("cut off")
        for k, first in enumerate(range(0, wide * high, step)):
            places, values = _coefficients(runs[k].replace(b"\xff\0", b"\xff"), self._blocks(chosen, first, min(first + step, wide * high), wide))
            self.values[places] = values

    def _picture(self) -> np.ndarray:
        planes = []
        for _, h, v, weights, begin in self.parts:
            rows, columns = self.rows * v, self.columns * h
            held = self.values[begin : begin + rows * columns * 64].reshape(-1, 64) * self.weights[weights]
            blocks = np.empty(held.shape, np.float32)
            blocks[:, ZIGZAG] = held
            blocks = COSINES.T.astype(np.float32) @ blocks.reshape(-1, 8, 8) @ COSINES.astype(np.float32) + 128
            plane = blocks.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
            plane = plane.repeat(self.down // v, 0).repeat(self.across // h, 1)
            planes.append(np.clip(np.rint(plane[: self.height, : self.width]), 0, 255))
        if len(planes) == 1:
            planes *= 3
        elif self.adobe != 0 and [p[0] for p in self.parts] != list(b"RGB"):
            y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
            planes = [y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue]
        return UPRIGHT.get(self.turn, lambda p: p)(np.clip(np.rint(np.stack(planes, 2)), 0, 255).astype(np.uint8))


def jpeg_pixels(data: bytes) -> np.ndarray | None:
    """Height x width x 3 values of a baseline JPEG, upright; null for anything else."""
    try:
        return _Jpeg(data).pixels() if data[:3] == b"\xff\xd8\xff" else None
    except (struct.error, ValueError, IndexError, KeyError):
        return None


def bmp_pixels(data: bytes) -> np.ndarray | None:
    """Of an uncompressed BMP of 8 (by palette), 24 or 32 bits a pixel; null for anything else."""
    try:
        if data[:2] != b"BM":
            return None
        begin, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
        if packed or bits not in (8, 24, 32) or width <= 0 or not 0 < width * abs(height) <= MOST_PIXELS:
            return None
        n, line = bits // 8, -(-width * bits // 32) * 4
        rows = np.frombuffer(data, np.uint8, line * abs(height), begin).reshape(abs(height), line)[:, : width * n].reshape(abs(height), width, n)
        if n == 1:
            rows = np.frombuffer(data[14 + header : begin], np.uint8).reshape(-1, 4)[rows[:, :, 0]]
        rows = rows[:, :, 2::-1]
        return rows[::-1] if height > 0 else rows
    except (struct.error, ValueError, IndexError):
        return None


def _png(data: bytes) -> np.ndarray | None:
    found = parsers.png_pixels(data)
    at = data.find(b"eXIf") if found is not None else -1
    if at < 4:
        return found
    return UPRIGHT.get(orientation(data[at + 4 : at + 4 + struct.unpack_from(">I", data, at - 4)[0]]), lambda p: p)(found)


def pixels(data: bytes) -> np.ndarray | None:
    """Height x width x 3 values, upright; null where no decoder knows the data."""
    for decode in (_png, jpeg_pixels, bmp_pixels):
        found = decode(data)
        if found is not None:
            return found if found.size else None
    return None


@parsers.arrow_udf("struct<perceptual_hash:string,width:int,height:int>")
def image_udf(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        p = None if data is None else pixels(bytes(data))
        rows.append((None, None, None) if p is None else (parsers.perceptual_hash(p), p.shape[1], p.shape[0]))
    return pd.DataFrame(rows, columns=["perceptual_hash", "width", "height"]).astype({"width": "Int32", "height": "Int32"})
