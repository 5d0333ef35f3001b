"""Shapes of PNG, TIFF and JPEG files from their headers, without reading pixels.

Each reader takes a function ``at(offset, length)`` that returns bytes of the file, so that a file in any store costs a few ranged
reads: PNG has its shape in the first 26 bytes; TIFF (both byte orders, also with 64-bit offsets) in the first directory of tags,
wherever that lies; JPEG in the frame segment, which is reached by hopping from segment to segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

At = Callable[[int, int], bytes]


class Shape(NamedTuple):
    kind: str | None = None
    width: int | None = None
    height: int | None = None
    bit_depth: int | None = None
    channels: int | None = None


SCHEMA = "kind string, width bigint, height bigint, bit_depth int, channels int"
# Fixed values of the formats: PNG colour types with their channels; TIFF tags and integer types; JPEG frame segments.
PNG_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}
WIDTH, HEIGHT, BITS, SAMPLES = 256, 257, 258, 277
TIFF_INTEGERS = {1: "B", 3: "H", 4: "I", 16: "Q"}
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
ALONE = {0x01, *range(0xD0, 0xD8)}
MOST_TAGS, MOST_SEGMENTS = 4096, 4096


def png_shape(at: At) -> Shape:
    head = at(0, 26)
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    return Shape("png", width, height, bits, PNG_CHANNELS.get(colour))


PNG_START = b"\x89PNG\r\n\x1a\n"


def plain_png(at: At) -> bool:
    """A PNG file of 8-bit gray or colour channels: no palette, no transparent colour, not interlaced."""
    head = at(0, 33)
    if len(head) < 33 or head[:8] != PNG_START or head[24] != 8 or head[25] not in (0, 2, 4, 6) or head[28]:
        return False
    place = 33
    for _ in range(MOST_SEGMENTS):
        length, kind = struct.unpack(">I4s", at(place, 8).ljust(8, b"\0"))
        if kind in (b"IDAT", b"tRNS", b"\0\0\0\0"):
            return kind == b"IDAT"
        place += length + 12
    return False


def _paeth(raw: np.ndarray, above: np.ndarray, step: int) -> None:
    """Undo the predictor of a line in place, pixel by pixel."""
    line, up = raw.tolist(), above.tolist()
    for i in range(len(line)):
        a, b, c = (line[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        line[i] = (line[i] + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
    raw[:] = line


def png_pixels(content: bytes) -> np.ndarray:
    """``(height, width, channels)`` of a file that is ``plain_png``; colours come as blue, green, red as in Spark's image source."""
    width, height, _, colour = struct.unpack(">IIBB", content[16:26])
    step, packed, place = {0: 1, 2: 3, 4: 2, 6: 4}[colour], [], 33
    while place + 8 <= len(content):
        length, kind = struct.unpack(">I4s", content[place:place + 8])
        if kind == b"IDAT":
            packed.append(content[place + 8:place + 8 + length])
        elif kind == b"IEND":
            break
        place += length + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)[:height * (1 + width * step)].reshape(height, 1 + width * step)
    out = lines[:, 1:].copy()
    above = np.zeros(width * step, np.uint8)
    for y, form in enumerate(lines[:, 0].tolist()):
        line = out[y]
        if form == 1:
            line[:] = np.cumsum(line.reshape(width, step), axis=0, dtype=np.uint8).ravel()
        elif form == 2:
            line += above
        elif form == 3:
            left = [0] * step
            for i, (value, up) in enumerate(zip(line.tolist(), above.tolist())):
                left.append((value + (left[i] + up) // 2) & 255)
            line[:] = left[step:]
        elif form == 4:
            _paeth(line, above, step)
        above = line
    out = out.reshape(height, width, step)
    return out[..., [2, 1, 0]] if step > 2 else out[..., :1]


def tiff_shape(at: At) -> Shape:
    """The first image of the file; a missing tag has the format's default."""
    head = at(0, 16)
    order = "<" if head[:2] == b"II" else ">"
    large = struct.unpack(order + "H", head[2:4])[0] == 43
    first = struct.unpack(order + ("Q" if large else "I"), head[8:16] if large else head[4:8])[0]
    count_form, entry, inline = ("Q", 20, 8) if large else ("H", 12, 4)
    size = struct.calcsize(count_form)
    n = struct.unpack(order + count_form, at(first, size))[0]
    if n > MOST_TAGS:
        raise ValueError("no directory of tags")
    table, found = at(first + size, n * entry), {}
    for k in range(n):
        row = table[k * entry:(k + 1) * entry]
        tag, form = struct.unpack(order + "HH", row[:4])
        if tag not in (WIDTH, HEIGHT, BITS, SAMPLES) or form not in TIFF_INTEGERS:
            continue
        count = struct.unpack(order + ("Q" if large else "I"), row[4:4 + inline])[0]
        value = row[4 + inline:]
        one = struct.calcsize(order + TIFF_INTEGERS[form])
        if count * one > inline:  # more values than fit are somewhere else; the first decides
            value = at(struct.unpack(order + ("Q" if large else "I"), value[:inline])[0], one)
        found[tag] = struct.unpack(order + TIFF_INTEGERS[form], value[:one])[0]
    return Shape("tiff", found[WIDTH], found[HEIGHT], found.get(BITS, 1), found.get(SAMPLES, 1))


def jpeg_shape(at: At) -> Shape:
    place = 2
    for _ in range(MOST_SEGMENTS):
        head = at(place, 10)
        if len(head) < 4 or head[0] != 0xFF:
            break
        marker = head[1]
        if marker == 0xFF or marker in ALONE:  # filling, or a segment without length
            place += 1 if marker == 0xFF else 2
            continue
        if marker in FRAMES:
            bits, height, width, channels = struct.unpack(">BHHB", head[4:10])
            return Shape("jpeg", width, height, bits, channels)
        place += 2 + struct.unpack(">H", head[2:4])[0]
    raise ValueError("no frame")


def shape_of(at: At) -> Shape:
    """Shape of a file of any known format; nulls for other or broken files."""
    try:
        head = at(0, 8)
        if head == b"\x89PNG\r\n\x1a\n":
            return png_shape(at)
        if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
            return tiff_shape(at)
        if head[:2] == b"\xff\xd8":
            return jpeg_shape(at)
    except (struct.error, ValueError, KeyError, IndexError):
        pass
    return Shape()


def shapes(batch: pa.RecordBatch, each: Iterator[Shape]) -> pa.RecordBatch:
    """``batch`` without its content, with the shapes beside."""
    kept = [k for k, name in enumerate(batch.schema.names) if name != "content"]
    fields = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = [pa.array(list(c), f) for c, f in zip(zip(*each), fields)] if batch.num_rows else [pa.array([], f) for f in fields]
    return pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *columns], names=[*[batch.schema.names[k] for k in kept], *Shape._fields])
