"""Image shapes from hand-made files."""

import zlib
import struct

import numpy as np

from segstats.sources import files
from segstats.sources.headers import Shape, shape_of


def tiff(order, large, width, height, bits, samples, pad=0, blocks=None):
    """A TIFF head: the directory stands behind ``pad`` bytes, several bit depths somewhere else."""
    word = "Q" if large else "I"
    start = (16 if large else 8) + pad
    tags = [(254, 4, 1, 0), (256, 3 if width < 65536 else 4, 1, width), (257, 4, 1, height), (258, 3, len(bits), bits), (277, 3, 1, samples), (282, 5, 1, 7)]
    after = start + (8 + 20 * len(tags) if large else 2 + 12 * len(tags))
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if large else 42)
    out += struct.pack(order + "HHQ", 8, 0, start) if large else struct.pack(order + "I", start)
    out += bytes(pad) + struct.pack(order + ("Q" if large else "H"), len(tags))
    room, extra = (8 if large else 4), b""
    for tag, form, count, value in tags:
        if isinstance(value, list):
            packed = struct.pack(order + f"{count}H", *value)
            if len(packed) > room:
                extra, packed = packed, struct.pack(order + word, after)
        else:
            packed = struct.pack(order + {3: "H", 4: "I", 5: "I"}[form], value)
        out += struct.pack(order + "HH" + word, tag, form, count) + packed.ljust(room, b"\0")
    return out + extra


def jpeg(width, height, channels, before=b"", frame=0xC0):
    return b"\xff\xd8" + before + bytes([0xFF, frame]) + struct.pack(">HBHHB", 8 + 3 * channels, 8, height, width, channels) + bytes(3 * channels)


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 7, 5, 16, 2, 0, 0, 0)
SEGMENTS = b"\xff\xe0\x00\x04ab" + b"\xff\xff\xff\xfe\x00\x05xyz" + b"\xff\xc4\x00\x03q" + b"\xff\xd0"
FILES = {
    "a.tif": (tiff("<", False, 640, 480, [8], 1), Shape("tiff", 640, 480, 8, 1)),
    "b.tiff": (tiff(">", False, 70_000, 9, [16, 16, 16], 3, 100_000), Shape("tiff", 70_000, 9, 16, 3)),
    "c.ome.btf": (tiff("<", True, 123_456, 654_321, [8, 8, 8, 8, 8], 5, 33), Shape("tiff", 123_456, 654_321, 8, 5)),
    "d.ome.tf8": (tiff(">", True, 12, 34, [32], 1), Shape("tiff", 12, 34, 32, 1)),
    "e.jpg": (jpeg(300, 200, 3), Shape("jpeg", 300, 200, 8, 3)),
    "f.jpeg": (jpeg(65_535, 1, 1, SEGMENTS, 0xC2), Shape("jpeg", 65_535, 1, 8, 1)),
    "g.png": (PNG, Shape("png", 7, 5, 16, 3)),
    "h.tif": (b"no image at all", Shape()), "i.jpg": (b"\xff\xd8\xff\xe0\xff\xff", Shape()), "j.png": (b"", Shape()), "k.tif": (b"II*\0\xff\xff\xff\xff", Shape()),
}


def test_shapes_and_bytes_read():
    for name, (content, expected) in FILES.items():
        asked = []
        got = shape_of(lambda at, n: (asked.append(n), content[at:at + n])[1])
        assert got == expected, name
        assert sum(asked) < 400 and len(asked) < 12, (name, asked)


def test_folder_and_table(spark, tmp_path):
    for name, (content, _) in FILES.items():
        (tmp_path / name).write_bytes(content + bytes(1000) if content else b"")
    (tmp_path / "notes.txt").write_text("II*")
    found = {r.path.rsplit("/", 1)[1]: Shape(r.kind, r.width, r.height, r.bit_depth, r.channels) for r in files.read_headers(spark, str(tmp_path)).collect()}
    assert found == {name: shape for name, (content, shape) in FILES.items() if content}  # empty files are not listed
    frame = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in FILES.items()] + [("null", None)], "path string, content binary")
    rows = {r.path: Shape(r.kind, r.width, r.height, r.bit_depth, r.channels) for r in files.image_headers(frame).collect()}
    assert rows == {**{name: shape for name, (_, shape) in FILES.items()}, "null": Shape()}


def filtered_png(image, colour, palette=b""):
    """A PNG file whose lines use the five predictors in turn."""
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    h, w, step = image.shape
    lines, above = [], np.zeros(w * step, int)
    for y in range(h):
        line = image[y].ravel().astype(int)
        left, corner = (np.concatenate([np.zeros(step, int), v[:-step]]) for v in (line, above))
        p = left + above - corner
        near = np.abs(np.stack([p - left, p - above, p - corner])).argmin(axis=0)
        guess = [0, left, above, (left + above) // 2, np.choose(near, [left, above, corner])][y % 5]
        lines.append(bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    extra = chunk(b"PLTE", palette) if palette else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_pixels_in_tasks_are_those_of_the_image_source(spark, tmp_path, monkeypatch):
    from segstats.sources import files, headers

    rng = np.random.default_rng(3)
    monkeypatch.setattr(files, "FILES_PER_JOB", 1)
    for colour, step in ((0, 1), (2, 3), (6, 4), (3, 1)):
        palette = rng.integers(0, 256, 768).astype(np.uint8).tobytes() if colour == 3 else b""
        image = rng.integers(0, 256, (11, 7, step))
        image[..., 3:] |= 1  # a clear pixel keeps its colour
        for k in "ab":
            folder = tmp_path / f"s {colour}" / k
            folder.mkdir(parents=True)
            (folder / "x.png").write_bytes(filtered_png(image, colour, palette))
            assert headers.plain_png(lambda at, n, b=(folder / "x.png").read_bytes(): b[at:at + n]) == (colour != 3)
    assert files.list_files(spark, str(tmp_path)).count() == 8
    source = spark.read.format("image").option("recursiveFileLookup", "true").load(str(tmp_path)).select("image.*").collect()
    got = {}
    for r in files.read_pixels(spark, str(tmp_path)).collect():
        got.setdefault(r.path.replace("%20", " ").split("s ")[-1], np.full((11, 7), -1))[r.y, r.x] = r.v
    assert len(got) == len(source) == 8
    for r in source:
        data = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
        gray = data[..., 0] if r.nChannels < 3 else files.to_eight_bits(data[..., :3] @ np.array([0.114, 0.587, 0.299]))
        key = r.origin.replace("%20", " ").split("s ")[-1]
        assert (got[key] == gray).all(), key
