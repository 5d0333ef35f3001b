"""Rasters as blocks of pixels, and model scores over sliding windows on them.

A block is one row with its pixels as bytes (32-bit floats, row-major). A window takes slices from the blocks that it crosses, at most
four if it is no larger than a block; scores go back as slices of blocks and are added there in arrays. What is shuffled are slices,
some thousand pixels a row, never single pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.operators.grouped import changes, ints, stream_groups
from segstats.operators.runs import div

BLOCK = 512
#: Rows of slices that a task holds at a time.
WINDOW_ROWS, SCORE_ROWS = 256, 32
PLACE = "height int, width int, top int, left int, h int, w int"
SLICE = "height int, width int, oy int, ox int, top int, left int, h int, w int"


def kind_of(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


@lru_cache(maxsize=1024)
def origins(length: int, patch: int, step: float) -> np.ndarray:
    """Different window origins along one axis, as in ``patches.windows``."""
    room = max(length - patch, 0)
    count = int(np.ceil(room / (patch * step))) + 1
    return np.unique(np.rint(np.arange(count) * (room / (count - 1) if count > 1 else 0.0)).astype(np.int64))


def crossing(low: int, high: int, length: int, patch: int, step: float) -> np.ndarray:
    """Origins of the windows that cover a place in ``low .. high - 1``."""
    spots = origins(length, patch, step)
    return spots[np.searchsorted(spots, low - patch, "right"):np.searchsorted(spots, high, "left")]


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def table_schema(image_type: pa.DataType, names: str, data: str = "data") -> pa.Schema:
    return pa.schema([("image_id", image_type), *[(n, pa.int32()) for n in names.split()], (data, pa.binary())])


def _pack(table: pa.Table, block: int) -> pa.Table:
    """Pixels of whole blocks as arrays; a pixel that is missing is 0."""
    starts = np.append(np.flatnonzero(changes(table, ["image_id", "by", "bx"])), table.num_rows)
    y, x, v = ints(table, "y"), ints(table, "x"), table["v"].to_numpy()
    height, width, ids = ints(table, "height"), ints(table, "width"), table["image_id"]
    rows = []
    for lo, hi in zip(starts[:-1], starts[1:]):
        top, left = int(y[lo]) // block * block, int(x[lo]) // block * block
        grid = np.zeros((min(block, int(height[lo]) - top), min(block, int(width[lo]) - left)), np.float32)
        grid[y[lo:hi] - top, x[lo:hi] - left] = v[lo:hi]
        rows.append((ids[int(lo)].as_py(), int(height[lo]), int(width[lo]), top, left, *grid.shape, grid.tobytes()))
    return rows_of(table_schema(ids.type, "height width top left h w"), rows)


def to_blocks(pixels: DataFrame, images: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks ``(image_id, height, width, top, left, h, w, data)`` of pixels ``(image_id, y, x, v)``."""
    placed = pixels.join(images.select("image_id", "height", "width"), "image_id").select(
        "image_id", div("y", block).alias("by"), div("x", block).alias("bx"), "y", "x", "height", "width", F.col("v").cast("float").alias("v")
    )
    return stream_groups(placed, ["image_id", "by", "bx"], [], partial(_pack, block=block), f"image_id {kind_of(pixels)}, {PLACE}, data binary")


def image_blocks(images: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of ``images (image_id, height, width, values)`` that come whole in a row-major array each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, height, width, values in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                grid = np.array(values, np.float32).reshape(height, width)
                for top in range(0, height, block):
                    for left in range(0, width, block):
                        part = grid[top:top + block, left:left + block]
                        rows.append((image, height, width, top, left, *part.shape, part.tobytes()))
            yield from rows_of(table_schema(batch.schema.field(0).type, "height width top left h w"), rows).to_batches()

    return images.select("image_id", "height", "width", "values").mapInArrow(run, f"image_id {kind_of(images)}, {PLACE}, data binary")


def window_slices(blocks: DataFrame, patch: tuple[int, int], step: float = 0.5) -> DataFrame:
    """``(image_id, height, width, oy, ox, top, left, h, w, data)``: what each window takes from each block; no shuffle."""
    if not 0 < step <= 1:
        raise ValueError("step must be in (0, 1]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = table_schema(batch.schema.field("image_id").type, "height width oy ox top left h w")
            for image, height, width, top, left, h, w, data in zip(*[c.to_pylist() for c in batch.columns]):
                grid, rows = np.frombuffer(data, np.float32).reshape(h, w), []
                for oy in crossing(top, top + h, height, patch[0], step):
                    for ox in crossing(left, left + w, width, patch[1], step):
                        y0, x0 = max(int(oy), top), max(int(ox), left)
                        part = grid[y0 - top:int(oy) + patch[0] - top, x0 - left:int(ox) + patch[1] - left]
                        rows.append((image, height, width, int(oy), int(ox), y0, x0, *part.shape, part.tobytes()))
                yield from rows_of(schema, rows).to_batches()

    columns = ["image_id", "height", "width", "top", "left", "h", "w", "data"]
    return blocks.select(columns).mapInArrow(run, f"image_id {kind_of(blocks)}, {SLICE}, data binary")


def _score(table: pa.Table, make: Callable, names: list[str], patch: tuple[int, int], block: int, batch_size: int, model: list) -> pa.Table:
    """Scores of whole windows, cut at the borders of blocks; places outside of the image are dropped."""
    if not model:
        model.append(make())
    starts = np.append(np.flatnonzero(changes(table, ["image_id", "oy", "ox"])), table.num_rows)
    ids, data = table["image_id"], table["data"]
    height, width, oy, ox, top, left, h, w = (ints(table, c) for c in ("height", "width", "oy", "ox", "top", "left", "h", "w"))
    rows = []
    for at in range(0, len(starts) - 1, batch_size):
        some = list(zip(starts[at:at + batch_size], starts[at + 1:at + 1 + batch_size]))
        some = some[:len(starts) - 1 - at]
        batch = np.zeros((len(some), *patch), np.float32)
        for n, (lo, hi) in enumerate(some):
            for k in range(lo, hi):
                y, x = top[k] - oy[k], left[k] - ox[k]
                batch[n, y:y + h[k], x:x + w[k]] = np.frombuffer(data[int(k)].as_py(), np.float32).reshape(h[k], w[k])
        scored = model[0](batch)
        scores = np.stack([np.asarray(scored[c], np.float64).reshape(len(some), *patch) for c in names], axis=1)
        for n, (lo, _) in enumerate(some):
            low_y, low_x = int(oy[lo]), int(ox[lo])
            high_y, high_x = min(low_y + patch[0], int(height[lo])), min(low_x + patch[1], int(width[lo]))
            for by in range(low_y // block, (high_y - 1) // block + 1):
                for bx in range(low_x // block, (high_x - 1) // block + 1):
                    y0, x0 = max(low_y, by * block), max(low_x, bx * block)
                    y1, x1 = min(high_y, (by + 1) * block), min(high_x, (bx + 1) * block)
                    part = scores[n, :, y0 - low_y:y1 - low_y, x0 - low_x:x1 - low_x]
                    rows.append((ids[int(lo)].as_py(), int(height[lo]), int(width[lo]), by, bx, y0, x0, y1 - y0, x1 - x0, part.tobytes()))
    return rows_of(table_schema(ids.type, "height width by bx top left h w"), rows)


def _merge(table: pa.Table, classes: int, block: int) -> pa.Table:
    """Mean scores of whole blocks, and the best class of each place, the lowest on a tie."""
    starts = np.append(np.flatnonzero(changes(table, ["image_id", "by", "bx"])), table.num_rows)
    ids, data = table["image_id"], table["data"]
    height, width, by, bx, top, left, h, w = (ints(table, c) for c in ("height", "width", "by", "bx", "top", "left", "h", "w"))
    rows = []
    for lo, hi in zip(starts[:-1], starts[1:]):
        y0, x0 = int(by[lo]) * block, int(bx[lo]) * block
        shape = min(block, int(height[lo]) - y0), min(block, int(width[lo]) - x0)
        total, count = np.zeros((classes, *shape)), np.zeros(shape)
        for k in range(lo, hi):
            place = np.s_[top[k] - y0:top[k] - y0 + h[k], left[k] - x0:left[k] - x0 + w[k]]
            total[(slice(None), *place)] += np.frombuffer(data[int(k)].as_py(), np.float64).reshape(classes, h[k], w[k])
            count[place] += 1
        rows.append((ids[int(lo)].as_py(), int(height[lo]), int(width[lo]), y0, x0, *shape, (total / np.maximum(count, 1)).tobytes()))
    return rows_of(table_schema(ids.type, "height width top left h w"), rows)


def segment_blocks(
    blocks: DataFrame, make: Callable, classes: int, patch: tuple[int, int], step: float = 0.5, batch_size: int = 32, block: int = BLOCK
) -> DataFrame:
    """Mean scores ``(image_id, height, width, top, left, h, w, data)`` of blocks, ``data`` being 64-bit floats by class, row, column.

    ``make`` returns a function from an array (batch, height, width) to ``{"c0": scores, ...}``; a task calls it once.
    """
    names, kind = [f"c{k}" for k in range(classes)], kind_of(blocks)
    score = partial(_score, make=make, names=names, patch=patch, block=block, batch_size=batch_size, model=[])
    scored = stream_groups(
        window_slices(blocks, patch, step), ["image_id", "oy", "ox"], ["top", "left"], score,
        f"image_id {kind}, height int, width int, by int, bx int, top int, left int, h int, w int, data binary", WINDOW_ROWS,
    )
    return stream_groups(
        scored, ["image_id", "by", "bx"], ["top", "left"], partial(_merge, classes=classes, block=block), f"image_id {kind}, {PLACE}, data binary", SCORE_ROWS
    )


def class_pixels(scores: DataFrame, classes: int) -> DataFrame:
    """A row per pixel ``(image_id, y, x, c0.., cls_id)`` of the blocks of ``segment_blocks``, for those who want rows."""
    kind = kind_of(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (top, left, h, w, data) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("top", "left", "h", "w", "data")])):
                flat = np.frombuffer(data, np.float64).reshape(classes, h * w)
                y, x = np.divmod(np.arange(h * w), w)
                columns = [batch.column("image_id").take(pa.array(np.full(h * w, k))), pa.array((y + top).astype(np.int32)), pa.array((x + left).astype(np.int32))]
                columns += [pa.array(c) for c in flat] + [pa.array(flat.argmax(axis=0).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "y", "x", *[f"c{n}" for n in range(classes)], "cls_id"])

    names = ", ".join(f"c{n} double" for n in range(classes))
    return scores.select("image_id", "top", "left", "h", "w", "data").mapInArrow(run, f"image_id {kind}, y int, x int, {names}, cls_id int")
