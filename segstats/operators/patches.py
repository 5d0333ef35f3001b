"""Sliding windows, model scores and their averages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.operators.blocks import BLOCK, class_pixels, segment_blocks, to_blocks
from segstats.operators.runs import PIXEL


def _axis(length: str, patch: int, step: float) -> tuple[Column, Column]:
    """Number of windows along an axis and the real distance between them."""
    room = F.greatest(F.col(length) - patch, F.lit(0))
    count = F.ceil(room / F.lit(patch * step)).cast("int") + 1
    return count, F.when(count > 1, room / (count - 1)).otherwise(F.lit(0.0))


def _spots(first: Column, last: Column, gap: Column) -> Column:
    return F.transform(F.sequence(first, last), lambda k: F.rint(k * gap).cast("int"))


def _origins(at: str, length: str, patch: int, step: float) -> Column:
    """Window origins along one axis that cover a pixel."""
    count, gap = _axis(length, patch, step)
    near = F.greatest(gap, F.lit(1.0))
    first = F.greatest(F.lit(0), F.floor((F.col(at) - patch) / near).cast("int"))
    last = F.least(count - 1, F.ceil(F.col(at) / near).cast("int") + 1)
    spots = _spots(F.least(first, last), last, gap)
    return F.filter(spots, lambda o: (o <= F.col(at)) & (F.col(at) < o + patch))


def windows(images: DataFrame, patch: tuple[int, int], step: float = 0.5) -> DataFrame:
    """Window origins ``(image_id, oy, ox)``; neighbours overlap by ``1 - step``."""
    if not 0 < step <= 1:
        raise ValueError("step must be in (0, 1]")
    out = images.select("image_id", "height", "width")
    for name, length, size in (("oy", "height", patch[0]), ("ox", "width", patch[1])):
        count, gap = _axis(length, size, step)
        out = out.withColumn(name, F.explode(_spots(F.lit(0), count - 1, gap)))
    return out.select("image_id", "oy", "ox")


def cut(pixels: DataFrame, images: DataFrame, patch: tuple[int, int], step: float = 0.5) -> DataFrame:
    """Every pixel once per window that covers it, with its place ``(py, px)`` inside.

    Pure arithmetic on the pixel, no join with the windows. Images smaller than a patch
    are padded with zeros.
    """
    if not 0 < step <= 1:
        raise ValueError("step must be in (0, 1]")
    sized = pixels.select(*PIXEL, "v").join(images.select("image_id", "height", "width"), "image_id")
    small = images.filter((F.col("height") < patch[0]) | (F.col("width") < patch[1]))
    pad = (
        small.withColumn("y", F.explode(F.sequence(F.lit(0), F.greatest("height", F.lit(patch[0])) - 1)))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.greatest("width", F.lit(patch[1])) - 1)))
        .filter("y >= height OR x >= width")
        .select("image_id", "y", "x", F.lit(0).cast(pixels.schema["v"].dataType).alias("v"), "height", "width")
    )
    both = sized.select("image_id", "y", "x", "v", "height", "width").unionByName(pad)
    return (
        both.withColumn("oy", F.explode(_origins("y", "height", patch[0], step)))
        .withColumn("ox", F.explode(_origins("x", "width", patch[1], step)))
        .select("image_id", "oy", "ox", "y", "x", (F.col("y") - F.col("oy")).alias("py"),
                (F.col("x") - F.col("ox")).alias("px"), "v")
    )


# every way to mirror the two image axes
FLIPS = [(), (1,), (2,), (1, 2)]


def averaged(folds: list[Callable], names: list[str], patch: tuple[int, int], mirror: bool) -> Callable:
    """A ``make_predict_fn`` that means the scores of all folds over all mirrored inputs."""
    flips = FLIPS if mirror else FLIPS[:1]

    def make():
        models = [fold() for fold in folds]

        def predict(batch):
            shape = (len(batch), *patch)
            total = {name: np.zeros(shape) for name in names}
            for axes in flips:
                turned = np.flip(batch.reshape(shape), axes)
                for model in models:
                    scores = model(turned)
                    for name in names:
                        total[name] += np.flip(np.asarray(scores[name], np.float64).reshape(shape), axes)
            runs = len(flips) * len(models)
            return {name: (t / runs).reshape(len(batch), -1) for name, t in total.items()}

        return predict

    return make


def segment(
    pixels: DataFrame,
    images: DataFrame,
    folds: list[Callable],
    classes: int,
    patch: tuple[int, int],
    step: float = 0.5,
    mirror: bool = True,
    batch_size: int = 32,
    block: int = BLOCK,
) -> DataFrame:
    """Raw class map ``(image_id, y, x, c0.., cls_id)`` of every image, given as pixels or as blocks.

    Scores are averaged over model folds, mirrored inputs and the windows that cover a pixel; the lowest class wins a tie. A fold is a
    ``make_predict_fn``: called once per task, it returns a function from an array (batch, height, width) to ``{"c0": scores, ...}`` of
    the same size. Windows are put together from blocks and scores added in blocks, so no pixel is a row before the result.
    """
    blocks = pixels if "data" in pixels.columns else to_blocks(pixels, images, block)
    make = averaged(folds, [f"c{k}" for k in range(classes)], patch, mirror)
    return class_pixels(segment_blocks(blocks, make, classes, patch, step, batch_size, block), classes)
