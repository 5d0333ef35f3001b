"""Exact Euclidean distance to the nearest background pixel.

Separable in two passes: distance inside each image column by a window, then along each
run of an image row. No pair of pixels is ever joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.operators.grouped import changes, ints, stream_groups
from segstats.operators.runs import as_pixels

REACH = 2**30  # longer than any image side
FAR = REACH**2  # squared distance where the image holds no background at all


def _least_along_runs(x: np.ndarray, g2: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``min over j of g2[j] + (x[i] - x[j])**2`` inside each run.

    The best ``j`` never moves left as ``i`` moves right, so the middle pixel of a stretch splits the candidates of its two
    halves. All stretches of one size are done together: about log2(longest run) passes, whatever the distances.
    """
    out = np.empty(len(x), dtype=np.int64)
    low, high, best_low, best_high = first, last, first, last
    while len(low):
        middle = (low + high) // 2
        count = best_high - best_low + 1
        begin = np.cumsum(count) - count
        j = np.arange(count.sum()) - np.repeat(begin - best_low, count)
        value = g2[j] + (np.repeat(x[middle], count) - x[j]) ** 2
        least = np.minimum.reduceat(value, begin)
        out[middle] = least
        hit = np.flatnonzero(value == np.repeat(least, count))
        best = j[hit[np.searchsorted(hit, begin)]]
        left, right = low < middle, middle < high
        low, high, best_low, best_high = (
            np.concatenate(pair) for pair in (
                (low[left], middle[right] + 1), (middle[left] - 1, high[right]),
                (best_low[left], best[right]), (best[left], best_high[right]),
            )
        )
    return out


def _row_pass(table: pa.Table) -> pa.Table:
    x, width = ints(table, "x"), ints(table, "width")
    far = table["g"].is_null().to_numpy()
    g2 = np.where(far, FAR, table["g"].fill_null(0).to_numpy().astype(np.int64) ** 2)
    fresh = changes(table, ["image_id", "y"])
    fresh[1:] |= x[1:] != x[:-1] + 1
    run = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(x)) - 1
    # background right before and right after the run, unless that is outside the image
    before = np.where(x[first] > 0, x[first] - 1, -FAR)[run]
    after = np.where(x[last] < width[last] - 1, x[last] + 1, FAR)[run]
    nearest = np.minimum(np.minimum(x - before, after - x), REACH)
    d2 = np.minimum(_least_along_runs(x, g2, first, last), nearest**2)
    return pa.table(
        {"image_id": table["image_id"], "y": table["y"], "x": table["x"], "d2": pa.array(np.minimum(d2, FAR))}
    )


def distance_to_background(mask: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels of ``mask`` with their squared distance ``d2`` and distance ``dist``.

    Outside the image is not background; ``dist`` is null where an image has none.
    """
    pixels = as_pixels(mask).select("image_id", "y", "x")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    island = pixels.withColumn("island", F.col("y") - F.row_number().over(column))
    whole = Window.partitionBy("image_id", "x", "island")
    ranged = island.select(
        "image_id", "y", "x", F.min("y").over(whole).alias("top"), F.max("y").over(whole).alias("bottom")
    ).join(images.select("image_id", "height", "width"), "image_id")
    up = F.when(F.col("top") > 0, F.col("y") - F.col("top") + 1)
    down = F.when(F.col("bottom") < F.col("height") - 1, F.col("bottom") - F.col("y") + 1)
    vertical = ranged.select("image_id", "y", "x", "width", F.least(up, down).cast("int").alias("g"))
    kind = mask.schema["image_id"].dataType.simpleString()
    out = stream_groups(
        vertical, ["image_id", "y"], ["x"], _row_pass, f"image_id {kind}, y int, x int, d2 bigint"
    )
    known = F.when(F.col("d2") < FAR, F.col("d2"))
    return out.select("image_id", "y", "x", known.alias("d2"), F.sqrt(known).alias("dist"))
