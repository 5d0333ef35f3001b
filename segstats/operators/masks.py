"""Class splits, mask algebra, hole filling, erosion and contours."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.constants import INTENSITY
from segstats.operators.algebra import ROW, part, places, sweep
from segstats.operators.components import label_components
from segstats.operators.geometry import paint
from segstats.operators.grouped import ints, stream_groups
from segstats.operators.regions import expand, find, region_sums
from segstats.operators.runs import PIXEL, TILE, TILE_KEY, as_pixels, complement, compress, cut_to_tiles
from segstats.session import materialize


def class_of(v: Column, rule: str = "scoring") -> Column:
    """Class name of a semantic mask value, null for background.

    ``scoring``: axon above 200, myelin 50 to 200. ``editor``: myelin strictly between
    100 and 200, so 200 is neither.
    """
    if rule == "scoring":
        myelin = v.between(50, 200)
    elif rule == "editor":
        myelin = (v > 100) & (v < 200)
    else:
        raise ValueError("rule must be 'scoring' or 'editor'")
    return F.when(v > 200, "axon").when(myelin, "myelin")


def split_classes(pixels: DataFrame, rule: str = "scoring") -> DataFrame:
    return pixels.withColumn("cls", class_of(F.col("v"), rule)).filter("cls IS NOT NULL")


def extract_class(pixels: DataFrame, cls_id: int) -> DataFrame:
    """Binary mask of one class of a raw class map ``(image_id, y, x, cls_id)``."""
    return pixels.select(
        *PIXEL, F.when(F.col("cls_id") == cls_id, INTENSITY["binary"]).otherwise(INTENSITY["background"]).alias("v")
    )


def class_census(pixels: DataFrame, classes: dict[str, int]) -> DataFrame:
    """Pixels per class of a raw class map; ``absent`` marks classes an image lacks.

    ``classes`` is the label map of a model: a handful of names.
    """
    tallies = pixels.groupBy("image_id").agg(
        *[F.count_if(F.col("cls_id") == value).alias(name) for name, value in classes.items()]
    )
    long = tallies.unpivot(["image_id"], list(classes), "cls", "n")
    return long.withColumn("absent", F.col("n") == 0)


def mask_name(path: Column, class_name: str) -> Column:
    """Output file name of one class of a raw prediction; other names are an error."""
    return F.when(
        path.endswith("_seg-nnunet.png"), F.replace(path, F.lit("_seg-nnunet.png"), F.lit(f"_seg-{class_name}.png"))
    ).otherwise(F.raise_error(F.concat(F.lit("not a raw prediction file: "), path)).cast("string"))


def merge_masks(axon: DataFrame, myelin: DataFrame) -> DataFrame:
    """Semantic mask ``v``: myelin 127 (also where both are set), axon 255."""
    met = sweep({"axon": axon.select(*ROW, *places(axon)), "myelin": myelin.select(*ROW, *places(myelin))})
    v = F.when(F.col("myelin"), INTENSITY["myelin"]).otherwise(INTENSITY["axon"])
    runs = met.select(*ROW, "x0", "x1", v.alias("v"))
    return runs if "x0" in axon.columns else as_pixels(runs).select(*PIXEL, "v")


def remove_overlap(first: DataFrame, second: DataFrame, priority: int = 1):
    """``(first, second, overlap)`` with the overlap kept only in the mask with priority."""
    if priority not in (1, 2):
        raise ValueError("priority must be 1 or 2")
    met = sweep({"a": first, "b": second})
    overlap = part(met, "a AND b", first, "a")
    if priority == 1:
        return first, part(met, "b AND NOT a", second, "b"), overlap
    return part(met, "a AND NOT b", first, "a"), second, overlap


def clip(mask: DataFrame, region: DataFrame) -> DataFrame:
    """The part of a mask inside a region of interest."""
    return part(sweep({"a": mask, "b": region.select(*ROW, *places(region))}), "a AND b", mask, "a")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return part(sweep({"a": a.select(*ROW, *places(a)), "b": b.select(*ROW, *places(b))}), "a <> b", a)


def small_holes(mask: DataFrame, images: DataFrame, max_area_fraction: float = 0.1, extent=None) -> DataFrame:
    """Pixels that filling would add: background pieces (side neighbours) below the limit."""
    holes = materialize(label_components(complement(mask, images), 1, extent=extent), "holes")
    limit = F.lit(max_area_fraction) * F.col("height") * F.col("width")
    small = (
        region_sums(holes).join(images, "image_id").filter(F.col("area") < limit).select("image_id", "label")
    )
    return as_pixels(paint(holes, small)).select(*PIXEL)


def enclosed_holes(mask: DataFrame, images: DataFrame, extent=None) -> DataFrame:
    """Background pixels (side neighbours) of pieces that do not touch the image border."""
    holes = materialize(label_components(complement(mask, images), 1, extent=extent), "holes")
    inside = (
        region_sums(holes).join(images, "image_id")
        .filter("bbox_min_y > 0 AND bbox_min_x > 0 AND bbox_max_y < height AND bbox_max_x < width")
        .select("image_id", "label")
    )
    return as_pixels(paint(holes, inside)).select(*PIXEL)


def _erode(table: pa.Table, tile: int, radius: int) -> pa.Table:
    """Flag each pixel of a tile whose disk is filled; outside the image counts as filled."""
    run, y, x, code, side = expand(table, tile, pad=radius + 1)
    x0, x1 = ints(table, "x0"), ints(table, "x1")
    height, width = ints(table, "height")[run], ints(table, "width")[run]
    kept = np.ones(len(y), bool)
    for dy in range(-radius, radius + 1):
        half = int(np.floor(np.sqrt(radius**2 - dy**2)))
        at = find(code, code + dy * side)
        row = run[at]
        filled = (x0[row] <= np.maximum(x - half, 0)) & (x1[row] >= np.minimum(x + half, width - 1))
        kept &= ((at >= 0) & filled) | (y + dy < 0) | (y + dy >= height)
    home = np.flatnonzero((y // tile == ints(table, "ty")[run]) & (x // tile == ints(table, "tx")[run]))
    return pa.table(
        {
            "image_id": table["image_id"].take(pa.array(run[home])),
            "y": pa.array(y[home].astype(np.int32)),
            "x": pa.array(x[home].astype(np.int32)),
            "kept": pa.array(kept[home]),
        }
    )


def eroded(mask: DataFrame, images: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Mask pixels with ``kept``: still set after erosion by a disk.

    Runs are made maximal first (those of labels end at tile borders). Tiles overlap by
    the radius, so one look-up per disk row decides a pixel.
    """
    runs = compress(mask)
    sized = runs.select("image_id", "y", "x0", "x1").join(images, "image_id")
    kind = mask.schema["image_id"].dataType.simpleString()
    return stream_groups(
        cut_to_tiles(sized, tile, halo=radius), TILE_KEY, ["y", "x0"],
        partial(_erode, tile=tile, radius=radius), f"image_id {kind}, y int, x int, kept boolean",
    )


def contour(mask: DataFrame, images: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Inner contour: the mask minus its erosion."""
    return eroded(mask, images, radius, tile).filter("NOT kept").select(*PIXEL)
