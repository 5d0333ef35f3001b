"""Pixels, runs and tiles.

A *mask* is a sparse table: ``(image_id, y, x)`` pixels or ``(image_id, y, x0, x1)``
runs with both ends included. Runs shrink a mask several times over, so they are what
gets shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 256
PIXEL = ["image_id", "y", "x"]
TILE_KEY = ["image_id", "ty", "tx"]


def div(col: Column | str, n: int) -> Column:
    """Floor division of an integer column, as INT."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(n)).cast("int")


def as_runs(mask: DataFrame) -> DataFrame:
    """Runs of a mask; a pixel counts as a run of length one."""
    if "x0" in mask.columns:
        return mask
    return mask.withColumn("x0", F.col("x")).withColumnRenamed("x", "x1")


def as_pixels(mask: DataFrame) -> DataFrame:
    """Pixels of a mask."""
    if "x0" not in mask.columns:
        return mask
    rest = [c for c in mask.columns if c not in ("x0", "x1", "image_id", "y")]
    return mask.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *rest)


def compress(mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Maximal runs of a mask (per value of ``by`` columns): gaps and islands over runs that may touch, overlap or repeat."""
    by = by or []
    row = Window.partitionBy("image_id", "y", *by).orderBy("x0")
    before = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    return (
        as_runs(mask).select("image_id", "y", "x0", "x1", *by)
        .withColumn("fresh", F.coalesce((F.col("x0") > before + 1).cast("int"), F.lit(1)))
        .withColumn("island", F.sum("fresh").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("image_id", "y", *by, "island")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("island")
    )


def cut_to_tiles(runs: DataFrame, tile: int = TILE, halo: int = 0) -> DataFrame:
    """Runs cut at tile borders with their tile ``(ty, tx)``.

    With a ``halo`` every tile also receives the pixels up to ``halo`` outside of it.
    """
    def tiles(low: str, high: str) -> str:
        return f"explode(sequence(cast(floor(({low} - {halo}) / {tile}) as int), cast(floor(({high} + {halo}) / {tile}) as int)))"

    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    ty = tiles("y", "y") if halo else f"cast(floor(y / {tile}) as int)"
    out = runs.selectExpr("*", f"{ty} AS ty").selectExpr("*", f"{tiles('x0', 'x1')} AS tx")
    return out.selectExpr(
        *rest, "ty", "tx", f"greatest(x0, tx * {tile} - {halo}) AS x0", f"least(x1, tx * {tile} + {tile - 1 + halo}) AS x1"
    ).filter("x0 <= x1 AND ty >= 0 AND tx >= 0")


def complement(mask: DataFrame, images: DataFrame) -> DataFrame:
    """Background runs of every image in ``images (image_id, height, width)``."""
    runs = as_runs(mask)
    rows = images.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    # a zero-length run before column 0 makes the first gap and the empty rows ordinary gaps
    start = rows.select("image_id", "y", F.lit(-1).alias("x0"), F.lit(-1).alias("x1"))
    row = Window.partitionBy("image_id", "y").orderBy("x0")
    # runs may overlap: a gap begins after the furthest end so far
    end = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gaps = runs.select("image_id", "y", "x0", "x1").unionByName(start).select("image_id", "y", end.alias("x1"), F.lead("x0").over(row).alias("next"))
    return (
        gaps.join(images.select("image_id", "width"), "image_id")
        .select(
            "image_id",
            "y",
            (F.col("x1") + 1).alias("x0"),
            (F.coalesce("next", "width") - 1).alias("x1"),
        )
        .filter("x0 <= x1")
    )


def lookup(points: DataFrame, runs: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """Left join points ``(image_id, y, x)`` with the run that covers them.

    The tile column is part of the key, so one long image row is never one join key.
    """
    cut = cut_to_tiles(runs.select("image_id", "y", "x0", "x1", *columns), tile)
    right = cut.select(
        F.col("image_id").alias("_image"), F.col("y").alias("_y"), F.col("tx").alias("_tx"),
        F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), *columns,
    )
    on = (
        (F.col("image_id") == F.col("_image"))
        & (F.col("y") == F.col("_y"))
        & (div("x", tile) == F.col("_tx"))
        & F.col("x").between(F.col("_x0"), F.col("_x1"))
    )
    return points.join(right, on, "left").drop("_image", "_y", "_tx", "_x0", "_x1")
